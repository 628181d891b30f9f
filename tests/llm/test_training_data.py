import base64
import hashlib
import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmoss.llm import encoding, grouping, linkage, packing, truncation


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("chunk", [3, 400_000])
def test_groups_of_chains_hubs_and_noise(spark, monkeypatch, chunk):
    monkeypatch.setattr(grouping, "CHUNK", chunk)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, 600 + i) for i in range(40)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    edges += [(None, 3), (9, 9), (5, 4), (4, 5)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    if chunk == 3:  # the map-side combine works on the Arrow batches that it gets
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["vertex"]: r["group_id"] for r in grouping.linked_groups(df, small=10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == components(edges)


def test_groups_of_nothing(spark):
    assert grouping.linked_groups(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_node_links(spark):
    s = "link_id bigint, pos int, t int, node_id int, timepoint double, next_id int, alternatives array<int>, group_id string"
    rows = [
        (1, 1, 0, 0, 10.0, 1, [1], "x"), (2, 1, 0, 1, 10.0, -1, [], "x"), (3, 1, 0, 2, 10.0, None, None, "x"),
        (4, 1, 2, 1, 30.0, 0, [0], "x"), (5, 1, 1, 1, 40.0, 7, [0, 1], "x"),  # frame 1 comes after frame 2
        (6, 1, 0, 0, 10.0, None, [1, 5], "x"), (7, 2, 0, 1, 10.0, 1, None, "x"), (8, 1, 2, 0, 30.0, 1, [], "x"), (9, None, 0, 0, None, 0, [0], "x"),
    ]
    got = {r["link_id"]: r["group_id"] for r in grouping.link_groups(spark.createDataFrame(rows, s)).collect()}
    assert got == {1: 1, 6: 1, 4: 1, 2: 2, 3: 3, 8: 5, 5: 5, 7: 7, 9: 9}


#: groups by SQL: labels wander along the links until none falls; as many steps as frames are linked in a row, so for a small table
GROUPS_SQL = """WITH RECURSIVE n AS (SELECT pos, t, node_id, min(link_id) AS v, min(CASE WHEN NOT isnan(timepoint) THEN timepoint END) AS tp FROM node_links GROUP BY pos, t, node_id),
m AS (SELECT pos, tp, lead(tp) OVER (PARTITION BY pos ORDER BY tp) AS nx FROM (SELECT DISTINCT pos, tp FROM n WHERE pos IS NOT NULL AND tp IS NOT NULL)),
c AS (SELECT DISTINCT pos, t, node_id, unnest(list_append(coalesce(alternatives, []), next_id)) AS k FROM node_links),
e AS MATERIALIZED (SELECT DISTINCT a.v AS a, b.v AS b FROM c JOIN n a ON a.pos = c.pos AND a.t = c.t AND a.node_id = c.node_id JOIN m ON m.pos = a.pos AND m.tp = a.tp JOIN n b ON b.pos = m.pos AND b.tp = m.nx AND b.node_id = c.k WHERE c.k >= 0),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, root) USING KEY (v) AS (SELECT v, v FROM n UNION (SELECT g.b, min(r.root) FROM r JOIN g ON g.a = r.v JOIN recurring.r AS o ON o.v = g.b WHERE r.root < o.root GROUP BY g.b))
SELECT l.link_id, r.root AS group_id FROM node_links l JOIN n ON n.pos IS NOT DISTINCT FROM l.pos AND n.t IS NOT DISTINCT FROM l.t AND n.node_id IS NOT DISTINCT FROM l.node_id JOIN r ON r.v = n.v"""


def test_groups_against_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view node_links as select * from '{data}/node_links.parquet'")
    want = sorted(con.execute(GROUPS_SQL).fetchall())
    got = sorted(tuple(r) for r in grouping.link_groups(spark.read.parquet(f"{data}/node_links.parquet")).select("link_id", "group_id").collect())
    assert got == want and len({g for _, g in got}) < len(got)


def test_decomposition_of_edges_that_lie_together():
    rng = np.random.default_rng(7)
    for n, m in ((2, 1), (50, 30), (400, 390), (3000, 2990)):
        edges = np.concatenate([rng.integers(0, n, (m, 2)), np.stack([np.arange(n, 2 * n), np.arange(n + 1, 2 * n + 1)], 1)]) * 977
        edges = edges[edges[:, 0] != edges[:, 1]]
        ids, least = grouping._decomposed(edges[:, 0], edges[:, 1])
        assert dict(zip(ids.tolist(), least.tolist())) == components([tuple(e) for e in edges.tolist()])


R = "row_id bigint, batch_no int, meta_pos int, meta_t int, filename string, covered_area double, graph_edge_length double, graph_node_count bigint, image_sha256_hash string, tunables_hash string, k1 string"


def sha(x):
    return hashlib.sha256(x.encode()).digest()


def b64(x):
    return base64.b64encode(sha(x)).decode()


def brute(rows):
    out = {}
    seen = []
    for r in sorted(rows):
        rid, _, mp, mt, rec, a, l, n, h, tun = r
        for q in seen:
            if q[2:5] == (mp, mt, rec) and q[9] == tun and None not in (mp, mt, rec, tun):
                near = all(x is not None and y is not None and x == x and y == y and abs(x - y) <= 0.01 * max(abs(x), abs(y)) for x, y in ((a, q[5]), (l, q[6]), (n, q[7])))
                if (h is not None and h == q[8]) or near:
                    out[rid] = q[0]
                    break
        seen.append(r)
    return out


def test_linkage_against_all_pairs(spark):
    rng = random.Random(6)
    names = ["Kara_pl01_nd00001_100.ome.tiff", "Moro_pl02_nd00002_200.ome.tiff"]
    ways = [lambda s: s, lambda s: "/data/x/" + s, lambda s: "D:\\a\\" + s, lambda s: "Copy of " + s, lambda s: s.replace("_", " "), lambda s: s.replace("_", "%20"), lambda s: s.upper(), lambda s: s.replace(".ome.tiff", " (2).ome.tiff"), lambda s: s + "?calibration=0.09;interval=600", lambda s: "  " + s.lower().replace(".ome", "_copy.ome"), lambda s: s.replace("_", "-").replace(".ome.tiff", ".tiff")]
    hashes = [lambda x: b64(x), lambda x: sha(x).hex(), lambda x: sha(x).hex().upper(), lambda x: "sha256:" + sha(x).hex(), lambda x: " " + b64(x) + " ", lambda x: b64(x).rstrip("="), lambda x: b64(x).replace("+", "-").replace("/", "_")]
    plain, dirty = [], []
    for i in range(1, 500):
        rec, mp, mt = rng.randrange(2), rng.randrange(2), rng.randrange(3)
        h = rng.choice([None, f"img{rng.randrange(60)}", "blank"])
        a = rng.choice([100.0 * (1 + rng.uniform(-0.02, 0.02)), 0.0, None, float("nan"), -50.0 * (1 + rng.uniform(-0.01, 0.01))])
        l, n, tun = 40.0 * (1 + rng.uniform(-0.012, 0.012)), rng.choice([200, 201, 203, 0]), rng.choice(["t1", "t2"])
        plain.append((i, 0, mp, mt, rec, a, l, n, h, tun))
        dirty.append((i, i // 200, mp, mt, rng.choice(ways)(names[rec]), a, l, n, None if h is None else rng.choice(hashes)(h), rng.choice(["", "VERSION:1:SHA256:"]) + rng.choice(hashes)(tun).strip().replace("sha256:", ""), "clash"))
    df = spark.createDataFrame(dirty + dirty[:3], R)
    index = linkage.LinkIndex(spark)
    got, links = {}, set()
    for part in linkage.deliveries(df):
        got |= {r["row_id"]: r["first_row_id"] for r in index.link(part).collect()}
        index.accept()
        index = linkage.LinkIndex(spark, root=index.root, deliveries=index.deliveries)  # as a later session would
    assert index.deliveries == 3 and got == brute(plain)
    whole = components(all_pairs(plain))
    assert {r["row_id"]: r["representative"] for r in index.mapping().collect()} == whole


def all_pairs(rows):
    """Every pair of rows that are one frame."""
    for i, r in enumerate(rows):
        for q in rows[:i]:
            if brute([(1, *q[1:]), (2, *r[1:])]):
                yield q[0], r[0]


def _same_frame(rows):
    """Rows (row_id, batch, covered area, hash) of one recording, position and frame."""
    return [(i, b, 0, 0, "a.tif", a, 50.0, 10, h, "t", "c") for i, b, a, h in rows]


def test_a_later_row_bridges_clusters(spark):
    """100 and 101.8 are apart; 100.9 agrees with both, and so do two clusters joined by a hash."""
    rows = _same_frame([(1, 0, 100.0, None), (2, 0, 101.8, None), (3, 1, 100.9, None), (4, 1, 300.0, "x"), (5, 2, 600.0, "y"), (6, 2, 600.0, "x"), (7, 3, 9.0, None)])
    index = linkage.LinkIndex(spark)
    written = []
    for part in linkage.deliveries(spark.createDataFrame(rows, R)):
        index.link(part)
        written.append({(r["row_id"], r["representative"]) for r in index.accept().collect()})
    assert {r["row_id"]: r["representative"] for r in index.mapping().collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert written == [set(), {(1, 1), (2, 1), (3, 1)}, {(4, 4), (5, 4), (6, 4)}, set()]


def _read_of(df):
    """Bytes of the files that a plan reads."""
    import os

    return sum(os.path.getsize(r["f"].removeprefix("file://")) for r in df.select(F.input_file_name().alias("f")).distinct().collect())


def test_history_is_read_by_recording(spark, monkeypatch):
    """Each delivery brings one recording: what it reads of the history doesn't grow with the number of deliveries before."""
    read = []
    own = linkage.LinkIndex._history

    def watched(self, *args):
        df = own(self, *args)
        read.append(_read_of(df))
        return df

    monkeypatch.setattr(linkage.LinkIndex, "_history", watched)
    index = linkage.LinkIndex(spark)
    for n in range(9):
        rows = [(n * 100 + i, n, 0, i % 50, f"rec{n % 4}.tif", 100.0, 50.0, 10, f"h{n % 4}-{i % 50}", "t", "c") for i in range(1, 61)]
        found = index.link(spark.createDataFrame(rows, R)).count()
        assert found == (10 if n < 4 else 60)
    whole = sum(_read_of(spark.read.parquet(index.scratch.path(f"keys/delivery={n}"))) for n in range(8))
    assert max(read) <= whole / 3 and read[6] <= read[3] * 1.5


def test_drifting_block_is_exact(spark, monkeypatch):
    """A block whose readings creep on over many tolerances, in all of the grid's distances; points compared are few."""
    monkeypatch.setattr(linkage, "SLICE", 16)
    rng = random.Random(3)
    rows = [(i, i // 300, 0, 0, "a.tif", 100.0 * 1.0003**i * (1 + rng.uniform(-0.004, 0.004)), 50.0 * 1.0002**i * (1 + rng.uniform(-0.003, 0.003)), 1000 + i // 3 + rng.randrange(4), None, "t", "c") for i in range(1, 451)]
    plain = [(r[0], 0, 0, 0, 0, *r[5:8], None, "t") for r in rows]
    index, got = linkage.LinkIndex(spark), {}
    for part in linkage.deliveries(spark.createDataFrame(rows, R)):
        got |= {r["row_id"]: r["first_row_id"] for r in index.link(part).collect()}
        index.accept()
    assert got == brute(plain)
    assert {r["row_id"]: r["representative"] for r in index.mapping().collect()} == components(all_pairs(plain))


def test_weights_decide(spark):
    """Without the exact rule a pair with other hashes and two of three readings alike is judged by what was learned."""
    learned = linkage.learned_weights([("equal", (1, 1, 1), 500), ("absent", (1, 1, 1), 200), ("other", (0, 0, 0), 400), ("other", (0, 1, 0), 60), ("absent", (1, 1, 0), 40), ("equal", (0, 0, 0), 3)])
    assert learned["absent", (1, 1, 0)] > 0.5 > learned["other", (0, 1, 0)] and learned["equal", (1, 1, 1)] > 0.99
    assert linkage.threshold_of(learned, False) == 0.5 and linkage.threshold_of(learned, True) == min(0.5, learned["equal", (0, 0, 0)])
    rows, n = [], 0
    for f in range(120):
        base = 100.0 + 7 * f
        same = f % 3 != 0
        for k in range(2):
            n += 1
            v = base if k == 0 or same else base * 1.7
            rows.append((n, k, 0, f, "a.tif", v, v / 2, int(v) if f % 30 != 1 or k == 0 else int(v * 2), None if same and k else f"h{f}-{k}", "t", "c"))
    index = linkage.LinkIndex(spark)
    found = {}
    for part in linkage.deliveries(spark.createDataFrame(rows, R)):
        found[len(found)] = {r["row_id"] for r in index.link(part, exact=False).collect()}
    alike = {r[0] for r in rows if r[1] == 1 and r[3] % 3 != 0}
    partly = {r[0] for r in rows if r[1] == 1 and r[3] % 30 == 1}
    assert found[0] == set() and found[1] == alike and partly <= alike
    strict = linkage.LinkIndex(spark)
    got = [strict.link(part) for part in linkage.deliveries(spark.createDataFrame(rows, R))]
    assert {r["row_id"] for r in got[1].collect()} == alike - partly


def test_linkage_nulls_and_empty(spark):
    one = [(1, 0, 0, 0, None, 1.0, 1.0, 1, "x", "t", "c"), (2, 0, 0, 0, None, 1.0, 1.0, 1, "x", "t", "c"), (3, 0, 0, 0, "a.tif", None, None, None, None, "t", "c"), (4, 0, 0, 0, "a.tif", None, None, None, None, "t", "c"), (5, 0, None, 0, "a.tif", 1.0, 1.0, 1, "x", None, "c")]
    assert linkage.LinkIndex(spark).link(spark.createDataFrame(one, R)).count() == 0
    assert linkage.LinkIndex(spark).link(spark.createDataFrame([], R)).count() == 0
    assert linkage.learned_weights([]) == {}


def test_hot_block_is_not_compared_pair_by_pair(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, 0, "a.tif", 100.0 * (1 + rng.uniform(-0.004, 0.004)), 50.0 * (1 + rng.uniform(-0.004, 0.004)), 10, None, "t", "c") for i in range(1, 3001)]
    got = linkage.LinkIndex(spark).link(spark.createDataFrame(rows, R))
    assert {r["first_row_id"] for r in got.collect()} == {1} and got.count() == 2999


def test_a_block_of_repeated_points_needs_no_grid(spark, monkeypatch):
    """Sixty rows that show two contents over and over are two points, compared one by one."""
    monkeypatch.setattr(linkage, "_grid_pairs", lambda points: pytest.fail("grid"))
    rows = _same_frame([(i, i // 40, 100.0 if i % 2 else 300.0, "x" if i % 2 else None) for i in range(1, 61)])
    index, got = linkage.LinkIndex(spark), {}
    for part in linkage.deliveries(spark.createDataFrame(rows, R)):
        got |= {r["row_id"]: r["first_row_id"] for r in index.link(part).collect()}
        index.accept()
    assert got == {i: 2 - i % 2 for i in range(3, 61)}
    assert {r["row_id"]: r["representative"] for r in index.mapping().collect()} == {i: 2 - i % 2 for i in range(1, 61)}


def test_texts_of_a_key_are_read_once(spark, data):
    """A row's names and hashes go through their replacements once, not again for the filter and each hash."""
    plan = linkage.blocking_rows(spark.read.parquet(f"{data}/result_table.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("copy of") == 2  # whether anything is left of the name, and what


def test_plain_names_and_hashes(spark):
    """What is written plainly is read as the chain of replacements reads it."""
    names = ["Kara_pl01.ome.tiff", "kara_pl01.TIF", "a_copy.tif", "a_copy.ome.tiff", "a__b.tif", "_a.tif", "a_.tif", "a.tif\n", " a_b.tiff ", "a", "copy.tif", ".tif", "a.ome", "a_copy_copy.tif"]
    want = ["kara_pl01", "kara_pl01", "a", "a", "a_b", "_a", "a_", "a", "a_b", "a", "copy", None, "a_ome", "a"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in names], "x string").coalesce(1).select(linkage.recording_name(F.col("x"))).collect()] == want
    h = sha("t")
    ways = [b64("t"), "VERSION:1:SHA256:" + b64("t"), "version:12:sha-256:" + h.hex(), h.hex().upper(), f" {h.hex()} ", "Sha256:" + b64("t").rstrip("="), b64("t").replace("+", "-").replace("/", "_")]
    assert {r[0] for r in spark.createDataFrame([(x,) for x in ways], "x string").select(linkage.hash_hex(F.col("x"))).collect()} == {h.hex()}
    assert [r[0] for r in spark.createDataFrame([("VERSION:1:" + b64("t"),), ("x" * 43 + "==",), ("",)], "x string").coalesce(1).select(linkage.hash_hex(F.col("x"))).collect()][::2] == ["VERSION:1:" + b64("t"), None]


@pytest.fixture(scope="module")
def official():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encoding.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_matches_the_public_one(official):
    e, rng = encoding.Encoder(), random.Random(9)
    texts = ["", " ", "a", "\n\n  x", "naïve 日本語 👩‍🍳", "<|endoftext|>", "ab" * 5000, "".join(rng.choice("abcehilnorst") for _ in range(20000)), " " * 3000, "0" * 999]
    pool = list(e.ids)
    texts += [b"".join(rng.choice(pool) for _ in range(rng.randint(1, 8))).decode("utf-8", "ignore") for _ in range(1500)]
    for t in texts:
        ids = e.encode(t)
        assert ids == official.encode_ordinary(t)
        assert e.decode(ids) == t.encode()
    assert e.encode(None) == []


def test_encoding_column(spark, official):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "日本" * 500), (4, "日本" * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["ids"]) for r in encoding.encoded(df).collect()]
    assert sorted(got) == sorted((i, official.encode_ordinary(t) if t else []) for i, t in rows)
    back = df.select("text", encoding.decode_ids(encoding.encode_text(F.col("text"))).alias("b")).collect()
    assert all(bytes(r["b"]) == (r["text"] or "").encode() for r in back)
    assert encoding.encoded(df.where("false")).count() == 0


def check_packing(spark, sizes, kinds, **kw):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint")
    k = spark.createDataFrame(kinds, "kind string, capacity_tokens int")
    got = packing.packed(df, k, **kw).collect()
    for kind, cap in kinds:
        if kind is None or not cap or cap <= 0:
            continue
        mine = [r for r in got if r["kind"] == kind]
        fill, per = {}, {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
            per.setdefault(r["doc_id"], []).append(r)
        assert max(fill.values(), default=0) <= cap and set(per) == set(range(len(sizes)))
        for i, s in enumerate(sizes):
            s = s or 0
            assert sum(r["n_tokens"] for r in per[i]) == s and len(per[i]) == max(1, -(-s // cap))
        yield kind, len(fill), packing.lower_bound(np.array([r["n_tokens"] for r in mine]), cap)


def test_packing_meets_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_PARTITION", 300)
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(4, 1)) for _ in range(1500)] + [0, None, 5000, 512, 513, 1024]
    for _, n, bound in check_packing(spark, sizes, [("small", 512), ("large", 4096), (None, 5), ("bad", 0)]):
        assert n - bound <= 1
    # exchanges close what rounding up in every partition leaves open
    rounds = []
    own = packing.Scratch.save
    monkeypatch.setattr(packing.Scratch, "save", lambda self, df, name, **kw: (rounds.append(name), own(self, df, name, **kw))[1])
    big = [rng.randint(180, 260) for _ in range(900)] + [rng.randint(1, 40) for _ in range(600)]
    for _, n, bound in check_packing(spark, big, [("small", 512)]):
        assert n - bound <= 1 and "round-1" in rounds


def test_packing_small_cases(spark):
    assert dict((k, n) for k, n, _ in check_packing(spark, [7, 6, 5, 4, 3], [("a", 10)]))["a"] == 3
    assert dict((k, n) for k, n, _ in check_packing(spark, [0, None], [("a", 10)]))["a"] == 1
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, size bigint"), spark.createDataFrame([("a", 10)], "kind string, capacity_tokens int")).count() == 0
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([], int), 10) == 0
    assert packing.lower_bound(np.array([4] * 6), 10) == 3 and packing.lower_bound(np.array([5] * 6), 10) == 3


def test_best_fit_against_trials():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 60, 80)
        at, n = packing.best_fit_decreasing(sizes, 100)
        fill = np.bincount(at, weights=sizes, minlength=n)
        assert fill.max() <= 100 and n >= packing.lower_bound(sizes, 100)


def _reviews(spark):
    rng = random.Random(8)
    parts = ["the kettle is easy to clean and my mother wants one too", "it survived a fall in the kitchen without a scratch", "setting it up took twenty minutes and nobody needed the leaflet", "we compared it with the old lamp that we had before", "delivery took nine days but the box was already open", "mine is the green one with the handle on the left", "the colour is a bit darker than in the picture"]
    docs = []
    for i in range(400):
        docs.append((i, ". ".join(rng.choice(parts).capitalize() for _ in range(rng.randint(2, 6))) + rng.choice([".", "!", ".", ""]), "web", "Fine"))
    cut = {1000: "The kettle is easy to clean and my mother wants one too. The colour is a bit darker than in the pic", 1001: "Delivery took nine days but the box was already open. Mine is the", 1002: "It survived a fall in the kitchen without a scratch. Setting it up took [more]", 1003: "We compared it with the old lamp that we had before. Delivery took nine days but the…"}
    whole = {2000: None, 2001: "", 2002: "   ", 2003: "Fine", 2004: "The colour is a bit darker than in the picture", 2005: "Mine is the green one with the handle on the left.\nSent from home", 2006: "Mine is the green one with the handle on the left...", 2007: "The box (and the kettle)", 2008: "Delivery took nine days 🎉"}
    docs += [(3000 + i, "Mine is the green one with the handle on the left.\nSent from home", "mail", "Fine") for i in range(5)]
    docs += [(k, v, "kiosk", None) for k, v in {**cut, **whole}.items()]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, title string"), set(cut)


def test_truncation(spark):
    docs, cut = _reviews(spark)
    found = truncation.truncated(docs)
    assert {r["doc_id"] for r in found.collect()} == cut
    share = {r["source"]: r for r in truncation.truncation_by_source(docs, found).collect()}
    assert share["kiosk"]["n_cut"] == len(cut) and share["web"]["cut_share"] == 0.0
    assert truncation.truncated(docs.where("false")).count() == 0


def test_copies_tell(spark):
    long = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and then more words follow here."
    docs = spark.createDataFrame([(1, long, None, None), (2, long[:-12], None, None), (3, long[:-1], "s", None), (3, long[:-1], "s", None)], "doc_id bigint, text string, source string, title string")
    assert {r["doc_id"] for r in truncation.truncated(docs).collect()} == {2}


def test_copies_of_a_band_all_meet(spark):
    """Variants with one opening, and a copy whose opening was touched up: each open ending meets every other text that is alike."""
    from threadmoss.scratch import Scratch

    w = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = {"cut": w[:54], "longer": w[:56], "longest": w[:58], "whole": [*w, "end."], "touched": ["zz", *w[1:], "end."], "other": [*w[::-1], "end."]}
    docs = spark.createDataFrame([(i, " ".join(t), None, None) for i, t in enumerate(texts.values())], "doc_id bigint, text string, source string, title string")
    t = truncation.texts_of(docs)
    name = {r["plain"]: k for r in t.collect() for k, v in texts.items() if r["plain"] == " ".join(v)}
    found = {(name[r["body"]], name[r["copy"]]) for r in truncation.near_copies(t, Scratch(spark, "t")).collect()}
    alike = {"cut", "longer", "longest", "whole", "touched"}
    assert found == {(a, b) for a in ("cut", "longer", "longest") for b in alike if a != b}


@pytest.mark.parametrize("hot", [1, 64])
def test_texts_that_lost_most_of_themselves_meet_their_copies(spark, monkeypatch, hot):
    """Cut to a tenth, with a slip near the end, beside a copy; and recall of all pairs of the reviews by which the longer holds the shorter."""
    from threadmoss.scratch import Scratch

    monkeypatch.setattr(truncation, "HOT", hot)
    w = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    cut, slip = w[:30], [*w[:44], "slip", *w[45:50]]
    docs = spark.createDataFrame([(i, " ".join(t), None, None) for i, t in enumerate([cut, slip, [*w, "end."]])], "doc_id bigint, text string, source string, title string")
    texts = truncation.texts_of(docs)
    verdicts = {r["text_id"]: r["n_on"] for r in truncation.copy_verdicts(truncation.near_copies(texts, Scratch(spark, "t"))).collect()}
    assert len(verdicts) == 2 and all(verdicts.values())
    sets = Scratch(spark, "t")
    texts = sets.save(truncation.texts_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "texts")
    found = {(r["text_id"], r["copy_id"]) for r in truncation.near_copies(texts, sets).collect()}
    rows = [(r["text_id"], r["open"], set(r["s"])) for r in sets.load("shingles").collect()]
    alike = lambda s, t: len(s & t) >= 0.8 * (min(len(s), len(t)) if len(s) >= truncation.SHORTEST else len(s | t))
    want = {(a, b) for a, is_open, s in rows if is_open for b, _, t in rows if a != b and len(t) >= 0.8 * len(s) and alike(s, t)}
    found &= want | {(a, b) for a, _, s in rows if len(s) >= truncation.SHORTEST for b, *_ in rows}
    assert want and found <= want and len(found) >= 0.9 * len(want), (len(found), len(want))


def test_a_shared_sentence_makes_no_pairs(spark, monkeypatch):
    """Texts round one long sentence: split by rare shingles its window pairs only a text with what holds it, and loses no such pair."""
    from threadmoss.scratch import Scratch

    monkeypatch.setattr(truncation, "LOOKED_UP", 1.0)
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    sentence = [f"same{name(i)}" for i in range(24)]
    texts = [" ".join([*(f"a{name(100 * i + k)}" for k in range(9)), *sentence, *(f"b{name(100 * i + k)}" for k in range(6))]) for i in range(1, 41)]
    texts += [f"{x} and more words follow here." for x in texts]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(texts)], "doc_id bigint, text string, source string, title string")
    t, compared, got = truncation.texts_of(docs), {}, {}
    cells = truncation._in_cells
    for hot in (4, 1000):
        parts = []
        monkeypatch.setattr(truncation, "HOT", hot)
        monkeypatch.setattr(truncation, "_in_cells", lambda *a: parts.append(cells(*a)) or parts[-1])
        got[hot] = {(r["text_id"], r["copy_id"]) for r in truncation.near_copies(t, Scratch(spark, "t")).collect()}
        compared[hot] = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().count()
    assert got[4] == got[1000] and len(got[4]) == 40
    assert compared[4] < 100 < 3000 < compared[1000]


@pytest.mark.parametrize("cell", [1, 4096])
def test_band_cells(spark, monkeypatch, cell):
    from threadmoss.scratch import Scratch

    monkeypatch.setattr(truncation, "CELL", cell)
    w = [f"word{chr(97 + i)}" for i in range(26)]
    docs = spark.createDataFrame([(i, " ".join([*w, chr(97 + i) * 3]), None, None) for i in range(6)], "doc_id bigint, text string, source string, title string")
    pairs = [(r["text_id"], r["copy_id"]) for r in truncation.near_copies(truncation.texts_of(docs), Scratch(spark, "t")).collect()]
    assert len(pairs) == len(set(pairs)) == 30


def test_finished_jobs_leave_no_files(spark, monkeypatch, data):
    """Shuffle files go with the job that wrote a table, and tables that no later step reads with that step; rounds change nothing."""
    import os

    from threadmoss.scratch import Scratch

    held, own, made = [], Scratch.save, []
    start = Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a: (start(self, *a), made.append(self))[0])

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(os.path.basename(p).startswith("shuffle_") for p in files.mkString("\n").split("\n"))

    def saved(self, *args, **kw):
        before = shuffled()
        out = own(self, *args, **kw)
        held.append(shuffled() - before)
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {}
    for n in (1 << 23, 9_000):
        monkeypatch.setattr(truncation, "ROUND", n)
        found[n] = {r["doc_id"] for r in truncation.truncated(documents).collect()}
        assert set(os.listdir(made[-1].root.removeprefix("file://"))) <= {"scores", "verdicts"} | {f"verified-{k}" for k in range(9)}
    assert found[9_000] == found[1 << 23] and len(found[9_000]) > 20
    assert max(held) <= 0


def test_marks_lose_no_pair(spark, monkeypatch):
    """Pairs that their marks keep apart aren't alike: without marks the same pairs are verified."""
    from threadmoss.scratch import Scratch

    t = Scratch(spark, "t").save(truncation.texts_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "texts")
    found, kept = [], []
    for words in (truncation.MARKS, 0):
        monkeypatch.setattr(truncation, "MARKS", words)
        if not words:
            monkeypatch.setattr(truncation, "_marks", lambda c: F.array().cast("array<bigint>"))
        scratch = Scratch(spark, "t")
        found.append({(r["text_id"], r["copy_id"]) for r in truncation.near_copies(t, scratch).collect()})
        kept.append(scratch.load("pairs").count())
    assert found[0] == found[1] and kept[0] < kept[1] / 2


def test_copies_are_aligned(spark):
    """A slip before the end, a slip in the last word, a phrase that occurs before, and a text that only ends in another word."""
    base = "it stood in the hall for years and nobody asked who had put it there until the painters came and wanted the wall free so we moved the clock"
    whole = base + " to the upper room and there it still runs every day. later on"
    ends = base + " to the upper room. there it still runs every day of the year"
    repeated = "we came home late. " + base + " and we came home late, tired and hungry"
    cases = [
        (base + " to the uper room and the", whole, 1, 0), (base + " to the upper room and ther", whole, 1, 0), (base + " to the uppr room", ends, 0, 1), (base + " to the upper roon", ends, 0, 1),
        (repeated[: repeated.index(", tired")], repeated, 1, 0), (base + " to the upper ceiling", whole, 0, 0), (base + " to the upper room and there it still runs every day", whole, 0, 1),
    ]
    pairs = spark.createDataFrame([(i, t, 100, c) for i, (t, c, *_) in enumerate(cases)], "text_id bigint, body string, copy_id bigint, copy string")
    got = {r["text_id"]: (r["n_on"], r["n_ends"]) for r in truncation.copy_verdicts(pairs).collect()}
    assert got == {i: (on, end) for i, (_, _, on, end) in enumerate(cases) if on + end}


@pytest.mark.parametrize("name", ["p1_found", "p1_clusters", "p4_found", "p4_sizes", "p6_ids", "p6_round_trip", "p7_packed", "p7_report", "p8_found", "p8_by_source", "p8_reasons"])
def test_queries_run(name, spark, data):
    from threadmoss.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() > 0


