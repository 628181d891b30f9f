import base64
import hashlib
import struct
import xml.etree.ElementTree
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmoss.__main__ import main, parser, tunables_of
from threadmoss.config import Tunables
from threadmoss.operators import frames as fr
from threadmoss.operators import graphs, results, tracking
from threadmoss.plans.pipeline import analyse, read_results
from threadmoss.sources.tiff import TiffStack


def write_tiff(path, pages, order="<"):
    """A baseline TIFF of uncompressed grey pages."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    at_link = 4
    for page in pages:
        data = page.astype(page.dtype.newbyteorder(order)).tobytes()
        start = len(out)
        out += data + b"\0" * (len(data) % 2)
        directory = len(out)
        out[at_link : at_link + 4] = struct.pack(order + "I", directory)
        h, w = page.shape
        tags = [(256, 4, w), (257, 4, h), (258, 3, page.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, start), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (339, 3, 3 if page.dtype.kind == "f" else 1)]
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        at_link = len(out)
        out += b"\0\0\0\0"
    path.write_bytes(bytes(out))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_tiff(spark, tmp_path, order, kind):
    pages = [(np.random.default_rng(k).random((5, 7)) * 200).astype(kind) for k in range(20)]
    write_tiff(tmp_path / "a.tif", pages, order)
    spark.dataSource.register(TiffStack)
    got = spark.read.format("tiff_stack").load(f"{tmp_path}/a.tif?calibration=0.09;interval=600").orderBy("t").collect()
    assert len(got) == 20 and got[3]["timepoint"] == 1800.0 and got[3]["calibration"] == 0.09 and got[0]["filename"] == "a.tif"
    assert np.array_equal(np.array(got[7]["pixels"]).reshape(5, 7), pages[7].astype(float))


def growing(n=8, size=40):
    """A dark line that grows by three pixels a frame, on a bright ground."""
    out = []
    for t in range(n):
        image = np.full((size, size), 200, np.uint8)
        image[18:21, 8 : 14 + 3 * t] = 10
        out.append(image)
    return out


TUNED = dict(ThresholdingTechnique="sauvola", ThresholdingParameters="window_size:8,k:0.05", CleanUpGaussianSigma=0.0, RemoveSmallStructuresSize=4.0, BorderArtifactRemovalBorderSize=0.0, TrackingMaximumCoverage=1.0, TrackingMinimumTrackedPointCount=3, TrackingMinimalMaximumLength=1.0, TrackingMinimalGrownLength=1.0)


def test_growth_is_tracked_end_to_end(spark, tmp_path):
    rows = [(1, t, t * 600.0, 40, 40, 1.0, im.astype(float).ravel().tolist()) for t, im in enumerate(growing())] + [(2, 0, 0.0, 3, 3, 1.0, [0.0] * 9), (3, 0, 0.0, 5, 5, 1.0, [1.0] * 25), (4, 0, 0.0, 5, 5, 0.0, [1.0] * 25)]
    frames = spark.createDataFrame([(*r, "u1") for r in rows], "pos int, t int, timepoint double, height int, width int, calibration double, pixels array<double>, dtype string")
    a = analyse(frames, Tunables(**TUNED, StoreImage=True), "note")
    with pytest.raises(NotImplementedError):
        analyse(frames, Tunables(BoxDetection=True))
    kept = {r["t"]: r for r in a.frames.where("pos = 1").collect()}
    assert len(kept) == 8 and a.frames.where("pos = 2").count() == 0
    assert all(r["graph_node_count"] == r["graph_endpoint_count"] + r["graph_junction_count"] and r["graph_endpoint_count"] == 2 for r in kept.values())
    lengths = [kept[t]["graph_edge_length"] for t in range(8)]
    assert all(b > a for a, b in zip(lengths, lengths[1:]))
    steps = a.steps.collect()
    assert {s["pos"] for s in steps} == {1} and len({s["track_id"] for s in steps}) >= 1
    assert a.failures.select("pos", "t").collect() == [(4, 0)] and "calibration" in a.failures.first()["failure"]
    first = a.frames.where("pos = 1 and t = 0").first()
    assert first["image_hash"] == base64.b64encode(hashlib.sha256(growing()[0].tobytes()).digest()).decode() and first["metadata"] == "note" and len(first["image"]) == 39 * 39
    n = a.overall_nodes.where("pos = 1")
    assert n.count() == n.agg(F.max("node")).first()[0] + 1 == 14 and n.agg(F.max("z")).first()[0] == 6 * 600.0
    edges = a.overall_edges.where("pos = 1").collect()
    assert sum(e["weight"] is not None for e in edges) == 7 and {(e["source"], e["target"]) for e in edges if e["weight"] is None} == {(2 * k["i"] + k["node_id"], 2 * k["i"] + 2 + k["next_id"]) for k in a.links.where("pos = 1 and i < 6 and next_id >= 0").collect()}
    lines = [r["line"] for r in a.overall_graphml.where("pos = 1").orderBy("part").collect()]
    assert len(list(xml.etree.ElementTree.fromstring("".join(lines))[-1])) == 14 + len(edges)
    assert {r["family"] for r in a.track_fits_optimized.collect()} == {r["family"] for r in a.track_fits.where("pvalue is not null").collect()}
    a.write(str(tmp_path / "out"), "/data/a.tif")
    assert read_results(spark, str(tmp_path / "out"), "frames").where("pos = 1").count() == 8
    with pytest.raises(Exception, match="(?i)exists"):
        a.write(str(tmp_path / "out"), "/data/a.tif")


def test_folding_in_blocks_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for pos in (1, 2):
        for i in range(23):
            nodes = [(0, 10.0 + rng.normal(0, 0.1), 5.0, "endpoint", 0), (1, 10.0, 30.0 + 2 * i, "endpoint", 0), (2, 10.0, 20.0, "junction", 0), (3, 2.0 * i, 50.0, "endpoint", 3)]
            rows.append((pos, i, i * 600.0, 1.0, 0.1 if i < 19 else 0.5, nodes, [(0, 2, 15.0 + 0.3 * i), (1, 2, 10.0 + 2.0 * i)]))
    schema = "pos int, t int, timepoint double, calibration double, covered_ratio double, nodes array<struct<node_id:int,y:double,x:double,kind:string,component:int>>, edges array<struct<a:int,b:int,weight:double>>"
    ordered = tracking.in_order(spark.createDataFrame(rows, schema))
    links = tracking.match_nodes(ordered)
    assert links.where("node_id = 1 and next_id = 1").count() == 44
    whole = sorted(map(tuple, tracking.track(ordered, links).collect()))
    monkeypatch.setattr(tracking, "BLOCK", 5)
    assert sorted(map(tuple, tracking.track(ordered, links).collect())) == whole
    assert {(s[0], s[2]) for s in whole} == {(p, i) for p in (1, 2) for i in range(19)}


def _pair_of_frames(second, links, first=None, hours=1.0):
    """Endpoints 0 and 1 and junction 2 of one component, and the frame after; edges are (a, b, weight)."""
    row = lambda i, edges, kinds, links: {"nodes": [{"kind": k, "y": 0.0, "x": float(n)} for n, k in enumerate(kinds)], "edges": [dict(zip("ab", e[:2]), weight=e[2]) for e in edges], "links": [{"node_id": a, "next_id": b, "alternatives": alt} for a, b, alt in links], "i": i, "timepoint": i * hours * 3600, "calibration": 1.0, "covered_ratio": 0.1}
    return tracking._Frame(row(0, first or [(0, 2, 10.0), (1, 2, 7.0)], ["endpoint", "endpoint", "junction"], links)), tracking._Frame(row(1, second, ["endpoint", "endpoint", "junction", "junction"], []))


@pytest.mark.parametrize(("second", "links", "fates"), [
    ([(0, 2, 20.0), (1, 2, 9.0)], [(0, 0, [0]), (1, 1, [1]), (2, 2, [2])], [None, None]),
    ([(0, 2, 20.0), (1, 2, 9.0)], [(0, 0, [0]), (2, 2, [2])], [None, "missing node"]),
    ([(0, 2, 20.0), (1, 2, 9.0)], [(0, 2, [2]), (1, 1, [1]), (2, 2, [2])], ["one successor", None]),
    ([(0, 3, 20.0), (1, 2, 9.0)], [(0, 0, [0]), (1, 1, [1]), (2, 2, [2])], ["unconnected", None]),
    ([(0, 3, 20.0), (1, 2, 9.0)], [(0, 0, [0]), (1, 1, [1]), (2, 2, [2, 3])], [None, None]),  # an alternative of the junction fits
    ([(0, 2, 5.0), (1, 2, 9.0)], [(0, 0, [0]), (1, 1, [1]), (2, 2, [2])], ["shortcut", None]),
    ([(0, 2, 111.0), (1, 2, 6.9)], [(0, 0, [0]), (1, 1, [1]), (2, 2, [2])], ["rate", "rate"]),
])
def test_fates_of_pairs(second, links, fates):
    a, b = _pair_of_frames(second, links)
    out = tracking._advance(a, b, np.empty((0, 3), int), 5, Tunables())
    assert out[["e", "other"]].values.tolist() == [[0, 2], [1, 2]]
    assert [None if f != f else f for f in out["fate"]] == fates
    assert sorted(out["track"][out["fate"].isna()]) == [5 + k for k in range(fates.count(None))]


def test_an_open_track_claims_its_endpoint_first():
    a, b = _pair_of_frames([(0, 2, 20.0), (1, 2, 9.0)], [(0, 0, [0]), (1, 1, [1]), (2, 2, [2])])
    out = tracking._advance(a, b, np.array([[3, 0, 2]]), 7, Tunables())
    assert list(out["track"]) == [3, -1, 7] and out["fate"].iat[1] == "endpoint used otherwise" and out["d2"].iat[0] == 20.0


def test_line_between_endpoints_is_judged_by_its_weighted_path():
    """A direct edge that is longer than the way round passes another node, whatever its number of hops."""
    links = [(0, 0, [0]), (1, 1, [1]), (2, 2, [2])]
    for direct, fate in ((20.0, "inner node"), (16.0, None)):
        a, b = _pair_of_frames([(0, 1, 18.0)], links, first=[(0, 2, 10.0), (1, 2, 7.0), (0, 1, direct)])
        out = tracking._advance(a, b, np.array([[1, 0, 1]]), 2, Tunables())
        assert (None if out["fate"].iat[0] is None else out["fate"].iat[0]) == fate and out["hops"].iat[0] == 1


def test_fates_are_rows(spark):
    nodes = [(0, 0.0, 0.0, "endpoint", 0), (1, 0.0, 10.0, "junction", 0)]
    rows = [(1, i, i * 600.0, 1.0, 0.1, nodes if i < 2 else [], [(0, 1, 10.0 + i)] if i < 2 else []) for i in range(3)]
    schema = "pos int, t int, timepoint double, calibration double, covered_ratio double, nodes array<struct<node_id:int,y:double,x:double,kind:string,component:int>>, edges array<struct<a:int,b:int,weight:double>>"
    ordered = tracking.in_order(spark.createDataFrame(rows, schema))
    out = tracking.outcomes(ordered, tracking.match_nodes(ordered))
    assert [(r["track_id"], r["i"], r["distance"], r["next_distance"]) for r in tracking.steps_of(out).withColumn("next_distance", F.lit(11.0)).collect()] == [(0, 0, 10.0, 11.0)]
    assert [(r["track_id"], r["i"], r["fate"]) for r in tracking.fates_of(out).orderBy("track_id").collect()] == [(None, 1, "one successor"), (0, 1, "one successor")]
    assert tracking.outcomes(ordered.where("false"), tracking.match_nodes(ordered.where("false"))).count() == 0


def test_matching_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [(1, t, k, float(y), float(x)) for t in range(3) for k, (y, x) in enumerate(rng.random((40, 2)) * 10)]
    got = {(r["t"], r["node_id"]): (r["next_id"], list(r["alternatives"])) for r in graphs.matched(spark.createDataFrame(pts, "pos int, t int, node_id int, y double, x double"), 1.5).collect()}
    for _, t, k, y, x in pts:
        near = sorted((np.hypot(y - b, x - a), j) for _, s, j, b, a in pts if s == t + 1 and np.hypot(y - b, x - a) <= 1.5)
        assert got[(t, k)] == (near[0][1] if near else -1, [j for _, j in near])


def test_graphml_round_trip(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, -1), (1, 1, 0, None)], "pos int, t int, node_id int, next_id int")
    g = graphs.graphml_of_links(df)
    back = graphs.read_graphml(g).collect()
    assert [(r["t"], r["source"], r["target"]) for r in back] == [(0, "n0", "s1")]


def test_records(spark):
    df = spark.createDataFrame([(i,) for i in range(40)], "n int")
    assert [r["n"] for r in df.where(results.in_range(F.col("n"), "0-2,7,38-")).collect()] == [0, 1, 2, 7, 38, 39]
    assert df.where(results.in_range(F.col("n"), "")).count() == 40
    p = results.project(df.withColumn("n_a", F.lit(1)).withColumn("m", F.lit(2)), ["m", "n*", "gone"])
    assert p.columns == ["m", "n", "n_a", "gone"] and np.isnan(p.first()["gone"])
    f = spark.createDataFrame([(1, 0, 1, 1, 1.0, [5.0]), (2, 0, 1, 2, 1.0, [3.0, float("nan")])], "pos int, t int, height int, width int, calibration double, pixels array<double>")
    assert [r[0] for r in f.orderBy("pos").select(fr.rescaled_uint8(F.col("pixels"))).collect()][0] == [0]
    assert fr.quantified(f.withColumn("mask", fr.dark_mask(F.col("pixels")))).count() == 2


def test_streaming(spark, data, tmp_path):
    from threadmoss.streaming.growth import arriving, first_deliveries, growth_per_window

    t0 = datetime(2031, 3, 1)
    schema = "row_id bigint, pos int, meta_t int, received_at timestamp, graph_edge_length double"
    rows = [(i, 1, i % 8, t0 + timedelta(minutes=10 * i), 10.0 + i) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = growth_per_window(live).writeStream.format("memory").queryName("growth").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {r["window_start"]: r for r in spark.table("growth").collect()}
    assert got[t0]["n_frames"] == 6 and got[t0]["least_length"] == 10.0 and got[t0]["greatest_length"] == 15.0
    q = first_deliveries(live, "1 hour").writeStream.format("memory").queryName("first").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    n = spark.table("first").count()
    assert 8 <= n < 40


def test_command_line(tmp_path, capsys):
    assert main(["--tunables-show", "-t", "CropWidth=4", "--tunables-save", str(tmp_path / "t.json")]) == 0
    assert '"CropWidth": 4' in capsys.readouterr().out
    assert tunables_of(parser().parse_args(["x.tif", "--tunables-load", str(tmp_path / "t.json"), "-t", "CropHeight=2"])).CropHeight == 2


def test_graph_tables(spark):
    from threadmoss.kernels.graph import NodeGraph, shortest_path

    node = "struct<node_id:int,y:double,x:double,kind:string,component:int>"
    ends = [(0, 0.0, 0.0, "endpoint", 0), (1, 0.0, 9.0, "endpoint", 0), (2, 0.0, 5.0, "junction", 0), (3, 9.0, 0.0, "endpoint", 3), (4, 9.0, 9.0, "endpoint", 3)]
    df = spark.createDataFrame([(1, 0, ends, [(0, 2, 5.0), (1, 2, 4.0), (3, 4, 9.0)]), (1, 1, ends[:3], [(0, 2, 5.0), (1, 2, 4.0), (0, 1, 2.0)]), (2, 0, [], [])], f"pos int, t int, nodes array<{node}>, edges array<struct<a:int,b:int,weight:double>>")
    pairs = {(r["t"], r["e"], r["other"]) for r in graphs.candidate_pairs(df).collect()}
    assert pairs == {(0, 0, 2), (0, 1, 2), (0, 3, 4), (0, 4, 3), (1, 0, 2), (1, 1, 2)}
    assert {(r["pos"], r["t"]): r["cycles"] for r in graphs.has_cycles(df).collect()} == {(1, 0): False, (1, 1): True, (2, 0): False}
    assert {(r["t"], r["component"]): r["node_ids"] for r in graphs.connected_nodes(df).collect()} == {(0, 0): [0, 1, 2], (0, 3): [3, 4], (1, 0): [0, 1, 2]}
    far = {(r["t"], r["a"], r["b"]): (r["distance"], r["hops"]) for r in fr.shortest_paths(df).collect()}
    assert far[(0, 0, 1)] == (9.0, 2) and far[(1, 0, 2)] == (5.0, 1) and (0, 0, 3) not in far
    assert len(graphs.read_graphml(graphs.graphml_of_graphs(df)).collect()) == 6
    g = NodeGraph(np.zeros((4, 2)), 2, {0: {1: 2.0, 2: 9.0}, 1: {0: 2.0, 2: 3.0}, 2: {1: 3.0, 0: 9.0}})
    assert shortest_path(g, 0, 2) == [0, 1, 2] and shortest_path(g, 0, 3) == []
