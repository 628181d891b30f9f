"""One group identifier for all records that are linked directly or through others.

Low-diameter decomposition: every vertex draws an exponential shift; clusters grow from the largest shifts first, one
hop a round, and a vertex that nobody reached by its own start opens a cluster.  The few edges between clusters are
contracted to edges between super-vertices, and the decomposition recurses on them until no edge is left; the
assignments of all levels are then composed.  Every step is a join or an aggregate over vertices or edges, and every
level is a written table, so neither a hub nor a chain of any length ends up in one task.

Before the first level, edges that lie together in a partition are decomposed in the same way on the spot, in chunks of fixed
size: a map-side combine that changes no result, only how many super-vertices the first level over all edges starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighbours import with_previous
from ..scratch import Scratch

#: rate of the exponential shifts: the larger, the smaller the clusters
RATE = 0.7
#: growth rounds of a level; a shift beyond is cut to it, which only makes clusters smaller
ROUNDS = 3


def _draw(vertex: np.ndarray, level: int) -> np.ndarray:
    """Rounds until a vertex starts a cluster of its own: an exponential draw fixed by vertex and level."""
    x = (vertex.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    unit = ((x >> np.uint64(24)).astype(float) + 1) / float(1 << 40)
    return np.maximum(0, ROUNDS - np.floor(-np.log(unit) / RATE)).astype(int)


def _decomposed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges that lie together, and of each the smallest vertex joined to it by those edges.

    The same decomposition as over the whole graph: clusters grow from shifted starts, contract, and the edges between them
    are decomposed in turn; every level leaves a fraction of the super-vertices.
    """
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: a.size], flat[a.size :]
    group, names, level = np.arange(ids.size), ids, 0
    while x.size:
        n = names.size
        start, own = _draw(names, level), np.arange(n)
        centre = np.where(start == 0, own, n)  # n: not reached yet
        for r in range(1, ROUNDS + 1):
            offer = np.full(n, n)
            np.minimum.at(offer, x, centre[y])
            np.minimum.at(offer, y, centre[x])
            late = np.where(offer < n, offer, np.where(start <= r, own, n))
            centre = np.where(centre < n, centre, late)
        centre = np.where(centre < n, centre, own)
        kept, cluster = np.unique(centre, return_inverse=True)
        group, names = cluster[group], names[kept]
        x, y = cluster[x], cluster[y]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        x, y, level = pair[:, 0], pair[:, 1], level + 1
    least = np.full(names.size, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return ids, least[group]


#: seconds of a position whose links lie together
STRETCH = 20_000.0
#: edges that a task decomposes at once
CHUNK = 400_000


def _chunk_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        t = pa.Table.from_batches(held)
        ids, low = _decomposed(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["v", "root"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.*")


def _shift(v, level: int):
    """Rounds until a vertex starts a cluster of its own: an exponential draw fixed by vertex and level."""
    unit = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    early = F.floor(-F.ln(unit) / F.lit(RATE))
    return F.greatest(F.lit(0), F.lit(ROUNDS) - early).cast("int")


def _decompose(edges: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """v, centre: the clusters of one level over the written edges (a, b)."""
    arcs = _both_ways(edges)
    state = arcs.groupBy("v").agg(F.min("u").alias("least")).select("v", _shift(F.col("v"), level).alias("start"), "least")
    state = state.select("v", "start", F.when(F.col("start") == 0, F.col("v")).alias("centre"))
    for r in range(1, ROUNDS + 1):
        state = scratch.save(state, f"grow-{level}-{r}")
        # what was reached a round ago reaches its neighbours now; ties go to the smaller centre
        reached = arcs.join(state.where("centre is not null").select(F.col("v").alias("u"), "centre"), "u").groupBy("v").agg(F.min("centre").alias("offer"))
        state = state.join(reached, "v", "left").select("v", "start", F.coalesce("centre", F.when(F.col("start") <= r, F.coalesce("offer", "v")), "offer").alias("centre"))
    return state.select("v", F.coalesce("centre", "v").alias("centre"))


def linked_groups(edges: DataFrame, label: str = "groups", small: int = 200) -> DataFrame:
    """vertex, group_id (the smallest vertex of the group) for every vertex of the edges (a, b: bigint).

    Null ends, self-loops and repeated edges are ignored; vertices without a real edge don't appear and are their own
    group.  An empty table gives an empty result.  Once a level has no more than ``small`` edges, a fixed bound, one
    partition contracts them.  Edges that lie together in a partition should share vertices where the caller can arrange
    it: that makes the map-side combine effective, and never changes the result.
    """
    scratch = Scratch(edges.sparkSession, label)
    clean = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    seen = scratch.save(clean.mapInArrow(_chunk_roots, "v bigint, root bigint"), "seen")
    # a vertex seen by several chunks links their roots
    first = scratch.save(seen.groupBy("v").agg(F.min("root").alias("root"), (F.max("root") != F.min("root")).alias("shared")), "first")
    split = first.where("shared").select("v", F.col("root").alias("a"))
    current = scratch.save(seen.join(split, "v").where("root <> a").select("a", F.col("root").alias("b")).distinct(), "edges-0")
    maps: list[DataFrame] = []
    level = 0
    while (n := current.count()) > small:
        cluster = scratch.save(_decompose(current, level, scratch), f"map-{level}")
        maps.append(cluster)
        for r in range(1, ROUNDS + 1):
            scratch.drop(f"grow-{level}-{r}")
        left = cluster.select(F.col("v").alias("a"), F.col("centre").alias("ca"))
        right = cluster.select(F.col("v").alias("b"), F.col("centre").alias("cb"))
        between = current.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        following = scratch.save(between.distinct(), f"edges-{level + 1}")
        scratch.drop(f"edges-{level}")
        current, level = following, level + 1
    if n:
        maps.append(scratch.save(current.coalesce(1).mapInArrow(_chunk_roots, "v bigint, root bigint").withColumnRenamed("root", "centre"), f"map-{level}"))
    if not maps:
        return first.select(F.col("v").alias("vertex"), F.col("root").alias("group_id"))
    # compose from the last level down; a vertex that a level doesn't list is its own centre there
    out = maps[-1]
    for cluster in reversed(maps[:-1]):
        up = out.select(F.col("v").alias("centre"), F.col("centre").alias("above"))
        out = cluster.join(up, "centre", "left").select("v", F.coalesce("above", "centre").alias("centre"))
    # every root is the smallest vertex of its chunk's group, so the smallest root names the whole group
    names = out.groupBy("centre").agg(F.min("v").alias("least"))
    named = scratch.save(out.join(names, "centre").select(F.col("v").alias("root"), F.least("least", "centre").alias("group_id")), "named")
    return first.join(named, "root", "left").select(F.col("v").alias("vertex"), F.coalesce("group_id", "root").alias("group_id"))


def frame_edges(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node_links: nodes are pos, t, node_id, vertex; edges a, b join a node to those named in the next frame.

    Rows with equal (pos, t, node_id) are one node, its vertex the smallest link_id.  Nodes without pos or timepoint link
    nothing.  Ids that the next frame doesn't have link nothing.
    """
    named = F.array_compact(F.array_union(F.coalesce("alternatives", F.array().cast("array<int>")), F.array(F.col("next_id").cast("int"))))
    rows = links.select("pos", "t", "node_id", "link_id", F.when(~F.isnan("timepoint"), F.col("timepoint")).alias("timepoint"), F.filter(F.array_sort(named), lambda x: x >= 0).alias("named"))
    per_node = rows.groupBy("pos", "t", "node_id").agg(F.min("link_id").alias("vertex"), F.min("timepoint").alias("timepoint"), F.array_distinct(F.flatten(F.collect_set("named"))).alias("named"))
    nodes = scratch.save(per_node, "nodes")
    timed = nodes.where("pos is not null and timepoint is not null and node_id is not null")
    moments = timed.groupBy("pos", "timepoint").agg((-F.min("timepoint")).alias("back"))
    following = with_previous(moments, ["pos"], ["back"], F.floor(F.col("back") / F.lit(500_000.0)), ["timepoint"]).where("previous is not null")
    following = following.select("pos", "timepoint", F.col("previous.timepoint").alias("next_timepoint"))
    calls = timed.select("pos", "timepoint", F.col("vertex").alias("a"), F.explode("named").alias("node_id")).join(following, ["pos", "timepoint"])
    calls = calls.select("pos", F.col("next_timepoint").alias("timepoint"), "node_id", "a")
    edges = calls.join(timed.select("pos", "timepoint", "node_id", F.col("vertex").alias("b")), ["pos", "timepoint", "node_id"])
    # short stretches of a position lie together for the map-side combine; the decomposition joins the stretches
    return nodes, edges.repartition("pos", F.floor(F.col("timepoint") / F.lit(STRETCH))).select("a", "b")


def link_groups(links: DataFrame) -> DataFrame:
    """link_id, group_id for every row of node_links: the smallest link_id of all rows linked directly or through others."""
    scratch = Scratch(links.sparkSession, "links")
    nodes, edges = frame_edges(links, scratch)
    groups = linked_groups(edges)
    of_node = nodes.select("pos", "t", "node_id", "vertex").join(groups, "vertex", "left").select("pos", "t", "node_id", F.coalesce("group_id", "vertex").alias("group_id"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("pos", "t", "node_id")]
    return links.select("link_id", "pos", "t", "node_id").alias("r").join(of_node.alias("n"), same).select("r.link_id", "n.group_id")
