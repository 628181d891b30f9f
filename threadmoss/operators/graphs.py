"""Graph operators over node and edge tables: radius joins on a grid, offsets, unions, GraphML."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.raster import DIRECTIONS

from .neighbours import with_previous
from .tracks import STRETCH


def _cells(p: DataFrame, radius: float) -> DataFrame:
    return p.withColumn("_cy", F.floor(F.col("y") / F.lit(radius))).withColumn("_cx", F.floor(F.col("x") / F.lit(radius)))


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of points (columns y, x) of equal keys within the radius: keys, left_id, right_id, distance.

    Points fall into cells of the radius' width; each left point looks into nine cells, so the join is on equal cells and
    splits by cell, whatever the key.  Points with null coordinates or keys pair with nothing.
    """
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in product((-1, 0, 1), repeat=2)])
    a = _cells(left, radius).select(*keys, left_id, F.col("y").alias("_ay"), F.col("x").alias("_ax"), "_cy", "_cx", F.explode(around).alias("o"))
    a = a.select(*keys, left_id, "_ay", "_ax", (F.col("_cy") + F.col("o.dy")).alias("_cy"), (F.col("_cx") + F.col("o.dx")).alias("_cx"))
    b = _cells(right, radius).select(*keys, F.col(right_id), F.col("y").alias("_by"), F.col("x").alias("_bx"), "_cy", "_cx")
    dy, dx = F.col("_ay") - F.col("_by"), F.col("_ax") - F.col("_bx")
    d2 = dy * dy + dx * dx
    return a.join(b, [*keys, "_cy", "_cx"]).where(d2 <= radius * radius).select(*keys, left_id, right_id, F.sqrt(d2).alias("distance"))


def representatives(points: DataFrame, keys: list[str], point_id: str, radius: float) -> DataFrame:
    """For each point the smallest id within the radius (itself included); one pass, so representatives may be neighbours."""
    other = points.withColumnRenamed(point_id, "_other")
    return radius_join(points, other, keys, radius, point_id, "_other").groupBy(*keys, point_id).agg(F.min("_other").alias("representative"))


def matched(nodes: DataFrame, radius: float) -> DataFrame:
    """Per node of frame t: next_id, the nearest node of frame t + 1 within the radius (-1 if none), and all of them by distance.

    Ties in distance go to the smaller id.  Frames are numbered without gaps per position.
    """
    after = nodes.select("pos", (F.col("t") - 1).alias("t"), F.col("node_id").alias("next"), "y", "x")
    hits = radius_join(nodes, after, ["pos", "t"], radius, "node_id", "next")
    best = hits.groupBy("pos", "t", "node_id").agg(F.array_sort(F.collect_list(F.struct("distance", "next"))).alias("near"))
    x = nodes.select("pos", "t", "node_id").join(best, ["pos", "t", "node_id"], "left")
    near = F.coalesce("near.next", F.array().cast("array<int>"))
    return x.select("pos", "t", "node_id", F.coalesce(F.get(near, F.lit(0)), F.lit(-1)).alias("next_id"), near.alias("alternatives"))


def overall_offsets(links: DataFrame) -> DataFrame:
    """Per frame but the last of its position: depth z (its time), number of nodes, and the number of nodes of all earlier frames.

    The offsets of a position come from sums per stretch of time, so that no position is summed in one task.
    """
    f = links.groupBy("pos", "t").agg(F.min("timepoint").alias("timepoint"), F.count_distinct("node_id").alias("n_nodes"))
    f = f.withColumn("_s", F.floor(F.col("timepoint") / F.lit(STRETCH)))
    stretch = f.groupBy("pos", "_s").agg(F.sum("n_nodes").alias("_sum"), F.max(F.struct("timepoint", "t")).alias("_last"))
    over = Window.partitionBy("pos").orderBy("_s")
    stretch = stretch.select("pos", "_s", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.max("_last").over(Window.partitionBy("pos")).alias("_last"))
    within = Window.partitionBy("pos", "_s").orderBy("timepoint", "t").rowsBetween(Window.unboundedPreceding, -1)
    x = f.withColumn("_here", F.coalesce(F.sum("n_nodes").over(within), F.lit(0))).join(stretch, ["pos", "_s"])
    x = x.where((F.col("timepoint") != F.col("_last.timepoint")) | (F.col("t") != F.col("_last.t")))
    return x.select("pos", "t", (F.round("timepoint", 6) + 0.0).alias("z"), "n_nodes", (F.col("_before") + F.col("_here")).alias("first_node"))


def temporal_edges(links: DataFrame) -> DataFrame:
    """Edges of the overall graph through time: per position, from a node to its successor, both by overall number."""
    off = overall_offsets(links)
    nodes = links.groupBy("pos", "t", "node_id").agg(F.max("next_id").cast("int").alias("next_id"))
    ordered = with_previous(off.withColumn("_back", -F.col("z")), ["pos"], ["_back", "t"], F.floor(F.col("_back") / F.lit(STRETCH)), ["first_node"], "following")
    x = nodes.where("next_id >= 0").join(ordered.where("following is not null"), ["pos", "t"])
    return x.select("pos", (F.col("first_node") + F.col("node_id")).alias("source"), (F.col("following.first_node") + F.col("next_id")).alias("target"))


def overall_graph(ordered: DataFrame, links: DataFrame, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The union of a position's frames but the last as (nodes, edges), rows of pos in any number of tasks.

    nodes: pos, node (numbered through all frames), i, x, y, z = timepoint * scale; edges: pos, source, target, weight, which is
    null for edges through time, from a node to its successor.  ``ordered`` needs pos, i, timepoint, nodes, edges; ``links`` pos, i,
    node_id, next_id.  Frames without nodes take part with none.
    """
    f = ordered.select("pos", "i", "timepoint", F.size("nodes").alias("n"))
    # running sums over blocks of frames, so that no position is summed in one task
    f = f.withColumn("_b", F.floor(F.col("i") / 4096))
    block = f.groupBy("pos", "_b").agg(F.sum("n").alias("_sum"), F.max("i").alias("_last"))
    over = Window.partitionBy("pos").orderBy("_b")
    block = block.select("pos", "_b", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.max("_last").over(Window.partitionBy("pos")).alias("_last"))
    within = Window.partitionBy("pos", "_b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_here", F.coalesce(F.sum("n").over(within), F.lit(0))).join(block, ["pos", "_b"]).where("i < _last")
    offset = f.select("pos", "i", (F.col("timepoint") * scale).alias("z"), (F.col("_before") + F.col("_here")).alias("first"))
    part = ordered.select("pos", "i", "nodes", "edges").join(offset, ["pos", "i"])
    n = part.select("pos", "i", "z", "first", F.explode("nodes").alias("n"))
    nodes = n.select("pos", (F.col("first") + F.col("n.node_id")).alias("node"), "i", F.col("n.x").alias("x"), F.col("n.y").alias("y"), "z")
    e = part.select("pos", "first", F.explode("edges").alias("e"))
    inside = e.select("pos", (F.col("first") + F.col("e.a")).alias("source"), (F.col("first") + F.col("e.b")).alias("target"), F.col("e.weight").alias("weight"))
    after = offset.select("pos", (F.col("i") - 1).alias("i"), F.col("first").alias("after"))
    through = links.where("next_id >= 0").select("pos", "i", "node_id", "next_id").join(offset, ["pos", "i"]).join(after, ["pos", "i"])
    through = through.select("pos", (F.col("first") + F.col("node_id")).alias("source"), (F.col("after") + F.col("next_id")).alias("target"), F.lit(None).cast("double").alias("weight"))
    return nodes, inside.unionByName(through)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pos, part, line of each position's GraphML: in order of part, head (0), nodes (1), edges (2) and end (3) make a document, written by any number of tasks."""
    s = lambda c: F.col(c).cast("string")
    data = lambda key: F.concat(F.lit(f'<data key="{key}">'), s(key), F.lit("</data>"))
    keys = "".join(f'<key id="{k}" for="{"edge" if k == "weight" else "node"}" attr.name="{k}" attr.type="double"/>' for k in ("x", "y", "z", "weight"))
    head = f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
    each = nodes.select("pos").unionByName(edges.select("pos")).distinct()
    frame = each.select("pos", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(head).alias("line")), F.struct(F.lit(3).alias("part"), F.lit("</graph></graphml>").alias("line")))).alias("f")).select("pos", "f.*")
    node = nodes.select("pos", F.lit(1).alias("part"), F.concat(F.lit('<node id="n'), s("node"), F.lit('">'), data("x"), data("y"), data("z"), F.lit("</node>")).alias("line"))
    edge = edges.select("pos", F.lit(2).alias("part"), F.concat(F.lit('<edge source="n'), s("source"), F.lit('" target="n'), s("target"), F.lit('">'), F.coalesce(data("weight"), F.lit("")), F.lit("</edge>")).alias("line"))
    return frame.unionByName(node).unionByName(edge)


def graphml_of_links(links: DataFrame) -> DataFrame:
    """pos, t, graphml: one small document per frame with its nodes and their successors, in order of node."""
    n = links.groupBy("pos", "t", "node_id").agg(F.max("next_id").cast("int").alias("next_id"))
    per = n.groupBy("pos", "t").agg(F.array_sort(F.collect_list(F.struct("node_id", "next_id"))).alias("n"))
    node = F.array_join(F.transform("n", lambda x: F.format_string('<node id="n%d"/>', x["node_id"])), "")
    edge = F.array_join(F.transform(F.filter("n", lambda x: x["next_id"] >= 0), lambda x: F.format_string('<edge source="n%d" target="s%d"/>', x["node_id"], x["next_id"])), "")
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'
    return per.select("pos", "t", F.concat(F.lit(head), node, edge, F.lit("</graph></graphml>")).alias("graphml"))


def read_graphml(documents: DataFrame, column: str = "graphml") -> DataFrame:
    """source and target of every edge of GraphML texts, beside the other columns; texts without edges give no row."""
    doc = F.col(column)
    ends = F.arrays_zip(F.xpath(doc, F.lit("//*[local-name()='edge']/@source")).alias("source"), F.xpath(doc, F.lit("//*[local-name()='edge']/@target")).alias("target"))
    return documents.select(*[c for c in documents.columns if c != column], F.explode(ends).alias("e")).select("*", "e.source", "e.target").drop("e")


def directions(bits: Column) -> Column:
    """The directions of a neighbourhood number as structs bit, dy, dx, opposite, in their fixed order."""
    opposite = {b: next(o for o, d in DIRECTIONS.items() if d == (-dy, -dx)) for b, (dy, dx) in DIRECTIONS.items()}
    every = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(opposite[b]).alias("opposite")) for b, (dy, dx) in DIRECTIONS.items()])
    return F.filter(every, lambda d: d["bit"].bitwiseAND(bits) != 0)


def node_rows(graph_rows: DataFrame) -> DataFrame:
    return graph_rows.select("pos", "t", F.explode("nodes").alias("n")).select("pos", "t", "n.*")


def edge_rows(graph_rows: DataFrame) -> DataFrame:
    """Both directions of every edge: pos, t, a, b, weight; a loop once."""
    e = graph_rows.select("pos", "t", F.explode("edges").alias("e")).select("pos", "t", "e.*")
    return e.unionByName(e.where("a <> b").select("pos", "t", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def candidate_pairs(graph_rows: DataFrame) -> DataFrame:
    """pos, t, e, other: an endpoint and an adjacent junction, or an adjacent endpoint where the component has no junction."""
    n = node_rows(graph_rows)
    ends = n.where("kind = 'endpoint'").select("pos", "t", F.col("node_id").alias("e"), "component")
    near = edge_rows(graph_rows).where("a <> b").select("pos", "t", F.col("a").alias("e"), F.col("b").alias("other"))
    other = n.select("pos", "t", F.col("node_id").alias("other"), "kind")
    pairs = ends.join(near, ["pos", "t", "e"]).join(other, ["pos", "t", "other"])
    with_junction = n.where("kind = 'junction'").select("pos", "t", "component").distinct()
    plain = pairs.where("kind = 'endpoint'").join(with_junction, ["pos", "t", "component"], "left_anti")
    return pairs.where("kind = 'junction'").select("pos", "t", "e", "other").unionByName(plain.select("pos", "t", "e", "other"))


def has_cycles(graph_rows: DataFrame) -> DataFrame:
    """pos, t, n_components, cycles: more edges than a forest of the nodes could have; a loop is a cycle."""
    n = F.size(F.array_distinct("nodes.component"))
    return graph_rows.select("pos", "t", n.alias("n_components"), (F.size("edges") - F.size("nodes") + n > 0).alias("cycles"))


def connected_nodes(graph_rows: DataFrame) -> DataFrame:
    """pos, t, component, node_ids: the nodes of each component in order."""
    return node_rows(graph_rows).groupBy("pos", "t", "component").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))


def graphml_of_graphs(graph_rows: DataFrame) -> DataFrame:
    """pos, t, graphml of each frame's graph: nodes with x and y, edges with their weight."""
    node = F.array_join(F.transform("nodes", lambda x: F.format_string('<node id="n%d"><data key="x">%s</data><data key="y">%s</data></node>', x["node_id"], x["x"].cast("string"), x["y"].cast("string"))), "")
    edge = F.array_join(F.transform("edges", lambda x: F.format_string('<edge source="n%d" target="n%d"><data key="weight">%s</data></edge>', x["a"], x["b"], x["weight"].cast("string"))), "")
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="x" for="node" attr.type="double"/><key id="y" for="node" attr.type="double"/><key id="weight" for="edge" attr.type="double"/><graph edgedefault="undirected">'
    return graph_rows.select("pos", "t", F.concat(F.lit(head), node, edge, F.lit("</graph></graphml>")).alias("graphml"))
