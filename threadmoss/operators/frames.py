"""Frames as rows: arithmetic on pixel arrays stays in the JVM, neighbourhood kernels run on Arrow batches of frames.

A frame row is pos, t, height, width, calibration, pixels (row-major array of doubles).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import graph as kernel_graph
from ..kernels import raster
from .neighbours import with_rank

KEY = ("pos", "t")


def frames_of_vectors(vectors: DataFrame, side: int = 8, calibration: float = 1.0) -> DataFrame:
    """Square frames from vectors of side * side values: pos is the label, t the rank by vec_id within it."""
    x = vectors.where("embedding is not null and label is not null").select(F.col("label").alias("pos"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))
    x = with_rank(x.where(F.size("pixels") == side * side), ["pos"], ["vec_id"], F.floor(F.col("vec_id") / 100_000))
    # small in bytes, heavy in kernels: frames stay spread however few bytes they are
    x = x.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pos", "rank")
    return x.select("pos", F.col("rank").cast("int").alias("t"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(calibration).alias("calibration"), "pixels")


def image_statistics(frames: DataFrame) -> DataFrame:
    h, w, c = F.col("height"), F.col("width"), F.col("calibration")
    return frames.select(*KEY, (h * c).alias("input_height"), (w * c).alias("input_width"), h.alias("input_height_pixel"), w.alias("input_width_pixel"), (h * w * c * c).alias("area"), (h * w).alias("area_pixel"))


def normalized(pixels: Column) -> Column:
    """0-1 by minimum and maximum; null pixels throughout for a constant frame."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return F.transform(pixels, lambda v: F.try_divide(v - low, high - low))


def rescaled_uint8(pixels: Column) -> Column:
    """0-255, truncated, as smallint; 0 throughout for a constant frame."""
    return F.transform(normalized(pixels), lambda v: F.coalesce(F.floor(v * 255), F.lit(0)).cast("smallint"))


def dark_mask(pixels: Column) -> Column:
    """True where a pixel is below its frame's mean; NaN never is."""
    mean = F.try_divide(F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v), F.size(pixels))
    return F.transform(pixels, lambda v: (v < mean) & ~F.isnan(mean))


def cropped(frames: DataFrame, crop_height: int, crop_width: int) -> DataFrame:
    """The frame without a margin of rows and columns; even a margin of 0 loses the last row and column."""
    y1, x1 = F.col("height") - max(crop_height, 1), F.col("width") - max(crop_width, 1)
    keep = F.filter("pixels", lambda v, i: (F.floor(i / F.col("width")) >= crop_height) & (F.floor(i / F.col("width")) < y1) & (i % F.col("width") >= crop_width) & (i % F.col("width") < x1))
    # the new size comes after the filter, whose expressions mean the old one
    return frames.withColumn("pixels", keep).select(*KEY, (y1 - crop_height).alias("height"), (x1 - crop_width).alias("width"), "calibration", "pixels")


def without_small_positions(frames: DataFrame, least_height: int = 4, least_width: int = 4) -> DataFrame:
    """Frames of positions all of whose frames are large enough: one small frame takes its position out."""
    bad = frames.where((F.col("height") < least_height) | (F.col("width") < least_width)).select("pos").distinct()
    return frames.join(bad, "pos", "left_anti")


def quantified(frames: DataFrame, mask: str = "mask") -> DataFrame:
    """covered_ratio, covered_area and covered_area_pixel of a boolean mask."""
    n = F.size(F.filter(mask, lambda v: v))
    return frames.select(*KEY, F.try_divide(n, F.size(mask)).alias("covered_ratio"), (n * F.col("calibration") * F.col("calibration")).alias("covered_area"), n.alias("covered_area_pixel"))


def _image(row) -> np.ndarray:
    return np.asarray(row.pixels, dtype=float).reshape(int(row.height), int(row.width))


#: array entries after which a task hands its rows on
HANDED_ON = 2_000_000


def whole_frames(frames: DataFrame) -> DataFrame:
    """Frames with as many pixels as their size says, none of them null, and a positive calibration."""
    whole = (F.size("pixels") == F.col("height") * F.col("width")) & (F.size("pixels") > 0) & (F.col("calibration") > 0) & ~F.exists("pixels", lambda v: v.isNull())
    return frames.where(F.coalesce(whole, F.lit(False)))


def map_frames(frames: DataFrame, kernel: Callable, schema: str, status: str | None = None) -> DataFrame:
    """Rows that a kernel makes of each frame: ``kernel(frame)`` yields tuples in the order of the schema after pos, t.

    Frames that aren't whole are left out, and an error of the kernel fails the task.  With ``status``, a column of that name
    is added: every frame gives a row, one that isn't whole or on which the kernel fails the text of its error and nulls; the
    others of its batch are not touched.  Rows are handed on as they fill a batch of HANDED_ON entries.
    """
    names = ["pos", "t", *[c.strip().split()[0] for c in schema.split(", ")]]
    source = frames if status else whole_frames(frames)

    def of_frame(r) -> list[tuple]:
        if not status:
            return [(r.pos, r.t, *x) for x in kernel(r)]
        try:
            if not r.calibration > 0:
                raise ValueError("no calibration")
            return [(r.pos, r.t, *x, None) for x in kernel(r)]
        except Exception as e:  # noqa: BLE001  whatever fails is told in the row
            return [(r.pos, r.t, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:200])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names, status] if status else names
        for pdf in batches:
            rows, entries = [], 0
            for r in pdf.itertuples(index=False):
                rows += of_frame(r)
                entries += 1 if r.pixels is None else len(r.pixels)
                if entries >= HANDED_ON:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows, entries = [], 0
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return source.mapInPandas(run, f"pos int, t int, {schema}" + (f", {status} string" if status else ""))


def _per_pixel(frames: DataFrame, kernel: Callable[[np.ndarray], tuple], **kinds: str) -> DataFrame:
    """y, x and the values of every pixel: the kernel gives one array per column of a frame, which the JVM takes apart."""
    schema = "width int, " + ", ".join(f"{c} array<{kind}>" for c, kind in kinds.items())
    x = map_frames(frames, lambda r: [(int(r.width), *[np.ravel(a) for a in kernel(_image(r))])], schema)
    x = x.select("pos", "t", "width", F.posexplode(F.arrays_zip(*kinds)).alias("i", "p"))
    return x.select("pos", "t", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), *[F.col(f"p.{c}").alias(c) for c in kinds])


def thresholds(frames: DataFrame, technique: str, **parameters) -> DataFrame:
    """pos, t, y, x, threshold (null where undefined), foreground by a named technique."""

    def kernel(image):
        t = raster.threshold(image, technique, **parameters)
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(t), t, np.nan), np.where(np.isnan(t), False, image < t)

    x = _per_pixel(frames, kernel, threshold="double", foreground="boolean")
    return x.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold")))


def box_statistics(frames: DataFrame, window: int) -> DataFrame:
    return _per_pixel(frames, lambda image: raster.box_mean_std(image, window), mean="double", std="double")


def neighbour_maps(frames: DataFrame) -> DataFrame:
    """Per set pixel of ``pixels`` (non-zero): connectivity, direction bits and class."""
    x = _per_pixel(frames, lambda image: (image != 0, *raster.neighbours(image != 0)), there="boolean", connectivity="int", neighbourhood="int").where("there").drop("there")
    d = F.col("connectivity")
    return x.withColumn("pixel_class", F.when(d == 1, "end").when(d == 2, "edge").when(d > 2, "junction").otherwise("single"))


def labelled(frames: DataFrame) -> DataFrame:
    """y, x, label of every set pixel: 8-connected components, numbered in row-major order of their first pixel."""
    return _per_pixel(frames, lambda image: (raster.label(image != 0)[0],), label="int").where("label > 0")


def masks(frames: DataFrame, kernel: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """Frames whose pixels are 1.0 and 0.0 after a kernel on the boolean mask."""

    def run(r):
        m = kernel(_image(r) != 0, float(r.calibration))
        yield int(m.shape[0]), int(m.shape[1]), float(r.calibration), m.astype(float).ravel()

    return map_frames(frames, run, "height int, width int, calibration double, pixels array<double>")


def graphs(skeletons: DataFrame) -> DataFrame:
    """Per frame: nodes (id, y, x, kind, component) and edges (a, b, weight) as arrays, and the graph's statistics."""

    def run(r):
        g = kernel_graph.node_graph(_image(r) != 0, float(r.calibration))
        comp = g.components()
        s = g.statistics(float(r.calibration))
        nodes = [(i, float(y), float(x), "endpoint" if i < g.n_endpoints else "junction", comp[i]) for i, (y, x) in enumerate(g.points)]
        yield nodes, g.edges, float(s["graph_edge_length"]), float(s["graph_edge_count"]), int(s["graph_node_count"]), int(s["graph_junction_count"]), int(s["graph_endpoint_count"])

    node, edge = "struct<node_id:int,y:double,x:double,kind:string,component:int>", "struct<a:int,b:int,weight:double>"
    return map_frames(skeletons, run, f"nodes array<{node}>, edges array<{edge}>, graph_edge_length double, graph_edge_count double, graph_node_count bigint, graph_junction_count bigint, graph_endpoint_count bigint")


def pathlets_of(skeletons: DataFrame) -> DataFrame:
    """pos, t, pathlet_id, n_pixels, length of every polyline of a skeleton, in the order they are walked."""

    def run(r):
        for k, line in enumerate(kernel_graph.pathlets(_image(r) != 0)):
            yield k, len(line), kernel_graph.path_length(line)

    return map_frames(skeletons, run, "pathlet_id int, n_pixels int, length double")


def shortest_paths(graph_rows: DataFrame) -> DataFrame:
    """pos, t, a, b, distance, hops for every connected ordered pair of different nodes of each frame's graph."""

    def run(r):
        g = kernel_graph.NodeGraph(np.zeros((len(r.nodes), 2)), 0, {})
        for e in r.edges:
            g.weight.setdefault(int(e["a"]), {})[int(e["b"])] = float(e["weight"])
            g.weight.setdefault(int(e["b"]), {})[int(e["a"])] = float(e["weight"])
        far, hops = g.shortest(), g.shortest(False)
        for a, b in np.argwhere(np.isfinite(far)):
            if a != b:
                yield int(a), int(b), float(far[a, b]), int(hops[a, b])

    given = graph_rows.select(*KEY, "nodes", "edges", F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(1.0).alias("calibration"), F.array(F.lit(1.0)).alias("pixels"))
    return map_frames(given, run, "a int, b int, distance double, hops int")


def start_frame_subtracted(frames: DataFrame, reference_t: int = 1, sigma: float = 15.0) -> DataFrame:
    """Frames divided by the smoothed reference frame of their position and brought to 0-1; positions without it have none.

    A pixel where the smoothed reference is zero is null, as are all pixels of a constant quotient.
    """
    ref = frames.where(F.col("t") == reference_t).select("pos", F.col("pixels").alias("reference"))

    def run(r):
        image, ground = _image(r), raster.gaussian(np.asarray(r.reference, float).reshape(int(r.height), int(r.width)), sigma)
        with np.errstate(all="ignore"):
            q = image / ground
        q = np.where(np.isfinite(q), q, np.nan)
        low, high = (np.nanmin(q), np.nanmax(q)) if np.isfinite(q).any() else (np.nan, np.nan)
        with np.errstate(all="ignore"):
            out = ((q - low) / (high - low)).ravel()
        yield int(r.height), int(r.width), float(r.calibration), [float(v) if np.isfinite(v) else None for v in out]

    return map_frames(frames.join(ref, "pos"), run, "height int, width int, calibration double, pixels array<double>")


def inverted(frames: DataFrame) -> DataFrame:
    """Grey values turned around within each frame's own range: the darkest pixel becomes the brightest."""
    top = F.array_max("pixels") + F.array_min("pixels")
    return frames.withColumn("_top", top).withColumn("pixels", F.transform("pixels", lambda v: F.col("_top") - v)).drop("_top")
