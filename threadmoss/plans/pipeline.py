"""The whole analysis: frames to masks, skeletons and graphs; graphs to correspondences, tracks and growth; written as tables."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Tunables, thresholding_parameters
from ..functions.names import node_name
from ..functions.regression import p_value
from ..kernels import graph as kernel_graph
from ..kernels import raster
from ..operators.frames import map_frames
from ..operators.graphs import graphml_lines, graphml_of_graphs, overall_graph
from ..operators.tracking import fates_of, in_order, match_nodes, outcomes, steps_of
from ..operators.tracks import position_regressions, position_regressions_optimized, track_regressions, track_regressions_optimized, track_table
from ..scratch import Scratch

#: fixed values: published defaults of the techniques' parameters
PARAMETERS = {"window_size": 15, "k": 0.5, "r": 128.0, "p": 2.0, "q": 10.0, "a": 0.5, "gaussian_sigma": 3.0, "shift": 0.2, "target": -0.5, "quotient": 1.2, "window_size2": 30, "gamma": 2.0, "a1": 0.12, "k1": 0.25, "k2": 0.04}
_NODE, _EDGE = "array<struct<node_id:int,y:double,x:double,kind:string,component:int>>", "array<struct<a:int,b:int,weight:double>>"
FRAME_COLUMNS = f"calibration double, timepoint double, input_height double, input_width double, area double, covered_ratio double, covered_area double, graph_edge_length double, graph_edge_count double, graph_node_count bigint, graph_junction_count bigint, graph_endpoint_count bigint, height int, width int, skeleton binary, binary binary, image binary, image_hash string, nodes {_NODE}, edges {_EDGE}"


def analyse_frames(frames: DataFrame, tunables: Tunables = Tunables()) -> DataFrame:
    """One row per frame: statistics, packed mask and skeleton, nodes and edges, and ``failure``, null where the frame could be analysed.

    ``frames`` needs pos, t, timepoint, height, width, calibration and pixels (row-major), and may have dtype, the kind of pixel
    that its bytes are hashed as (double otherwise).  A frame that fails has its error in ``failure`` and nulls; a frame below
    4 x 4 pixels takes its whole position out.  With StoreImage the grey image of 0-255 is kept.  Box detection isn't there and
    is refused.
    """
    if tunables.BoxDetection:
        raise NotImplementedError("BoxDetection: frames are taken as cropped")
    given = thresholding_parameters(tunables.ThresholdingParameters, PARAMETERS) if tunables.ThresholdingParameters else {}
    small = frames.where((F.col("height") < 4) | (F.col("width") < 4)).select("pos").distinct()

    def kernel(r):
        cal = float(r.calibration)
        image = np.asarray(r.pixels, float).reshape(int(r.height), int(r.width))
        raw = image.astype(getattr(r, "dtype", None) or "float64").tobytes()
        if tunables.Invert:
            image = image.max() + image.min() - image
        image = raster.rescale_uint8(image)
        ch, cw = tunables.CropHeight, tunables.CropWidth
        image = image[ch : -(ch or 1), cw : -(cw or 1)]
        mask = image.astype(bool) if tunables.SkipBinarization else raster.binarize(image, tunables.ThresholdingTechnique, **given)
        if tunables.InvertBinarization:
            mask = ~mask
        mask = raster.clean_up(mask, cal, tunables.CleanUpGaussianSigma, tunables.CleanUpGaussianThreshold, tunables.CleanUpHoleFillSize)
        mask = raster.remove_small(mask, int(tunables.RemoveSmallStructuresSize / cal**2))
        mask = raster.remove_border_artifacts(mask, tunables.BorderArtifactRemovalBorderSize / cal)
        skeleton = raster.thin(mask)
        g = kernel_graph.node_graph(skeleton, cal, tunables.NodeEndpointMergeRadius, tunables.NodeJunctionMergeRadius, tunables.NodeLookupRadius, tunables.NodeLookupCutoffRadius)
        s, comp = g.statistics(cal), g.components()
        h, w = image.shape
        nodes = [(i, float(y), float(x), "endpoint" if i < g.n_endpoints else "junction", comp[i]) for i, (y, x) in enumerate(g.points)]
        yield (
            cal, float(r.timepoint), h * cal, w * cal, h * w * cal * cal, float(mask.mean()), float(mask.sum()) * cal * cal, float(s["graph_edge_length"]), float(s["graph_edge_count"]),
            s["graph_node_count"], s["graph_junction_count"], s["graph_endpoint_count"], h, w, np.packbits(skeleton).tobytes(), np.packbits(mask).tobytes(), image.tobytes() if tunables.StoreImage else None,
            base64.b64encode(hashlib.sha256(raw).digest()).decode(), nodes, g.edges,
        )

    return map_frames(frames.join(small, "pos", "left_anti"), kernel, FRAME_COLUMNS, status="failure")


@dataclass
class Analysis:
    """Tables of a run: analysed frames and failed ones, steps of tracks, kept tracks, fates of the others, fits, and graphs."""

    frames: DataFrame
    failures: DataFrame
    links: DataFrame
    steps: DataFrame
    fates: DataFrame
    tracks: DataFrame
    track_fits: DataFrame
    track_fits_optimized: DataFrame
    position_fits: DataFrame
    position_fits_optimized: DataFrame
    graphml: DataFrame
    overall_nodes: DataFrame
    overall_edges: DataFrame
    overall_graphml: DataFrame

    def write(self, folder: str, source: str) -> None:
        """Each table as Parquet under ``folder/<table>/source=<name>/pos=<n>``; a source that is there already is an error."""
        name = self.frames.sparkSession.range(1).select(node_name(F.lit(source))).first()[0]
        for table in fields(self):
            getattr(self, table.name).write.mode("errorifexists").partitionBy("pos").parquet(f"{folder}/{table.name}/source={name}")


def analyse(frames: DataFrame, tunables: Tunables = Tunables(), meta: str = "", label: str = "analysis") -> Analysis:
    """Run every stage; the frame table is written once and read by the later stages.  ``meta`` is kept with every frame."""
    scratch = Scratch(frames.sparkSession, label)
    every = scratch.save(analyse_frames(frames, tunables).withColumns({"tunables_hash": F.lit(tunables.hash()), "metadata": F.lit(meta)}), "frames")
    table = every.where("failure is null").drop("failure")
    ordered = scratch.save(in_order(table), "ordered")
    links = scratch.save(match_nodes(ordered, tunables), "links")
    told = outcomes(ordered, links, tunables)
    steps = scratch.save(steps_of(told), "steps")
    kept = track_table(steps, tunables)
    with_p = lambda df: df.withColumn("pvalue", p_value(F.col("rvalue"), F.col("n")))
    nodes, edges = overall_graph(ordered, links)
    return Analysis(
        table, every.where("failure is not null").select("pos", "t", "failure"), links, steps, fates_of(told), kept, with_p(track_regressions(steps, kept)), with_p(track_regressions_optimized(steps, kept)),
        with_p(position_regressions(table)), with_p(position_regressions_optimized(table)), graphml_of_graphs(table), nodes, edges, graphml_lines(nodes, edges),
    )


def read_results(spark, folder: str, table: str) -> DataFrame:
    """A table of all stored sources, with source and pos as columns; filters on them prune files."""
    return spark.read.parquet(f"{folder}/{table}")
