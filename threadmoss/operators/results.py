"""Records and result tables: ranges, projections, crops, lookups."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frametime import present
from .neighbours import with_rank


def in_range(value: Column, text: str) -> Column:
    """Whether a number lies in a selection such as ``0-9,20,30-``; an empty text selects everything."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts:
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        low, dash, high = p.partition("-")
        if not dash:
            out = out | (value == int(low))
        else:
            hit = value >= int(low or 0)
            out = out | (hit & (value <= int(high)) if high else hit)
    return out


def project(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Columns by name or wildcard, in the order of the patterns; a plain name that is absent becomes a NaN column."""
    names: list[str] = []
    for p in patterns:
        if any(ch in p for ch in "*?["):
            names += [c for c in sorted(df.columns) if fnmatch.fnmatchcase(c, p) and c not in names]
        elif p not in names:
            names.append(p)
    return df.select(*[F.col(c) if c in df.columns else F.lit(float("nan")).alias(c) for c in names])


def crop_margins(frames: DataFrame, crop_height: int, crop_width: int) -> DataFrame:
    """Crop bounds moved inwards, and the size that is left."""
    t, b, l, r = F.col("crop_t") + crop_height, F.col("crop_b") - crop_height, F.col("crop_l") + crop_width, F.col("crop_r") - crop_width
    return frames.select("row_id", t.alias("crop_t"), b.alias("crop_b"), l.alias("crop_l"), r.alias("crop_r"), (b - t).alias("height"), (r - l).alias("width"))


def copied_calibration(frames: DataFrame) -> DataFrame:
    """Per position the calibration of its first row, and whether all rows agree; absent calibrations don't count."""
    x = frames.where(present(F.col("calibration")))
    return x.groupBy("pos").agg(F.min_by("calibration", "row_id").alias("calibration"), (F.min("calibration") == F.max("calibration")).alias("is_constant"))


def divided_by_reference(frames: DataFrame, reference_t: int = 1) -> DataFrame:
    """Mean over the pixels of frame / reference frame of its position; zero pixels of the reference are left out."""
    ref = frames.where(F.col("t") == reference_t).select("pos", F.col("pixels").alias("reference"))
    x = frames.join(ref, "pos").withColumn("q", F.filter(F.zip_with("pixels", "reference", lambda a, b: F.try_divide(a, b)), lambda v: v.isNotNull()))
    return x.select("pos", "t", F.try_divide(F.aggregate("q", F.lit(0.0), lambda a, v: a + v), F.size("q")).alias("mean_ratio"))


def aux_mapping(kept: DataFrame) -> DataFrame:
    """Number of each kept track within its position, and the name of its own table."""
    numbered = with_rank(kept.select("pos", "track_id"), ["pos"], ["track_id"], F.floor(F.col("track_id") / 10_000))
    return numbered.select("pos", "track_id", F.col("rank").cast("int").alias("aux_table")).withColumn("individual_table", F.format_string("track_table_aux_tables_%09d", F.col("aux_table")))


def longest_tracks(steps: DataFrame, kept: DataFrame) -> DataFrame:
    """Steps of the track with the most points of each position (ties: smaller track), relative to the track's least distance."""
    best = kept.groupBy("pos").agg(F.min_by("track_id", F.struct(-F.col("count"), "track_id")).alias("track_id"))
    s = steps.join(best, ["pos", "track_id"], "left_semi")
    low = s.groupBy("pos", "track_id").agg(F.min("distance").alias("low"))
    return s.join(low, ["pos", "track_id"]).select("pos", "track_id", "i", (F.col("distance") - F.col("low")).alias("relative_distance"))


def overview(result_table: DataFrame) -> DataFrame:
    """What a store holds per recording as named: positions, frames, last time."""
    t = F.when(present(F.col("timepoint")) & (F.abs("timepoint") != float("inf")), F.col("timepoint"))
    return result_table.groupBy("filename").agg(F.count_distinct("meta_pos").alias("n_positions"), F.count(F.lit(1)).alias("n_frames"), F.max(t).alias("last_timepoint"))
