"""The true time of a frame, whatever unit its ``timepoint`` was stored in.

Frames of a position are planned ``interval_s`` apart, so ``timepoint / (frame number * interval_s)`` is near one for
seconds and near 1/60, 1/3600 or 1000 for minutes, hours and milliseconds.  Where that level is unclear (the first
frame, long pauses before an early frame) the neighbouring frames of the same position decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: seconds per stored unit
UNITS = (1.0, 0.001, 60.0, 3600.0)
#: frames of a position handled together; longer positions are split so that none fills a task
FRAMES_PER_BLOCK = 512


def present(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _nearest_unit(ratio: Column) -> Column:
    """The unit that brings the ratio closest to one."""
    costs = [F.abs(F.ln(ratio * F.lit(u))) for u in UNITS]
    best = F.least(*costs)
    out = F.lit(UNITS[-1])
    for u, c in reversed(list(zip(UNITS, costs))):
        out = F.when(c == best, F.lit(u)).otherwise(out)
    return out


def with_frame_seconds(frames: DataFrame, positions: DataFrame, key: str = "pos") -> DataFrame:
    """Add ``interval_s``, ``unit_s`` (seconds per stored unit) and ``seconds`` (true time, null without a timepoint).

    ``frames`` needs ``pos``, ``meta_t`` and ``timepoint``.  Rows of a position that ``positions`` doesn't know, or whose
    interval isn't positive, get nulls.  A NaN timepoint counts as absent.  Repeated rows get equal times.  Columns of the added names
    are replaced.
    """
    plan = positions.groupBy(key).agg(F.max("interval_s").alias("interval_s")).where("interval_s > 0")
    t = F.when(present(F.col("timepoint")), F.col("timepoint"))
    x = frames.drop("interval_s", "unit_s", "seconds").withColumn("_t", t).withColumn("_block", F.coalesce(F.floor(F.col("meta_t") / FRAMES_PER_BLOCK), F.lit(0)))
    # the interval goes to every block of its position, so that a hot position is joined block by block
    spans = x.groupBy(key).agg(F.min("_block").alias("_a"), F.max("_block").alias("_z")).join(plan, key)
    x = x.join(spans.select(key, "interval_s", F.explode(F.sequence("_a", "_z")).alias("_block")), [key, "_block"], "left")
    planned = F.col("meta_t") * F.col("interval_s")
    ratio = F.when((planned > 0) & (F.col("_t") > 0), F.col("_t") / planned)
    x = x.withColumn("_ratio", ratio).withColumn("_level", F.when(F.col("_ratio").isNotNull(), _nearest_unit(F.col("_ratio"))))
    # a level is sure while the frame is at most a few times later than planned in the unit found
    sure = F.col("_level").isNotNull() & (F.abs(F.ln(F.col("_ratio") * F.col("_level"))) < 1.1)
    x = x.withColumn("_anchor", F.when(sure, F.struct(F.col("meta_t").alias("m"), (F.col("_t") * F.col("_level")).alias("s"), F.col("_level").alias("u"))))
    w = Window.partitionBy(key, "_block").orderBy("meta_t")
    before = F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_anchor", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = x.withColumn("_before", before).withColumn("_after", after)
    near = F.coalesce("_after", "_before")
    # time the neighbour suggests, and how many slots each unit is away from it
    told = F.when(F.col("_after").isNotNull() & F.col("_before").isNotNull(), F.least(F.greatest(F.col("_before.s"), F.col("_after.s") - (F.col("_after.m") - F.col("meta_t")) * F.col("interval_s")), F.col("_after.s"))).otherwise(
        F.greatest(F.lit(0.0), near["s"] + (F.col("meta_t") - near["m"]) * F.col("interval_s"))
    )
    x = x.withColumn("_told", told).withColumn("_near_u", near["u"])
    far = [F.abs(F.col("_t") * F.lit(u) - F.col("_told")) for u in UNITS]
    closest = F.lit(UNITS[-1])
    for u, c in reversed(list(zip(UNITS, far))):
        closest = F.when(c == F.least(*far), F.lit(u)).otherwise(closest)
    local = F.when(F.abs(F.col("_t") * F.col("_near_u") - F.col("_told")) <= F.col("interval_s"), F.col("_near_u")).otherwise(closest)
    unit = F.when(sure, F.col("_level")).when(F.col("_told").isNotNull(), local).otherwise(F.coalesce("_level", F.lit(1.0)))
    x = x.withColumn("unit_s", F.when(F.col("_t").isNotNull() & F.col("interval_s").isNotNull(), unit))
    x = x.withColumn("seconds", F.col("_t") * F.col("unit_s"))
    return x.drop("_t", "_block", "_ratio", "_level", "_anchor", "_before", "_after", "_told", "_near_u")
