"""Frames in pairs, correspondences, tracks and growth: the time-series operators, all as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tunables
from ..functions.regression import linregress, optimized_regression
from .frametime import present
from .neighbours import with_previous, with_rank

#: stretch of time in seconds that one task orders
STRETCH = 500_000.0


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(present(c) & (F.abs(d) != F.lit(float("inf"))), d)


def clean_steps(track_steps: DataFrame) -> DataFrame:
    """Each step of a track once, with its distance; steps without distance are left out."""
    need = track_steps.select("pos", "track_id", "i", "timepoint", "node_id_a", "node_id_b", "node_next_id_a", "node_next_id_b", finite(F.col("distance")).alias("distance"), "distance_num")
    return need.where("distance is not null").distinct()


def pairwise(frames: DataFrame, keys: list[str], order: str, carry: list[str]) -> DataFrame:
    """Consecutive pairs: every frame with a struct ``following`` of the next frame of its group (the last has none)."""
    x = frames.withColumn("_back", -F.col(order))
    return with_previous(x, keys, ["_back"], F.floor(F.col("_back") / F.lit(STRETCH)), carry, "following").where("following is not null").drop("_back")


def taken_while(frames: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """Frames before the first one of their group for which ``stop`` holds; null counts as not holding."""
    first = frames.where(stop).groupBy(*keys).agg(F.min(order).alias("_stop"))
    return frames.join(first, keys, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def reverse_links(links: DataFrame) -> DataFrame:
    """successor_to_self: per node of the next frame, the last node of this frame that names it as its successor."""
    named = links.where("next_id >= 0").select("pos", "t", F.col("next_id").cast("int").alias("next_id"), "node_id")
    return named.groupBy("pos", "t", "next_id").agg(F.max("node_id").alias("node_id"), F.count_distinct("node_id").alias("n_candidates"))


def shrinkage_allowed(now: Column, later: Column, tunables: Tunables = Tunables()) -> Column:
    """Whether a length may follow another: growth, or a loss below the tolerated share; zero lengths never."""
    shrunk = F.abs(1 - F.try_divide(now, later)) < tunables.TrackingMaximumRelativeShrinkage
    return (now != 0) & (later != 0) & ((later > now) | F.coalesce(shrunk, F.lit(False)))


def smoothed(steps: DataFrame, reach: int = 2, block: int = 4096) -> DataFrame:
    """pos, track_id, i, smoothed: mean length over the steps up to ``reach`` rows before and after (fewer at the ends).

    Tracks are cut into blocks of ``block`` rows; rows near a border also stand in the neighbouring block.
    """
    x = with_rank(steps, ["pos", "track_id"], ["i", "timepoint", "distance"], F.floor(F.col("i") / block))
    home = F.floor(F.col("rank") / block)
    reached = F.array_distinct(F.array(home, F.floor((F.col("rank") - reach) / block), F.floor((F.col("rank") + reach) / block)))
    y = x.select("pos", "track_id", "i", "distance", "rank", home.alias("home"), F.explode(reached).alias("part"))
    w = Window.partitionBy("pos", "track_id", "part").orderBy("rank").rowsBetween(-reach, reach)
    return y.withColumn("smoothed", F.avg("distance").over(w)).where("home = part").select("pos", "track_id", "i", "smoothed")


def step_fates(steps: DataFrame, tunables: Tunables = Tunables()) -> DataFrame:
    """Every step with the next one of its track, its rate in micrometres per hour and what becomes of it.

    fate: ``last`` for a track's last step, ``shortcut`` beyond the tolerated shrinkage, ``rate`` outside the (open) range of
    elongation rates, else ``goes on``.  Steps at one time have no rate.
    """
    x = with_previous(steps.withColumn("_back", -F.col("timepoint")), ["pos", "track_id"], ["_back", "i"], F.floor(F.col("_back") / F.lit(STRETCH)), ["timepoint", "distance"], "following").drop("_back")
    later, hours = F.col("following.distance"), (F.col("following.timepoint") - F.col("timepoint")) / 3600
    rate = F.try_divide(later - F.col("distance"), hours)
    short = (later < F.col("distance")) & (F.coalesce(F.abs(1 - F.try_divide(F.col("distance"), later)), F.lit(float("inf"))) > tunables.TrackingMaximumRelativeShrinkage)
    inside = (rate > tunables.TrackingMinimumTipElongationRate) & (rate < tunables.TrackingMaximumTipElongationRate)
    fate = F.when(later.isNull(), "last").when(short, "shortcut").when(~F.coalesce(inside, F.lit(False)), "rate").otherwise("goes on")
    return x.select("pos", "track_id", "i", "timepoint", "distance", later.alias("next_distance"), rate.alias("mu_per_h"), fate.alias("fate"))


def track_table(steps: DataFrame, tunables: Tunables = Tunables()) -> DataFrame:
    """One row per kept track: extremes, duration, count, and grown length.

    Kept are tracks with enough points, a sufficient greatest length, and a sufficient span from the least to the greatest length.
    """
    t = steps.groupBy("pos", "track_id").agg(
        F.min("timepoint").alias("timepoint_begin"), F.max("timepoint").alias("timepoint_end"),
        F.min("distance").alias("minimum_distance"), F.max("distance").alias("maximum_distance"),
        F.min("distance_num").alias("minimum_distance_num"), F.max("distance_num").alias("maximum_distance_num"),
        F.count(F.lit(1)).alias("count"), (F.max("distance") - F.min("distance")).alias("grown"),
    )
    t = t.withColumn("timepoint_center", F.col("timepoint_begin") + (F.col("timepoint_end") - F.col("timepoint_begin")) / 2).withColumn("duration", F.col("timepoint_end") - F.col("timepoint_begin"))
    kept = (F.col("count") >= tunables.TrackingMinimumTrackedPointCount) & (F.col("maximum_distance") >= tunables.TrackingMinimalMaximumLength) & (F.col("grown") >= tunables.TrackingMinimalGrownLength) & (F.col("grown") != 0)
    return t.where(kept)


#: family -> value regressed on time; each also over its linear window, prefixed ``optimized_``
FAMILIES = ("plain_regression", "normalized_regression", "logarithmic_plain_regression", "logarithmic_normalized_regression")


def _families(steps: DataFrame, kept: DataFrame) -> DataFrame:
    x = steps.select("pos", "track_id", "timepoint", "distance").join(kept.select("pos", "track_id", "minimum_distance"), ["pos", "track_id"])
    norm = F.try_divide(F.col("distance"), F.col("minimum_distance"))
    log = lambda c: F.when(c > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
    values = (F.col("distance"), norm, log(F.col("distance")), log(norm))
    return x.select("pos", "track_id", "timepoint", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), v.alias("y")) for f, v in zip(FAMILIES, values)])).alias("f")).select("pos", "track_id", "timepoint", "f.*")


def track_regressions(steps: DataFrame, kept: DataFrame) -> DataFrame:
    """pos, track_id, family and the plain fit of each kept track; a logarithm of zero leaves the fit null."""
    x = _families(steps, kept)
    whole = F.min("y") > F.lit(float("-inf"))
    y = finite(F.col("y"))
    return x.groupBy("pos", "track_id", "family").agg(*[F.when(whole, c).alias(k) for k, c in linregress(F.col("timepoint"), y).items()])


def track_regressions_optimized(steps: DataFrame, kept: DataFrame) -> DataFrame:
    return optimized_regression(_families(steps, kept), ["pos", "track_id", "family"], "timepoint", "y", bucket=STRETCH)


POSITION_FIELDS = ("covered_ratio", "covered_area", "graph_edge_length", "graph_edge_count", "graph_node_count", "graph_junction_count", "graph_endpoint_count")


def _position_series(result_table: DataFrame) -> DataFrame:
    log = lambda c: F.when(c > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
    v = [finite(F.col(f)) for f in POSITION_FIELDS]
    pairs = [F.struct(F.lit(f).alias("field"), F.lit(s).alias("scale"), (c if s == "linear" else F.when(c.isNotNull(), log(c))).alias("y")) for f, c in zip(POSITION_FIELDS, v) for s in ("linear", "logarithmic")]
    x = result_table.select("pos", finite(F.col("timepoint")).alias("timepoint"), F.explode(F.array(*pairs)).alias("p"))
    return x.select("pos", "timepoint", "p.*").where("timepoint is not null and y is not null")


def position_regressions(result_table: DataFrame) -> DataFrame:
    """pos, field, scale and the fit of the field (or its logarithm) over time, frame rows as delivered."""
    x = _position_series(result_table)
    whole = F.min("y") > F.lit(float("-inf"))
    return x.groupBy("pos", "field", "scale").agg(*[F.when(whole, c).alias(k) for k, c in linregress(F.col("timepoint"), finite(F.col("y"))).items()])


def position_regressions_optimized(result_table: DataFrame) -> DataFrame:
    return optimized_regression(_position_series(result_table), ["pos", "field", "scale"], "timepoint", "y", bucket=STRETCH)


def position_regressions_wide(result_table: DataFrame, part: str = "slope") -> DataFrame:
    """One row per position with a column ``<field>_<scale>_regression_<part>`` for every field and scale."""
    x = position_regressions(result_table)
    cols = [F.max(F.when((F.col("field") == f) & (F.col("scale") == s), F.col(part))).alias(f"{f}_{s}_regression_{part}") for f in POSITION_FIELDS for s in ("linear", "logarithmic")]
    return x.groupBy("pos").agg(*cols)
