"""Least-squares fits as aggregate columns, their p-values, and fits over the linear window of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.neighbours import with_rank
from ..scratch import Scratch

#: logarithm that stands for a non-finite one when a linear window is searched
LOWEST_LOG = float(np.log(np.finfo(float).eps))
PARTS = ("slope", "intercept", "rvalue", "stderr", "intercept_stderr")


def linregress(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates n, slope, intercept, rvalue, stderr, intercept_stderr over the rows where x and y are both given.

    Fewer than two rows or a constant x give nulls; a constant y gives slope 0 and rvalue null; two rows give errors of 0.
    """
    n, sxx, sxy, syy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    mx, my = F.regr_avgx(y, x), F.regr_avgy(y, x)
    slope = F.try_divide(sxy, sxx)
    r = F.try_divide(sxy, F.sqrt(sxx * syy))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    rest = F.when(n > 2, F.sqrt(F.try_divide((1 - F.coalesce(r, F.lit(0.0)) ** 2) * syy, sxx * (n - 2)))).when(slope.isNotNull(), F.lit(0.0))
    return {"n": n, "slope": slope, "intercept": my - slope * mx, "rvalue": r, "stderr": rest, "intercept_stderr": rest * F.sqrt(sxx / n + mx * mx)}


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def two_sided_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """p-value of a correlation r over n points under the t distribution with n - 2 degrees of freedom."""
    from math import lgamma

    r, n = np.asarray(r, float), np.asarray(n, float)
    out = np.full(r.shape, np.nan)
    out[(n == 2) & ~np.isnan(r)] = 1.0
    ok = (n > 2) & ~np.isnan(r)
    if ok.any():
        df = n[ok] - 2
        x = np.clip(1 - r[ok] ** 2, 0.0, 1.0)  # df / (df + t*t)
        a, b = df / 2, np.full_like(df, 0.5)
        const = np.array([lgamma(p + 0.5) - lgamma(p) - lgamma(0.5) for p in a])
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(const + a * np.log(x) + b * np.log1p(-x))
            low = x < (a + 1) / (a + b + 2)
            p = np.where(low, front * _betacf(a, b, x) / a, 1 - front * _betacf(b, a, 1 - x) / b)
        out[ok] = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, p))
    return out


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value; null where r is null or n is below 2."""

    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(r.to_numpy(float), n.to_numpy(float)))

    p = run(r.cast("double"), F.coalesce(n, F.lit(0)).cast("double"))
    return F.when(~F.isnan(p), p)


def optimized_regression(series: DataFrame, keys: list[str], x: str, y: str, share: float = 0.1, least: float = 0.9, bucket: float = 500_000.0) -> DataFrame:
    """Per group, the fit from the first to the last of the blocks whose own fit has an rvalue above ``least``.

    Points are ranked by x (ties by y) and cut into blocks of a tenth of the group, three at least; a block of one or two
    points counts.  Groups without such a block get nulls, and begin and end of -1.  Columns: the keys, begin_index,
    end_index (exclusive), begin, end, n and the parts of the fit.  Null x or y are left out; a non-finite y, such as the
    logarithm of zero, becomes LOWEST_LOG.  ``bucket`` is the stretch of x that one task ranks.
    """
    v = F.when(F.isnan(y) | (F.abs(F.col(y)) == float("inf")), F.lit(LOWEST_LOG)).otherwise(F.col(y))
    s = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), v.alias("_y"))
    s = with_rank(s, keys, ["_x", "_y"], F.floor(F.col("_x") / F.lit(bucket))).withColumnsRenamed({"rank": "_i", "group_n": "_n"})
    s = s.withColumn("_w", F.greatest(F.lit(3), F.floor(F.col("_n") * share)))
    s = Scratch(series.sparkSession, "series").save(s, "ranked")  # read for the blocks and for the fit
    blocks = s.groupBy(*keys, F.floor(F.col("_i") / F.col("_w")).alias("_b")).agg(F.min("_i").alias("b"), (F.max("_i") + 1).alias("e"), linregress(F.col("_x"), F.col("_y"))["rvalue"].alias("r"), F.max("_n").alias("_n"))
    span = blocks.groupBy(*keys).agg(F.min(F.when(F.col("r") > least, F.col("b"))).alias("begin_index"), F.max(F.when(F.col("r") > least, F.col("e"))).alias("end_index"), F.max("_n").alias("_n"))
    x_at = s.join(span.drop("_n"), keys)
    inside = (F.col("_i") >= F.col("begin_index")) & (F.col("_i") < F.col("end_index"))
    fit = linregress(F.when(inside, F.col("_x")), F.when(inside, F.col("_y")))
    last = F.when(F.col("end_index").isNotNull(), F.least(F.col("end_index"), F.col("_n") - 1))
    return x_at.groupBy(*keys).agg(
        F.max("begin_index").alias("begin_index"), F.max("end_index").alias("end_index"),
        F.coalesce(F.max(F.when(F.col("_i") == F.col("begin_index"), F.col("_x"))), F.lit(-1.0)).alias("begin"), F.coalesce(F.max(F.when(F.col("_i") == last, F.col("_x"))), F.lit(-1.0)).alias("end"),
        *[c.alias(k) for k, c in fit.items()],
    )
