"""Implausible readings: spikes, stuck values and physically impossible ones, judged by their own source.

Plan: bounds are plain expressions.  The frames of a source go, cut into blocks with a halo, into one row of arrays per
block, so a source of any length is spread over many tasks.  Arrow batches of blocks are solved together in numpy by an
undecimated wavelet of three levels: the predict step of level w interpolates in time between the medians on either side of
a run of w frames, the detail is by how much the whole run leaves that prediction, and what remains without the largest
detail of the levels is the approximation, the source's course.  A first pass takes the source's own coefficients: the
median finest detail (noise) and the median change over as many frames as the widest level (growth), each block's medians
combined to the source's by their numbers of readings.  The second pass holds every detail against a limit made of these two.
A run of exactly zero first differences is a stuck value.  The verdicts are joined back to every row of the frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .frametime import FRAMES_PER_BLOCK, present, with_frame_seconds

FIELDS = ("covered_area", "graph_edge_length", "graph_node_count")
HALO = 24
#: frames that a spike lasts at most
WIDEST = 3
#: a stuck value is the same for so many successive frames
STUCK = 6
#: a detail beyond so many robust deviations of the noise and so many times the growth over a widest run is a spike; a count may
#: be off by its rounding besides
DEVIATIONS, GROWTHS, ROUNDINGS = 4.0, 1.5, {"graph_node_count": 1.0}


def _shift(a: np.ndarray, k: int) -> np.ndarray:
    """a[:, i + k] at i, NaN beyond the ends."""
    out = np.full_like(a, np.nan)
    n = a.shape[1]
    if abs(k) < n:
        if k >= 0:
            out[:, : n - k] = a[:, k:]
        else:
            out[:, -k:] = a[:, : n + k]
    return out


def _median3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Median of up to three values, the nearest first; farther ones may be NaN."""
    two = np.where(np.isnan(b), a, (a + b) / 2)
    three = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    return np.where(np.isnan(c) | np.isnan(b), two, three)


def _packed(keep: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The kept entries of each row moved to its left, NaN behind them, and where each came from."""
    order = np.argsort(~keep, axis=1, kind="stable")
    width = max(1, int(keep.sum(axis=1).max(initial=0)))
    order = order[:, :width]
    there = np.take_along_axis(keep, order, axis=1)
    return order, [np.where(there, np.take_along_axis(a, order, axis=1), np.nan) for a in arrays]


def own_coefficients(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of packed series: noise (robust deviation of the finest details), growth over WIDEST frames, and readings above zero."""
    before, after, later = _shift(y, -1), _shift(y, 1), _shift(y, WIDEST)
    tb, ta = _shift(t, -1), _shift(t, 1)
    with np.errstate(all="ignore"):
        detail = np.abs(np.where(y > 0, y - (before + (after - before) * (t - tb) / (ta - tb)), np.nan))
        change = np.abs(np.where((y > 0) & (later > 0), later - y, np.nan))

    def median(a):
        out, some = np.zeros(a.shape[0]), np.isfinite(a).any(axis=1)
        if some.any():
            out[some] = np.nanmedian(np.where(np.isfinite(a[some]), a[some], np.nan), axis=1)
        return out

    return median(detail) * 1.4826 / 1.2247, median(change), (y > 0).sum(axis=1)


def transform(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Details (level, row, sample) of packed series and the approximation; per sample the largest detail and it add up to y.

    A sample's detail at level w is that of the run of w samples around it that leaves its prediction the most, all to one side;
    a run that doesn't return, as at a step, or that goes on growing has none.
    """
    found, approximation = np.zeros((WIDEST, *y.shape)), y.copy()
    most = np.zeros_like(y)
    left, tl = _median3(_shift(y, -1), _shift(y, -2), _shift(y, -3)), _median3(_shift(t, -1), _shift(t, -2), _shift(t, -3))
    right0, tr0 = _median3(_shift(y, 1), _shift(y, 2), _shift(y, 3)), _median3(_shift(t, 1), _shift(t, 2), _shift(t, 3))
    for w in range(1, WIDEST + 1):
        right, tr = _shift(right0, w - 1), _shift(tr0, w - 1)
        each, bases = [], []
        for o in range(w):
            v, tv = _shift(y, o), _shift(t, o)
            with np.errstate(all="ignore"):
                base = left + (right - left) * (tv - tl) / (tr - tl)
            off, a, b = v - base, v - left, v - right
            size = np.minimum(np.abs(off), np.minimum(np.abs(a), np.abs(b)))
            same = (np.sign(a) == np.sign(b)) & (np.sign(a) == np.sign(off))
            each.append(np.where(same, size * np.sign(off), 0.0))
            bases.append(base)
        e = np.stack(each)
        low = np.where((e > 0).all(axis=0) | (e < 0).all(axis=0), np.abs(e).min(axis=0), 0.0)
        low = np.nan_to_num(low, nan=0.0)
        for o in range(w):
            here, base = np.nan_to_num(_shift(low, -o)), _shift(bases[o], -o)
            better = here > most
            most = np.where(better, here, most)
            approximation = np.where(better, base, approximation)
            found[w - 1] = np.maximum(found[w - 1], here)
    return found, approximation


def spikes(t: np.ndarray, y: np.ndarray, noise: np.ndarray, growth: np.ndarray, roundings: float = 0.0, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spikes of each row (times t, logarithms y, NaN where absent; the source's noise and growth): flags, course, threshold.

    What is flagged leaves the series before the next round, so that a spike doesn't hide its neighbours.
    """
    flag = np.zeros(y.shape, dtype=bool)
    course, threshold = y.copy(), np.full(y.shape, np.nan)
    own = (DEVIATIONS * noise + GROWTHS * growth)[:, None]
    for _ in range(rounds):
        keep = ~np.isnan(y) & ~np.isnan(t) & ~flag
        order, (tp, yp) = _packed(keep, t, y)
        found, base = transform(tp, yp)
        most = found.max(axis=0)
        limit = own + roundings * np.exp(-np.maximum(np.nan_to_num(base), 0.0))
        # only a sample that no neighbouring excursion explains better: the largest of each neighbourhood goes first
        peak = most
        for k in range(-WIDEST, WIDEST + 1):
            peak = np.fmax(peak, _shift(most, k))
        hit = (most > limit) & (most > 0.4 * peak)
        if not hit.any():
            break
        rows, cols = np.nonzero(hit)
        for whole, part in ((flag, True), (course, base[rows, cols]), (threshold, limit[rows, cols])):
            whole[rows, order[rows, cols]] = part
    return flag, course, threshold


def stuck_runs(v: np.ndarray) -> np.ndarray:
    """Every sample but the first of each run of at least STUCK equal non-zero values; NaN samples are stepped over."""
    order, (p,) = _packed(~np.isnan(v), v)
    n = p.shape[1]
    still = np.zeros(p.shape, dtype=bool)
    still[:, 1:] = (p[:, 1:] == p[:, :-1]) & (p[:, 1:] != 0)
    start = np.where(still, 0, np.arange(n))
    start = np.maximum.accumulate(start, axis=1)
    end = np.where(np.concatenate([still[:, 1:], np.zeros((p.shape[0], 1), bool)], axis=1), n, np.arange(n))
    end = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros(v.shape, dtype=bool)
    rows, cols = np.nonzero(still & (end - start + 1 >= STUCK))
    out[rows, order[rows, cols]] = True
    return out


def _matrices(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Blocks of like length as matrices in order of time: their rows in the batch, frame numbers, times, and each field's readings."""
    size = pdf["meta_t"].map(len).to_numpy()
    for lo, hi in ((0, 48), (48, 96), (96, 192), (192, 1 << 30)):
        rows = np.flatnonzero((size > lo) & (size <= hi))
        if not rows.size:
            continue
        n = int(size[rows].max())

        def matrix(name, rows=rows, n=n):
            out = np.full((rows.size, n), np.nan)
            for k, r in enumerate(rows):
                a = np.asarray(pdf[name].iat[r], dtype=float)
                out[k, : a.size] = a
            return out

        m, t = matrix("meta_t"), matrix("slot_time")
        for k, length in enumerate(size[rows]):  # a frame without a time stands where its number puts it
            lost = np.isnan(t[k, :length])
            if lost.any():
                have = ~lost
                late = np.median(t[k, :length][have] - m[k, :length][have]) if have.any() else 0.0
                at = np.interp(m[k, :length][lost], m[k, :length][have], t[k, :length][have] - m[k, :length][have]) if have.sum() > 1 else late
                t[k, :length][lost] = m[k, :length][lost] + at
        order = np.argsort(np.where(np.isnan(t), np.inf, t), axis=1, kind="stable")
        m, t = np.take_along_axis(m, order, axis=1), np.take_along_axis(t, order, axis=1)
        mine = (np.arange(n)[None, :] < size[rows][:, None]) & (np.floor(m / FRAMES_PER_BLOCK) == pdf["block"].to_numpy()[rows][:, None])
        yield rows, m, t, mine, {f: np.take_along_axis(matrix(f), order, axis=1) for f in FIELDS}


def _log(v: np.ndarray) -> np.ndarray:
    return np.log1p(np.where(v >= 0, v, np.nan))


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """pos, field, noise, growth, n of every block, its halo left out."""
    for pdf in batches:
        parts = []
        for rows, _, t, mine, values in _matrices(pdf):
            for f in FIELDS:
                y = _log(values[f])
                _, (tp, yp) = _packed(mine & ~np.isnan(y) & ~np.isnan(t), t, y)
                noise, growth, n = own_coefficients(tp, yp)
                parts.append(pd.DataFrame({"pos": pdf["pos"].to_numpy()[rows], "field": f, "noise": noise, "growth": growth, "n": n}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = []
        for rows, m, t, mine, values in _matrices(pdf):
            pos = np.broadcast_to(pdf["pos"].to_numpy()[rows][:, None], m.shape)
            own = [{k: x[k] for k in x} for x in pdf["own"].to_numpy()[rows]]
            for f in FIELDS:
                v = values[f]
                stuck = stuck_runs(v)
                noise, growth = (np.array([x[f"{c}_{f}"] or 0.0 for x in own]) for c in ("noise", "growth"))
                flag, course, limit = spikes(t, _log(v), noise, growth, ROUNDINGS.get(f, 0.0))
                keep = mine & ~np.isnan(v) & (flag | stuck)
                if keep.any():
                    parts.append(pd.DataFrame({
                        "pos": pos[keep], "meta_t": m[keep].astype("int32"), "field": f, "value": v[keep], "spike": flag[keep], "stuck": stuck[keep], "course": np.expm1(course[keep]), "threshold": limit[keep],
                    }))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def impossible(field: str) -> Column:
    """A reading that can't be real: negative, infinite, covering more than the frame, or longer or more numerous than its pixels allow."""
    v, cal = F.col(field).cast("double"), F.coalesce(F.when(F.col("calibration") > 0, F.col("calibration")), F.lit(0.065))
    most = {"covered_area": F.col("area"), "graph_edge_length": F.col("area") / cal, "graph_node_count": F.col("area") / (cal * cal)}[field]
    odd = (v < 0) | (v == F.lit(float("inf"))) | ((v > most) & present(F.col("area")))
    return present(v) & F.coalesce(odd, F.lit(False))


def implausible_readings(readings: DataFrame, positions: DataFrame) -> DataFrame:
    """Every implausible reading: row_id, pos, field, reason (impossible, spike or stuck), value, course.

    A frame is (pos, meta_t); copies of a frame share its verdict where they hold the same reading.  Null and NaN readings
    are never cases, nor are zeros before growth, lasting steps or growth across gaps.  Rows without pos or meta_t are held
    against the bounds alone.  Sources with fewer than three readings can't show a spike; stuck values are found in any source
    with a reading above zero.
    """
    need = readings.select("row_id", "pos", "meta_t", "timepoint", "area", "calibration", *[F.col(f).cast("double").alias(f) for f in FIELDS])
    rows = need.withColumns({f"_bad_{f}": impossible(f) for f in FIELDS})
    timed = with_frame_seconds(rows, positions).where("pos is not null and meta_t is not null")
    # the first reading of a frame that is there and possible; impossible readings are no part of the source's course
    read = lambda f: F.when(~F.col(f"_bad_{f}") & present(F.col(f)), F.col("row_id"))
    frames = timed.groupBy("pos", "meta_t").agg(F.min(F.col("seconds") / F.col("interval_s")).alias("slot_time"), *[F.min_by(f, read(f)).alias(f) for f in FIELDS])
    block = F.floor(F.col("meta_t") / FRAMES_PER_BLOCK)
    reach = F.array_distinct(F.array(block, F.floor((F.col("meta_t") - HALO) / FRAMES_PER_BLOCK), F.floor((F.col("meta_t") + HALO) / FRAMES_PER_BLOCK)))
    placed = frames.select("pos", "meta_t", "slot_time", *FIELDS, F.explode(reach).alias("block"))
    seq = placed.groupBy("pos", "block").agg(F.array_sort(F.collect_list(F.struct("meta_t", "slot_time", *FIELDS))).alias("at"))
    arrays = seq.select("pos", "block", F.col("at.slot_time").alias("slot_time"), F.col("at.meta_t").alias("meta_t"), *[F.col(f"at.{f}").alias(f) for f in FIELDS])
    arrays = Scratch(readings.sparkSession, "spikes").save(arrays, "blocks")  # read by both passes
    learned = arrays.mapInPandas(_learn, "pos int, field string, noise double, growth double, n bigint").where("n > 0")
    of_source = lambda c, f: F.expr(f"percentile({c}, 0.5, n) FILTER (WHERE field = '{f}')").alias(f"{c}_{f}")
    own = learned.groupBy("pos").agg(*[of_source(c, f) for f in FIELDS for c in ("noise", "growth")])
    judged = arrays.join(own.select("pos", F.struct(*[f"{c}_{f}" for f in FIELDS for c in ("noise", "growth")]).alias("own")), "pos")
    verdicts = judged.mapInPandas(_judge, "pos int, meta_t int, field string, value double, spike boolean, stuck boolean, course double, threshold double")
    long = rows.select("row_id", "pos", "meta_t", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"_bad_{f}").alias("bad")) for f in FIELDS])).alias("r")).select("row_id", "pos", "meta_t", "r.*")
    shared = long.where("not bad").join(verdicts.withColumnRenamed("value", "v0"), ["pos", "meta_t", "field"]).where("value = v0")
    return long.where("bad").select("row_id", "pos", "field", F.lit("impossible").alias("reason"), "value", F.lit(None).cast("double").alias("course")).unionByName(
        shared.select("row_id", "pos", "field", F.when(F.col("spike"), "spike").otherwise("stuck").alias("reason"), "value", F.when(F.col("spike"), F.col("course")).alias("course"))
    )
