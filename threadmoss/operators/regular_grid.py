"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

Plan: usable readings are averaged per (source, slot) with map-side combine; the slots of a source are cut into
buckets of ``SLOTS`` with a halo from either side, one row of arrays per bucket, so a source of any length is spread
over many tasks.  Each bucket's series is embedded as a Hankel trajectory matrix, truncated to its leading singular
vectors and averaged back along the anti-diagonals; only missing entries are replaced, again and again until they stand
still.  Arrow batches of buckets are solved together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .frametime import present, with_frame_seconds

SLOTS = 128
HALO = 24
OBSERVED, FILLED, UNSETTLED, MISSING = "observed", "filled", "unsettled", "missing"
#: a gap whose values still move after so many rounds is unsettled
ROUNDS = 5000


def impute(series: np.ndarray, window: int = 12, rank: int = 2, rounds: int = ROUNDS, tolerance: float = 1e-4) -> np.ndarray:
    """Fill the NaNs of each row of a matrix; rows are series of equal length."""
    return imputed(series, window, rank, rounds, tolerance)[0]


def imputed(series: np.ndarray, window: int = 12, rank: int = 2, rounds: int = ROUNDS, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """The rows with their NaNs filled, and which entries still moved by more than ``tolerance`` of the row's largest value in the last round.

    A row with fewer than two readings gets its single reading everywhere, an empty row stays NaN.
    """
    x = np.array(series, dtype=float)
    b, n = x.shape
    gap = np.isnan(x)
    grid = np.arange(n)
    for r in range(b):
        have = ~gap[r]
        if have.any() and gap[r].any():
            x[r, gap[r]] = np.interp(grid[gap[r]], grid[have], x[r, have])
    window = min(window, (n + 1) // 2)
    todo = np.flatnonzero(gap.any(axis=1) & ~np.isnan(x).any(axis=1) & ((~gap).sum(axis=1) > 2))
    moving = np.zeros_like(gap)
    if window < 2 or not todo.size:
        return x, moving
    scale = np.ones(b)
    scale[todo] = np.maximum(np.abs(x[todo]).max(axis=1), 1e-300)
    width = n - window + 1
    weight = np.zeros(n)
    for k in range(window):
        weight[k : k + width] += 1
    for _ in range(rounds):
        y = x[todo] / scale[todo, None]
        h = np.lib.stride_tricks.sliding_window_view(y, window, axis=1)
        _, v = np.linalg.eigh(h.transpose(0, 2, 1) @ h)
        top = v[:, :, -rank:]
        low = (h @ top) @ top.transpose(0, 2, 1)
        back = np.zeros_like(y)
        for k in range(window):
            back[:, k : k + width] += low[:, :, k]
        new = np.where(gap[todo], back / weight, y)
        moved = np.abs(new - y) > tolerance
        x[todo] = np.where(gap[todo], new * scale[todo, None], x[todo])
        moving[todo] = moved
        todo = todo[moved.any(axis=1)]
        if not todo.size:
            break
    return x, moving


def _solver(fields: tuple[str, ...], longest_fill: int, rounds: int = ROUNDS):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            lo = np.maximum(pdf["bucket"].to_numpy() * SLOTS - HALO, pdf["first_slot"].to_numpy())
            hi = np.minimum((pdf["bucket"].to_numpy() + 1) * SLOTS + HALO - 1, pdf["last_slot"].to_numpy())
            length = hi - lo + 1
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                read = {f: np.full((rows.size, int(n)), np.nan) for f in fields}
                count = np.zeros((rows.size, int(n)), dtype=np.int64)
                for k, r in enumerate(rows):
                    s = np.asarray(pdf["slots"].iat[r], dtype=np.int64) - lo[r]
                    if s.size:
                        count[k, s] = pdf["n"].iat[r]
                        for f in fields:
                            read[f][k, s] = pdf[f].iat[r]
                # an infinite reading stays in its own slot, but no gap is filled from it
                full, moving = {}, np.zeros(count.shape, dtype=bool)
                for f, m in read.items():
                    x, moves = imputed(np.where(np.isinf(m), np.nan, m), rounds=rounds)
                    full[f] = np.where(np.isinf(m), m, x)
                    moving |= moves
                # length of the gap that each slot lies in, within bucket and halo
                gap = count == 0
                run = np.zeros_like(count)
                for k in np.flatnonzero(gap.any(axis=1)):
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gap[k].astype(np.int8), [0]))))
                    for a, z in edge.reshape(-1, 2):
                        run[k, a:z] = z - a
                slot = lo[rows][:, None] + np.arange(int(n))
                mine = (slot // SLOTS) == pdf["bucket"].to_numpy()[rows][:, None]
                far = (run > longest_fill) | np.isnan(full[fields[0]])
                state = np.where(~gap, OBSERVED, np.where(far, MISSING, np.where(moving, UNSETTLED, FILLED)))
                out = {"pos": np.broadcast_to(pdf["pos"].to_numpy()[rows][:, None], slot.shape)[mine], "slot": slot[mine], "n_rows": count[mine], "state": state[mine]}
                for f in fields:
                    out[f] = np.where(far & gap, np.nan, full[f])[mine]
                parts.append(pd.DataFrame(out))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return solve


def regular_grid(readings: DataFrame, positions: DataFrame, fields: tuple[str, ...] = ("covered_ratio", "graph_edge_length"), longest_fill: int = HALO) -> DataFrame:
    """One row per slot between a source's first and last usable slot: pos, slot, n_rows, state and the fields.

    state is ``observed``, ``filled`` (imputed), ``unsettled`` (imputed, but still moving after ROUNDS rounds) or ``missing``
    (gap longer than ``longest_fill`` slots: fields are null).
    A row is usable if its timepoint and all fields are neither null nor NaN; several rows of one slot are averaged.
    Sources without a usable row, with a null key or without a planned interval yield no row.  Infinite times are not
    usable.  Extra columns of the input are ignored.
    """
    need = readings.select("pos", "meta_t", "timepoint", *fields)
    usable = present(F.col("timepoint"))
    for f in fields:
        usable = usable & present(F.col(f))
    timed = with_frame_seconds(need, positions).where(usable & present(F.col("seconds")) & (F.abs("seconds") < 1e15) & F.col("pos").isNotNull())
    slot = F.floor(F.col("seconds") / F.col("interval_s") + 0.5)
    per_slot = timed.groupBy("pos", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in fields])
    per_slot = Scratch(readings.sparkSession, "grid").save(per_slot, "slots")  # read twice: for the buckets and for the spans
    # each slot goes to its bucket, and near a border also to the neighbour's halo
    here = F.floor(F.col("slot") / SLOTS)
    reach = F.array_distinct(F.array(here, F.floor((F.col("slot") - HALO) / SLOTS), F.floor((F.col("slot") + HALO) / SLOTS)))
    buckets = per_slot.select("*", F.explode(reach).alias("bucket")).groupBy("pos", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("slot", "n", *fields))).alias("at")
    )
    spans = per_slot.groupBy("pos").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    every = spans.select("*", F.explode(F.sequence(F.floor(F.col("first_slot") / SLOTS), F.floor(F.col("last_slot") / SLOTS))).alias("bucket"))
    rows = every.join(buckets, ["pos", "bucket"], "left").select(
        "pos", "bucket", "first_slot", "last_slot", F.coalesce("at.slot", F.array().cast("array<bigint>")).alias("slots"),
        F.coalesce("at.n", F.array().cast("array<bigint>")).alias("n"), *[F.coalesce(f"at.{f}", F.array().cast("array<double>")).alias(f) for f in fields],
    )
    schema = "pos int, slot bigint, n_rows bigint, state string, " + ", ".join(f"{f} double" for f in fields)
    grid = rows.mapInPandas(_solver(fields, longest_fill), schema)
    return grid.select("pos", "slot", "n_rows", "state", *[F.when(~F.isnan(f), F.col(f)).alias(f) for f in fields])


def missing_slots(grid: DataFrame) -> DataFrame:
    """The slots without a usable row of their own, filled or not."""
    return grid.where(F.col("state") != OBSERVED).select("pos", "slot")
