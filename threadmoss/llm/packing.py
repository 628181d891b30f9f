"""Items of varying length into containers of fixed capacity, bound-certified and repacked.

Items are spread over partitions of bounded size; each is packed by best-fit decreasing and certified if it needs no more
containers than the lower bound of its dual feasible functions.  Partitions with gaps exchange documents: those of all open
containers of a partition that isn't certified, and those of the emptiest container of one that is, as each bound rounds its
last container up.  They are spread anew and packed again, until the number of containers meets the lower bound of the whole
or an exchange gains nothing.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .encoding import VOCABULARY, count_tokens

#: items that one task packs
ITEMS_PER_PARTITION = 2_000
#: thresholds of the dual feasible functions, as shares of the capacity
SHARES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)
#: steps of the rounding dual feasible functions
STEPS = (1, 2, 3, 4, 5)
_OUT = "kind string, part int, doc_id bigint, piece_no int, n_tokens int, bin int, filled int, certified boolean, emptiest boolean"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item and the number of containers: largest first, each where it leaves the least room."""
    order = np.argsort(-sizes, kind="stable")
    at = np.empty(sizes.size, dtype=np.int64)
    rooms: list[tuple[int, int]] = []  # (room left, container), sorted
    n = 0
    for i in order.tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b, n = capacity, n, n + 1
        at[i] = b
        bisect.insort(rooms, (room - s, b))
    return at, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of two families of dual feasible functions.

    For a threshold e, sizes above capacity - e count as a whole container, sizes below e as nothing, the others as they are.
    For a step k, a size counts as the multiples of 1/(k + 1) of the capacity in it, each as 1/k; as it is if it is such a multiple.
    """
    best = 0
    for share in SHARES:
        e = share * capacity
        big, small = sizes > capacity - e, sizes < e
        best = max(best, int(big.sum()) + math.ceil(int(sizes[~big & ~small].sum()) / capacity - 1e-9))
    for k in STEPS:
        whole, rest = np.divmod(sizes.astype(np.int64) * (k + 1), capacity)
        best = max(best, math.ceil(np.where(rest == 0, sizes / capacity, whole / k).sum() - 1e-6))
    return max(best, 1 if sizes.size else 0)


def _pack_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    sizes, cap = pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iat[0])
    at, n = best_fit_decreasing(sizes, cap)
    filled = np.bincount(at, weights=sizes, minlength=n).astype(np.int64)
    return pd.DataFrame({
        "kind": pdf["kind"], "part": pdf["part"], "doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "n_tokens": sizes, "bin": at, "filled": filled[at],
        "certified": n <= lower_bound(sizes, cap), "emptiest": at == int(filled.argmin()),
    })


def sized(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, size in tokens (0 for null)."""
    return documents.select("doc_id", count_tokens(F.col("text"), path).alias("size"))


def needed(n_tokens: Column, capacity: Column) -> Column:
    """Aggregate: containers that all items together need, by the same bound as lower_bound."""
    sums = [F.sum(F.when(n_tokens > capacity * (1 - s), capacity).when(n_tokens < capacity * s, 0).otherwise(n_tokens)) / F.max(capacity) for s in SHARES]
    for k in STEPS:
        many = n_tokens.cast("bigint") * (k + 1)
        sums.append(F.sum(F.when(many % capacity == 0, n_tokens / capacity).otherwise(F.floor(many / capacity) / k)))
    return F.ceil(F.greatest(*sums) - 1e-6)


def packed(sizes: DataFrame, kinds: DataFrame, label: str = "packing") -> DataFrame:
    """kind, doc_id, piece_no, n_tokens, container_id: every document in a container of every kind.

    A document longer than the capacity fills whole containers with its first pieces; its last piece is an item like any
    other document.  Documents of size 0 take their place in some container.  Repeated doc_ids are packed as often as they
    occur.  ``sizes`` has doc_id and size; null sizes count as 0.  Kinds without a positive capacity are left out.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, label)
    capacity = {r["kind"]: int(r["capacity_tokens"]) for r in kinds.where("kind is not null and capacity_tokens > 0").collect()}  # a fixed, tiny table
    if not capacity:
        return spark.createDataFrame([], "kind string, doc_id bigint, piece_no int, n_tokens int, container_id string")
    docs = scratch.save(sizes.select("doc_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), "sizes")
    n_docs = docs.count()
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in capacity.items()]))
    wanted = docs.select("doc_id", "size", kind.alias("k")).select("doc_id", "size", "k.*")
    wanted = wanted.withColumn("whole", F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")) - 1))
    full = wanted.where("whole > 0").select("kind", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("piece_no"), F.col("capacity").cast("int").alias("n_tokens"))
    full = full.select("*", F.concat_ws("-", "kind", F.lit("whole"), "doc_id", "piece_no").alias("container_id"))
    items = wanted.select("kind", "doc_id", F.col("whole").cast("int").alias("piece_no"), (F.col("size") - F.col("whole") * F.col("capacity")).cast("int").alias("n_tokens"), F.col("capacity").cast("int").alias("capacity"))
    items = scratch.save(items, "items")
    need = {r["kind"]: int(r["need"]) for r in items.groupBy("kind").agg(needed(F.col("n_tokens"), F.col("capacity")).alias("need")).collect()}

    def pack(pool: DataFrame, parts: int, r: int) -> tuple[DataFrame, dict[str, int]]:
        """The pool packed in so many partitions a kind, mixed anew in every round, and its number of containers by kind."""
        spread = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(r)), F.lit(parts)).cast("int"))
        out = scratch.save(spread.groupBy("kind", "part").applyInPandas(_pack_partition, _OUT), f"round-{r}")
        bins = out.groupBy("kind", "part").agg((F.max("bin") + 1).alias("n")).groupBy("kind").agg(F.sum("n").alias("n"))
        return out, {x["kind"]: x["n"] for x in bins.collect()}

    caps = F.create_map(*[x for k, c in capacity.items() for x in (F.lit(k), F.lit(c))])
    named = lambda df, r: df.select("kind", "doc_id", "piece_no", "n_tokens", F.concat_ws("-", "kind", F.lit(r), "part", "bin").alias("container_id"))
    parts = max(1, math.ceil(n_docs / ITEMS_PER_PARTITION))
    out, have = pack(items, parts, 0)
    closed, n_closed, r, done = [], dict.fromkeys(need, 0), 0, []
    while True:
        gaps = [k for k in have if n_closed[k] + have[k] > need[k]] if parts > 1 else []
        # kinds whose packing is certified as the best, or that can't exchange, are done
        done.append(named(out.where(~F.col("kind").isin(gaps)), r) if gaps else named(out, r))
        if not gaps:
            break
        roomy = F.col("kind").isin(gaps) & (F.col("filled") < caps[F.col("kind")]) & (~F.col("certified") | F.col("emptiest"))
        pool = out.where(roomy).select("kind", "doc_id", "piece_no", "n_tokens", caps[F.col("kind")].cast("int").alias("capacity"))
        given = {x["kind"]: x for x in out.where(roomy).groupBy("kind", "part", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("bins")).collect()}
        fewer = max(1, math.ceil(max((x["items"] for x in given.values()), default=0) / ITEMS_PER_PARTITION))
        again, packed_again = pack(pool, fewer, r + 1)
        gained = [k for k in gaps if k in given and packed_again[k] < given[k]["bins"]]
        # an exchange that gains nothing leaves the kind as it was
        done.append(named(out.where(F.col("kind").isin([k for k in gaps if k not in gained])), r))
        closed.append(named(out.where(F.col("kind").isin(gained) & ~roomy), r))
        for k in gained:
            n_closed[k] += have[k] - given[k]["bins"]
        out, have, parts, r = again.where(F.col("kind").isin(gained)), {k: packed_again[k] for k in gained}, fewer, r + 1
        if not gained:
            break
    result = full
    for part in (*done, *closed):
        result = result.unionByName(part)
    return result


def packing_report(assignment: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the volume bound, the dual feasible bound, what is above it, and the share of unused space."""
    x = assignment.join(kinds.select("kind", "capacity_tokens"), "kind")
    per = x.groupBy("kind", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("tokens"))
    total = per.groupBy("kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    bound = x.groupBy("kind").agg(needed(F.col("n_tokens"), F.col("capacity_tokens")).alias("bound"))
    out = total.join(bound, "kind")
    return out.select(
        "kind", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("volume_bound"), "bound", (F.col("n_containers") - F.col("bound")).alias("gap"),
        F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )


def packing_faults(assignment: DataFrame, sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind what must be none: containers above the capacity, documents split without need or into too many pieces, and sums that differ from the size."""
    k = kinds.where("kind is not null and capacity_tokens > 0").select("kind", F.col("capacity_tokens").alias("cap"))
    over = assignment.groupBy("kind", "container_id").agg(F.sum("n_tokens").alias("tokens")).join(k, "kind").groupBy("kind").agg(F.sum((F.col("tokens") > F.col("cap")).cast("bigint")).alias("n_over_capacity"))
    given = sizes.select("doc_id", F.coalesce("size", F.lit(0)).alias("size"))
    pieces = assignment.groupBy("kind", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")).join(given, "doc_id").join(k, "kind")
    apart = F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("cap")))
    docs = pieces.groupBy("kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(apart.cast("bigint")).alias("n_wrong_pieces"), F.sum((F.col("tokens") != F.col("size")).cast("bigint")).alias("n_wrong_sums"))
    return docs.join(over, "kind").select("kind", "n_documents", "n_over_capacity", "n_wrong_pieces", "n_wrong_sums")
