"""Packing by optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket boundaries
that minimise padding. Inside each bucket, documents in order of length fill batches
whose padded size stays within a token budget. Ranks inside a bucket come from a range
partitioned table and the counts of its partitions, so one bucket may hold any share of
all rows without a task of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.session import cut

BUCKETS, BUDGET = 16, 32_768
WORDS = r"[^\x20\x09-\x0D]+"


def _best_cuts(cost: np.ndarray, n: np.ndarray, t: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j the least cost[i] + padding of one bucket for the lengths i to j, and its least i.

    The padding meets the quadrangle inequality, so the best i rises with j: ends are taken
    halves first, each within the answers of its neighbours, a whole level at a time.
    """
    d = len(lengths)
    best, at = np.empty(d + 1, np.int64), np.zeros(d + 1, np.int64)
    best[0] = cost[0]
    lo, hi = np.array([1]), np.array([d])  # open ranges of ends
    least, most = np.array([0]), np.array([d - 1])  # where their answers lie
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(most, mid - 1) - least + 1
        starts = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(mid)), size)
        i = np.arange(len(seg)) - starts[seg] + least[seg]
        j = mid[seg]
        c = cost[i] + (n[j] - n[i]) * lengths[j - 1] - (t[j] - t[i])
        low = np.minimum.reduceat(c, starts)
        hit = np.flatnonzero(c == low[seg])
        first = hit[np.searchsorted(seg[hit], np.arange(len(mid)))]
        best[mid], at[mid] = low, i[first]
        got = i[first]
        left, right = lo < mid, mid < hi
        lo, hi = np.r_[lo[left], mid[right] + 1], np.r_[mid[left] - 1, hi[right]]
        least, most = np.r_[least[left], got[right]], np.r_[got[left], most[right]]
    return best, at


def boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` of the ascending ``lengths``, the last among them, with the least padding.

    ``counts`` are the documents for each length, ``totals`` the sums of their true lengths.
    Time is buckets x lengths x log(lengths), all in whole numbers.
    """
    d = len(lengths)
    if not d:
        return []
    n = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    t = np.concatenate(([0], np.cumsum(np.asarray(totals, np.int64))))
    lengths = np.asarray(lengths, np.int64)
    # A round allows one bucket more (an empty one costs nothing).
    cost, back = np.r_[0, n[1:] * lengths - t[1:]], [np.zeros(d + 1, np.int64)]
    best, rounds = cost[d], 1
    for _ in range(min(buckets, d) - 1):
        cost, at = _best_cuts(cost, n, t, lengths)
        back.append(at)
        if cost[d] < best:
            best, rounds = cost[d], len(back)
    out, j = [], d
    for at in reversed(back[:rounds]):
        if j:
            out.append(int(lengths[j - 1]))
            j = at[j]
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding.

    n_tokens counts words (null text has none, and takes a place all the same). A batch is
    (bucket, batch): at most ``budget // bucket_len`` documents, each padded to bucket_len;
    a document longer than the budget is a batch by itself. Order inside a bucket: length,
    then doc_id, nulls first; rows equal in both (repeated rows too) come in any order.
    Every row is placed, a repeated one as often as it comes; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    lengths = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("n_tokens")), "lengths")
    spark = docs.sparkSession
    one = F.greatest("n_tokens", F.lit(1))
    # One row for each different length; D of them need D*D/2 words, so even 10**13 words have some millions at most.
    histogram = lengths.groupBy(one.alias("at")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
    at, n, t = (np.array([r[c] for r in sorted(histogram)], np.int64) for c in ("at", "n", "t"))
    edges = boundaries(at, n, t, buckets)
    if not edges:
        edges = [1]
    array = F.array(*[F.lit(e).cast("long") for e in edges])
    rows = lengths.withColumn("bucket", F.size(F.filter(array, lambda e: e < F.col("n_tokens"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(parts, "bucket", "n_tokens", "doc_id").sortWithinPartitions("bucket", "n_tokens", "doc_id").withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("at", 33)
    # At most one row for each partition and bucket that meet: partitions + buckets of them.
    sums = ordered.groupBy("bucket", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ordered.withColumn("part", part).join(F.broadcast(before.select("bucket", "part", "first", "before")), ["bucket", "part"])
    rank, length = F.col("before") + F.col("at") - F.col("first"), F.get(array, F.col("bucket"))
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / length)).cast("long")
    return ranked.withColumn("rank", rank).select(
        "doc_id", "n_tokens", "bucket", length.alias("bucket_len"), F.floor(F.col("rank") / holds).cast("long").alias("batch"),
        F.pmod("rank", holds).cast("long").alias("slot"), (length - F.col("n_tokens")).alias("padding"),
    )
