"""Interval algebra by windows and scans."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contigua.operators.scan import scan

#: Width of the bins of interval joins: long against most intervals, short against chromosomes.
BIN = 1 << 17

#: So many times the shuffle partitions take joins whose rows are sorted where they arise, since they are many more than those that move.
FINER = 8


def overlapping(left: DataFrame, right: DataFrame, on: str, l_span: tuple[str, str], r_span: tuple[str, str], width: int = BIN) -> DataFrame:
    """Rows of both sides with the same ``on`` (a column of both) whose half-open spans share a base; column names must differ otherwise.

    Both sides are dealt out to bins of ``width`` and meet by (on, bin), a pair in the first
    bin that both are in, so rows far from each other on one sequence never meet and one
    sequence is many keys.
    """
    ls, le, rs, re = (F.col(c) for c in (*l_span, *r_span))
    at = lambda c: F.floor(c / width)
    bins = lambda a, b: F.explode(F.sequence(at(a), at(F.greatest(a, b - 1))))
    r = right.withColumn("_on", F.col(on)).drop(on).withColumn("_r_bin", bins(rs, re))
    j = left.withColumn("_bin", bins(ls, le)).join(r, (F.col(on) == F.col("_on")) & (F.col("_bin") == F.col("_r_bin")))
    return j.where((ls < re) & (le > rs) & (F.col("_bin") == F.greatest(at(ls), at(rs)))).drop("_on", "_bin", "_r_bin")


def within(left: DataFrame, right: DataFrame, on: str, l_span: tuple[str, str], r_span: tuple[str, str], width: int = BIN, dealt: bool = False) -> DataFrame:
    """Rows of both sides with the same ``on`` where the left span (a point too) lies whole in the right one.

    Only the right side is dealt out to bins; a left row meets what its start's bin holds.
    If ``dealt``, the rows stay dealt out by (on, _bin), to more tasks than else, and ``_bin``
    is one of their columns: a window by these and a left row's own key moves nothing.
    """
    ls, le, rs, re = (F.col(c) for c in (*l_span, *r_span))
    at = lambda c: F.floor(c / width)
    # A span may begin where the right one ends if it has no extent, so the bin of the end counts.
    r = right.withColumn("_on", F.col(on)).drop(on).withColumn("_r_bin", F.explode(F.sequence(at(rs), at(F.greatest(rs, re)))))
    x = left.withColumn("_bin", at(ls))
    if dealt:
        n = FINER * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Nulls meet nothing, and dealt out by key they would all be one task's.
        x = x.where(ls.isNotNull() & le.isNotNull() & F.col(on).isNotNull()).repartition(n, on, "_bin").hint("merge")
        r = r.where("_on is not null").repartition(n, "_on", "_r_bin")
    j = x.join(r, (F.col(on) == F.col("_on")) & (F.col("_bin") == F.col("_r_bin")))
    return j.where((ls >= rs) & (le <= re)).drop("_on", "_r_bin", *([] if dealt else ["_bin"]))


def complement_with_context(ranges: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """What ranges (key, start, end, mate_start, mate_end) leave free of each sequence (key, len), with what they match on both sides.

    (key, free_start, free_end, left_mate, right_mate, open_left, open_right): the mate's
    end before and its start after; an edge of the sequence has none and is open. Ranges
    don't overlap.
    """
    edges = ranges.select(key, "start", "end", "mate_start", "mate_end", F.lit(0).alias("last")).unionByName(lengths.select(key, F.col("len").alias("start"), F.col("len").alias("end"), F.lit(None).cast("long").alias("mate_start"), F.lit(None).cast("long").alias("mate_end"), F.lit(1).alias("last")))
    w = Window.partitionBy(key).orderBy("start", "last", "end")
    before = F.lag("end").over(w)
    x = edges.select(key, F.coalesce(before, F.lit(0)).alias("free_start"), F.col("start").alias("free_end"), F.lag("mate_end").over(w).alias("left_mate"), F.col("mate_start").alias("right_mate"), before.isNull().alias("open_left"), (F.col("last") == 1).alias("open_right"))
    return x.where("free_start < free_end")


def merge(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping intervals of a sequence as one each (touching ones stay apart)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.select(key, start, end, F.when(reach > F.col(start), 0).otherwise(1).alias("new"))
    numbered = islands.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("island")


def complement(merged: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """What intervals leave free of each sequence (key, len): between them, before the first and after the last."""
    edges = merged.select(key, "start", "end").unionByName(lengths.select(key, F.col("len").alias("start"), F.col("len").alias("end")))
    w = Window.partitionBy(key).orderBy("start", "end")
    return edges.select(key, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("free_start"), F.col("start").alias("free_end")).where("free_start < free_end")


class _Greedy:
    def __init__(self):
        self.stop = None

    def step(self, start, end):
        if self.stop is not None and start <= self.stop:
            return []
        self.stop = end
        return [(start, end)]

    def end(self):
        return []


def greedy(df: DataFrame, key: str) -> DataFrame:
    """Intervals in order of (start, end), each kept if it starts after the last kept one ends (closed ends); those with a null don't count."""
    return scan(df.where("start is not null and end is not null"), [key], [F.col("start"), F.col("end")], _Greedy, [df.schema["start"], df.schema["end"]])


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Run-length encoding: runs of equal values in order, with their number of rows."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = df.withColumn("new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return flagged.groupBy(key, "run", value).agg(F.count("*").alias("n"))


def nearest(points: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """For each (key, pos): the last gap that starts at or before it and the first that ends at or after it.

    One union and two running windows in place of a range join: both sides move once.
    """
    none = F.lit(None).cast("long")
    both = points.select(key, "pos", F.lit(1).alias("what"), none.alias("g"), none.alias("e")).unionByName(gaps.select(key, F.col("start").alias("pos"), F.lit(0).alias("what"), F.col("start").alias("g"), none.alias("e"))).unionByName(
        gaps.select(key, F.col("end").alias("pos"), F.lit(2).alias("what"), none.alias("g"), F.col("end").alias("e"))
    )
    w = Window.partitionBy(key).orderBy("pos", "what")
    up = F.last("g", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first("e", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.select(key, "pos", "what", up.alias("up"), down.alias("down")).where("what = 1").drop("what")


class _NonCrossing:
    def __init__(self):
        self.stop = None

    def step(self, *row):
        start, end = row[-2:]
        kept = start is not None and end is not None and (self.stop is None or start > self.stop)
        if kept:
            self.stop = end
        return [(*row, kept)]

    def end(self):
        return []


def noncrossing(df: DataFrame, key: str, order: list[str], start: str, end: str) -> DataFrame:
    """Rows in order, ``kept`` where the mate starts after the last kept mate ends; ``order`` must be unique within a key.

    A mate with a null end isn't kept.
    """
    columns = [*order, start, end]
    return scan(df, [key], [F.col(c) for c in columns], _NonCrossing, [*[df.schema[c] for c in columns], T.StructField("kept", T.BooleanType())])


def grow_regions(regions: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Regions (key, id, a, b) widened until no feature reaches over an edge: with the islands of features they overlap."""
    islands = merge(features, key).select(F.col(key).alias("i_key"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    met = overlapping(regions, islands.withColumnRenamed("i_key", key), key, ("a", "b"), ("i_start", "i_end"))
    edges = met.groupBy(F.col(key).alias("e_key"), F.col("id").alias("e_id"), F.col("a").alias("e_a"), F.col("b").alias("e_b")).agg(F.min("i_start").alias("lo"), F.max("i_end").alias("hi"))
    return regions.join(edges, (F.col(key) == F.col("e_key")) & (F.col("id") == F.col("e_id")) & (F.col("a") == F.col("e_a")) & (F.col("b") == F.col("e_b")), "left").select(key, "id", F.least("a", F.coalesce("lo", "a")).alias("a"), F.greatest("b", F.coalesce("hi", "b")).alias("b"))


def subtract_span(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """What of each row's [start, end) lies before ``lo`` (side left) and from ``hi`` on (side right); one row each."""
    left = F.struct(F.lit("left").alias("side"), F.col("start").alias("u_start"), F.least("end", lo).alias("u_end"))
    right = F.struct(F.lit("right").alias("side"), F.greatest("start", hi).alias("u_start"), F.col("end").alias("u_end"))
    return df.withColumn("__u", F.explode(F.array(left, right))).select(*df.columns, "__u.*").where("u_start < u_end")


class _Tolerant:
    def __init__(self, tolerance: int):
        self.tolerance, self.run, self.now = tolerance, 0, None

    def step(self, at, v):
        now = self.now
        if now and v is not None and now[0] is not None and abs(v - now[0]) <= self.tolerance:
            now[1], now[3] = now[1] + 1, at
            return []
        out = self.end()
        self.run, self.now = self.run + 1, [v, 1, at, at]
        return out

    def end(self):
        return [(self.run, *self.now)] if self.now else []


def tolerant_runs(df: DataFrame, key: str, order: str, value: str, tolerance: int) -> DataFrame:
    """(key, run, first, n, start, stop): a run goes on while values stay within ``tolerance`` of its first one.

    Every run counts, the last one too; a null is a run of its own.
    """
    fields = [T.StructField(c, T.LongType()) for c in ("run", "first", "n", "start", "stop")]
    return scan(df, [key], [F.col(order).cast("long"), F.col(value).cast("long")], partial(_Tolerant, tolerance), fields)
