"""Chaining of hits and markers: dynamic programmes over sorted streams of a group's rows."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contigua.operators.frontier import HitChain, MarkerRun, Tiling
from contigua.operators.scan import scan
from contigua.session import cut, ship


LONG = T.LongType()


def _named(df: DataFrame, **columns) -> list[T.StructField]:
    """Fields of the types that columns have in ``df``; a type stands for itself."""
    return [T.StructField(k, c if isinstance(c, T.DataType) else df.schema[c].dataType) for k, c in columns.items()]


def _list(name: str, fields: list[T.StructField]) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StructType(fields)))


def _hits(hits: DataFrame, weight: str) -> tuple[DataFrame, list]:
    w = F.col(weight).cast("long")
    return hits.where((F.col("te") > F.col("ts")) & (F.col("qe") > F.col("qs")) & w.isNotNull()), [F.col("ts"), F.col("qs"), F.col("te"), F.col("qe"), w]


def best_chains(hits: DataFrame, keys: list[str], limit: int, weight: str = "matches") -> DataFrame:
    """Score of the heaviest chain of each group: next hits start 0 to ``limit`` after, on target and query.

    Hits (ts, te, qs, qe, weight) without extent on either side, or with a null, don't count.
    """
    good, values = _hits(hits, weight)
    return scan(good, keys, values, partial(HitChain, limit, False), [T.StructField("score", LONG)])


def _marks(marks: DataFrame) -> DataFrame:
    return marks.where("pos is not null and start is not null and end is not null")


def most_markers(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of markers (pos, start, end) whose map positions rise as their places do, places not overlapping; those with a null don't count."""
    return scan(_marks(marks), keys, [F.col(c) for c in ("pos", "start", "end")], partial(MarkerRun, False), [T.StructField("n_markers", LONG)])


def best_per_query(scores: DataFrame, query: str, target: str) -> DataFrame:
    """The best target of each query; ties go to the smaller target."""
    return scores.groupBy(query).agg(F.max_by(target, F.struct("score", -F.col(target))).alias(target), F.max("score").alias("score"))


def _tiles(hits: DataFrame) -> tuple[DataFrame, list]:
    return hits.where("te > ts"), [F.col("ts"), F.col("te"), F.coalesce(F.col("forced").cast("long"), F.lit(0).cast("long"))]


def best_tiling(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Most covered by hits (ts, te, forced) of each group in a row: the next one starts 0 to ``limit`` after the last one's end.

    A tiling has all forced hits; score is null where none can, as when they overlap.
    """
    good, values = _tiles(hits)
    return scan(good, keys, values, partial(Tiling, limit, False), [T.StructField("score", LONG)])


def chain_members(hits: DataFrame, keys: list[str], limit: int, weight: str = "matches") -> DataFrame:
    """The heaviest chain of each group, as ``best_chains`` scores it: score, n, region (t_start, t_end, q_start, q_end) and members in order.

    Of equally heavy chains the one with fewer hits, then the one whose hits (ts, qs, te, qe, weight) come first.
    """
    good, values = _hits(hits, weight)
    fields = _named(hits, score=LONG, n=LONG, t_start="ts", t_end="te", q_start="qs", q_end="qe")
    return scan(good, keys, values, partial(HitChain, limit, True), [*fields, _list("members", _named(hits, ts="ts", qs="qs", te="te", qe="qe", w=LONG))])


def marker_members(marks: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of each group, as ``most_markers`` counts it, with its markers (pos, start, end) in order; ties go to what comes first."""
    return scan(_marks(marks), keys, [F.col(c) for c in ("pos", "start", "end")], partial(MarkerRun, True), [T.StructField("n_markers", LONG), _list("members", _named(marks, pos="pos", start="start", end="end"))])


def tiling_members(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The tiling of each group that ``best_tiling`` scores, with its hits (ts, te, forced) in order; nothing where none can be.

    Of equally long tilings the one with fewer hits, then the one whose hits come first.
    """
    good, values = _tiles(hits)
    return scan(good, keys, values, partial(Tiling, limit, True), [T.StructField("score", LONG), _list("members", _named(hits, ts="ts", te="te", f=LONG))])


def widened(hits: DataFrame, keys: list[str], start: int, step: int, most: int) -> DataFrame:
    """``best_tiling`` with the least limit of start, start + step, ... that lets a tiling have all forced hits; ``limit`` tells which.

    Groups that are done leave the next round; beyond ``most`` the rest comes with a null score.
    """
    left, limit, out = hits, start, None
    while True:
        got = cut(best_tiling(left, keys, limit).withColumn("limit", F.lit(limit).cast("long")), "tilings")
        good = got.where("score is not null") if limit < most else got
        out = good if out is None else out.unionByName(good)
        bad = got.where("score is null").select(*[F.col(k).alias(f"b_{k}") for k in keys])
        if limit >= most or not bad.head(1):
            return out
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"b_{k}"))
        left, limit = hits.join(bad, same, "left_semi"), min(most, limit + step)


def edges(df: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """(keys, a, b): neighbours along each path."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(node).alias("a"), F.lead(node).over(w).alias("b")).where("b is not null")


def reachable(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): what edges (a, b) lead to from the starts (node), these too; a round of joins for each step."""
    seen = cut(starts.select("node").distinct(), "seen")
    front = seen
    while True:
        n = graph.join(front, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct()
        front = cut(n.join(seen, "node", "left_anti"), "front")
        if not front.head(1):
            return seen
        seen = cut(seen.unionByName(front), "seen")


def on_cycles(graph: DataFrame) -> DataFrame:
    """Edges (a, b) that no order of the nodes can have all forward: what is left after sources and sinks went, again and again.

    No rows for a graph without cycles.
    """
    left = cut(graph.select("a", "b").distinct(), "edges")
    while True:
        heads, tails = left.select(F.col("b").alias("n")).distinct(), left.select(F.col("a").alias("m")).distinct()
        inner = cut(left.join(heads, F.col("a") == F.col("n"), "left_semi").join(tails, F.col("b") == F.col("m"), "left_semi"), "edges")
        if inner.count() == left.count():
            return inner
        left = inner


def merged_order(path: list, forced: list) -> list:
    """A path with the forced ids put where their own order has them.

    Between two ids of the path that the forced list has in this order (its begin and end
    count as such) come the forced ids that lie between; a way round from an id back to
    itself is left out, by the shortest way from begin to end.
    """
    place = {x: i for i, x in enumerate(forced)}
    begin, end = ("begin",), ("end",)
    rank = {begin: -1, end: len(forced)} | {(x,): i for x, i in place.items()}
    ways: dict[tuple, list[tuple]] = {}
    at = begin
    for node in [*((x,) for x in path), end]:
        steps = [(x,) for x in forced[rank[at] + 1 : rank[node]]] + [node] if at in rank and node in rank and rank[at] < rank[node] else [node]
        for to in steps:
            ways.setdefault(at, []).append(to)
            at = to
    came, todo = {begin: begin}, [begin]
    for node in todo:
        for to in ways.get(node, []):
            if to not in came:
                came[to] = node
                todo.append(to)
    out, node = [], came.get(end, begin)
    while node != begin:
        out.append(node[0])
        node = came[node]
    return out[::-1]


def merge_orders(paths: DataFrame, forced: DataFrame) -> DataFrame:
    """(chr, ord, id): ``merged_order`` of each chromosome's path (chr, ord, id) and forced ids (chr, ord, id); one chromosome's ids are a task's."""
    ship(paths.sparkSession)

    def run(key, p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = merged_order(p.sort_values("ord")["id"].tolist(), f.sort_values("ord")["id"].tolist())
        return pd.DataFrame({"chr": [key[0]] * len(out), "ord": range(1, len(out) + 1), "id": out})

    kind = dict(paths.dtypes)
    return paths.groupBy("chr").cogroup(forced.groupBy("chr")).applyInPandas(run, f"chr {kind['chr']}, ord long, id {kind['id']}")
