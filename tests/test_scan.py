"""Scans against brute force, over batches, hot keys and nulls."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from contigua.operators import chain, frontier, intervals, ranks, structure
from contigua.operators.scan import Chain, first


def _ways(rows, goes_on):
    """All non-empty subsets in order whose neighbours may follow each other."""
    for n in range(1, len(rows) + 1):
        for c in combinations(range(len(rows)), n):
            if all(goes_on(rows[a], rows[b]) for a, b in zip(c, c[1:], strict=False)):
                yield c


def _hits(rng, n, far):
    out = []
    for _ in range(n):
        t, q = rng.randrange(far), rng.randrange(far)
        out.append((t, q, t + rng.randrange(1, 6), q + rng.randrange(1, 6), rng.randrange(4)))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_hit_chains_equal_all_subsets(block, monkeypatch):
    monkeypatch.setattr(frontier, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(150):
        limit = rng.choice([0, 1, 3, 8, 100])
        rows = _hits(rng, rng.randrange(1, 10), rng.choice([5, 15, 30]))
        state = frontier.HitChain(limit, True)
        for r in rows:
            assert state.step(*r) == []
        want = min((-sum(rows[i][4] for i in c), len(c), c) for c in _ways(rows, lambda y, x: 0 <= x[0] - y[2] <= limit and 0 <= x[1] - y[3] <= limit))
        score, n, *_, members = state.end()[0]
        assert (-score, n, [tuple(m.values()) for m in members]) == (want[0], want[1], [rows[i] for i in want[2]])


def test_marker_runs_equal_all_subsets():
    rng = random.Random(3)
    for _ in range(200):
        rows = sorted((rng.randrange(8), s := rng.randrange(20), s + rng.randrange(-1, 6)) for _ in range(rng.randrange(1, 10)))
        state = frontier.MarkerRun(True)
        for r in rows:
            state.step(*r)
        want = min((-len(c), c) for c in _ways(rows, lambda y, x: x[0] > y[0] and x[1] >= y[2]))
        n, members = state.end()[0]
        assert (-n, [tuple(m.values()) for m in members]) == (want[0], [rows[i] for i in want[1]])


def test_tilings_equal_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        limit = rng.choice([0, 2, 5, 50])
        rows = sorted((s := rng.randrange(30), s + rng.randrange(1, 8), int(rng.random() < 0.2)) for _ in range(rng.randrange(1, 10)))
        state = frontier.Tiling(limit, True)
        for r in rows:
            state.step(*r)
        forced = {i for i, r in enumerate(rows) if r[2]}
        ways = [(-sum(rows[i][1] - rows[i][0] for i in c), len(c), c) for c in _ways(rows, lambda y, x: 0 <= x[0] - y[1] <= limit) if forced <= set(c)]
        got = state.end()
        assert bool(got) == bool(ways)
        if ways:
            assert (-got[0][0], [tuple(m.values()) for m in got[0][1]]) == (min(ways)[0], [rows[i] for i in min(ways)[2]])


def test_ranges_of_chains_equal_a_plain_search():
    rng = random.Random(5)
    near, there = frontier.Best(), []
    for i in range(4000):
        if there and rng.random() < 0.4:
            q, c = there.pop(rng.randrange(len(there)))
            near.remove(q, c)
        else:
            q, c = rng.randrange(500), Chain(None, rng.randrange(50), i, ())
            near.add(q, c)
            there.append((q, c))
        low = rng.randrange(-10, 500)
        want = None
        for q, c in there:
            if low <= q <= low + 60 and first(c, want):
                want = c
        assert near.of(low, low + 60) is want


def test_a_hot_key_spans_batches(spark):
    n = 30_000
    one = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("ts"), (F.col("id") * 10 + 5).alias("te"), (F.col("id") * 10).alias("qs"), (F.col("id") * 10 + 5).alias("qe"), F.lit(2).alias("matches"))
    two = spark.createDataFrame([(None, 0, 5, 0, 5, 7), (None, 7, 9, 6, 9, 1), (3, 0, 5, 0, 5, None), (3, 0, 0, 0, 5, 9)], one.schema.simpleString()[7:-1].replace(":", " "))
    hits = one.unionByName(two)
    assert {r.k: r.score for r in chain.best_chains(hits, ["k"], 5).collect()} == {1: 2 * n, None: 8}
    members = chain.chain_members(hits, ["k"], 5).where("k = 1").select("n", "t_end", F.size("members").alias("m")).collect()
    assert [tuple(r) for r in members] == [(n, 10 * n - 5, n)]
    marks = one.selectExpr("k", "ts as pos", "qs as start", "qe as end")
    assert [tuple(r) for r in chain.most_markers(marks, ["k"]).collect()] == [(1, n)]
    spans = one.selectExpr("k", "ts as start", "te as end")
    assert intervals.greedy(spans, "k").count() == n and intervals.greedy(spans.limit(0), "k").count() == 0
    assert chain.best_chains(hits.limit(0), ["k"], 5).collect() == []


def test_scans_of_intervals_with_nulls(spark):
    rows = spark.createDataFrame([("a", 0, 4), ("a", 4, 6), ("a", 5, 7), ("a", None, 9), ("a", 8, None), ("b", 1, 1)], "_v0 string, start long, end long")
    assert sorted(map(tuple, intervals.greedy(rows, "_v0").collect())) == [("a", 0, 4), ("a", 5, 7), ("b", 1, 1)]
    crossed = intervals.noncrossing(rows.selectExpr("_v0 as k", "monotonically_increasing_id() as i", "start as s", "end as e"), "k", ["i"], "s", "e")
    assert [r.kept for r in crossed.where("k = 'a'").orderBy("i").collect()] == [True, False, True, False, False]
    runs = intervals.tolerant_runs(rows, "_v0", "end", "start", 1).where("_v0 = 'a'").orderBy("run").collect()
    assert [(r.run, r.first, r.n) for r in runs] == [(1, 8, 1), (2, 0, 1), (3, 4, 2), (4, None, 1)]


def test_running_sums_over_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x", "if(id % 5 = 0, null, id % 13) as w", "'u' as held").repartition(5)
    got = {r.x: (r.w, r.n, r.total) for r in ranks.before(ranks.before(df, [F.desc("x")], name="n"), [F.desc("x")], "w", "total").collect()}
    total = 0
    for n, x in enumerate(range(999, -1, -1)):
        assert got[x][1:] == (n, total)
        total += got[x][0] or 0
    assert ranks.before(df.limit(0), ["x"]).collect() == []


def test_targets_stand_in_for_what_is_missing(spark):
    rows = spark.createDataFrame([("g", 1, "u", 5, 25, True), ("g", 2, "m", 0, 500, False), ("g", 3, "d", 7, 8, True), ("h", 1, "u", 0, 3, None)], "obj string, place int, comp string, start long, end long, there boolean")
    got = [tuple(r)[1:] for r in structure.targets(rows, 100).where("obj = 'g'").orderBy("part").collect()]
    assert got == [
        (1, "UP", "W", 0, 20, "u", 5, 25, "+"), (2, "GAP", "N", 20, 120, None, None, None, None), (3, "SEQ", "S", 120, 130, "m", 0, 500, "+"),
        (4, "GAP", "N", 130, 230, None, None, None, None), (5, "DOWN", "W", 230, 231, "d", 7, 8, "+"),
    ]
    assert [tuple(r)[2:6] for r in structure.targets(rows, 100).where("obj = 'h'").collect()] == [("UP", "S", 0, 10)]
    assert structure.targets(rows.limit(0)).count() == 0
