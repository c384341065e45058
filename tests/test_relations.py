"""Operators that SQL doesn't express, or only for one set of parameters, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from contigua.operators import chain, intervals, matching, placing, signals


def test_greedy_matching_takes_what_the_global_order_takes(spark):
    r = random.Random(1)
    pairs = [(r.randrange(30), r.randrange(30), r.randrange(12)) for _ in range(300)]
    best = {}
    for a, b, s in pairs:
        best[a, b] = max(s, best.get((a, b), 0))
    want, used_a, used_b = set(), set(), set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in best.items() if s > 2), key=lambda x: (-x[0], x[1], x[2])):
        if a not in used_a and b not in used_b:
            want.add((a, b, s))
            used_a.add(a)
            used_b.add(b)
    got = matching.greedy_matching(spark.createDataFrame(pairs, "a long, b long, score long"), 2)
    assert {tuple(x) for x in got.collect()} == want
    assert matching.greedy_matching(spark.createDataFrame([], "a long, b long, score long")).count() == 0


def test_savitzky_golay_fits_polynomials(spark):
    r = random.Random(2)
    series = {1: [r.random() for _ in range(40)], 2: [r.random() for _ in range(7)], 3: [1.0, 5.0, 2.0]}
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    got = signals.savitzky_golay(spark.createDataFrame(rows, "k int, i int, x double"), "k", "i", "x", 7, 3)
    found = {(x.k, x.i): x.smooth for x in got.collect()}
    for k, xs in series.items():
        for i, x in enumerate(xs):
            a = min(max(i - 3, 0), max(len(xs) - 7, 0))
            want = np.polyval(np.polyfit(np.arange(7), xs[a : a + 7], 3), i - a) if len(xs) >= 7 else x
            assert abs(found[k, i] - want) < 1e-9, (k, i)


def test_regions_grow_to_the_fix_point(spark):
    r = random.Random(3)
    genes = [(k, s, s + r.randrange(1, 30)) for k in (1, 2) for s in (r.randrange(1000) for _ in range(40))]
    regions = [(k, i, 50 * i, 50 * i + 20) for k in (1, 2) for i in range(20)]
    want = set()
    for k, i, a, b in regions:
        while True:
            met = [g for g in genes if g[0] == k and g[1] < b and g[2] > a]
            lo, hi = min([a, *(g[1] for g in met)]), max([b, *(g[2] for g in met)])
            if (lo, hi) == (a, b):
                break
            a, b = lo, hi
        want.add((k, i, a, b))
    got = intervals.grow_regions(spark.createDataFrame(regions, "k int, id int, a int, b int"), spark.createDataFrame(genes, "k int, start int, end int"), "k")
    assert {tuple(x) for x in got.collect()} == want


def test_heaviest_sets_and_exclusions():
    r = random.Random(4)
    for _ in range(60):
        items = [(a, a + r.randrange(12), r.randrange(1, 9), i, False) for i, a in enumerate(r.randrange(40) for _ in range(9))]
        fits = lambda xs: all(x[1] < y[0] for x, y in zip(xs, xs[1:], strict=False))
        sets = [[x for i, x in enumerate(items) if m >> i & 1] for m in range(1 << len(items))]
        want = max(sum(x[2] for x in xs) for xs in sets if fits(sorted(xs)))
        got = placing.heaviest(items)
        assert fits(sorted(items[i] for i in got)) and sum(items[i][2] for i in got) == want
        pairs = [(r.randrange(9), r.randrange(9)) for _ in range(8)]
        path = placing.without_excluded(items, {i: r.randrange(4) for i in range(9)}, pairs)
        assert not any(a != b and a in path and b in path for a, b in pairs) and fits([items[i] for i in path])
    forced = [(0, 10, 1, "a", True), (5, 15, 99, "b", False), (8, 12, 9, "c", True), (11, 20, 2, "d", False)]
    assert placing.heaviest(forced) == ["a", "d"] and placing.heaviest([]) == []
    # The longer of an excluded pair stays, or the forced one.
    two = [(0, 1, 1, "a", False), (2, 3, 1, "b", False)]
    assert placing.without_excluded(two, {"a": 1, "b": 2}, [("b", "a")]) == ["b"]
    assert placing.without_excluded([(*two[0][:4], True), two[1]], {"a": 1, "b": 2}, [("b", "a")]) == ["a"]


def test_two_haplotypes_share_no_sequence_and_no_mates(spark):
    rows = [("c", i, 3 * i, 3 * i + (5 if i % 3 else 1), 1 + i % 4, i, i == 7) for i in range(30)]
    seqs = spark.createDataFrame(rows, "chr string, seq long, start long, stop long, weight long, length long, forced boolean")
    pairs, mates = (spark.createDataFrame([(i, i + k) for i in range(30)], "a long, b long") for k in (2, 5))
    got = placing.two_haplotypes(seqs, pairs, mates).collect()
    one, two = ({r.seq for r in got if r.haplotype == h} for h in (1, 2))
    assert 7 in one and two and not one & two and not any(a - b in (5, -5) for a in one for b in two)
    for path in (one, two):
        assert not any(a - b == 2 for a in path for b in path)
        ordered = [rows[i] for i in sorted(path)]
        assert all(x[3] < y[2] for x, y in zip(ordered, ordered[1:], strict=False))
    assert placing.two_haplotypes(seqs.where("false"), pairs, mates).count() == 0


def test_tiling_takes_every_forced_hit(spark):
    rows = [(1, 0, 10, False), (1, 10, 30, False), (1, 12, 20, True), (1, 25, 40, False), (2, 0, 9, True), (2, 5, 9, True), (3, 0, 5, False), (3, 50, 59, False)]
    got = chain.best_tiling(spark.createDataFrame(rows, "t int, ts long, te long, forced boolean"), ["t"], 10)
    assert {r.t: r.score for r in got.collect()} == {1: 33, 2: None, 3: 9}


def test_tolerant_runs_compare_with_the_first_value(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 6, 4, 7, 8, 9])], "k int, i long, x long")
    assert [tuple(r) for r in intervals.tolerant_runs(df, "k", "i", "x", 1).orderBy("run").collect()] == [(1, 1, 5, 3, 0, 2), (1, 2, 7, 2, 3, 4), (1, 3, 9, 1, 5, 5)]


def test_projection_keeps_both_distances(spark):
    rows = [(10, 20, 0, 100, 200, 300, "+"), (10, 20, 0, 100, 200, 300, "-"), (10, 20, 0, 100, 200, 200, "+"), (50, 50, 0, 100, 200, 220, "+"), (10, 20, 0, 100, 200, 280, "+")]
    at = placing.projected(*[F.col(c) for c in "s e fs fe ts te d".split()], F.lit(1000))
    got = spark.createDataFrame(rows, "s long, e long, fs long, fe long, ts long, te long, d string").select(at.alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got] == [(210, 220), (280, 290), (200, 200), None, (240, 240)]
