"""Decisions, paths and reports against hand-made cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from contigua import functions as fn
from contigua import streaming
from contigua.operators import chain, curation, fill, intervals, placing, qc, sequences, structure
from contigua.plans import catalogue, reports

SF = "/root/testdata/sf0.001"
AGP = "obj string, ctype string, part long, obj_start long, obj_end long, comp string, comp_start long, comp_end long, strand string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_joins_meet_each_pair_once(spark):
    r = random.Random(3)
    span = lambda: (lambda a: (a, a + r.randrange(1, 60)))(r.randrange(300))
    left, right = [(i, r.randrange(3), *span()) for i in range(120)], [(i, r.randrange(3), *span()) for i in range(120)]
    a, b = spark.createDataFrame(left, "i long, k long, s long, e long"), spark.createDataFrame(right, "j long, k long, t long, f long")
    over = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    inside = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3]}
    for width in (7, 50, 1 << 17):
        got = rows(intervals.overlapping(a, b, "k", ("s", "e"), ("t", "f"), width).select("i", "j"))
        assert len(got) == len(over) and set(got) == over
        got = rows(intervals.within(a, b, "k", ("s", "e"), ("t", "f"), width).select("i", "j"))
        assert len(got) == len(inside) and set(got) == inside


def test_one_sequence_with_all_rows_joins_in_proportion(spark):
    # 60,000 x 60,000 rows of one sequence: 3.6 billion pairs without bins.
    a = spark.range(60_000).selectExpr("1 as k", "id * 1000 as s", "id * 1000 + 500 as e")
    b = spark.range(60_000).selectExpr("1 as k", "id * 1000 + 400 as t", "id * 1000 + 900 as f")
    assert intervals.overlapping(a, b, "k", ("s", "e"), ("t", "f"), 10_000).count() == 60_000


def test_sequences_of_slices_in_chunks(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGTTTGA"), ("b", "GGCCA"), ("e", "")], "seq_id string, seq string")
    agp = spark.createDataFrame([("o", "W", 1, 0, 7, "a", 2, 9, "-"), ("o", "N", 2, 7, 11, None, None, None, None), ("o", "W", 3, 11, 16, "b", 0, 5, "+"), ("p", "W", 1, 0, 3, "z", 0, 3, "+")], AGP)
    for size in (1, 3, 4, 100):
        chunks = sequences.chunked(seqs, size)
        made = sequences.assembled(agp, chunks, size)
        assert rows(sequences.whole(made)) == [("o", "AACGTAC" + "NNNN" + "GGCCA")]
        assert all(len(r.bases) <= size for r in made.collect())
        assert rows(sequences.missing(agp, chunks)) == [("z",)]


def test_breaking(spark):
    lens = spark.createDataFrame([("a", 100), ("b", 9)], "seq_id string, len long")
    gaps = spark.createDataFrame([("a", 20, 30), ("a", 0, 5), ("a", 90, 100), ("a", 50, 51)], "seq_id string, start long, end long")
    got = rows(structure.broken(lens, gaps, "n_").select("obj", "comp", "comp_start", "comp_end", "obj_end"))
    assert got == [("n_a_1", "a", 0, 20, 20), ("n_a_2", "a", 30, 50, 20), ("n_a_3", "a", 51, 100, 49), ("n_b", "b", 0, 9, 9)]
    agp = spark.createDataFrame([("o", "N", 1, 0, 2, None, None, None, None), ("o", "W", 2, 2, 10, "a", 0, 8, "+"), ("o", "N", 3, 10, 12, None, None, None, None), ("o", "W", 4, 12, 20, "b", 0, 8, "+"), ("o", "N", 5, 20, 40, None, None, None, None), ("o", "W", 6, 40, 50, "c", 0, 10, "+")], AGP)
    assert rows(structure.between_gaps(agp, 10)) == [("o", 2, 20, 0, 2, 20, 40), ("o", 40, 50, 20, 40, 50, 50)]
    shut = spark.createDataFrame([("o", 19, 21)], "obj string, x_start long, x_end long")
    assert rows(structure.between_gaps(agp, 10, shut)) == [("o", 2, 50, 0, 2, 50, 50)]


def test_direction_of_positions(spark):
    cases = {(1,): "single", (): "single", (1, 2, 3): "+", (3, 2, 1): "-", (1, 2, 1): "undetectable", (1, 1): "-", (5, 5, 7): "+", (7, 5, 5): "-", (1, 3, 2, 4): "+"}
    df = spark.createDataFrame([(list(k),) for k in cases], "x array<long>")
    assert [r.d for r in df.select(fn.direction(F.col("x")).alias("d")).collect()] == list(cases.values())
    assert [r.m for r in spark.createDataFrame([(10, 10), (0, 10), (9, 10)], "a long, b long").select(fn.mapq(F.col("a"), F.col("b")).alias("m")).collect()] == [0, 255, 25]


def test_chains_over_both_strands_and_their_paths(spark):
    hits = catalogue.v.hit(spark, SF).collect()
    by = {}
    for h in hits:
        by.setdefault((h.tid, h.qid, h.strand), []).append((h.ts, h.qs, h.te, h.qe, h.matches))

    def score(items):
        items, best = sorted(items), []
        for x in items:
            best.append(x[4] + max([s for y, s in zip(items, best) if 0 <= x[0] - y[2] <= 20_000 and 0 <= x[1] - y[3] <= 20_000], default=0))
        return max(best)

    top = {}
    for (t, q, s), items in by.items():
        top.setdefault(q, []).append((-score(items), t, s))
    got = {r.qid: r for r in reports.best_chain_per_query(spark, SF).collect()}
    assert {q: (-r.score, r.tid, r.strand) for q, r in got.items()} == {q: min(x) for q, x in top.items()}
    assert all(r.mapq == int(255 * (1 - r.score / r.q_len) // 1) for r in got.values())
    span, last = {}, {}
    for r in sorted(reports.unique_tiles(spark, SF).collect(), key=lambda r: (r.tid, r.qid, r.place)):
        k = (r.tid, r.qid)
        span[k] = span.get(k, 0) + r.te - r.ts
        assert k not in last or (r.ts >= last[k][0] and r.qs >= last[k][1])
        assert r.score >= span[k]
        last[k] = (r.te, r.qe)


def test_tilings_have_their_scores(spark):
    score = {(r.tid, r.qid): r.score for r in catalogue.tiling_score_1d(spark, SF).collect()}
    path, last = {}, {}
    for r in sorted(reports.tiling_path(spark, SF).collect(), key=lambda r: (r.tid, r.qid, r.place)):
        k = (r.tid, r.qid)
        path[k] = path.get(k, 0) + r.te - r.ts
        assert r.score == score[k] and (k not in last or 0 <= r.ts - last[k] <= 100_000)
        last[k] = r.te
    assert path == {k: s for k, s in score.items() if s is not None}
    r = random.Random(2)
    hits = [(k, a, a + r.randrange(1, 6), r.random() < 0.2) for k in range(30) for a in (r.randrange(40) for _ in range(7))]
    items = {}
    for k, a, b, f in hits:
        items[k, a, b] = items.get((k, a, b), False) or f
    df = spark.createDataFrame([(*k, f) for k, f in items.items()], "k int, ts long, te long, forced boolean")

    def best(k, limit):
        own, out = sorted((a, b, f) for (x, a, b), f in items.items() if x == k), None
        for m in range(1, 1 << len(own)):
            c = [x for i, x in enumerate(own) if m >> i & 1]
            if all(x in c for x in own if x[2]) and all(0 <= y[0] - x[1] <= limit for x, y in zip(c, c[1:])):
                out = max(out or 0, sum(x[1] - x[0] for x in c))
        return out

    for x in chain.widened(df, ["k"], 2, 4, 10).collect():
        tried = {n: best(x.k, n) for n in (2, 6, 10)}
        limit = next((n for n, s in tried.items() if s is not None), 10)
        assert (x.score, x.limit) == (tried[limit], limit)


def test_network_paths_weigh_as_the_scores(spark):
    score = {r.chr: r.score for r in catalogue.marker_network_score(spark, SF).collect()}
    got, last = {}, {}
    for r in sorted(reports.marker_network_path(spark, SF).collect(), key=lambda r: (r.chr, r.ord)):
        assert r.chr not in last or last[r.chr] < r.start
        got[r.chr], last[r.chr] = got.get(r.chr, 0) + r.weight, r.stop
    assert got == score


def test_two_haplotypes_are_feasible(spark):
    placed = {(r.chr, r.seq): r for r in catalogue._placed(spark, SF).collect()}
    out = sorted(catalogue.two_haplotype_solve(spark, SF).collect(), key=lambda r: (r.haplotype, r.chr, r.ord))
    first = {r.seq for r in out if r.haplotype == 1}
    assert first and first.isdisjoint({r.seq for r in out if r.haplotype == 2})
    for r in out:
        assert r.haplotype == 1 or not {r.seq - 500, r.seq + 500} & first
    for _, group in itertools.groupby(out, key=lambda r: (r.haplotype, r.chr)):
        path = [placed[r.chr, r.seq] for r in group]
        assert all(a.stop < b.start for a, b in zip(path, path[1:])) and not {r.seq for r in path} & {r.seq + 1 for r in path}


def test_orders_merge():
    m = chain.merged_order
    assert m(["a", "b", "c"], []) == ["a", "b", "c"] and m([], ["x", "y"]) == ["x", "y"]
    assert m(["a", "f1", "f3", "b"], ["f1", "f2", "f3"]) == ["a", "f1", "f2", "f3", "b"]
    assert m(["f2", "b"], ["f1", "f2"]) == ["f1", "f2", "b"] and m(["f1", "b", "f3"], ["f1", "f2", "f3"]) == ["f1", "b", "f3"]
    assert m(["f2", "f1"], ["f1", "f2", "f3"]) == ["f1", "f2", "f3"]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (7, 8)], "a long, b long")
    assert rows(chain.on_cycles(e)) == [(2, 3), (3, 4), (4, 2)] and rows(chain.on_cycles(e.where("a <> 4"))) == []
    assert rows(chain.reachable(e, spark.createDataFrame([(3,)], "node long"))) == [(2,), (3,), (4,), (5,)]


def test_policies_for_conflicting_strands(spark):
    markers = spark.createDataFrame([("a", "+"), ("b", "."), ("c", "-"), ("d", ".")], "seq string, strand string")
    forced = spark.createDataFrame([("a", 1, "-"), ("b", 2, "-"), ("c", 1, "-")], "seq string, hap int, f_strand string")
    same = [("blacklist", 1, "a", o) for o in "+-."]
    rest = [("forced", 1, "c", "-"), ("forced", 2, "b", "-"), ("markers", None, "b", "-"), ("markers", None, "c", "-"), ("markers", None, "d", "+")]
    own = {1: [("markers", None, "a", "+")], 2: [("markers", None, "a", "+"), ("forced", 1, "a", "+")], 3: [("markers", None, "a", "+"), *same], 4: [("forced", 1, "a", "-"), *same]}
    for k, want in own.items():
        got = [(r.list, r.hap, r.seq, r.strand) for r in qc.marker_policy(markers, forced, F.lit(k)).collect()]
        assert sorted(got, key=str) == sorted(rest + want, key=str)
    with pytest.raises(Exception, match="unknown policy"):
        qc.marker_policy(markers, forced, F.lit(9)).collect()


def test_first_reason_against_a_place(spark):
    data = [(1, 1, "+", 5, 2, 10, "+"), (1, 2, "+", None, None, None, None), (1, 3, "+", None, 4, None, "+"), (1, 4, "+", 3, 3, 50, "+"), (1, 5, "+", 5, None, 40, "-"), (1, 6, "+", 5, 1, 20, "+"), (1, 7, "-", 5, 1, 45, "-")]
    df = spark.createDataFrame(data, "chr int, ord int, strand string, own long, other long, least long, direction string")
    got = [r.conflict for r in qc.conflicts(df).orderBy("ord").collect()]
    assert got == [None, "Unsupported", "Wrong_chr", "Not_highest_support", "Orientation", "Wrong_order", None]


def test_filler_of_a_gap(spark):
    cases = [
        ((1, "x", False, 50, 60, 100, 1, True, 90, 90, 100), "T1"), ((1, "hybrid_left:alt", True, 60, 60, 100, 2, True, 95, 80, 100), "T1"), ((1, "hybrid_left:alt", True, 60, 60, 100, 2, True, 95, 95, 100), "T2"),
        ((1, "flanking_left", True, 90, 90, 100, 2, True, 50, 50, 100), "T1"), ((1, "flanking_left", True, 60, 60, 100, 2, True, 50, 50, 100), "T2"), ((1, "flanking_left", True, 60, 60, 100, 2, False, 50, 50, 100), "T1"),
        ((1, "flanking_left", False, 60, 60, 100, 2, False, 50, 50, 100), None), ((1, "flanking_left", True, 39, 39, 100, 2, False, 90, 90, 100), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "i1 int, st string, m1 boolean, p1 long, a1 long, l1 long, i2 int, m2 boolean, p2 long, a2 long, l2 long")
    side = lambda n: {"id": F.col(f"i{n}"), "strategy": F.col("st"), "mapped": F.col(f"m{n}"), "passed": F.col(f"p{n}"), "all": F.col(f"a{n}"), "length": F.col(f"l{n}")}
    assert [r.x for r in df.select(fill.chosen_filler(side(1), side(2), 40).alias("x")).collect()] == [w for _, w in cases]


def test_regions_give_way_to_genes(spark):
    p = spark.createDataFrame([(1, 0, 100, "+", 0, 200, "+", 90, 10), (2, 0, 100, "-", 0, 200, "-", 90, 10), (3, 0, 100, "+", 0, 200, "+", None, None)], "id long, l_start long, l_end long, l_strand string, r_start long, r_end long, r_strand string, left_stop long, right_stop long")
    right = spark.createDataFrame([(1, 8, 15, 5), (1, 6, 11, 6), (2, 20, 30, 7)], "id long, start long, end long, gene long")
    left = spark.createDataFrame([(1, 80, 95, 8), (1, 84, 90, 9)], "id long, start long, end long, gene long")
    got = {r.id: (r.status, r.shift, r.l_start, r.l_end, r.r_start, r.r_end, r.harmed) for r in fill.refined(p, right, left).collect()}
    assert got == {1: ("overlapping", 7, 0, 93, 3, 200, [8]), 2: ("overlapping", 0, 0, 100, 0, 190, []), 3: ("disjointed", 0, 0, 100, 0, 200, [])}


def test_flags(spark):
    seqs = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", None), ("e", 2)], "seq string, chr int")
    assoc = spark.createDataFrame([("a", "m1", 1), ("b", "m1", 1), ("b", "m2", 2), ("c", "m3", 3), ("d", "m1", 1), ("d", "m4", 1)], "seq string, mol string, chr int")
    alt = spark.createDataFrame([("c", "m4", 4), ("a", "m9", 2)], "seq string, mol string, chr int")
    got = {r.seq: tuple(r)[1:] for r in qc.association_flags(seqs, assoc, alt).collect()}
    assert got == {"a": (1, False, False, True, False, 1), "b": (1, True, True, None, None, 1), "c": (None, None, False, None, False, None), "d": (None, None, True, None, None, 1), "e": (2, None, None, None, None, 2)}
    flags = spark.createDataFrame([(1, 0), (3, 0), (4, 1), (2, 9)], "a int, b int").select(*qc.duplication_flags(F.col("a"), F.col("b"), 0.33)).collect()
    assert [[i for i, x in enumerate(r) if x] for r in flags] == [[0], [1], [2], [3, 6]]
    steps = spark.createDataFrame([("a", "DONE"), ("b", "TODO")], "step string, state string")
    assert qc.next_step(steps, ["a", "b", "c"]) == "b" and qc.next_step(steps, ["a"]) is None


def test_exons_meet_and_are_trimmed(spark):
    parts = spark.createDataFrame([("m", 10, 20), ("m", 20, 30), ("m", 31, 40), ("n", 5, 9)], "mrna string, start long, end long")
    exons = curation.exons_from(parts)
    assert rows(exons) == [("m", 10, 30), ("m", 31, 40), ("n", 5, 9)] and rows(curation.introns(exons)) == [("m", 30, 31)]
    e = spark.createDataFrame([(0, 6, "NNACGN"), (10, 13, "NNN"), (20, 22, "AC")], "start long, end long, bases string")
    assert rows(curation.trimmed(e)) == [(2, 5, "ACG"), (20, 22, "AC")]


def test_runs_of_activity_in_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 00:00:00"), ("z", "2024-01-03 00:00:00")], "key string, ts string").selectExpr("key", "cast(ts as timestamp) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
    q = streaming.depth_sessions(stream).writeStream.format("memory").queryName("contigua_runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.n) for r in spark.table("contigua_runs").collect()) == [("a", 1), ("a", 2), ("b", 1)]
