"""Queries on the whole of their table: every row, every pair, whole sequences."""

import random
from collections import Counter

from contigua.operators import chain, structure
from contigua.plans import catalogue
from contigua.plans import views as v

SF = "/root/testdata/sf0.001"


def test_copies_of_every_gene_over_paired_chromosomes(spark):
    genes = [(r.chr, r.gene, r.kind, int(r.props.split(":")[1].strip(" }"))) for r in v.gene(spark, SF).collect()]
    n = Counter((c, kind, k) for c, _, kind, k in genes)
    want = {(c, g, n[c & ~1, kind, k], n[c | 1, kind, k]) for c, g, kind, k in genes}
    got = catalogue.copy_number_join(spark, SF).collect()
    assert len(got) == len(genes) == 1000 and {(r.chr, r.gene, r.h1, r.h2) for r in got} == want
    assert all(r.ratio is None if r.h1 == 0 else abs(r.ratio - r.h2 / r.h1) < 1e-6 for r in got)
    flags = {(r.chr, r.gene, r.flag) for r in catalogue.imbalance_unpivot(spark, SF).collect()}
    assert flags == {(c, g, f) for c, g, a, b in want for f, here in (("more_h1", a > b), ("more_h2", b > a), ("only_h1", a > 0 == b), ("only_h2", b > 0 == a)) if here}


def test_a_region_at_every_gene(spark):
    genes = v.gene(spark, SF).select("chr", "start", "end", "gene").collect()
    by = {}
    for g in genes:
        by.setdefault(g.chr, []).append((g.start, g.end))
    want = set()
    for g in genes:
        a, b = g.start, g.start + 3600
        while True:
            met = [x for x in by[g.chr] if x[0] < b and x[1] > a]
            lo, hi = min([a, *(x[0] for x in met)]), max([b, *(x[1] for x in met)])
            if (lo, hi) == (a, b):
                break
            a, b = lo, hi
        want.add((g.chr, g.gene, a, b))
    got = catalogue.gene_region_fixpoint(spark, SF).collect()
    assert len(got) == 1000 and {tuple(r) for r in got} == want


def test_frames_of_whole_sequences(spark, tmp_path):
    open_to_the_end = "ATG" + "GCC" * 400 + "TAA"
    texts = [open_to_the_end, open_to_the_end[:60] + "TAG" + open_to_the_end[60:], "G" + open_to_the_end, "CC" + open_to_the_end[:-3], "GCC" * 20, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.seq_id: (r.phase, r.pseudo) for r in catalogue.cds_frame(spark, str(tmp_path)).collect()}
    assert got == {0: (0, False), 1: (None, True), 2: (1, False), 3: (2, False), 4: (None, True), 5: (None, True), 6: (None, True)}


def test_features_of_every_row_reach_every_component(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = v.feature(spark, SF).collect()
    assert sorted(r.id for r in got) == list(range(1, rows.count() + 1))
    assert {r.comp for r in got} == {r.l_partkey for r in rows.select("l_partkey").distinct().collect()}
    assert all(r.end - r.start in {50 * n for n in range(1, 8)} for r in got)


def test_inversion_fills_what_no_placement_covers(spark):
    rows = [("o", "W", 1, 0, 30, "1", 20, 50, "-"), ("o", "N", 2, 30, 40, None, None, None, None), ("o", "W", 3, 40, 50, "1", 70, 80, "+"), ("o", "W", 5, 60, 65, "2", 0, 5, "+")]
    agp = spark.createDataFrame(rows, "obj string, ctype string, part long, obj_start long, obj_end long, comp string, comp_start long, comp_end long, strand string")
    lengths = spark.createDataFrame([("1", 100), ("2", 5), ("3", 7)], "comp string, len long")
    got = sorted(tuple(r) for r in structure.invert_filled(agp, lengths).collect())
    assert got == [
        ("1", 1, 0, 20, "1", 0, 20, "+"), ("1", 2, 20, 50, "o", 0, 30, "-"), ("1", 3, 50, 70, "1", 50, 70, "+"), ("1", 4, 70, 80, "o", 40, 50, "+"), ("1", 5, 80, 100, "1", 80, 100, "+"),
        ("2", 1, 0, 5, "o", 60, 65, "+"), ("3", 1, 0, 7, "3", 0, 7, "+"),
    ]


def test_chains_name_their_members(spark):
    r = random.Random(5)
    hits = [(k, a, a + r.randrange(1, 9), b, b + r.randrange(1, 9), r.randrange(3)) for k in range(25) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(8))]
    marks = [(k, r.randrange(9), a, a + 3) for k in range(25) for a in (r.randrange(30) for _ in range(8))]

    def best(items, fits, loss):
        sets = [[x for i, x in enumerate(items) if m >> i & 1] for m in range(1, 1 << len(items))]
        return min((loss(c), c) for c in sets if all(fits(x, y) for x, y in zip(c, c[1:], strict=False)))

    got = {x.k: x for x in chain.chain_members(spark.createDataFrame(hits, "k int, ts long, te long, qs long, qe long, matches long"), ["k"], 10).collect()}
    for k in range(25):
        items = sorted((a, c, b, d, w) for h, a, b, c, d, w in hits if h == k)
        (loss, n), c = best(items, lambda x, y: 0 <= y[0] - x[2] <= 10 and 0 <= y[1] - x[3] <= 10, lambda c: (-sum(x[4] for x in c), len(c)))
        g = got[k]
        assert (g.score, g.n, [tuple(x) for x in g.members]) == (-loss, n, c) and (g.t_start, g.q_start, g.t_end, g.q_end) == (*c[0][:2], *c[-1][2:4])
    runs = {x.k: x for x in chain.marker_members(spark.createDataFrame(marks, "k int, pos long, start long, end long"), ["k"]).collect()}
    for k in range(25):
        loss, c = best(sorted(m[1:] for m in marks if m[0] == k), lambda x, y: x[0] < y[0] and y[1] >= x[2], lambda c: -len(c))
        assert (runs[k].n_markers, [tuple(x) for x in runs[k].members]) == (-loss, c)


def test_members_add_up_to_the_scores(spark):
    got, score = {}, {(r.tid, r.qid): r.score for r in catalogue.hit_chain_matches(spark, SF).collect()}
    for r in catalogue.hit_chain_members(spark, SF).collect():
        got[r.tid, r.qid] = got.get((r.tid, r.qid), 0) + r.matches
    assert got == score
    n = Counter(r.seq for r in catalogue.marker_lis_members(spark, SF).collect())
    assert n == {r.seq: r.n_markers for r in catalogue.marker_lis(spark, SF).collect()}
