"""What a review found: results and plans that were wrong before."""

import random

import duckdb
from test_catalogue import canonical

from contigua.operators import curation, structure
from contigua.plans import reports  # noqa: F401 (adds to the catalogue)
from contigua.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_lifted_places_are_numbered_where_they_arise(spark):
    df = QUERIES["liftover_multi_suffix"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(obj" not in plan
    above, _, below = plan.partition("SortMergeJoin")
    assert "Window" in above and "Exchange" not in above and "Exchange" in below


def test_numbered_places_of_features_equal_brute_force(spark):
    r = random.Random(3)
    features = [(i, r.choice([1, 2, 3, None]), a, r.choice([a + r.randrange(60), None]), r.choice("+-")) for i, a in enumerate(r.randrange(300_000) for _ in range(200))]
    placed = [(r.randrange(5), "W", 0, n, r.choice([1, 2, 3, None]), a, a + n, r.choice("+-")) for a, n in ((r.choice([0, 0, 1000, 131_072]), r.randrange(400_000)) for _ in range(60))]
    got = structure.liftover_numbered(
        spark.createDataFrame(features, "id int, comp int, start long, end long, f_strand string"), spark.createDataFrame([*placed, (1, "N", 0, 9, None, None, None, None)], "obj int, ctype string, obj_start long, obj_end long, comp int, comp_start long, comp_end long, strand string")
    )
    want = []
    for i, comp, a, b, s in features:
        met = [(obj, o + a - ca if t == "+" else o + cb - b, "+" if t == s else "-", b - a) for obj, _, o, _, c, ca, cb, t in placed if comp is not None and b is not None and c == comp and ca <= a and b <= cb]
        want += [(i, obj, x, x + n, t, k) for k, (obj, x, t, n) in enumerate(sorted(met), 1)]
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)


def test_exons_that_end_in_a_line_end_keep_the_n_before_it(spark):
    rows = [(0, 6, "NACNN\n"), (10, 13, "NN\n"), (20, 24, "ANN\r"), (30, 36, "NNAGNN"), (40, 42, "NN"), (50, 53, "\nAN"), (60, 63, "éN\u2028"), (70, 70, "")]
    got = curation.trimmed(spark.createDataFrame(rows, "start int, end int, bases string"))
    assert sorted(map(tuple, got.collect())) == [(1, 6, "ACNN\n"), (12, 13, "\n"), (20, 24, "ANN\r"), (32, 34, "AG"), (50, 52, "\nA"), (60, 63, "éN\u2028")]


def test_events_before_the_origin_count_whole_seconds_downwards(spark, tmp_path):
    con = duckdb.connect()
    early = "case when event_id % 3 = 0 then null when event_id % 3 = 1 then ts - to_days(40) else ts end"
    con.execute(f"copy (select * replace ({early} as ts) from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    for name in ("lineitem", "part", "documents", "events"):
        con.execute(f"create view {name} as select * from '{tmp_path if name == 'events' else SF}/{name}.parquet'")
    for name in ("complement_context", "complement_regions"):
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
        assert any(r[names.index("free_start")] < 0 for r in rows)
        assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rows)


def test_copies_of_events_leave_the_same_stretches_free(spark):
    from contigua.operators import intervals

    rows = [("a", a, a + 10) for a in (0, 5, 40, 60, 65, 90)] + [("b", 7, 8)]
    lengths = spark.createDataFrame([("a", 200), ("b", 20)], "chr string, len long")
    free = []
    for n in (1, 60):
        g = spark.createDataFrame(rows * n, "chr string, start long, end long")
        m = intervals.merge(g, "chr").selectExpr("chr", "start", "end", "start + 7 as mate_start", "end + 9 as mate_end")
        free.append(sorted(map(str, intervals.complement_with_context(m, "chr", lengths).collect())))
    assert free[0] == free[1] and len(free[0]) == 6
