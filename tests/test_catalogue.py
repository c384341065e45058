"""Every query with an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from contigua.plans import reports  # noqa: F401 (adds to the catalogue)
from contigua.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, want.fetchall())


def test_islets(spark):
    from pyspark.sql import functions as F

    from contigua import functions as fn

    got = spark.createDataFrame([("ACNNNTTTNNNGG",)], "s string").select(fn.without_islets(F.col("s")).alias("x"), fn.translated(F.lit("ATGTAAC")).alias("p")).first()
    assert got.x == "ACNNNNNNNNNGG" and got.p == "M*"


def test_entry_without_the_training_data_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith(("contigua.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [type("Gone", (), {"find_spec": staticmethod(lambda name, path=None, target=None: (_ for _ in ()).throw(ModuleNotFoundError(name=name)) if name.startswith(("contigua.llm", "corpus_pipeline")) else None)}), *sys.meta_path])
    assert set(e.queries()) == set(QUERIES)
