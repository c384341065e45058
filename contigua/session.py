"""Session helpers: tables, shared scratch tables and shipping of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent a local folder serves in local mode; a cluster
    without the setting is an error, since executors would not see such a folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_contigua_scratch", None)
    if own is None:
        own = spark.sparkContext._contigua_scratch = "file://" + tempfile.mkdtemp(prefix="contigua-")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/contigua-{uuid.uuid4().hex}-{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    If ``tidy``, what the writing shuffled is deleted at its end, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name that begins with ``name`` and that no column in ``taken`` has."""
    there = {t.lower() for t in taken}
    out = f"_{name}"
    while out in there:
        out += "_"
    return out


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_contigua_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="contigua-zip-"))
    path = os.path.join(folder, "contigua_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._contigua_shipped = True
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        spark.conf.set(key, value)
