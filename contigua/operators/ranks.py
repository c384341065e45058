"""Numbers and running sums over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigua.session import cut, fresh_name


def before(df: DataFrame, order: list[str | Column], weight: str | None = None, name: str = "before", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, if given) with the sum of ``weight`` (the number, without one) of all rows before each in a global order; nulls weigh nothing.

    Rows are dealt out by ranges of the order and stored, then each partition adds what
    the ones before it hold: a row for each partition is all that one task and a broadcast
    see. Rows equal in ``order`` come in any order.
    """
    at, part, first, held = (fresh_name(x, [*df.columns, name]) for x in ("at", "part", "first", "held"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.columns if keep is None else keep
    stored = kept if weight is None or weight in kept else [*kept, weight]
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*stored, F.monotonically_increasing_id().alias(at)), "ordered", tidy=True)
    rows = rows.withColumn(part, F.shiftrightunsigned(at, 33))
    size = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    sums = rows.groupBy(F.col(part).alias(f"{part}_")).agg(F.min(at).alias(first), size.alias(held))
    w = Window.orderBy(f"{part}_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(f"{part}_", first, F.coalesce(F.sum(held).over(w), F.lit(0)).alias(held))
    if weight is None:
        own = F.col(at) - F.col(first)
    else:
        own = F.coalesce(F.sum(weight).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = rows.join(F.broadcast(sums), F.col(part) == F.col(f"{part}_"))
    return x.select(*kept, (F.col(held) + own).alias(name))
