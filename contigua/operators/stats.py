"""Length and composition statistics; windows run over histograms, not over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_values(df: DataFrame, length: str, whole: int | None = None, steps: range = range(0, 101, 10)) -> DataFrame:
    """N (or, with ``whole``, NG) values: the length and rank where the longest reach n percent; (0, 0) if never."""
    by_length = df.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("length"))  # one row for each distinct length
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    table = by_length.select("length", "k", F.coalesce(F.sum(F.expr("length * k")).over(up_to), F.lit(0)).alias("before"), F.coalesce(F.sum("k").over(up_to), F.lit(0)).alias("ranks"))
    goal = F.lit(whole).cast("long") if whole is not None else F.max(F.col("before") + F.expr("length * k")).over(Window.partitionBy())
    table = table.withColumn("goal", goal).withColumn("n", F.explode(F.array(*[F.lit(n) for n in steps])))
    need = F.ceil(F.greatest(F.lit(0), F.col("n") * F.col("goal") - 100 * F.col("before")) / (100 * F.col("length")))
    hit = table.withColumn("rank", F.col("ranks") + F.greatest(F.lit(1), need)).where(100 * (F.col("before") + F.expr("length * k")) >= F.col("n") * F.col("goal"))
    best = hit.groupBy("n").agg(F.max("length").alias("length"), F.min("rank").cast("long").alias("rank"))
    every = table.select("n").distinct()
    return every.join(best, "n", "left").select("n", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("rank", F.lit(0)).alias("rank"))


CLASSES = (100, 500, 1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000)


def length_stats(length: Column, classes: tuple = CLASSES) -> list[Column]:
    """Aggregates: number, sum, mean, median, least, most (0 where there is none), and number, sum and their percentages of those beyond each class."""
    zero, n, total = F.lit(0), F.count(length), F.coalesce(F.sum(length), F.lit(0))
    out = [n.alias("n"), total.alias("total"), F.round(F.coalesce(F.avg(length), zero), 2).alias("mean"), F.coalesce(F.min(length), zero).alias("least"), F.coalesce(F.max(length), zero).alias("most"), F.coalesce(F.percentile(length, 0.5), zero).alias("median")]
    for c in classes:
        n_over, sum_over = F.count_if(length > c), F.coalesce(F.sum(F.when(length > c, length)), zero)
        out += [n_over.alias(f"n_over_{c}"), sum_over.alias(f"sum_over_{c}"), F.round(F.coalesce(F.try_divide(100 * n_over, n), zero), 2).alias(f"n_share_{c}"), F.round(F.coalesce(F.try_divide(100 * sum_over, total), zero), 2).alias(f"sum_share_{c}")]
    return out


def base_counts(seq: Column, letters: str = "ACGTUN") -> list[Column]:
    """Aggregates: how often each letter is in the sequences, what is none of them, the percentage of G and C, and that without N and others."""
    n = lambda x: F.length(seq) - F.length(F.replace(seq, F.lit(x), F.lit("")))
    own = {x: F.sum(n(x)) for x in letters}
    other, whole, gc = F.sum(F.length(F.translate(seq, letters, ""))), F.sum(F.length(seq)), own["G"] + own["C"]
    share = lambda of: F.round(F.coalesce(F.try_divide(100 * gc, of), F.lit(0)), 2)
    return [v.alias(f"n_{x.lower()}") for x, v in own.items()] + [other.alias("n_other"), share(whole).alias("gc"), share(whole - own["N"] - other).alias("gc_known")]


def region_classes(runs: DataFrame, keys: list[str], code: str, n: str) -> DataFrame:
    """keys and ``class`` of each region from runs (code, n bases): what holds more than three quarters of it, the first of

    GAP (G), REP (H or R), HAP (0 or 1), DIP (2) and OK (2, H or R); else NO, as for a region without bases.
    """
    c = F.col(code)
    of = lambda *codes: 4 * F.coalesce(F.sum(F.when(c.isin(*codes), F.col(n))), F.lit(0)) > 3 * F.sum(n)
    kind = F.when(of("G"), "GAP").when(of("H", "R"), "REP").when(of("0", "1"), "HAP").when(of("2"), "DIP").when(of("2", "H", "R"), "OK").otherwise("NO")
    return runs.groupBy(*keys).agg(kind.alias("class"))
