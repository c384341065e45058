"""Decisions about gaps: which filler to take, how to trim overlapping regions, which hits count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.operators import intervals, stats


def chosen_filler(t1: dict[str, Column], t2: dict[str, Column], least: float) -> Column:
    """T1, T2 or null: whose filler closes the gap.

    Each side has id, strategy (T1 only), mapped (whether the filler has hits), passed and all
    (matches of its best path, filtered and not) and length. A hybrid T1 that is mapped wins
    unless T2 has more than half as many matches on top in both measures; else a mapped T2
    wins unless T1 has; the winner's filtered matches must cover ``least`` percent of it.
    """
    passed, every = t2["passed"] - t1["passed"], t2["all"] - t1["all"]
    hybrid = F.startswith(t1["strategy"], F.lit("hybrid_")) & t1["mapped"]
    use = (
        F.when(t1["id"] == t2["id"], "T1")
        .when(hybrid, F.when((passed <= 0.5 * t1["passed"]) | (every <= 0.5 * t1["all"]), "T1").otherwise("T2"))
        .when(t2["mapped"], F.when((passed <= -0.5 * t2["passed"]) | (every <= -0.5 * t2["all"]), "T1").otherwise("T2"))
        .when(t1["mapped"], "T1")
    )
    cover = lambda t: F.coalesce(F.try_divide(100 * t["passed"], t["length"]), F.lit(0.0))
    return F.when((use == "T1") & (cover(t1) >= least), "T1").when((use == "T2") & (cover(t2) >= least), "T2")


def refined(pairs: DataFrame, right_genes: DataFrame, left_genes: DataFrame) -> DataFrame:
    """Neighbouring regions trimmed where they overlap, so that no gene of the right one is cut.

    ``pairs`` has id, l_start, l_end, l_strand, r_start, r_end, r_strand and, if they overlap,
    left_stop and right_stop (where the overlap ends on each); genes have id, start, end,
    gene. The right region gives way up to right_stop, less what the leftmost gene across it
    needs (three bases before it too); the left one gives that up. Adds shift, the trimmed
    ends and the genes of the left region that are cut.
    """
    cut = right_genes.join(pairs.select(F.col("id").alias("p_id"), "right_stop"), (F.col("id") == F.col("p_id")) & (F.col("start") < F.col("right_stop")) & (F.col("right_stop") < F.col("end")))
    shifts = cut.groupBy(F.col("p_id").alias("s_id")).agg((F.first("right_stop") - F.greatest(F.lit(0), F.min("start") - 3)).alias("shift"))
    x = pairs.join(shifts, F.col("id") == F.col("s_id"), "left").drop("s_id").withColumn("shift", F.coalesce("shift", F.lit(0)))
    harm = left_genes.join(x.where("shift > 0").select(F.col("id").alias("h_id"), (F.col("left_stop") - F.col("shift")).alias("at")), (F.col("id") == F.col("h_id")) & (F.col("start") < F.col("at")) & (F.col("at") < F.col("end")))
    harmed = harm.groupBy(F.col("h_id").alias("c_id")).agg(F.sort_array(F.collect_set("gene")).alias("harmed"))
    apart, s = F.col("right_stop").isNull(), F.col("shift")
    left, right = F.col("l_strand") == "+", F.col("r_strand") == "+"
    give = F.when(apart, 0).otherwise(F.col("right_stop") - s)
    out = x.join(harmed, F.col("id") == F.col("c_id"), "left")
    return out.select(
        "id", F.when(apart, "disjointed").otherwise("overlapping").alias("status"), "shift", F.when(left, F.col("l_start")).otherwise(F.col("l_start") + s).alias("l_start"), F.when(left, F.col("l_end") - s).otherwise(F.col("l_end")).alias("l_end"),
        F.when(right, F.col("r_start") + give).otherwise(F.col("r_start")).alias("r_start"), F.when(right, F.col("r_end")).otherwise(F.col("r_end") - give).alias("r_end"), F.coalesce("harmed", F.array().cast("array<bigint>")).alias("harmed"),
    )


def classified(hits: DataFrame, signal: DataFrame, keys: list[str]) -> DataFrame:
    """``hits`` (keys, chr, ts, te) with ``class`` of the signal (chr, s_start, s_end, code) under them and ``passes``.

    GAP, REP and NO don't pass; what no signal covers is NO.
    """
    met = intervals.overlapping(hits.select(*keys, "chr", "ts", "te").distinct(), signal, "chr", ("ts", "te"), ("s_start", "s_end"))
    n = F.least("te", "s_end") - F.greatest("ts", "s_start")
    of = [*keys, "chr", "ts", "te"]
    kinds = stats.region_classes(met.withColumn("n", n), of, "code", "n").select(*[F.col(c).alias(f"k_{c}") for c in of], "class")
    same = F.lit(True)
    for c in of:
        same = same & (F.col(c) == F.col(f"k_{c}"))
    return hits.join(kinds, same, "left").select(*hits.columns, F.coalesce("class", F.lit("NO")).alias("class")).withColumn("passes", ~F.col("class").isin("GAP", "NO", "REP"))
