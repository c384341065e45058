"""Exact deduplication by distributed MSD radix partitioning.

Each text, white space deleted, is a byte string that starts with its length. A level
splits every open group by the next run of bytes; runs grow from level to level up to
``MOST_RUN`` bytes, the most that a grouping key holds. A group closes when it is a singleton or when
its bytes have ended: two texts share a closed group exactly when their bytes are
equal, and no digest decides anything. Level 0 splits by length and a short prefix
and counts without moving texts; only members of open groups carry their rest on.

Hot groups: a level counts with partial aggregation (one row per map task and group)
and rows find their group by a sort-merge join, whose large partitions Spark splits.
Each level is written to the shared folder, so a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.session import cut, fresh_name

PREFIX, GROWTH, MOST_RUN = 64, 16, 1 << 20


def normalised(text):
    """Text without the characters tab to carriage return and space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Of equal texts the
    row with most code points in the original stays, then the smallest id (null ids
    last); of rows that tie even there (repeated rows) exactly one stays. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    found = _groups(docs, F.col(id_col), F.col(text_col), F.monotonically_increasing_id(), prefix, growth)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _groups(docs: DataFrame, id_: Column, text: Column, row: Column, prefix: int = PREFIX, growth: int = GROWTH) -> DataFrame:
    """As ``exact_groups``, with the number ``row`` of each row (unique, and fixed when the first level is written) and sha."""
    rows = docs.select(
        id_.cast("long").alias("doc_id"), row.alias("row"), F.length(F.coalesce(text, F.lit(""))).alias("points"), normalised(text).alias("norm")
    ).select(
        "doc_id", "row", "points", F.octet_length("norm").alias("size"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.encode("norm", "utf-8").alias("rest")
    )
    head = F.expr(f"substring(rest, 1, {prefix})")
    open_groups = (
        docs.select(normalised(text).alias("norm"))
        .select(F.octet_length("norm").alias("g_size"), F.expr(f"substring(encode(norm, 'utf-8'), 1, {prefix})").alias("g_run"))
        .groupBy("g_size", "g_run").agg(F.count("*").alias("n")).where("n > 1")
        .select("g_size", "g_run", F.monotonically_increasing_id().alias("gid"))
    )
    joined = rows.withColumn("run", head).join(cut(open_groups, "radix-open").hint("merge"), (F.col("size") == F.col("g_size")) & (F.col("run") == F.col("g_run")), "left")
    state = cut(
        joined.select("doc_id", "points", "size", "sha", "gid", "row", F.when(F.col("gid").isNotNull(), F.expr(f"substring(rest, {prefix + 1}, size)")).alias("rest")),
        "radix-0",
    )
    result = [state.where("gid is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "row")]
    live, end, width = state.where("gid is not null"), prefix, min(prefix * growth, MOST_RUN)
    while live.select("doc_id").head(1):
        step = live.withColumn("run", F.expr(f"substring(rest, 1, {width})"))
        end += width
        groups = cut(
            step.groupBy("gid", "run")
            .agg(F.count("*").alias("n"), F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))).alias("best"))
            .select(F.col("gid").alias("g_gid"), F.col("run").alias("g_run"), "n", "best", F.monotonically_increasing_id().alias("next_gid")),
            f"radix-groups-{end}",
        )
        is_open = (F.col("n") > 1) & (F.col("size") > end)
        state = cut(
            step.withColumn("tail", F.expr(f"substring(rest, {width + 1}, size)")).drop("rest")
            .join(groups.hint("merge"), (F.col("gid") == F.col("g_gid")) & (F.col("run") == F.col("g_run")))
            .select("doc_id", "points", "size", "sha", "row", "n", "best", F.when(is_open, F.col("next_gid")).alias("gid"), F.when(is_open, F.col("tail")).alias("rest")),
            f"radix-{end}",
        )
        result.append(
            state.where("gid is null").select("doc_id", (-F.col("best.minus_id")).alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == -F.col("best.minus_row")).alias("kept"), "sha", "row")
        )
        live, width = state.where("gid is not null").drop("n", "best"), min(width * growth, MOST_RUN)
    out = result[0]
    for part in result[1:]:
        out = out.unionByName(part)
    return out


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    Rows are told apart by their place in a written copy of ``docs``, so neither ids nor
    digests decide: null and repeated ids are ids of their own, and of rows that repeat
    both id and text one stays. Null texts stay null. An empty table stays empty.
    """
    row = fresh_name("row", docs.columns)
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()), "exact-rows")
    # A narrow table of its own: while it is small, Spark sends it to the texts, and they stay where they are.
    gone = cut(_groups(held, F.col(id_col), F.col(text_col), F.col(row)).where("not kept").select(F.col("row").alias(row)), "exact-gone")
    return held.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
