"""Adapter views: the given tables as components, hits, genes, features, sequences and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contigua.functions import ascii_upper
from contigua.operators import ranks
from contigua.session import table

ROW = "l_partkey l_suppkey l_shipdate l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
STRAND = "case when l_linestatus = 'F' then '+' else '-' end"


def comp(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *ROW)
    # The number comes first, then the names: else the rows of an object would move again.
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *ROW).withColumn("ord", F.row_number().over(w).cast("long"))
    return x.select(F.col("l_orderkey").alias("obj"), "ord", F.col("l_partkey").alias("comp"), F.expr("cast(1000 * l_quantity as bigint)").alias("len"), F.expr(STRAND).alias("strand"))


def feature(spark: SparkSession, d: str) -> DataFrame:
    """Features in component space, one for each lineitem row; the id is its number in the order of whole rows."""
    order = ["l_orderkey", "l_linenumber", *ROW]
    x = ranks.before(table(spark, d, "lineitem").select(*order), order, keep=["l_orderkey", "l_linenumber", "l_partkey"])
    return x.selectExpr("before + 1 as id", "l_partkey as comp", "(l_orderkey * 37) % 20000 as start", "(l_orderkey * 37) % 20000 + 50 * l_linenumber as end", "case when l_orderkey % 3 = 0 then '-' else '+' end as f_strand")


def hit(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").selectExpr(
        "l_suppkey as tid", "l_partkey % 25 as qid", "100 * datediff(cast(l_shipdate as date), date '1992-01-01') as ts", "cast(10 * l_quantity as bigint) as n", "cast(floor(l_extendedprice) as bigint) as qs",
        "cast(10 * l_quantity - floor(100 * l_discount + 0.5) as bigint) as matches", f"{STRAND} as strand",
    )
    return x.selectExpr("tid", "qid", "cast(ts as bigint) as ts", "cast(ts + n as bigint) as te", "qs", "qs + n as qe", "matches", "strand")


def gene(spark: SparkSession, d: str) -> DataFrame:
    # Whole seconds downwards; a difference in seconds is cut towards zero, so one too late before the origin.
    x = table(spark, d, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"))
    x = x.selectExpr("user_id as chr", "(us - pmod(us, 1000000)) div 1000000 as start", "event_id as gene", "event_type as kind", "value", "props")
    return x.selectExpr("chr", "start", "start + 1 + cast(floor(10 * value) as bigint) as end", "gene", "kind", "props")


def seq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), ascii_upper(F.coalesce("text", F.lit(""))).alias("seq"))


def marker_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey % 19 as chr", "p_partkey as pos", "p_partkey as marker").where("marker % 10 <> 3")


def marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey as seq", "l_linenumber * 1000 + l_suppkey % 700 as start", "l_linenumber * 1000 + l_suppkey % 700 + 100 as end", "l_partkey as marker")


#: The same views for the oracle.
SQL = f"""
v_comp as (select l_orderkey as obj, row_number() over (partition by l_orderkey order by l_linenumber, {', '.join(ROW)}) as ord, l_partkey as comp, cast(1000 * l_quantity as bigint) as len, {STRAND} as strand from lineitem),
v_at as (select *, cast(coalesce(sum(len + 1000) over (partition by obj order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as start from v_comp),
v_agp as (select obj, 'W' as ctype, 2 * ord - 1 as part, start as obj_start, start + len as obj_end, comp, 0 as comp_start, len as comp_end, strand from v_at
  union all select obj, 'N', 2 * ord - 2, start - 1000, start, null, null, null, null from v_at where ord > 1),
v_hit as (select tid, qid, ts, ts + n as te, qs, qs + n as qe, matches, strand from (select l_suppkey as tid, l_partkey % 25 as qid, 100 * date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as ts, cast(10 * l_quantity as bigint) as n,
  cast(floor(l_extendedprice) as bigint) as qs, cast(10 * l_quantity - floor(100 * l_discount + 0.5) as bigint) as matches, {STRAND} as strand from lineitem)),
v_gene as (select chr, start, start + 1 + cast(floor(10 * value) as bigint) as "end", gene, kind, props from (select user_id as chr, cast(floor(epoch_us(ts) / 1000000.0) as bigint) - 1704067200 as start, event_id as gene, event_type as kind, value, props from events)),
v_seq as (select doc_id as seq_id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as seq from documents),
v_map as (select p_partkey % 19 as chr, p_partkey as pos, p_partkey as marker from part where p_partkey % 10 <> 3),
v_marker as (select l_orderkey as seq, l_linenumber * 1000 + l_suppkey % 700 as start, l_linenumber * 1000 + l_suppkey % 700 + 100 as "end", l_partkey as marker from lineitem)
"""

#: ``feature`` for the oracle, for queries that use it.
FEATURE_SQL = f""", v_feature as (select row_number() over (order by l_orderkey, l_linenumber, {', '.join(ROW)}) as id, l_partkey as comp, (l_orderkey * 37) % 20000 as start, (l_orderkey * 37) % 20000 + 50 * l_linenumber as "end", case when l_orderkey % 3 = 0 then '-' else '+' end as f_strand from lineitem)"""
