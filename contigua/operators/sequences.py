"""Sequences of structures and transcripts, in chunks: no row holds more than a chunk of bases, whatever the length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.functions import reverse_complement

CHUNK = 1 << 20


def chunked(seqs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seq_id, chunk, bases) of (seq_id, seq): consecutive pieces of ``size`` bases, numbered from 0."""
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size))
    x = seqs.where("length(seq) > 0").select("seq_id", "seq", F.posexplode(starts).alias("chunk", "a"))
    return x.select("seq_id", F.col("chunk").cast("long").alias("chunk"), F.substr("seq", F.col("a") + 1, F.lit(size)).alias("bases"))


def assembled(structure: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(obj, chunk, bases): the sequence of each object, gaps as N, from the chunks (of the same size) of its components.

    Components are cut where chunks of either side end, turned if their strand is -, and
    put together chunk by chunk. A component that ``chunks`` lacks is left out of them, to
    be found by ``missing``.
    """
    at = lambda c: F.floor(c / size)
    cut_up = lambda a, b: F.explode(F.sequence(at(a), at(b - 1)))
    n = lambda c: F.col(c).cast("int")
    w = structure.where("ctype = 'W' and comp_start < comp_end").withColumn("k", cut_up(F.col("comp_start"), F.col("comp_end")))
    j = w.join(chunks.select(F.col("seq_id").alias("c_id"), F.col("chunk").alias("c"), "bases"), (F.col("comp") == F.col("c_id")) & (F.col("k") == F.col("c")))
    j = j.withColumns({"lo": F.greatest("comp_start", F.col("k") * size), "hi": F.least("comp_end", F.col("k") * size + F.length("bases"))}).where("lo < hi")
    j = j.withColumn("piece", F.substr("bases", (F.col("lo") - F.col("k") * size + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    start = F.when(F.col("strand") == "-", F.col("obj_start") + F.col("comp_end") - F.col("hi")).otherwise(F.col("obj_start") + F.col("lo") - F.col("comp_start"))
    pieces = j.select("obj", start.alias("a"), (start + F.col("hi") - F.col("lo")).alias("b"), F.when(F.col("strand") == "-", reverse_complement(F.col("piece"))).otherwise(F.col("piece")).alias("piece"))
    gaps = structure.where("ctype <> 'W' and obj_start < obj_end").select("obj", F.col("obj_start").alias("a"), F.col("obj_end").alias("b"), F.lit(None).cast("string").alias("piece"))
    both = pieces.unionByName(gaps).withColumn("chunk", cut_up(F.col("a"), F.col("b")))
    both = both.withColumns({"lo": F.greatest("a", F.col("chunk") * size), "hi": F.least("b", (F.col("chunk") + 1) * size)})
    own = both.withColumns({"skip": F.col("lo") - F.col("a"), "len": F.col("hi") - F.col("lo")})
    text = F.coalesce(F.substr("piece", n("skip") + 1, n("len")), F.repeat(F.lit("N"), n("len")))
    ordered = F.sort_array(F.collect_list(F.struct("lo", text.alias("text"))))
    return own.groupBy("obj", "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("bases"))


def missing(structure: DataFrame, chunks: DataFrame) -> DataFrame:
    """Components without a sequence."""
    return structure.where("ctype = 'W'").select("comp").distinct().join(chunks.select("seq_id").distinct(), F.col("comp") == F.col("seq_id"), "left_anti")


def spliced(parts: DataFrame) -> DataFrame:
    """Structure of transcripts (mrna, seqname, start, end, strand): their parts one after the other in the order of reading."""
    order = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    x = parts.withColumns({"o": order, "n": F.col("end") - F.col("start")})
    w = Window.partitionBy("mrna").orderBy("o", "n")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select(F.col("mrna").alias("obj"), F.lit("W").alias("ctype"), F.row_number().over(w).alias("part"), before.alias("obj_start"), (before + F.col("n")).alias("obj_end"), F.col("seqname").alias("comp"), F.col("start").alias("comp_start"), F.col("end").alias("comp_end"), F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"))


def whole(chunks: DataFrame) -> DataFrame:
    """(obj, seq) of (obj, chunk, bases), for objects as short as transcripts."""
    return chunks.groupBy("obj").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "bases"))), lambda x: x["bases"]), "").alias("seq"))
