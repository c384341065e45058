"""Writers of the file formats: each gives lines (keys of their order, value) that ``write_lines`` puts into files.

Coordinates go back to each format's own convention. Lines are sorted by range, so files
follow one another in order and no task holds more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """Records as text, bases wrapped; write with ``.write.text``."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), wrapped).alias("value"))


def agp_lines(df: DataFrame) -> DataFrame:
    gap = F.col("ctype").isin("N", "U")
    return df.select(F.concat_ws("\t", "obj", F.col("obj_start") + 1, "obj_end", "part", "ctype", F.when(gap, F.concat_ws("\t", "gap_len", "gap_type", "linkage", "evidence")).otherwise(F.concat_ws("\t", "comp", F.col("comp_start") + 1, "comp_end", "strand"))).alias("value"))


def write_lines(lines: DataFrame, path: str, order: list[str], compress: bool = False, by: str | None = None) -> None:
    """Writes ``value`` in the order of ``order``; ``by`` gives each of its values a folder of its own."""
    out = lines.orderBy(*([by] if by else []), *order).select("value", *([by] if by else []))
    writer = out.write.option("compression", "gzip" if compress else "none")
    (writer.partitionBy(by) if by else writer).text(path)


def tabbed(*columns: Column | str) -> Column:
    """Columns as one line, nulls as a dot."""
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in columns])


def bed_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(chrom, start, end, value) of intervals, with further columns if named."""
    return df.select("chrom", "start", "end", tabbed("chrom", "start", "end", *(columns or [])).alias("value"))


def gff_to_bed(gff: DataFrame) -> DataFrame:
    """Three columns of features."""
    return gff.select(F.col("seqname").alias("chrom"), "start", "end")


#: Kinds of features in the order they have below their transcript.
FEATURES = ("exon", "five_prime_UTR", "CDS", "three_prime_UTR")


def gff3_lines(features: DataFrame, lens: DataFrame) -> DataFrame:
    """(seqname, g_start, gene, m_start, mrna, level, start, value) of genes, transcripts and features, after a line for each sequence.

    ``features`` has seqname, source, feature, start, end, score, strand, phase, attr, gene and
    mrna (null for what is above them). Order: sequence, gene by start, transcript by start, kind, start.
    """
    kind = F.when(F.col("feature") == "gene", 0).when(F.col("mrna").isNull() | F.col("feature").isin("mRNA", "transcript"), 1)
    for i, f in enumerate(FEATURES):
        kind = kind.when(F.col("feature") == f, 2 + i)
    g, m = Window.partitionBy("seqname", "gene"), Window.partitionBy("seqname", "gene", "mrna")
    x = features.select("*", F.min("start").over(g).alias("g_start"), F.when(kind.otherwise(9) > 0, F.min("start").over(m)).alias("m_start"), kind.otherwise(9).alias("level"))
    rows = x.select("seqname", "g_start", "gene", "m_start", "mrna", "level", "start", tabbed("seqname", "source", "feature", F.col("start") + 1, "end", "score", "strand", "phase", "attr").alias("value"))
    null = lambda t: F.lit(None).cast(t)
    heads = lens.select(F.col("seq_id").alias("seqname"), F.lit(-1).cast("long").alias("g_start"), null("string").alias("gene"), null("long").alias("m_start"), null("string").alias("mrna"), F.lit(-1).alias("level"), null("long").alias("start"), F.concat_ws(" ", F.lit("##sequence-region"), "seq_id", F.lit(1), "len").alias("value"))
    return heads.unionByName(rows)


GFF_ORDER = ["seqname", "g_start", "gene", "m_start", "mrna", "level", "start"]


def table_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines; a sorted table is these lines in the order of ``value``."""
    return df.select(tabbed(*columns).alias("value"))


def signal_lines(runs: DataFrame, key: str = "chrom") -> DataFrame:
    """(key, start, value) of runs (key, start, end, code); a code that is no number is written as 0."""
    code = F.when(F.col("code").rlike("^[0-9]+([.][0-9]+)?$"), F.col("code")).otherwise("0")
    return runs.select(key, "start", tabbed(key, "start", "end", code).alias("value"))


def paf_lines(df: DataFrame) -> DataFrame:
    """(tid, t_start, value) of hits (qid, q_len, q_start, q_end, strand, tid, t_len, t_start, t_end, matches, hit_len, mapq)."""
    names = ["qid", "q_len", "q_start", "q_end", "strand", "tid", "t_len", "t_start", "t_end", "matches", "hit_len", "mapq"]
    return df.select("tid", "t_start", tabbed(*names).alias("value"))


def block_lines(structure: DataFrame, unused: DataFrame | None = None) -> DataFrame:
    """(obj, ord, value): a header for each object, then its components; ``unused`` (seq_id, len) become objects of their own."""
    w = Window.partitionBy("obj").orderBy("obj_start")
    rows = structure.where("ctype = 'W'").select(F.col("obj").cast("string").alias("obj"), F.row_number().over(w).alias("ord"), F.concat_ws("\t", "comp", "comp_start", "comp_end", "strand").alias("value"))
    heads = rows.where("ord = 1").select("obj", F.lit(0).alias("ord"), F.concat(F.lit(">"), "obj").alias("value"))
    out = heads.unionByName(rows)
    if unused is not None:
        own = unused.select(F.col("seq_id").cast("string").alias("obj"), F.array(F.concat(F.lit(">"), "seq_id"), F.concat_ws("\t", "seq_id", F.lit(0), "len", F.lit("+"))).alias("two"))
        out = out.unionByName(own.select("obj", F.posexplode("two").alias("ord", "value")))
    return out


def count_lines(df: DataFrame, key: str, n: str) -> DataFrame:
    """(place, value): a header, then the rows."""
    rows = df.select(F.lit(1).alias("place"), tabbed(key, n).alias("value"))
    return df.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(f"{key}\t{n}").alias("value")).unionByName(rows)


def list_lines(df: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """(key, value): the items of each key in order, comma-joined."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("_item")))), lambda x: x["_item"].cast("string"))
    return df.groupBy(key).agg(F.array_join(items, ",").alias("_l")).select(key, tabbed(key, "_l").alias("value"))


def number_text(c: Column, digits: int) -> Column:
    """A number with so many digits after the point and no separators."""
    return F.format_string(f"%.{digits}f", c.cast("double"))
