"""Curation of gene models: exons from coding parts, introns, spans, trimming at gaps, pseudogenes, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exons_from(parts: DataFrame) -> DataFrame:
    """(mrna, start, end) of coding parts and untranslated regions (mrna, start, end): what touches or overlaps is one exon."""
    w = Window.partitionBy("mrna").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = parts.select("mrna", "start", "end", F.when(reach >= F.col("start"), 0).otherwise(1).alias("new"))
    y = x.withColumn("i", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return y.groupBy("mrna", "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def trimmed(exons: DataFrame, bases: str = "bases") -> DataFrame:
    """Exons with their bases, cut back where they begin or end in N; such that are all N go."""
    # Not by patterns: their $ also stands before a line end that closes the bases.
    n = F.lit("N")
    left = F.length(bases) - F.length(F.ltrim(bases, n))
    right = F.length(bases) - F.length(F.rtrim(bases, n))
    x = exons.withColumns({"_l": left, "_r": right}).where(F.col("_l") < F.length(bases))
    return x.withColumns({"start": F.col("start") + F.col("_l"), "end": F.col("end") - F.col("_r"), bases: F.trim(bases, n)}).drop("_l", "_r")


def exon_names(exons: DataFrame) -> DataFrame:
    """``exons`` (mrna, start, end) with their number from 1 on and the attributes ID and Parent."""
    w = Window.partitionBy("mrna").orderBy("start", "end")
    x = exons.withColumn("exon", F.row_number().over(w))
    return x.withColumn("attr", F.concat(F.lit("ID="), "mrna", F.lit(".exon_"), "exon", F.lit(";Parent="), "mrna"))


def introns(exons: DataFrame) -> DataFrame:
    """(mrna, start, end) between neighbouring exons of a transcript."""
    w = Window.partitionBy("mrna").orderBy("start", "end")
    x = exons.select("mrna", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), F.col("start").alias("b"))
    return x.where("a < b").select("mrna", F.col("a").alias("start"), F.col("b").alias("end"))


def spans(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, mrna, start, end, gene_start, gene_end): from the exons of each transcript and of all of a gene's (``genes``: mrna, gene)."""
    m = exons.groupBy("mrna").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(genes, "mrna")
    w = Window.partitionBy("gene")
    return m.select("gene", "mrna", "start", "end", F.min("start").over(w).alias("gene_start"), F.max("end").over(w).alias("gene_end"))


def pseudogenes(features: DataFrame, dropped: DataFrame) -> DataFrame:
    """(feature, id, parent, start, end, attr): the models of dropped transcripts (mrna) as pseudogenes.

    ``features`` has feature (gene, mRNA, exon, ...), gene, mrna, start, end. A gene with a
    dropped transcript comes under its name with .pseudo, the transcript below it, of its
    parts only exons.
    """
    gone = dropped.select(F.col("mrna").alias("d")).distinct()
    of = features.where("mrna is not null").join(gone, F.col("mrna") == F.col("d"))
    genes = of.select(F.col("gene").alias("g")).distinct()
    note = F.lit(';pseudogene="unknown";pseudo=true')
    name = F.concat(F.col("gene"), F.lit(".pseudo"))
    null = F.lit(None).cast("string")
    top = features.where("feature = 'gene'").join(genes, F.col("gene") == F.col("g")).select(F.lit("gene").alias("feature"), name.alias("id"), null.alias("parent"), "start", "end", F.concat(F.lit("ID="), name, note).alias("attr"))
    mid = of.where("feature = 'mRNA'").select(F.lit("transcript").alias("feature"), F.col("mrna").alias("id"), name.alias("parent"), "start", "end", F.concat(F.lit("ID="), "mrna", F.lit(";Parent="), name, note).alias("attr"))
    low = of.where("feature = 'exon'").select("feature", null.alias("id"), F.col("mrna").alias("parent"), "start", "end", F.concat(F.lit("Parent="), "mrna", note).alias("attr"))
    return top.unionByName(mid).unionByName(low)


def feature_table(features: DataFrame, feature: str, pattern: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(seqname, start, end, id) of one kind of feature; on sequences whose names hold ``pattern``, or that ``ids`` (seqname) lists."""
    x = features.where(F.col("feature") == feature)
    if pattern is not None:
        x = x.where(F.contains("seqname", F.lit(pattern)))
    if ids is not None:
        x = x.join(ids.select("seqname").distinct(), "seqname", "left_semi")
    return x.select("seqname", "start", "end", "id")
