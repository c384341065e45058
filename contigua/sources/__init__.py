"""Readers of the file formats; coordinates become 0-based and half-open on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value, file, line): the lines of text files (gzip too) with their numbers from 1 on in each file.

    Blocks of a file are counted by themselves and their counts added up (one row for
    each block of a file), so no task sees a whole file.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(before, ["file", "block"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"))


def last_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with file and line) without those whose keys come again later; only keys and places are shuffled."""
    place = F.struct("file", "line")
    last = rows.groupBy(*keys).agg(F.max(place).alias("last"), F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"l_{k}") for k in keys], "last")
    met = [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys]
    stale = met[0] & (place < F.col("last"))
    for m in met[1:]:
        stale = stale & m
    return rows.join(last, stale, "left_anti")


def _fields(lines: DataFrame, names: list[str], least: int, *more: str) -> DataFrame:
    f = F.split("value", "\t", -1)
    good = lines.where("trim(value) <> '' and not startswith(value, '#')")
    return good.where(F.size(f) >= least).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)], *more)


def _rows(spark: SparkSession, path: str, names: list[str], least: int) -> DataFrame:
    """Tab-separated rows without comment and blank lines; fields that a line lacks are null."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    f = F.split("value", "\t", -1)
    return lines.where(F.size(f) >= least).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): upper-case sequences; of repeated ids the last one stays, records without bases drop out."""
    records = numbered(spark, path, "\n>")
    body = F.regexp_replace(F.regexp_replace("value", r"^>", ""), "\r", "")
    head = F.substring_index(body, "\n", 1)
    seq = F.upper(F.regexp_replace(F.expr("substring(x, length(h) + 1)"), r"\s", ""))
    rows = records.select(body.alias("x"), head.alias("h"), "file", "line").select(F.regexp_extract("h", r"^(\S*)", 1).alias("seq_id"), seq.alias("seq"), "file", "line").where("seq_id <> ''")
    return last_wins(rows, ["seq_id"]).where("seq <> ''").select("seq_id", "seq")


def read_fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id) in order, repeated ones as often as they come."""
    heads = spark.read.text(path).where("startswith(value, '>')")
    return heads.select(F.regexp_extract("value", r"^>(\S*)", 1).alias("seq_id")).orderBy("seq_id")


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.length("seq").alias("len"))


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """Structure rows; of rows with the same object and start the last one stays."""
    x = last_wins(_fields(numbered(spark, path), ["obj", "a", "b", "part", "ctype", "c", "d", "e", "f"], 9, "file", "line"), ["obj", "a"])
    n = lambda c: F.col(c).cast("long")
    gap = F.col("ctype").isin("N", "U")
    none = F.lit(None)
    return x.select(
        "obj", (n("a") - 1).alias("obj_start"), n("b").alias("obj_end"), n("part").alias("part"), "ctype", F.when(~gap, F.col("c")).alias("comp"),
        F.when(~gap, F.expr("try_cast(d as bigint)") - 1).alias("comp_start"), F.when(~gap, F.expr("try_cast(e as bigint)")).alias("comp_end"), F.when(~gap, F.col("f")).alias("strand"),
        F.when(gap, F.expr("try_cast(c as bigint)")).alias("gap_len"), F.when(gap, F.col("d")).alias("gap_type"), F.when(gap, F.col("e")).otherwise(none).alias("linkage"), F.when(gap, F.col("f")).alias("evidence"),
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, score, strand), the last three null where absent; of lines with one span the first stays."""
    x = _fields(numbered(spark, path), ["chrom", "start", "end", "name", "score", "strand"], 3, "file", "line")
    x = x.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    rest = ["name", "score", "strand"]
    first = x.groupBy("chrom", "start", "end").agg(F.min_by(F.struct(*rest), F.struct("file", "line")).alias("x"))
    return first.select("chrom", "start", "end", "x.*")


def read_bed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, chrom, start, end, rest): every line with its number, columns beyond the third as an array."""
    f = F.split("value", "\t", -1)
    good = numbered(spark, path).where("trim(value) <> '' and not startswith(value, '#')").where(F.size(f) >= 3)
    return good.select("line", f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.slice(f, 4, 1 << 20).alias("rest"))


def read_bed_last(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each sequence."""
    return read_bed_lines(spark, path).groupBy("chrom").agg(F.max_by(F.struct("start", "end", "rest"), "line").alias("x")).select("chrom", "x.*")


def range_list(bed: DataFrame, chrom: str) -> DataFrame:
    """(start, end) of one sequence."""
    return bed.where(F.col("chrom") == chrom).select("start", "end")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Hits of the first eleven columns; ``id`` is the number of the line."""
    x = _fields(numbered(spark, path), ["qid", "q_len", "q_start", "q_end", "strand", "tid", "t_len", "t_start", "t_end", "matches", "hit_len"], 11, F.col("line").alias("id"))
    return x.withColumns({c: F.col(c).cast("long") for c in ("q_len", "q_start", "q_end", "t_len", "t_start", "t_end", "matches", "hit_len")})


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    names = ["matches", "mismatch", "rep", "n", "q_gaps", "q_gap_len", "t_gaps", "t_gap_len", "strand", "qid", "q_len", "q_start", "q_end", "tid", "t_len", "t_start", "t_end"]
    x = _rows(spark, path, names, 17)
    x = x.withColumns({c: F.expr(f"try_cast({c} as bigint)") for c in names if c not in ("strand", "qid", "tid")})
    return x.where("matches is not null").withColumn("hit_len", F.expr("matches + mismatch + t_gap_len"))


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """Alignment coordinates of 13 columns; matches are the identical part of the hit, cut to a whole number."""
    x = _rows(spark, path, ["ts", "te", "qs", "qe", "t_hit", "hit_len", "identity", "t_len", "q_len", "t_cov", "q_cov", "tid", "qid"], 13)
    n = lambda c: F.col(c).cast("long")
    return x.select("tid", "qid", (n("ts") - 1).alias("t_start"), n("te").alias("t_end"), (F.least(n("qs"), n("qe")) - 1).alias("q_start"), F.greatest(n("qs"), n("qe")).alias("q_end"), F.when(n("qs") <= n("qe"), "+").otherwise("-").alias("strand"), n("hit_len").alias("hit_len"), F.expr("cast(floor(cast(hit_len as double) * cast(identity as double) / 100) as bigint)").alias("matches"))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature and parent: seqname, source, feature, start, end, score, strand, phase, attrs, id, parent."""
    x = _rows(spark, path, ["seqname", "source", "feature", "a", "b", "score", "strand", "phase", "attr"], 9)
    repaired = F.regexp_replace("attr", r"(?<=[^;])(?=(?:coverage|identity)=)", ";")
    x = x.withColumn("attrs", F.str_to_map(F.regexp_replace(repaired, r";+$", ""), F.lit(";"), F.lit("=")))
    x = x.select("seqname", "source", "feature", (F.col("a").cast("long") - 1).alias("start"), F.col("b").cast("long").alias("end"), "score", "strand", "phase", "attrs", F.col("attrs")["ID"].alias("id"), F.explode_outer(F.split(F.col("attrs")["Parent"], ",")).alias("parent"))
    return x.where("feature not in ('intron', 'intergenic')")


def read_block(spark: SparkSession, path: str) -> DataFrame:
    """(obj, ord, seq_id, start, end, strand) of files with ``>object`` headers and a component on each line."""
    parts = spark.read.option("lineSep", "\n>").text(path)
    body = parts.select(F.regexp_replace("value", r"^>", "").alias("x"))
    lines = body.select(F.regexp_extract("x", r"^(\S+)", 1).alias("obj"), F.expr("slice(split(x, '\\r?\\n'), 2, 2147483647)").alias("ls")).where("obj <> ''")
    good = F.filter("ls", lambda s: (F.trim(s) != "") & ~F.startswith(F.trim(s), F.lit("#")))
    f = F.split(F.trim("l"), r"\s+")
    x = lines.select("obj", F.posexplode(good).alias("i", "l")).select("obj", "i", f.alias("f"))
    return x.select("obj", (F.col("i") + 1).alias("ord"), F.get("f", F.lit(0)).alias("seq_id"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("end"), F.get("f", F.lit(3)).alias("strand"))


def genes_of(gff: DataFrame) -> DataFrame:
    """(mrna, gene) of the mRNA rows."""
    return gff.where("feature = 'mRNA'").select(F.col("id").alias("mrna"), F.col("parent").alias("gene"))


def gff_faults(gff: DataFrame) -> DataFrame:
    """(fault, id) of what makes a file unusable: mRNAs without id or parent, repeated mRNA ids, parents that are not there."""
    mrna, known = gff.where("feature = 'mRNA'"), gff.select(F.col("id").alias("k")).where("k is not null").distinct()
    lacks = mrna.where("id is null or parent is null").select(F.lit("incomplete").alias("fault"), F.coalesce("id", "parent").alias("id"))
    twice = mrna.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("fault"), "id")
    orphan = gff.where("parent is not null").join(known, F.col("parent") == F.col("k"), "left_anti").select(F.lit("orphan").alias("fault"), F.coalesce("id", "parent").alias("id"))
    return lacks.unionByName(twice).unionByName(orphan)


def read_cds_hits(spark: SparkSession, path: str, coverage: float, identity: float) -> DataFrame:
    """Mapped transcripts of a hit file with coverage and identity above both thresholds: seqname, start, end, strand, name, coverage, identity."""
    x = read_gff3(spark, path).where("feature = 'mRNA'")
    n = lambda k: F.expr(f"try_cast(attrs['{k}'] as double)").alias(k)
    x = x.select("seqname", "start", "end", "strand", F.col("attrs")["Name"].alias("name"), n("coverage"), n("identity"))
    return x.where((F.col("coverage") > coverage) & (F.col("identity") > identity))


def read_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Any of the tab-separated lists (markers, pairs, exclusions, coverage, ...), as strings."""
    return _rows(spark, path, names, 1)


def read_marker_map(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, marker); of a repeated marker the last line stays."""
    x = last_wins(_fields(numbered(spark, path), ["chr", "pos", "marker"], 3, "file", "line"), ["marker"])
    return x.select("chr", F.col("pos").cast("long").alias("pos"), "marker")


def read_marker_hits(spark: SparkSession, path: str) -> DataFrame:
    """(seq, start, end, marker), the lesser coordinate first."""
    x = _rows(spark, path, ["seq", "a", "b", "marker"], 4).withColumns({"a": F.col("a").cast("long"), "b": F.col("b").cast("long")})
    return x.select("seq", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), "marker")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) both ways, each once; orientations are left out, as a pair holds for all of them."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


ORIENTATIONS = ("+", "-", ".")


def three_orientations(ids: DataFrame, column: str) -> DataFrame:
    """Each id with its three orientations, ``id|+`` and so on."""
    each = F.array(*[F.concat(F.col(column), F.lit("|" + o)) for o in ORIENTATIONS])
    return ids.withColumn(column, F.explode(each))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): sequences that exclude each other, both ways. A line with another number of ids is an error."""
    x = _rows(spark, path, ["a", "b", "more"], 1)
    bad = F.raise_error(F.concat(F.lit("not a pair of ids: "), F.concat_ws(" ", "a", "b", "more")))
    return symmetric(x.select("a", F.when(F.col("b").isNull() | F.col("more").isNotNull(), bad).otherwise(F.col("b")).alias("b")))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(seq, grp): known placements, a sequence may be in several groups."""
    return _rows(spark, path, ["seq", "grp"], 2).distinct()


def read_alternatives(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): each sequence of a line's first list with each of its second one, both ways."""
    x = _rows(spark, path, ["a", "b"], 2)
    item = lambda c: F.explode(F.split(c, ","))
    return symmetric(x.select(item("a").alias("a"), "b").select("a", item("b").alias("b")))


def read_required(spark: SparkSession, path: str, lens: DataFrame, least: int = 0) -> DataFrame:
    """(chr, ord, seq_id, strand) of the listed oriented ids of at least a length, in order; ``ord`` begins at 1 and has no holes."""
    x = _rows(spark, path, ["chr", "ids"], 2).select("chr", F.posexplode(F.split("ids", ",")).alias("at", "id")).select("chr", "at", oriented(F.col("id")).alias("o")).select("chr", "at", "o.*")
    long = x.join(lens.select(F.col("seq_id").alias("k"), "len"), F.col("seq_id") == F.col("k")).where(F.col("len") >= least)
    return long.select("chr", F.row_number().over(Window.partitionBy("chr").orderBy("at")).alias("ord"), "seq_id", "strand")


def required_twice(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sequences required in both haplotypes, which is an input error."""
    return first.select("seq_id").intersect(second.select("seq_id"))


def read_pairs(spark: SparkSession, path: str, lens: DataFrame, names: list[str]) -> DataFrame:
    """Correspondence rows with ``known``: whether all their sequences are in ``lens``; a name of the chromosome is not one of them."""
    x = _rows(spark, path, names, len(names))
    for c in names:
        if c == "chr":
            continue
        there = lens.select(F.col("seq_id").alias(f"k_{c}")).distinct()
        x = x.join(there, F.col(c) == F.col(f"k_{c}"), "left")
    known = F.lit(True)
    for c in names:
        known = known & F.col(f"k_{c}").isNotNull() if c != "chr" else known
    return x.select(*names, known.alias("known"))


def read_breakpoints(spark: SparkSession, path: str, lens: DataFrame) -> DataFrame:
    """(seq, start, stop, known): pairs ``a-b,c-d``; BEGIN or START is 0, END or STOP the length; other words are an error.

    Sequences that are not in ``lens`` come with ``known`` false, to be reported and left out.
    """
    return breakpoints(_rows(spark, path, ["seq", "breaks"], 2), lens)


def breakpoints(rows: DataFrame, lens: DataFrame) -> DataFrame:
    """The same from rows (seq, breaks)."""
    pair = F.split(F.trim("p"), "-", -1)
    x = rows.select("seq", F.explode(F.filter(F.split("breaks", ","), lambda p: F.trim(p) != "")).alias("p")).select("seq", "p", F.upper(F.trim(F.get(pair, F.lit(0)))).alias("a"), F.upper(F.trim(F.get(pair, F.lit(1)))).alias("b"), F.size(pair).alias("n"))
    x = x.join(lens.select(F.col("seq_id").alias("k"), "len"), F.col("seq") == F.col("k"), "left")
    bad = F.raise_error(F.concat(F.lit("not a pair of coordinates: "), F.col("seq"), F.lit(" "), F.col("p"))).cast("long")
    number = lambda c: F.when((F.col("n") == 2) & F.col(c).rlike("^[0-9]+$"), F.col(c).cast("long")).otherwise(bad)
    start = F.when(F.col("a").isin("BEGIN", "START") & (F.col("n") == 2), F.lit(0).cast("long")).otherwise(number("a"))
    stop = F.when(F.col("b").isin("END", "STOP") & (F.col("n") == 2), F.col("len").cast("long")).otherwise(number("b"))
    return x.select("seq", start.alias("start"), stop.alias("stop"), F.col("k").isNotNull().alias("known"))


def read_descriptions(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """(gene, description): upper-case descriptions of genes, given for the gene or one of its mRNAs (``genes``: mrna, gene)."""
    return descriptions(_rows(spark, path, ["feature", "description"], 2), genes)


def descriptions(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """The same from rows (feature, description)."""
    of = genes.select(F.col("mrna").alias("m"), F.col("gene").alias("g"))
    return rows.join(of, F.col("feature") == F.col("m"), "left").select(F.coalesce("g", "feature").alias("gene"), F.upper("description").alias("description")).distinct()


def read_coverage(spark: SparkSession, path: str, lens: DataFrame) -> DataFrame:
    """(chrom, start, end, depth) runs of a table (chrom, 1-based position, depth); positions that it lacks have depth 0.

    Runs of equal depth are one, so a base is a row only where it must be.
    """
    x = _rows(spark, path, ["chrom", "p", "d"], 3).select("chrom", (F.col("p").cast("long") - 1).alias("at"), F.col("d").cast("long").alias("depth"))
    w = Window.partitionBy("chrom").orderBy("at")
    new = F.when((F.lag("depth").over(w) == F.col("depth")) & (F.lag("at").over(w) == F.col("at") - 1), 0).otherwise(1)
    runs = x.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("chrom", "run", "depth").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"))
    ends = lens.select(F.col("seq_id").alias("chrom"), F.col("len").alias("start"), F.col("len").alias("end"), F.lit(0).cast("long").alias("depth"))
    both = runs.select("chrom", "start", "end", "depth").unionByName(ends)
    o = Window.partitionBy("chrom").orderBy("start", "end")
    free = both.select("chrom", F.coalesce(F.lag("end").over(o), F.lit(0)).alias("a"), F.col("start").alias("end")).where("a < end").select("chrom", F.col("a").alias("start"), "end", F.lit(0).cast("long").alias("depth"))
    return runs.select("chrom", "start", "end", "depth").unionByName(free)


SIGNALS = ("string", "float", "int", "mixed_int", "mixed_float")


def read_signal(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(file, at, value, word) of files that hold one tab-separated vector: a number as ``value``, anything else as ``word``.

    ``string`` keeps all as words; ``float`` and ``int`` want numbers only (``int`` rounds
    them half away from zero); the mixed kinds take whole numbers and leave other words.
    """
    if kind not in SIGNALS:
        raise ValueError(f"unknown kind of signal {kind!r}, known are {', '.join(SIGNALS)}")
    x = numbered(spark, path, "\t").select("file", (F.col("line") - 1).alias("at"), F.rtrim(F.regexp_replace("value", "[\r\n]+$", "")).alias("w"))
    number = F.expr("try_cast(w as double)")
    if kind == "string":
        value = F.lit(None).cast("double")
    elif kind.startswith("mixed"):
        value = F.when(F.col("w").rlike("^[0-9]+$"), number)
    else:
        good = F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col("w"))).cast("double")).otherwise(number)
        value = F.round(good) if kind == "int" else good
    return x.select("file", "at", value.alias("value"), F.when(value.isNull(), F.col("w")).alias("word"))


def bases_of_runs(runs: DataFrame) -> DataFrame:
    """(chrom, at, value): one row for each base of runs (chrom, start, end, value)."""
    return runs.where("start < end").select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"), "value")


def known_structure(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(chr, hap, ord, seq_id, strand): components in order of a structure (obj, obj_start, comp, strand, ctype) with ``names`` (obj, chr, hap).

    Of an object named twice the least chromosome and haplotype count; ``ord`` begins at 0.
    """
    first = names.groupBy(F.col("obj").alias("n_obj")).agg(F.min(F.struct("chr", "hap")).alias("x"))
    j = rows.where("ctype = 'W'").join(first, F.col("obj") == F.col("n_obj"))
    w = Window.partitionBy("x.chr", "x.hap").orderBy("obj", "obj_start")
    return j.select("x.chr", "x.hap", (F.row_number().over(w) - 1).alias("ord"), F.col("comp").alias("seq_id"), "strand")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """(seq, pseudomolecule, strand)."""
    return _rows(spark, path, ["seq", "pseudomolecule", "strand"], 3)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, category); of lines with one start the last stays."""
    x = last_wins(_fields(numbered(spark, path), ["chrom", "start", "end", "category"], 4, "file", "line"), ["start"])
    return x.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "category")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """(step, state) of a JSON object of steps."""
    x = spark.read.text(path, wholetext=True).select(F.translate("value", "\r\n\t", "   ").alias("value"))
    return x.select(F.explode(F.from_json("value", "map<string,string>")).alias("step", "state"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report table with a header and the columns that ``schema`` names."""
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def depth_runs(df: DataFrame) -> DataFrame:
    """Coverage (chrom, start, end, depth) from intervals (chrom, start, end): a sweep over their ends."""
    ends = df.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy("chrom", "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("chrom").orderBy("at")
    swept = ends.select("chrom", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return swept.where("depth > 0 and end is not null")


def oriented(c: Column) -> Column:
    """``id|+`` as a struct of id and strand."""
    return F.struct(F.regexp_extract(c, r"^(.*)\|[+.-]$", 1).alias("seq_id"), F.regexp_extract(c, r"\|([+.-])$", 1).alias("strand"))
