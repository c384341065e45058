"""Placement policies and reports: marker policies, constraints, conflicts, usage, duplication and association flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What to do where markers and the forced list disagree on a strand.
POLICIES = {1: "markers, no longer forced", 2: "forced with the markers' strand", 3: "markers, no longer forced and blacklisted", 4: "forced as asked and blacklisted, no markers"}


def marker_policy(markers: DataFrame, forced: DataFrame, method: Column) -> DataFrame:
    """(list, hap, seq, strand): marker sequences (seq, strand), forced ones and blacklisted orientations after the policy.

    ``markers`` has seq and strand (+, - or .), ``forced`` has seq, hap, f_strand (one row a
    sequence), ``method`` is a key of ``POLICIES``. Without a conflict both lists keep the
    sequence; one without direction takes the forced strand, or + if it isn't forced.
    """
    x = markers.join(forced.select(F.col("seq").alias("f_seq"), "hap", "f_strand"), F.col("seq") == F.col("f_seq"), "left").withColumn("m", method)
    free, same, open_ = F.col("f_seq").isNull(), F.col("strand") == F.col("f_strand"), F.col("strand") == "."
    row = lambda name, hap, strand: F.struct(F.lit(name).alias("list"), hap.cast("int").alias("hap"), strand.alias("strand"))
    none, hap, own, asked = F.lit(None), F.col("hap"), F.col("strand"), F.col("f_strand")
    black = [row("blacklist", hap, F.lit(o)) for o in ("+", "-", ".")]
    out = (
        F.when(free, F.array(row("markers", none, F.when(open_, "+").otherwise(own))))
        .when(same | open_, F.array(row("markers", none, asked), row("forced", hap, asked)))
        .when(F.col("m") == 1, F.array(row("markers", none, own)))
        .when(F.col("m") == 2, F.array(row("markers", none, own), row("forced", hap, own)))
        .when(F.col("m") == 3, F.array(row("markers", none, own), *black))
        .when(F.col("m") == 4, F.array(row("forced", hap, asked), *black))
        .otherwise(F.raise_error(F.concat(F.lit("unknown policy "), F.col("m").cast("string"))).cast("array<struct<list:string,hap:int,strand:string>>"))
    )
    return x.withColumn("_x", F.explode(out)).select(*[c for c in markers.columns if c != "strand"], "_x.*")


def allowed(pairs: DataFrame, excluded: DataFrame, known: DataFrame) -> DataFrame:
    """Those pairs (seq, chr) that no exclusion (seq, chr) forbids and that known placements (seq, chr), where a sequence has any, name."""
    e = excluded.select(F.col("seq").alias("e_seq"), F.col("chr").alias("e_chr")).distinct()
    k = known.select(F.col("seq").alias("k_seq"), F.col("chr").alias("k_chr")).distinct()
    has = k.select(F.col("k_seq").alias("h_seq")).distinct()
    x = pairs.join(e, (F.col("seq") == F.col("e_seq")) & (F.col("chr") == F.col("e_chr")), "left_anti")
    x = x.join(has, F.col("seq") == F.col("h_seq"), "left").join(k, (F.col("seq") == F.col("k_seq")) & (F.col("chr") == F.col("k_chr")), "left")
    return x.where("h_seq is null or k_seq is not null").select(*pairs.columns)


def conflicts(placed: DataFrame) -> DataFrame:
    """``placed`` with ``conflict``: the first reason that speaks against each component's place, or null.

    ``placed`` has chr, ord, strand, own and other (markers on its chromosome and most on any
    other, null for none), least (the smallest map position on its chromosome) and
    direction. Reasons in order: Unsupported, Wrong_chr, Not_highest_support, Wrong_order
    (before one that stands right), Orientation.
    """
    first = F.when(F.col("own").isNull() & F.col("other").isNull(), "Unsupported").when(F.col("own").isNull(), "Wrong_chr").when(F.col("own") <= F.coalesce("other", F.lit(0)), "Not_highest_support")
    x = placed.withColumn("_first", first)
    w = Window.partitionBy("chr").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # Those that stand right rise, so the last of them has the greatest position so far.
    right = F.max(F.when(F.col("_first").isNull(), F.col("least"))).over(w)
    order = F.when(F.col("least") < right, "Wrong_order")
    turn = F.when(F.col("direction").isin("+", "-") & (F.col("direction") != F.col("strand")), "Orientation")
    return x.withColumn("conflict", F.coalesce("_first", order, turn)).drop("_first")


def after_policy(found: DataFrame, released: list[str], ignored: list[str]) -> DataFrame:
    """Components with ``verdict``: kept where there's no conflict or it is ignored, released where it is to be, else an error to stop at."""
    verdict = F.when(F.col("conflict").isNull() | F.col("conflict").isin(*ignored), "kept").when(F.col("conflict").isin(*released), "released").otherwise("error")
    return found.withColumn("verdict", verdict)


def marker_usage(hits: DataFrame, placed: DataFrame, lifted: DataFrame) -> DataFrame:
    """(seq, chr, strand, n, least, most): markers of each placed sequence that lie on its chromosome, and those lifted onto it.

    ``hits`` has seq, chr, pos (where the map has the marker); ``placed`` seq, chr, strand;
    ``lifted`` seq, chr, pos from older structures, whatever their chromosome.
    """
    p = placed.select(F.col("seq").alias("p_seq"), F.col("chr").alias("p_chr"), "strand")
    own = hits.join(p, (F.col("seq") == F.col("p_seq")) & (F.col("chr") == F.col("p_chr"))).select("seq", "pos")
    every = own.unionByName(lifted.select("seq", "pos"))
    return every.groupBy("seq").agg(F.count("*").alias("n"), F.min("pos").alias("least"), F.max("pos").alias("most")).join(p, F.col("seq") == F.col("p_seq")).select("seq", F.col("p_chr").alias("chr"), "strand", "n", "least", "most")


def duplication_flags(h1: Column, h2: Column, ratio: float) -> list[Column]:
    """Flags of copy numbers on both haplotypes: one or more against none, and many against few or more, each way."""
    out = []
    for name, a, b in (("h1", h1, h2), ("h2", h2, h1)):
        many = (a > 1) & (b > 0)
        out += [((a == 1) & (b == 0)).alias(f"{name}_1_0"), ((a > 1) & (b == 0)).alias(f"{name}_gt1_0"), (many & (a > b / F.lit(ratio))).alias(f"{name}_gt1_gt0_grt"), (many & (a < b * F.lit(ratio))).alias(f"{name}_gt1_gt0_lrt")]
    return out


def association_flags(seqs: DataFrame, associated: DataFrame, alternative: DataFrame) -> DataFrame:
    """(seq, chr, chr_assoc, mult_assoc, chr_alt, mult_alt, resolved) of unplaced sequences (seq, chr or null).

    ``associated`` and ``alternative`` have seq, mol, chr: pseudomolecules that its group or its
    alternatives are in. A flag is null where there's nothing to say; ``chr_*`` tells whether
    they contradict the sequence's chromosome (or each other), ``mult_*`` whether there are
    several. A sequence without a chromosome takes theirs where all of them agree.
    """
    def known(df, end):
        return df.groupBy(F.col("seq").alias(f"s_{end}")).agg(F.countDistinct("mol").alias(f"n_{end}"), F.countDistinct("chr").alias(f"c_{end}"), F.min("chr").alias(f"o_{end}"))

    x = seqs.join(known(associated, "assoc"), F.col("seq") == F.col("s_assoc"), "left").join(known(alternative, "alt"), F.col("seq") == F.col("s_alt"), "left")
    wrong = lambda e: F.when(F.col(f"n_{e}").isNull(), F.lit(None)).when(F.col(f"c_{e}") > 1, True).when(F.col("chr").isNull(), F.lit(None)).otherwise(F.col(f"o_{e}") != F.col("chr"))
    one = lambda e: F.coalesce(F.col(f"c_{e}"), F.lit(1)) == 1
    agree = one("assoc") & one("alt") & (F.col("o_assoc").isNull() | F.col("o_alt").isNull() | (F.col("o_assoc") == F.col("o_alt")))
    resolved = F.coalesce("chr", F.when(agree, F.coalesce("o_assoc", "o_alt")))
    return x.select("seq", "chr", wrong("assoc").alias("chr_assoc"), (F.col("n_assoc") > 1).alias("mult_assoc"), wrong("alt").alias("chr_alt"), (F.col("n_alt") > 1).alias("mult_alt"), resolved.alias("resolved"))


def metric_table(stats: DataFrame, files: list[str]) -> DataFrame:
    """metric x file as text, a dash where a file lacks the metric; ``stats`` has metric, file, value."""
    wide = stats.groupBy("metric").pivot("file", files).agg(F.first("value"))
    return wide.select("metric", *[F.coalesce(F.col(f"`{f}`"), F.lit("-")).alias(f) for f in files])


def filled_orientation(ids: DataFrame, found: DataFrame) -> DataFrame:
    """``ids`` (seq, strand) with . replaced by the strand that ``found`` (seq, f_strand) has, or +."""
    f = found.select(F.col("seq").alias("f_seq"), "f_strand")
    strand = F.when(F.col("strand") == ".", F.coalesce(F.when(F.col("f_strand").isin("+", "-"), F.col("f_strand")), F.lit("+"))).otherwise(F.col("strand"))
    return ids.join(f, F.col("seq") == F.col("f_seq"), "left").withColumn("strand", strand).drop("f_seq", "f_strand")


def polygons(ranges: DataFrame, target_height: int, query_height: int) -> DataFrame:
    """(grp, point, x, y): the five corners of each pair of ranges (grp, ts, te, qs, qe), the first one again at the end."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.lit(y).alias("y"))
    t, q = target_height, query_height
    points = F.array(corner("ts", t), corner("te", t), corner("qe", q), corner("qs", q), corner("ts", t))
    return ranges.select("grp", F.posexplode(points).alias("point", "c")).select("grp", "point", "c.x", "c.y")


def next_step(steps: DataFrame, order: list[str]) -> str | None:
    """The first of the steps in order that is not DONE; steps that the table (step, state) lacks aren't."""
    done = {r["step"] for r in steps.where("state = 'DONE'").select("step").distinct().collect()}  # as many as a run has steps
    return next((s for s in order if s not in done), None)
