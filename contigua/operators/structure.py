"""Structures: ordered, oriented components with gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.operators import intervals


def build(components: DataFrame, gap: int = 1000) -> DataFrame:
    """Structure rows from (obj, ord, comp, len, strand): running offsets, a gap before each component but the first."""
    w = Window.partitionBy("obj").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = components.withColumn("start", F.coalesce(F.sum(F.col("len") + gap).over(w), F.lit(0)))
    null = F.lit(None).cast("long")
    piece = F.struct(F.lit("W").alias("ctype"), (2 * F.col("ord") - 1).alias("part"), F.col("start").alias("obj_start"), (F.col("start") + F.col("len")).alias("obj_end"), F.col("comp").alias("comp"), F.lit(0).cast("long").alias("comp_start"), F.col("len").alias("comp_end"), F.col("strand").alias("strand"))
    hole = F.struct(F.lit("N").alias("ctype"), (2 * F.col("ord") - 2).alias("part"), (F.col("start") - gap).alias("obj_start"), F.col("start").alias("obj_end"), null.alias("comp"), null.alias("comp_start"), null.alias("comp_end"), F.lit(None).cast("string").alias("strand"))
    return placed.select("obj", F.explode(F.when(F.col("ord") > 1, F.array(hole, piece)).otherwise(F.array(piece))).alias("x")).select("obj", "x.*")


def invert(structure: DataFrame) -> DataFrame:
    """Components as objects: where each of their stretches went."""
    w = Window.partitionBy("comp").orderBy("comp_start", "obj", "obj_start")
    return structure.where("ctype = 'W'").select(F.col("comp").alias("obj"), F.row_number().over(w).alias("part"), F.col("comp_start").alias("obj_start"), F.col("comp_end").alias("obj_end"), F.col("obj").alias("comp"), F.col("obj_start").alias("comp_start"), F.col("obj_end").alias("comp_end"), "strand")


def invert_filled(structure: DataFrame, lengths: DataFrame) -> DataFrame:
    """As ``invert``, with what no placement covers of each component (comp, len) filled by the component itself.

    A component without any placement comes as itself whole.
    """
    placed = invert(structure)
    used = intervals.merge(placed.select("obj", F.col("obj_start").alias("start"), F.col("obj_end").alias("end")), "obj")
    free = intervals.complement(used, "obj", lengths.select(F.col("comp").alias("obj"), "len"))
    own = free.select("obj", F.col("free_start").alias("obj_start"), F.col("free_end").alias("obj_end"), F.col("obj").alias("comp"), F.col("free_start").alias("comp_start"), F.col("free_end").alias("comp_end"), F.lit("+").alias("strand"))
    w = Window.partitionBy("obj").orderBy("obj_start", "comp", "comp_start", "obj_end")
    return placed.drop("part").unionByName(own).select("obj", F.row_number().over(w).alias("part"), "obj_start", "obj_end", "comp", "comp_start", "comp_end", "strand")


def compose(structure: DataFrame, child: DataFrame) -> DataFrame:
    """Structure in terms of what its components are made of: (comp, c_start, c_end, sub, s_start, s_end, s_strand)."""
    lo, hi = F.greatest("comp_start", "c_start"), F.least("comp_end", "c_end")
    j = intervals.overlapping(structure.where("ctype = 'W'"), child, "comp", ("comp_start", "comp_end"), ("c_start", "c_end")).withColumns({"lo": lo, "hi": hi})
    at = F.when(F.col("strand") == "+", F.col("obj_start") + F.col("lo") - F.col("comp_start")).otherwise(F.col("obj_start") + F.col("comp_end") - F.col("hi"))
    sub = F.when(F.col("s_strand") == "+", F.col("s_start") + F.col("lo") - F.col("c_start")).otherwise(F.col("s_end") - (F.col("hi") - F.col("c_start")))
    n = F.col("hi") - F.col("lo")
    return j.select("obj", at.alias("obj_start"), (at + n).alias("obj_end"), F.col("sub").alias("comp"), sub.alias("comp_start"), (sub + n).alias("comp_end"), F.when(F.col("strand") == F.col("s_strand"), "+").otherwise("-").alias("strand"))


def liftover(features: DataFrame, structure: DataFrame) -> DataFrame:
    """Features (id, comp, start, end, f_strand) that lie whole in a placed stretch, in object coordinates."""
    return _lifted(intervals.within(features, structure.where("ctype = 'W'"), "comp", ("start", "end"), ("comp_start", "comp_end")))


def _lifted(met: DataFrame, *kept: str) -> DataFrame:
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("obj_start") + F.col("start") - F.col("comp_start")).otherwise(F.col("obj_start") + F.col("comp_end") - F.col("end"))
    return met.select("id", "obj", start.alias("start"), (start + F.col("end") - F.col("start")).alias("end"), F.when(plus == (F.col("f_strand") == "+"), "+").otherwise("-").alias("strand"), *kept)


def liftover_numbered(features: DataFrame, structure: DataFrame) -> DataFrame:
    """As ``liftover``, with the number ``n`` of each place of a feature in the order of (obj, start, strand), from 1; ids must be unique.

    A feature's places arise in one task and are numbered there: they may be many times
    the features, so only features and stretches move.
    """
    met = intervals.within(features, structure.where("ctype = 'W'"), "comp", ("start", "end"), ("comp_start", "comp_end"), dealt=True)
    w = Window.partitionBy("comp", "_bin", "id").orderBy("obj", "start", "strand")
    return _lifted(met, "comp", "_bin").withColumn("n", F.row_number().over(w)).drop("comp", "_bin")


def dropped(features: DataFrame, structure: DataFrame) -> DataFrame:
    """Features that no placed stretch holds; the longest stretch of a component from 0 on decides."""
    reach = structure.where("ctype = 'W' and comp_start = 0").groupBy(F.col("comp").alias("r_comp")).agg(F.max("comp_end").alias("reach"))
    return features.join(reach, (F.col("comp") == F.col("r_comp")) & (F.col("end") <= F.col("reach")), "left_anti")


def reused(structure: DataFrame) -> DataFrame:
    """Stretches of a component that overlap another placement of it, from sorted neighbours only."""
    w = Window.partitionBy("comp").orderBy("comp_start", "comp_end", "obj", "obj_start")
    before = F.max("comp_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("comp_start").over(w)
    return structure.where("ctype = 'W'").select("*", before.alias("b"), after.alias("a")).where("b > comp_start or a < comp_end").drop("a", "b")


def broken(lengths: DataFrame, breaks: DataFrame, prefix: str) -> DataFrame:
    """Structure of what is left of sequences (seq_id, len) between the gaps (seq_id, start, end) at which they break.

    A sequence without gaps to break at is one object, ``prefix`` and its id; one with
    them is several, numbered from 1 in order. Gaps at an end of the sequence don't count.
    """
    inner = breaks.join(lengths, "seq_id").where("start > 0 and end < len").select("seq_id", "start", "end").distinct()
    free = intervals.complement(intervals.merge(inner, "seq_id"), "seq_id", lengths)
    w = Window.partitionBy("seq_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("free_start"))
    name = F.concat(F.lit(prefix), F.col("seq_id").cast("string"), F.when(n > 1, F.concat(F.lit("_"), i)).otherwise(""))
    size = F.col("free_end") - F.col("free_start")
    return free.select(name.alias("obj"), F.lit("W").alias("ctype"), F.lit(1).cast("long").alias("part"), F.lit(0).cast("long").alias("obj_start"), size.alias("obj_end"), F.col("seq_id").alias("comp"), F.col("free_start").alias("comp_start"), F.col("free_end").alias("comp_end"), F.lit("+").alias("strand"))


def between_gaps(structure: DataFrame, least: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """Runs of components between the gaps at which an object may break: (obj, start, end, up_start, up_end, down_start, down_end).

    A gap is no such place if it is shorter than ``least`` or one of its ends lies in an
    excluded region (obj, x_start, x_end); a run goes on over it. Before the first run stands (0, 0)
    or the gap that the object begins with, after the last one its end.
    """
    gap = F.col("ctype") != "W"
    rows = structure.withColumn("jump", gap & (F.col("obj_end") - F.col("obj_start") < least))
    if excluded is not None:
        ends = structure.where(gap).select("obj", "part", F.explode(F.array(F.col("obj_start"), F.col("obj_end"))).alias("at"))
        hit = intervals.within(ends.withColumn("at_2", F.col("at")), excluded, "obj", ("at", "at_2"), ("x_start", "x_end")).select(F.col("obj").alias("h_obj"), F.col("part").alias("h_part")).distinct()
        rows = rows.join(hit, (F.col("obj") == F.col("h_obj")) & (F.col("part") == F.col("h_part")), "left").withColumn("jump", F.col("jump") | (gap & F.col("h_obj").isNotNull())).drop("h_obj", "h_part")
    w = Window.partitionBy("obj").orderBy("obj_start", "obj_end")
    # A gap before all sequence counts whatever its length.
    first = F.sum(F.when(~gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0
    breaks = gap & (first | ~F.col("jump"))
    x = rows.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = x.groupBy("obj", "run").agg(F.min(F.when(~gap, F.col("obj_start"))).alias("start"), F.max(F.when(~gap, F.col("obj_end"))).alias("end"), F.max(F.when(F.col("breaks"), F.struct("obj_start", "obj_end"))).alias("up"))
    o = Window.partitionBy("obj").orderBy("run")
    y = spans.withColumn("down", F.lead("up").over(o)).where("start is not null")
    zero = F.lit(0).cast("long")
    return y.select("obj", "start", "end", F.coalesce("up.obj_start", zero).alias("up_start"), F.coalesce("up.obj_end", zero).alias("up_end"), F.coalesce("down.obj_start", "end").alias("down_start"), F.coalesce("down.obj_end", "end").alias("down_end"))


def targets(regions: DataFrame, gap: int = 10_000, substitute: int = 10) -> DataFrame:
    """Structures to map fillers on: the regions (obj, place, comp, start, end, there) of each object in the order of ``place``, a gap between neighbours.

    (obj, part, region, ctype, obj_start, obj_end, comp, comp_start, comp_end, strand): of
    three regions the first is UP, the next SEQ, the last DOWN, and what lies between GAP. A
    region that isn't there (its sequence is missing) is ``substitute`` unknown bases, of
    type S, with the coordinates it stands for.
    """
    w = Window.partitionBy("obj").orderBy("place", "comp", "start", "end")
    size = F.when(F.col("there"), F.col("end") - F.col("start")).otherwise(F.lit(substitute)).cast("long")
    x = regions.withColumns({"n": size, "i": F.row_number().over(w)})
    x = x.withColumn("a", F.coalesce(F.sum(F.col("n") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    null = F.lit(None).cast("long")
    names = F.array(*[F.lit(r) for r in ("UP", "SEQ", "DOWN")])
    kind = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    piece = kind(part=2 * F.col("i") - 1, region=F.get(names, F.col("i") - 1), ctype=F.when(F.col("there"), "W").otherwise("S"), obj_start=F.col("a"), obj_end=F.col("a") + F.col("n"), comp=F.col("comp"), comp_start=F.col("start"), comp_end=F.col("end"), strand=F.lit("+"))
    hole = kind(part=2 * F.col("i") - 2, region=F.lit("GAP"), ctype=F.lit("N"), obj_start=F.col("a") - gap, obj_end=F.col("a"), comp=F.lit(None).cast(regions.schema["comp"].dataType), comp_start=null, comp_end=null, strand=F.lit(None).cast("string"))
    return x.select("obj", F.explode(F.when(F.col("i") > 1, F.array(hole, piece)).otherwise(F.array(piece))).alias("x")).select("obj", "x.*")
