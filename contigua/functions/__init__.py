"""Column functions of the sequence domain; all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complement of each IUPAC letter, in order.
BASES = "ACGTUNRYSWKMBDHV"
COMPLEMENTS = "TGCAANYRSWMKVHDB"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"  # codons in the order T, C, A, G


def ascii_upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reverse_complement(c: Column) -> Column:
    """Reverse complement of an upper-case sequence; other characters stay."""
    return F.reverse(F.translate(c, BASES, COMPLEMENTS))


def translated(c: Column) -> Column:
    """Amino acids of whole codons from the first base on; codons with other letters give X."""
    number = lambda s, i: F.instr(F.lit("TCAG"), F.substring(s, i, 1))
    codons = F.regexp_extract_all(c, F.lit("(?s)(...)"), F.lit(1))

    def one(s):
        a, b, d = number(s, 1), number(s, 2), number(s, 3)
        return F.when((a > 0) & (b > 0) & (d > 0), F.lit(AMINO).substr((a - 1) * 16 + (b - 1) * 4 + d, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(codons, one), "")


def open_phase(c: Column) -> Column:
    """The first of the phases 0 to 2 that reads ATG first and no stop before its last codon; else null."""

    def whole(phase):
        rest = c.substr(F.lit(phase + 1), F.length(c))
        return rest.startswith("ATG") & ~translated(rest).rlike("\\*(?s:.)")

    return F.coalesce(*[F.when(whole(i), F.lit(i)) for i in range(3)])


def runs_of(c: Column, expression: str) -> Column:
    """Spans (start, end), 0-based half-open, of the expression's matches."""
    found, between = F.regexp_extract_all(c, F.lit(expression), F.lit(0)), F.split(c, expression, -1)
    both = F.zip_with(found, between, lambda m, g: F.struct(F.char_length(g).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("own")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    out = F.aggregate(
        both, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.when(x["own"] > 0, F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["own"]).alias("end"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    return out


def without_islets(c: Column, least: int = 10) -> Column:
    """Stretches of fewer than ``least`` letters between runs of N become N; lengths stay."""
    for n in range(1, least):
        c = F.regexp_replace(c, rf"(?<=N)[^N]{{{n}}}(?=N)", "N" * n)
    return c


def attributes(c: Column) -> Column:
    """``k=v;k=v`` as a map."""
    return F.str_to_map(c, F.lit(";"), F.lit("="))


def coverage_category(value: Column, median: Column) -> Column:
    """Ploidy class of a depth against the median: 0, 1, 2 or H."""
    return F.when(value <= 0.1 * median, "0").when(value <= 0.6 * median, "1").when(value < 2.4 * median, "2").otherwise("H")


def direction(places: Column) -> Column:
    """Where an array of map positions leads: single, +, -, or undetectable where rises and falls are as many.

    Equal neighbours are neither; without any rise it is -, as for positions that are all equal.
    """
    steps = F.zip_with(F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.signum(b - a))
    up, down = F.size(F.filter(steps, lambda x: x > 0)), F.size(F.filter(steps, lambda x: x < 0))
    return F.when(F.size(places) < 2, "single").when(up == 0, "-").when(down == 0, "+").when(up > down, "+").when(up < down, "-").otherwise("undetectable")


def mapq(matches: Column, length: Column) -> Column:
    """Pseudo mapping quality: 255 for no match at all, 0 where every base matches, cut to a whole number."""
    return F.floor(255 * (1 - matches / length)).cast("int")


def alt_strategy(left: Column, middle: Column, right: Column) -> Column:
    """How to patch a gap from the mate's regions; haploid ones tell nothing there. Null for none."""
    side = lambda c, name: F.when(c.isin("DIP", "OK"), name).when(c == "REP", "rep")
    a, b = side(left, "left"), side(right, "right")
    own = F.when(middle == "DIP", "altF").when(middle == "OK", "alt").when(middle == "REP", "altR")
    # A repeat on the left needs sequence on the right, one on the right sequence on the left.
    flank = F.when(a == "left", F.concat_ws(":", F.lit("left"), F.when(b.isNotNull(), F.lit("gap")), b)).when(b == "right", F.when(a == "rep", F.lit("rep:gap:right")).otherwise(F.lit("right")))
    return F.when(own.isNotNull(), F.concat_ws(":", a, own, b)).otherwise(flank)


def patch_strategy(left: Column, middle: Column, right: Column) -> Column:
    """How to patch a gap from the classes of its left, middle and right regions; null for none."""
    side = lambda c, name: F.when(c.isin("DIP", "OK", "HAP"), name).when(c == "REP", "rep")
    a, b = side(left, "left"), side(right, "right")
    hybrid = F.when(a.isNotNull() | b.isNotNull(), F.concat(F.lit("hybrid_"), F.concat_ws(":", a, F.lit("alt"), b)))
    flank = (
        F.when(a == "left", F.concat_ws(":", F.lit("flanking_left"), F.when(b.isNotNull(), F.lit("gap")), b))
        .when((a == "rep") & b.isNotNull(), F.concat(F.lit("flanking_rep:gap:"), b))
        .when(a.isNull() & (b == "right"), F.lit("flanking_right"))
    )
    return F.when(middle.isin("DIP", "OK"), hybrid).otherwise(flank)
