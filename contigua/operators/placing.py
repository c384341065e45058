"""Placing sequences on chromosomes: assignment by markers, heaviest sets of intervals, exclusions, projection.

What a task holds is one chromosome's placed sequences (one row for each), never its hits or markers.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.operators.chain import most_markers
from contigua.session import cut, ship


def assigned(marks: DataFrame) -> DataFrame:
    """(seq, verdict, chr, strand) from (seq, chr, pos, start, end): by the longest marker chain among chromosomes and strands.

    A chain longer than all others assigns; both strands of one chromosome alike leave the
    strand open ('.'); chains as long on another chromosome make the sequence unreliable.
    """
    both = marks.withColumn("strand", F.lit("+")).unionByName(marks.withColumns({"strand": F.lit("-"), "pos": -F.col("pos")}))
    chains = most_markers(both, ["seq", "chr", "strand"])
    w = Window.partitionBy("seq").orderBy(F.desc("n_markers"), F.desc("chr"), F.desc("strand"))
    ranked = chains.withColumn("place", F.row_number().over(w)).where("place <= 3").groupBy("seq")
    at = lambda c, i: F.max(F.when(F.col("place") == i, F.col(c))).alias(f"{c}{i}")
    top = ranked.agg(*[at(c, i) for c in ("n_markers", "chr", "strand") for i in (1, 2, 3)])
    alone = F.col("n_markers2").isNull() | (F.col("n_markers1") > F.col("n_markers2"))
    open_ = (F.col("chr1") == F.col("chr2")) & (F.col("n_markers3").isNull() | (F.col("n_markers1") > F.col("n_markers3")))
    verdict = F.when(alone, "assigned").when(open_, "undirected").otherwise("unreliable")
    return top.select("seq", verdict.alias("verdict"), F.when(alone | open_, F.col("chr1")).alias("chr"), F.when(alone, F.col("strand1")).when(open_, ".").alias("strand"))


def heaviest(items: list[tuple]) -> list:
    """Ids of the heaviest set of (start, stop, weight, id, forced) whose members end before the next start.

    Forced items stay, of overlapping ones the first; others that overlap a kept one go. Ties leave an item out.
    """
    kept, stops = [], []
    for x in sorted((x for x in items if x[4]), key=lambda x: (x[0], x[1], x[3])):
        if not kept or kept[-1][1] < x[0]:
            kept.append(x)
            stops.append(x[1])

    def free(x):
        i = bisect_left(stops, x[0])
        return i == len(kept) or x[1] < kept[i][0]

    order = sorted([*kept, *(x for x in items if not x[4] and x[2] > 0 and free(x))], key=lambda x: (x[1], x[0], x[3]))
    ends, best, before = [x[1] for x in order], [0], []
    for i, x in enumerate(order):
        before.append(bisect_left(ends, x[0], 0, i))
        best.append(max(best[i], best[before[i]] + x[2]))
    out, i = [], len(order)
    while i:
        if best[i] > best[i - 1] or order[i - 1][4]:
            out.append(order[i - 1][3])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def without_excluded(items: list[tuple], lengths: dict, pairs: list[tuple]) -> list:
    """``heaviest`` set with no excluded pair in it.

    Of the first pair that is, the forced one stays, else the longer, else the smaller id;
    the other goes, and those that had gone for its sake return.
    """
    forced, gone, victims = {x[3]: x[4] for x in items}, set(), {}
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    while True:
        path = heaviest([x for x in items if x[3] not in gone])
        there = set(path)
        hit = next((p for p in pairs if p[0] in there and p[1] in there), None)
        if hit is None:
            return path
        a, b = hit
        stays = lambda x: (forced[x], lengths[x])
        win, lose = (b, a) if stays(b) > stays(a) else (a, b)
        gone.add(lose)
        victims.setdefault(win, set()).add(lose)
        gone -= victims.pop(lose, set())


def place(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chr, seq, ord): for each chromosome the order of its heaviest set of sequences without excluded pairs.

    ``seqs`` has chr, seq, start, stop, weight, length, forced (one row a sequence and
    chromosome); ``pairs`` has a, b. No sequences give no rows.
    """
    ship(seqs.sparkSession)
    own = lambda c: seqs.select(F.col("chr").alias(f"chr_{c}"), F.col("seq").alias(f"seq_{c}"))
    met = pairs.join(own("a"), F.col("a") == F.col("seq_a")).join(own("b"), (F.col("b") == F.col("seq_b")) & (F.col("chr_a") == F.col("chr_b"))).select(F.col("chr_a").alias("chr"), "a", "b").distinct()

    def run(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        items = list(zip(x["start"], x["stop"], x["weight"], x["seq"], x["forced"], strict=True))
        path = without_excluded(items, dict(zip(x["seq"], x["length"], strict=True)), list(zip(p["a"], p["b"], strict=True)))
        return pd.DataFrame({"chr": [x["chr"].iloc[0]] * len(path) if len(path) else [], "seq": path, "ord": range(1, len(path) + 1)})

    columns = seqs.select("chr", "seq", "start", "stop", "weight", "length", "forced")
    kind = dict(columns.dtypes)
    return columns.groupBy("chr").cogroup(met.groupBy("chr")).applyInPandas(run, f"chr {kind['chr']}, seq {kind['seq']}, ord long")


def two_haplotypes(seqs: DataFrame, pairs: DataFrame, mates: DataFrame) -> DataFrame:
    """(haplotype, chr, seq, ord): the second is placed from what the first and its mates leave."""
    first = cut(place(seqs, pairs), "first-haplotype")
    used = first.select(F.col("seq").alias("u")).distinct()
    out = used.union(mates.join(used, F.col("a") == F.col("u")).select("b")).union(mates.join(used, F.col("b") == F.col("u")).select("a")).distinct()
    second = place(seqs.join(out, F.col("seq") == F.col("u"), "left_anti"), pairs)
    return first.select(F.lit(1).alias("haplotype"), "*").unionByName(second.select(F.lit(2).alias("haplotype"), "*"))


def projected(start, stop, from_start, from_end, to_start, to_end, strand, length):
    """Struct (start, stop) of a span's place in the mate of the range that holds it; null if it falls outside.

    Distances to both ends are kept; a mate without extent gives its place. Ends that cross
    give the middle of the mate, unless the start lies beyond it or the end before it.
    """
    left, right = start - from_start, from_end - stop
    plus = strand == "+"
    a = F.least(F.when(plus, to_start + left).otherwise(to_start + right), length)
    b = F.greatest(F.when(plus, to_end - right).otherwise(to_end - left), F.lit(0))
    mid = F.floor((to_start + to_end) / 2)
    inside = (a <= to_end) & (b >= to_start)
    span = lambda x, y: F.struct(x.cast("long").alias("start"), y.cast("long").alias("stop"))
    return F.when(to_start == to_end, span(to_start, to_start)).when(a <= b, span(a, b)).when(inside, span(mid, mid))
