"""Near duplicates by DartMinHash signatures.

Each element (a shingle of five words) of weight w owns a region of weight by rank:
darts fall on it as a Poisson process that the element's hash fixes, the same in every
document. A document of total weight W takes the darts of rank below t/W, about t of
them whatever its length; each dart names one of k coordinates, and the earliest dart of
a coordinate is the signature's value there. Two signatures agree at a coordinate with
the probability of the (weighted) Jaccard similarity.

Copies (equal word sequences) are one text. Bands of coordinates put texts in buckets; a
bucket's texts are compared with its first text, so links grow with the texts and not
with their pairs. Signatures drop hopeless pairs; all others are verified on their whole
shingle sets. Where a bucket still holds several classes, texts outside its largest
class are compared with the texts of other classes, more of them each round, until none
is left: no pair of texts of different classes that share a bucket stays untested.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.llm.components import compact, components
from contigua.llm.substring_dedup import mixed, window_hashes, word_hashes
from contigua.session import cut, drop_cut, fresh_name, ship

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Coordinates beyond those of the bands, which make the estimate of a pair's similarity sharper.
EXTRA = 192
_U = np.uint64
_SHINGLE_BASE = 0x9E3779B97F4A7C15 | 1
#: Members of a bucket that are compared together; standard deviations below the similarity at which a pair is hopeless.
PART, MARGIN = 1000, 4
#: Pairs verified in one group; a centre with more has several groups.
GROUP = 500


def shingles(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words; fewer words are one shingle, none are none."""
    return [np.unique(r) for r in shingle_runs(texts, size)]


def counted(texts: list[str], size: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same with how often each comes."""
    both = [np.unique(r, return_counts=True) for r in shingle_runs(texts, size)]
    return [b[0] for b in both], [b[1] for b in both]


def measured(texts: list[str], weighted: bool) -> tuple[list[np.ndarray], list]:
    """Elements of each text and their weights, None where each weighs 1."""
    return counted(texts) if weighted else (shingles(texts), [None] * len(texts))


def reach(a: np.ndarray, m: np.ndarray | None, b: np.ndarray, n: np.ndarray | None, similarity: float) -> bool:
    """Whether two sets (with weights) have the Jaccard similarity."""
    if m is None or n is None:
        same, both = len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)
    else:
        _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        same, both = int(np.minimum(m[x], n[y]).sum()), int(m.sum() + n.sum())
    return same >= similarity * (both - same)


def shingle_runs(texts: list[str], size: int) -> list[np.ndarray]:
    """Hashes of each text's runs of ``size`` words in order."""
    words = [t.encode().split() for t in texts]
    hashes = word_hashes(b" ".join([b" ".join(w) for w in words if w]))
    runs = window_hashes(hashes, _SHINGLE_BASE, size)
    out, at = [], 0
    for w in words:
        n = len(w)
        if n >= size:
            out.append(runs[at : at + n - size + 1])
        elif n:
            out.append(window_hashes(hashes[at : at + n], _SHINGLE_BASE, n) ^ _U(n))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def dart_signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """Signatures (one row of k numbers for each set) of sets of element hashes with positive weights (1 if not given).

    Rows of empty sets are zero. Sets whose darts miss a coordinate throw again for twice as many.
    """
    out = np.zeros((len(sets), k), _U)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    t = k * (math.log(k) + 2)
    while len(todo):
        missing = []
        for a in range(0, len(todo), 256):
            part = todo[a : a + 256]
            best, ids = _throw([sets[i] for i in part], [weights[i] for i in part] if weights else None, k, t)
            full = np.isfinite(best).all(1)
            out[part[full]] = ids[full]
            missing.append(part[~full])
        todo, t = np.concatenate(missing), 2 * t
    return out


def _throw(sets, weights, k: int, t: float):
    """Earliest rank and dart of each coordinate among about t darts for each set."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    e, d = np.concatenate(sets), np.repeat(np.arange(n), size)
    if weights is None:
        total, part = size.astype(float), None
    else:
        w = np.concatenate(weights).astype(float)
        total = np.bincount(d, w, n)
        slabs = np.ceil(w).astype(np.int64)  # unit slabs of weight; the last may be a part of one
        first = np.repeat(np.cumsum(slabs) - slabs, slabs)
        slab = np.arange(len(first)) - first
        part = np.minimum(1.0, np.repeat(w, slabs) - slab)
        e, d = mixed(np.repeat(e, slabs) + slab.astype(_U) * _U(0xD1B54A32D192ED03)), np.repeat(d, slabs)
    limit = (t / total)[d]
    best, ids = np.full(n * k, np.inf), np.zeros(n * k, _U)
    rank, i = np.zeros(len(e)), 1
    while len(e):
        h = mixed(e + _U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = rank - np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0**-53)
        alive = rank <= limit
        e, d, limit, rank, h = e[alive], d[alive], limit[alive], rank[alive], h[alive]
        part = part[alive] if part is not None else None
        if len(e):
            dart = mixed(h ^ _U(0xA0761D6478BD642F))
            at = d * k + ((dart >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
            own, r = dart, rank
            if part is not None:
                hit = (mixed(dart) >> _U(11)).astype(float) * 2.0**-53 < part
                at, own, r = at[hit], dart[hit], rank[hit]
            np.minimum.at(best, at, r)
            won = best[at] == r
            ids[at[won]] = own[won]
        i += 1
    return best.reshape(n, k), ids.reshape(n, k)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), _U)
    s = signatures.reshape(-1, bands, rows)
    for r in range(rows):
        out = mixed(out * _U(_SHINGLE_BASE) + s[:, :, r])
    return mixed(out + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(rows: DataFrame, bands: int, rows_of_band: int, weighted: bool = False) -> DataFrame:
    """(doc_id, copy, bands, sig): digest of the word sequence, band hashes, the coordinates' low bytes. Without words: none."""
    k = bands * rows_of_band + EXTRA

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            sets, weights = measured(texts, weighted)
            some = [i for i, s in enumerate(sets) if len(s)]
            sig = dart_signatures([sets[i] for i in some], k, [weights[i] for i in some] if weighted else None)
            hashes = band_hashes(sig[:, : bands * rows_of_band], bands, rows_of_band)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(some, pa.int32())), pa.array([hashlib.sha256(b" ".join(texts[i].encode().split())).digest() for i in some], pa.binary()),
                    pa.array(list(hashes), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()),
                ],
                names=["doc_id", "copy", "bands", "sig"],
            )

    return rows.mapInArrow(run, "doc_id long, copy binary, bands array<long>, sig binary")


def likely(pairs: DataFrame, reps: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those pairs whose signatures do not rule the similarity out."""
    sig = reps.select("rep", "sig")
    both = pairs.join(sig.withColumnsRenamed({"rep": "r1", "sig": "s1"}), F.col("a") == F.col("r1")).join(sig.withColumnsRenamed({"rep": "r2", "sig": "s2"}), F.col("b") == F.col("r2")).select("a", "b", "s1", "s2")
    least = similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / k)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, k) for i in (2, 3))
            yield b.filter(pa.array((x == y).mean(1) >= least)).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def compared(members: DataFrame, leaders: DataFrame, k: int, similarity: float) -> DataFrame:
    """Likely pairs (a, b) of a bucket's members and its leaders b of other classes.

    ``members`` has bucket, n (of the bucket), rep, label, bands, sig; ``leaders`` the same for
    a few members. A bucket is dealt out in parts of some thousand members, each with all
    leaders; signatures are compared in blocks and only likely pairs become rows, each in
    the first bucket that the two share and the leader leads.
    """
    parts = F.ceil(F.col("n") / PART).cast("int")
    columns = ["bucket", "part", "kind", "rep", "label", "sig", "bands", "leads"]
    leads = leaders.groupBy(F.col("rep").alias("l_rep")).agg(F.collect_list("bucket").alias("leads"))  # at most one for each band
    first = leaders.join(leads, F.col("rep") == F.col("l_rep")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("kind", F.lit(0)).select(columns)
    rest = members.withColumns({"part": F.pmod(F.xxhash64("rep"), parts).cast("int"), "kind": F.lit(1), "leads": F.lit(None).cast("array<bigint>")}).select(columns)
    spark = members.sparkSession
    dealt = first.unionByName(rest).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    least = similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / k)

    def run(batches):
        at, held = None, []
        for b in batches:
            bucket, part, kind, rep, label = (b.column(i).to_numpy() for i in range(5))
            sig = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, k)
            bands = b.column(6).flatten().to_numpy().reshape(len(bucket), -1)
            edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            out = [[], []]
            for lo, hi in zip(edges, np.r_[edges[1:], len(bucket)], strict=True):
                key = (bucket[lo], part[lo])
                if key != at:
                    at, held = key, []
                if kind[lo] == 0:
                    held += [(int(rep[i]), label[i], sig[i].copy(), np.where(np.isin(bands[i], b.column(7)[i].as_py()), bands[i], 0)) for i in range(lo, hi)]
                    continue
                for leader, own, s, led in held:
                    good = lo + np.flatnonzero(((sig[lo:hi] == s).mean(1) >= least) & (label[lo:hi] != own))
                    if len(good):
                        shared = (bands[good] == led) & (led != 0)
                        good = good[led[shared.argmax(1)] == key[0]]
                    out[0] += rep[good].tolist()
                    out[1] += [leader] * len(good)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, weighted: bool = False) -> DataFrame:
    """Those pairs (a, b) whose shingle sets (or counts) have the similarity. Grouped by b, in groups of bounded size."""
    n = pairs.groupBy("b").agg(F.count("*").alias("n")).where(f"n > {GROUP}").select(F.col("b").alias("big"), F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    placed = pairs.join(n, F.col("b") == F.col("big"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    # Each group needs the text of its centre once and those of its members.
    wants = placed.select(F.col("a").alias("doc"), "b", "part").unionByName(placed.select(F.col("b").alias("doc"), "b", "part").distinct())
    rows = wants.join(texts, F.col("doc") == F.col("t_id")).select("b", "part", "doc", "text")

    def run(t: pa.Table) -> pa.Table:
        ids, centre = t.column("doc").to_pylist(), t.column("b")[0].as_py()
        own, own_n = (x[0] for x in measured([t.column("text")[ids.index(centre)].as_py()], weighted))
        good = []
        for at in range(0, len(ids), 50):
            for i, s, n in zip(ids[at : at + 50], *measured(t.column("text").slice(at, 50).to_pylist(), weighted), strict=True):
                if i != centre and reach(own, own_n, s, n, similarity):
                    good.append(i)
        return pa.table({"a": pa.array(good, pa.int64()), "b": pa.array([centre] * len(good), pa.int64())})

    return rows.groupBy("b", "part").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows_of_band: int = ROWS, weighted: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, rep_id.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles
    (every element weighs 1) or, if ``weighted``, of their counts of shingles (an element
    weighs as often as it comes, so the sum of the lesser counts over that of the greater)
    is ``similarity`` or more; a class is what links connect, its id the smallest doc_id
    in it. rep_id is the smallest id with the same words. Texts of one to four words have
    one shingle, texts without words (null too) none: these are classes of their own. Rows
    that repeat an id share a class; rows without an id are not compared and have no class.
    A pair of similarity 0.8 shares no bucket or is held hopeless with probability 1e-4, one of
    0.85 with less than 1e-6. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    k = bands * rows_of_band + EXTRA
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = cut(signatures(rows.where("doc_id is not null"), bands, rows_of_band, weighted), "signatures")
    copies = signed.groupBy("copy").agg(F.min("doc_id").alias("rep"))
    size, wide = signed.count(), 8 * bands + k + 32
    owner = cut(compact(signed.select("doc_id", "copy").join(copies, "copy").select("doc_id", "rep"), size), "copies")
    reps = cut(compact(signed.join(copies.select(F.col("copy").alias("c"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("copy") == F.col("c"))).select("rep", "bands", "sig").dropDuplicates(["rep"]), size, wide), "reps")
    drop_cut(signed)
    member = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    held = cut(compact(member.join(buckets, "bucket"), size * bands), "buckets")
    star = held.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = cut(likely(star, reps, k, similarity), "pairs")
    # A narrow table of its own: while it is small, Spark sends it to the texts, and those that no bucket holds stay where they are.
    wanted = cut(compact(held.select(F.col("rep").alias("w_id")).distinct(), size), "wanted")
    texts = cut(rows.join(wanted, F.col("doc_id") == F.col("w_id"), "left_semi").select(F.col("doc_id").alias("t_id"), "text").dropDuplicates(["t_id"]), "texts")
    links = cut(verified(pairs, texts, similarity, weighted), "links")
    labels = components(links)
    tested, leaders, most = pairs.withColumnsRenamed({"a": "p_a", "b": "p_b"}), None, 4
    open_members = cut(held.where("n > 2").join(reps.select(F.col("rep").alias("s_rep"), "sig", "bands"), F.col("rep") == F.col("s_rep")).select("rep", "bucket", "n", "sig", "bands"), "open")
    n_open = open_members.count()
    while True:
        # Buckets with several classes, and their members outside the largest class that have not been leaders.
        marked = cut(compact(open_members.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "bucket", "n", "sig", "bands", F.coalesce("label", "rep").alias("label")), n_open, wide), "marked")
        by_class = marked.groupBy("bucket", "label").agg(F.count("*").alias("of"))
        largest = by_class.groupBy("bucket").agg(F.max_by("label", F.struct("of", -F.col("label"))).alias("top"), F.count("*").alias("classes")).where("classes > 1").select(F.col("bucket").alias("t_bucket"), "top")
        left = marked.join(largest, (F.col("bucket") == F.col("t_bucket")) & (F.col("label") != F.col("top")))
        if leaders is not None:
            left = left.join(leaders.withColumnsRenamed({"rep": "l_rep", "bucket": "l_bucket"}), (F.col("rep") == F.col("l_rep")) & (F.col("bucket") == F.col("l_bucket")), "left_anti")
        # The first few of each bucket: salted ranks, so that no task ranks a whole bucket.
        salted = left.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(most)), F.lit(64)))
        some = salted.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("rep"))).where(f"place <= {most}")
        some = some.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("place", "rep"))).where(f"place <= {most}")
        some = cut(compact(some.select("rep", "bucket", "n", "sig", "bands", "label"), n_open, wide), "leaders")
        if not some.head(1):
            break
        # A member meets at most ``most`` leaders of a bucket; that bounds the rows.
        fresh = cut(compact(compared(marked, some, k, similarity).join(tested, (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b")), "left_anti"), n_open * most), "fresh")
        more = cut(verified(fresh, texts, similarity, weighted), "links")
        drop_cut(marked)  # leaders hold what later rounds need of it
        tested = tested.unionByName(fresh.select(F.col("a").alias("p_a"), F.col("b").alias("p_b")))
        leaders = some.select("rep", "bucket") if leaders is None else leaders.unionByName(some.select("rep", "bucket"))
        if more.head(1):
            of = lambda c: labels.select(F.col("node").alias(f"n_{c}"), F.col("label").alias(f"l_{c}"))
            between = more.join(of("a"), F.col("a") == F.col("n_a"), "left").join(of("b"), F.col("b") == F.col("n_b"), "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
            joined = components(between).withColumnsRenamed({"node": "old", "label": "new"})
            grown = labels.select("node", "label").unionByName(more.select(F.col("a").alias("node")).union(more.select(F.col("b"))).distinct().join(labels.select(F.col("node").alias("has")), F.col("node") == F.col("has"), "left_anti").select("node", F.col("node").alias("label")))
            labels = cut(compact(grown.join(joined, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), size), "labels")
        most *= 4
    classed = owner.join(labels, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min("rep").alias("rep_id"), F.min(F.coalesce("label", "rep")).alias("class_id"))
    out = rows.select("doc_id").join(classed.withColumnRenamed("doc_id", "c_id"), F.col("doc_id") == F.col("c_id"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep_id", "doc_id").alias("rep_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, and those without an id; all their columns.

    Rows that repeat the id that stays all stay. An empty table stays empty.
    """
    classes = near_duplicates(docs, id_col, text_col, similarity)
    gone_id = fresh_name("gone", docs.columns)
    gone = classes.where("class_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
