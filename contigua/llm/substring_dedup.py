"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

Documents lie in blocks of consecutive ids. Each block hashes all its windows, keeps
one entry per distinct window, and deals the sorted entries out by ranges of the hash
(a blob of differences per block and range, so a window costs a few bytes in the
shuffle and a very frequent one costs a few bytes a block). For each range one task
merges the blobs and answers, one bit per entry, which windows an earlier block has
too. Each block then joins its bits with the repeats it sees itself, and repeated
windows merge into maximal intervals of words to remove.

Entries have 64 hash bits and as many bytes of a second hash as keep the expected
number of false equalities among all windows of the input below 2**-20.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import ship

WINDOW = 20
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
MIN_BLOCKS, MAX_CUTS = 32, 4096
_M = (1 << 64) - 1
_BASE, _BASE_2, _BYTE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0x100000001B3
_SLICE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_known_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_known_powers.get(base, ())) < n:
        _known_powers[base] = _powers(base, max(n, _SLICE + 4096))
    return _known_powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(joined: bytes) -> np.ndarray:
    """Hash of each word of words joined by single spaces."""
    out, at, end = [], 0, len(joined)
    inverse = pow(_BYTE, -1, 1 << 64)
    while at < end:
        to = end if end - at <= _SLICE else joined.find(b" ", at + _SLICE)
        to = end if to < 0 else to
        a = np.frombuffer(joined, np.uint8, to - at, at)
        spaces = np.flatnonzero(a == 32)
        starts = np.concatenate(([0], spaces + 1))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers(_BYTE, len(a)), out=sums[1:])
        ends = np.concatenate((spaces, [len(a)]))
        raw = (sums[ends] - sums[starts]) * powers(inverse, len(a) + 1)[starts]
        out.append(mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE)))
        at = to + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, base: int, size: int) -> np.ndarray:
    """Rolling polynomial hash of each run of ``size`` consecutive words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    n = len(words) - size + 1
    return mixed((sums[size:] - sums[:n]) * powers(pow(base, -1, 1 << 64), n))


class Block:
    """The documents of one block in order, and their distinct windows."""

    def __init__(self, ids: list, texts: list, size: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.words = [texts[i].encode().split() for i in order]
        n = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(n)))
        total = int(self.starts[-1])
        hashes = word_hashes(b" ".join([b" ".join(w) for w in self.words if w]))
        valid = np.ones(total, bool)
        for k in range(size - 1):  # the last words of a document start no window
            at = self.starts[1:][n > k] - 1 - k
            valid[at] = False
        self.at = np.flatnonzero(valid)
        h, c = (window_hashes(hashes, b, size)[self.at[: len(self.at)]] if len(self.at) else np.zeros(0, np.uint64) for b in (_BASE, _BASE_2))
        order_h = np.argsort(h, kind="stable")
        hs, cs = h[order_h], c[order_h]
        new = np.ones(len(hs), bool)
        if len(hs) > 1:
            same = hs[1:] == hs[:-1]
            if (same & (cs[1:] != cs[:-1])).any():  # equal in 64 bits only: order by both
                order_h = np.lexsort((c, h))
                hs, cs = h[order_h], c[order_h]
                same = hs[1:] == hs[:-1]
            new[1:] = ~(same & (cs[1:] == cs[:-1]))
        self.order, self.new, self.total, self.size = order_h, new, total, size
        self.h, self.c = hs[new], cs[new]

    def blobs(self, parts: int, check: int):
        """(range, blob) of the distinct windows; a blob is count, width, differences, check bytes."""
        edges = np.searchsorted(self.h, range_edges(parts))
        edges = np.append(edges, len(self.h))
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if a < b:
                yield p, pack(self.h[a:b], self.c[a:b], check)

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """For each word whether a window that starts earlier too covers it."""
        repeated = np.empty(len(self.new), bool)
        group = np.cumsum(self.new) - 1
        repeated[self.order] = ~self.new | earlier[group] if len(group) else False
        marks = np.zeros(self.total + 1, np.int32)
        at = self.at[repeated]
        marks[at] += 1
        np.subtract.at(marks, at + self.size, 1)
        return np.cumsum(marks[:-1]) > 0


def range_edges(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(parts)], np.uint64)


def pack(h: np.ndarray, c: np.ndarray, check: int) -> bytes:
    d = np.diff(h, prepend=np.uint64(0))
    most = int(d[1:].max()) if len(d) > 1 else 0
    width = max(1, (most.bit_length() + 7) // 8)
    head = len(h).to_bytes(4, "little") + bytes([width]) + int(h[0]).to_bytes(8, "little")
    planes = d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    checks = c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :check]
    return head + planes.tobytes() + checks.tobytes()


def unpack(blob: bytes, check: int) -> tuple[np.ndarray, np.ndarray]:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    d = np.zeros((n, 8), np.uint8)
    d[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 13).reshape(-1, width)
    d = d.view("<u8").ravel()
    d[0] = int.from_bytes(blob[5:13], "little")
    c = np.zeros((n, 8), np.uint8)
    if check:
        c[:, :check] = np.frombuffer(blob, np.uint8, n * check, 13 + (n - 1) * width).reshape(-1, check)
    return np.cumsum(d, dtype=np.uint64), c.view("<u8").ravel()


def seen_before(blobs: list[bytes], check: int) -> list[bytes]:
    """For blobs in the order of their blocks: one bit per entry, set if an earlier blob has it."""
    parts = [unpack(b, check) for b in blobs]
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    hs, cs = h[order], c[order]
    same = hs[1:] == hs[:-1]
    if (same & (cs[1:] != cs[:-1])).any():
        order = np.lexsort((c, h))
        hs, cs = h[order], c[order]
        same = hs[1:] == hs[:-1]
    flags = np.zeros(len(h), bool)
    flags[order[1:]] = same & (cs[1:] == cs[:-1])
    out, at = [], 0
    for p in parts:
        out.append(np.packbits(flags[at : at + len(p[0])]).tobytes())
        at += len(p[0])
    return out


def check_bytes(windows: float) -> int:
    """Bytes of the second hash: expected false equalities n*n/2**bits stay below 2**-20."""
    bits = 2 * math.log2(max(2, windows)) + 20 - 64
    return min(8, max(1, math.ceil(bits / 8)))


def with_blocks(rows: DataFrame, blocks: int, without_id: int = 1) -> DataFrame:
    """Adds ``block``: numbers that grow with doc_id; null ids come in the last ``without_id`` ones, dealt out by their texts."""
    last = F.lit(1 << 40) + F.pmod(F.xxhash64("text"), F.lit(without_id))
    return _id_blocks(rows, blocks).withColumn("block", F.when(F.col("doc_id").isNull(), last).otherwise(F.col("block")).cast("long"))


def _id_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    cuts = min(blocks, MAX_CUTS)
    fine = -(-blocks // cuts)
    found = rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / cuts for i in range(1, cuts)], max(10_000, 20 * cuts)).alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    edges = sorted(set(found["q"] or []))
    if len(edges) < 1 or found["lo"] is None:
        return rows.withColumn("block", F.lit(0).cast("long"))
    splits = [float("-inf"), *edges, float("inf")]
    rows = Bucketizer(splits=splits, inputCol="__id", outputCol="__b", handleInvalid="keep").transform(rows.withColumn("__id", F.col("doc_id").cast("double")))
    if fine > 1:
        ends = F.array(*[F.lit(float(x)) for x in [found["lo"], *edges, found["hi"] + 1]])
        i = F.least(F.col("__b").cast("int"), F.lit(len(edges)))
        lo, hi = F.get(ends, i), F.get(ends, i + 1)
        sub = F.least(F.floor((F.col("__id") - lo) * fine / F.greatest(hi - lo, F.lit(1.0))), F.lit(fine - 1))
        rows = rows.withColumn("block", (F.col("__b") * fine + F.coalesce(sub, F.lit(0))).cast("long"))
    else:
        rows = rows.withColumn("block", F.col("__b").cast("long"))
    return rows.drop("__id", "__b")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, full: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if ``full``, intervals and kept text.

    Words are runs of bytes other than space and tab to carriage return. A window is
    ``size`` consecutive words of one document; a word goes if some window that covers
    it also starts earlier (smaller id, or earlier in the same document). Null text has
    no words, a text shorter than a window loses none. Rows that repeat an id count as
    documents one after the other, ordered by text; null ids come last, in an order that
    their texts fix. The documents of a block, ``block_bytes`` on average, are worked on
    together. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own_bytes = F.octet_length("text")
    total, nulls = (x or 0 for x in rows.agg(F.sum(own_bytes), F.sum(F.when(F.col("doc_id").isNull(), own_bytes))).first())
    blocks = max(MIN_BLOCKS, math.ceil(total / block_bytes))
    ranges = max(MIN_BLOCKS, math.ceil(total / RANGE_BYTES))
    check = check_bytes(total / 2)  # a window starts at a word, and a word has two bytes with its space
    placed = with_blocks(rows, blocks, max(1, math.ceil(nulls / block_bytes))).select("block", "doc_id", "text")

    def distinct_windows(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        b = Block(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), size)
        got = list(b.blobs(ranges, check))
        return pa.table({"block": pa.array([block] * len(got), pa.int64()), "part": pa.array([p for p, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        masks = seen_before(t.column("blob").to_pylist(), check)
        counts = [int.from_bytes(x.as_py()[:4], "little") for x in t.column("blob")]
        return pa.table({"block": t.column("block"), "part": t.column("part"), "n": pa.array(counts, pa.int32()), "mask": pa.array(masks, pa.binary())})

    def resolve(docs_t: pa.Table, masks_t: pa.Table) -> pa.Table:
        b = Block(docs_t.column("doc_id").to_pylist(), docs_t.column("text").to_pylist(), size)
        masks_t = masks_t.sort_by("part")
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(masks_t.column("mask").to_pylist(), masks_t.column("n").to_pylist(), strict=True)]
        gone = b.removed(np.concatenate(bits) if bits else np.zeros(0, bool))
        counts = np.concatenate(([0], np.cumsum(gone)))
        out = {"doc_id": b.ids, "n_words": [], "n_removed": [], "kept_sha256": []} | ({"removed": [], "kept": []} if full else {})
        for i, words in enumerate(b.words):
            a, z = b.starts[i], b.starts[i + 1]
            n = int(counts[z] - counts[a])
            kept = b" ".join(compress(words, ~gone[a:z]) if n else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if full:
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:z].astype(np.int8), [0]))))
                out["removed"].append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                out["kept"].append(kept.decode())
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", removed array<struct<start:long,end:long>>, kept string" if full else "")
    entries = placed.groupBy("block").applyInArrow(distinct_windows, "block long, part int, blob binary")
    masks = entries.groupBy("part").applyInArrow(answer, "block long, part int, n int, mask binary")
    return placed.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(resolve, schema)
