"""Toxicity of restored text.

Disguised words go through a noisy channel backwards: a token with leet characters,
letters set apart or letters repeated is a lattice of what each character may stand
for, and Viterbi decoding takes the likeliest path under a character language model.
The model mixes trigram counts over all documents with those of the words that mark the
labelled toxic rows. What is decoded takes the place of what stood there, and a logistic
regression on words and word beginnings of that restored text, trained on labelled rows,
gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.session import cut, ship

#: Labelled rows that the classifier is fitted on at most (those with the smallest hashes of their ids).
MAX_LABELLED = 16_000
#: Features of the classifier at most, the least number of toxic rows that one must be in, and by how
#: many standard deviations it must be more frequent there than in all rows. They choose columns of the
#: classifier from the labelled rows; no text, row or word is left out of scoring by them.
MAX_FEATURES, MIN_TOXIC, MIN_SURPRISE = 1500, 4, 4
#: Words up to WORD letters are features of their own, beginnings of longer words than these are others.
WORD, PREFIXES = 30, (4, 5, 6)

# What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "(": "c", "€": "e", "£": "l"}
_LEET = re.compile("[" + re.escape("".join(LEET)) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"(?<![\w])[A-Za-z0-9@$!|](?:[ .*_-][A-Za-z0-9@$!|]){3,}(?![\w])")
#: A closing @ or $ may stand for a letter; other marks at the end are punctuation.
_EDGES = re.compile(r"^[\"'(\[{<]+|(?:[^\w@$]|_)+$")
#: Fixed value: a number with at most three letters after it, or one or two letters before it.
_PLAIN = re.compile(r"[0-9][0-9.,:/+*-]*[^\W\d_]{0,3}$|[^\W\d_]{1,2}[0-9]+$")
_STRIP = "\"'.,;:!?()[]{}<>*#%&$@|/\\-_=+~`0123456789"
LETTERS = 28  # boundary, a to z, any other letter


def classes(text: str) -> np.ndarray:
    """Class of each character: 1 to 26 for letters, 27 for letters beyond ASCII, else 0."""
    a = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    out = np.where((a >= 97) & (a <= 122), a - 96, 0)
    return np.where((a >= 0xAA) & (a != 0xD7) & (a != 0xF7) & (a < 0x2000) | (a > 0x2E00), 27, out).astype(np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all documents: LETTERS**3 numbers, whatever the input."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(LETTERS**3, np.int64)

        def add(texts):
            c = classes(" ".join(["", *texts, ""]))
            np.add(total, np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(total)), out=total)

        held, size = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    held.append(text)
                    size += len(text)
                if size > 100_000:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(LETTERS, LETTERS, LETTERS)


def word_trigrams(words: dict[str, float]) -> np.ndarray:
    out = np.zeros((LETTERS, LETTERS, LETTERS))
    for w, n in words.items():
        c = classes(f"  {w} ")
        np.add.at(out, (c[:-2], c[1:-1], c[2:]), n)
    return out


class LanguageModel:
    """Character trigrams, a mixture of the corpus and of marked words; log probabilities."""

    def __init__(self, corpus: np.ndarray, marked: np.ndarray, share: float = 0.3):
        def conditional(n):
            low = n.sum(0)
            low = (low + 0.5) / (low + 0.5).sum(1, keepdims=True)
            return (n + 2 * low[None]) / (n.sum(2, keepdims=True) + 2)

        # In the corpus a word starts after one boundary; the state before it is the same class.
        corpus = corpus.copy()
        corpus[0, 0, 1:] += corpus[:, 0, 1:].sum(0) - corpus[0, 0, 1:]
        corpus[0, 0, 0] = 0
        self.log = np.log((1 - share) * conditional(corpus) + share * conditional(marked) if marked.any() else conditional(corpus))


class Restorer:
    """Viterbi decoding of disguised tokens, with a memory of bounded size."""

    KEEP, SWAP, DROP = 0.0, math.log(0.15), math.log(0.3)

    def __init__(self, model: LanguageModel):
        self.log, self.known = model.log.tolist(), {}

    def word(self, token: str) -> str:
        """The likeliest reading of a token's characters."""
        return self._decode(token)

    def read(self, token: str) -> str:
        """What a token (lower case) is in the restored text; it depends on that token only."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            core = token if token.isalnum() else _EDGES.sub("", token)
            found = self._decode(core) if self.disguised(core) else token.strip(_STRIP)
            if len(token) <= 80:
                self.known[token] = found
        return found

    @staticmethod
    def disguised(core: str) -> bool:
        """Whether letters stand beside characters that may stand for letters, or one is repeated.

        A number with a short ending (2nd, 5kg) or a single letter before a number (a4) is as it is meant.
        """
        if core.isalpha():
            return bool(_REPEAT.search(core))
        if len(core) < 3 or not _LETTER.search(core) or not _LEET.search(core):
            return bool(_REPEAT.search(core))
        return not _PLAIN.match(core)

    def _decode(self, token: str, apart: bool = False) -> str:
        """The likeliest reading; of letters set ``apart``, any of them may begin another word."""
        # Columns of the lattice: (reading, channel cost); a run of a letter may shrink to two or one.
        columns: list[list[tuple[str, float]]] = []
        for m in re.finditer(r"(.)\1*", token.lower(), re.S):
            c, n = m.group(1), len(m.group())
            reads = [(c, self.KEEP)] if c.isalpha() else []
            reads += [(x, self.SWAP) for x in LEET.get(c, "")]
            if not reads:
                continue  # what can't be a letter is what sets letters apart
            column = []
            for r, cost in reads:
                column.append((r, cost + (self.DROP if n > 1 else 0)))
                if n > 1:
                    column.append((r * 2, cost + (self.DROP if n > 2 else 0)))
                if n > 2 and c.isalpha():
                    column.append((r * n, cost) if n <= 3 else (r * 3, cost + self.DROP))
            columns.append(column)
        log = self.log
        # Paths are linked backwards, so a long token takes time in proportion.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for column in columns:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for r, cost in column:
                    x, y, s = a, b, score + cost
                    for ch in r:
                        z = ord(ch) - 96 if "a" <= ch <= "z" else 27
                        s += log[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (path, r))
                    if apart and path is not None:
                        x, y, s = 0, 0, score + cost + log[a][b][0]
                        for ch in r:
                            z = ord(ch) - 96 if "a" <= ch <= "z" else 27
                            s += log[x][y][z]
                            x, y = y, z
                        if (x, y) not in after or s > after[x, y][0]:
                            after[x, y] = (s, (path, " " + r))
            best = after
        ends = [(s + log[a][b][0], p) for (a, b), (s, p) in best.items()]
        most = max(s for s, _ in ends)
        return max(self._read(p) for s, p in ends if s == most)

    @staticmethod
    def _read(path: tuple | None) -> str:
        out = []
        while path is not None:
            path, r = path
            out.append(r)
        return "".join(reversed(out))

    def together(self, text: str) -> str:
        """``text`` in lower case with letters set apart put together to words."""
        return _APART.sub(lambda m: " " + self._decode(re.sub(r"[ .*_-]", "", m.group()), True) + " ", text).lower()

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        return set(map(self.read, set(self.together(text).split())))

    def restored(self, text: str) -> str:
        """The whole restored text: its words in order, one space between them."""
        return " ".join(w for t in self.together(text).split() if (w := self.read(t)))


def words_of(text: str, restorer: Restorer | None) -> set[str]:
    """Distinct words of a text (restored, if there's a restorer) in lower case without marks around them."""
    out = restorer.words(text) if restorer else {w.strip(_STRIP) for w in set(text.lower().split())}
    out.discard("")
    return out


def marks_of(words: set[str]) -> set[str]:
    """Features: words of up to ``WORD`` letters, and beginnings of words."""
    out = {"=" + w for w in words if len(w) <= WORD}
    for n in PREFIXES:
        out |= {w[:n] for w in words if len(w) > n}
    return out


def _same_text():
    return Window.partitionBy(F.xxhash64("text"), "toxic").orderBy("doc_id")


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled training rows, one for each text."""
    train = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and l_id is not null and crc32(cast(l_id as string)) % 5 <> 0")
    train = train.groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    rows = docs.join(F.broadcast(train), docs["doc_id"] == F.col("l_id")).select("doc_id", "text", "toxic")
    return cut(rows.withColumn("n", F.row_number().over(_same_text())).where("n = 1").select("text", "toxic").repartition(12), "labelled")


class ToxicityModel:
    """Weights of the features, the intercept and the language model."""

    def __init__(self, weights: dict[str, float], bias: float, language: LanguageModel):
        self.weights, self.bias, self.language = weights, bias, language

    def scorer(self):
        weights, bias, restorer = self.weights, self.bias, Restorer(self.language)
        whole = {k[1:]: v for k, v in weights.items() if k[0] == "="}
        begin = {n: {k: v for k, v in weights.items() if k[0] != "=" and len(k) == n} for n in PREFIXES}

        def score(text: str | None) -> float:
            words = words_of(text or "", restorer)
            z = bias + sum(whole[w] for w in words & whole.keys())
            for n, table in begin.items():
                if table:
                    z += sum(table[p] for p in {w[:n] for w in words if len(w) > n} & table.keys())
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Language model from all ``docs``, classifier from labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    corpus = trigram_counts(rows)
    train = labelled(rows, labels, most)
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    base = math.log((pos + 0.5) / (neg + 4.5))
    if not pos or not neg:
        return ToxicityModel({}, min(base, -0.1), LanguageModel(corpus, np.zeros_like(corpus)))

    def count(batches):
        seen = [Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(marks_of(words_of(text, None)))
        # Where a task has a mark in no toxic row, other tasks may have: all marks count.
        for toxic in (0, 1):
            keys = list(seen[toxic])
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[toxic][k] for k in part], pa.int64()), pa.array([toxic] * len(part), pa.int64())], names=["mark", "n", "toxic"])

    counts = train.mapInArrow(count, "mark string, n long, toxic long").groupBy("mark").agg(F.sum(F.expr("n * toxic")).alias("p"), F.sum(F.expr("n * (1 - toxic)")).alias("q"))
    expected = (F.col("p") + F.col("q")) * (pos / (pos + neg))
    surprise = (F.col("p") - expected) / F.sqrt(expected * (neg / (pos + neg)) + 0.25)
    top = counts.where(F.col("p") >= MIN_TOXIC).withColumn("z", surprise).where(F.col("z") > MIN_SURPRISE).orderBy(F.desc("z"), "mark").limit(MAX_FEATURES).collect()
    marks = [r["mark"] for r in top]
    language = LanguageModel(corpus, word_trigrams({r["mark"][1:]: r["p"] for r in top if r["mark"][0] == "=" and r["q"] * 4 < r["p"]}))
    index = {m: i for i, m in enumerate(marks)}

    def features(batches):
        restorer = Restorer(language)
        for b in batches:
            found = [sorted(index[m] for m in marks_of(words_of(t, restorer)) & index.keys()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], names=["f", "toxic"])

    # Rows with the same features and label are one: at most as many as training rows.
    got = train.select("text", F.col("toxic").cast("int")).mapInArrow(features, "f array<int>, toxic int").groupBy("f", "toxic").agg(F.count("*").alias("n")).collect()
    x = np.zeros((len(got), len(marks)), np.float32)
    for i, r in enumerate(got):
        x[i, r["f"]] = 1
    y, w = np.array([r["toxic"] for r in got], np.float64), np.array([r["n"] for r in got], np.float64)
    beta, bias = logistic(x, y, w)
    return ToxicityModel({m: float(b) for m, b in zip(marks, beta, strict=True) if abs(b) > 1e-4}, bias, language)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weighted logistic regression, squared penalty on the weights, by accelerated gradient steps."""
    beta, bias = np.zeros(x.shape[1]), math.log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    v, vb, step = beta.copy(), bias, 4.0 / (float((n * (x.sum(1) + 1)).max(initial=1)) + float((n[:, None] * x).sum(0).max(initial=1)) * 2 + n.sum() * 0.05 + penalty)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + vb, -40, 40)))
        r = n * (p - y)
        new, new_b = v - step * (x.T @ r + penalty * v), vb - step * r.sum()
        v, vb = new + (i / (i + 3)) * (new - beta), new_b + (i / (i + 3)) * (new_b - bias)
        beta, bias = new, new_b
    return beta, float(bias)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without any feature. Labels other than
    0 and 1 and those without an id don't count; an id labelled both ways counts as toxic.
    Without labels of both kinds every score is one below 0.5. Equal texts, equal scores.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels, most, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        score = model.scorer()
        for b in batches:
            ids, s = b.column(0).to_pylist(), [score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, whole.

    Null and empty texts score as a text without any feature, which is below 0.5 where
    most labelled rows are clean. Repeated rows stay or go together; an empty table stays
    empty, and without labels of both kinds every row stays.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels, most, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
