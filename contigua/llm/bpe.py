"""BPE encoding and decoding by dynamic programming over prefixes.

A word is a sequence of symbols (byte characters, the last one marked as word end).
For each of its prefixes exactly one token can be the last of that prefix's BPE
encoding. An automaton of suffix matches (the vocabulary's tokens as a tree with failure
links, so that each state is the longest suffix that begins a token) lists the tokens
that end at a prefix; those that BPE never makes of their own symbols are left out of it
from the start. Of the others the one that is right is the one whose pair with the
last token of what precedes it survives a test of compatibility: undoing the two
tokens' merges, latest first, never meets a pair that BPE would have merged across
the cut. Following the last tokens backwards gives the ids. Letters that Unicode took
in after version 16 are classed by the installed regex library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import ship

#: A worker remembers at most twice as many words: the latest, and those of the generation before.
CACHE_WORDS = 300_000
#: Longer words are encoded without being kept.
CACHE_WORD_LEN = 64

#: Fixed value: the pre-token pattern for which a faster equal one is at hand.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """Encoder of single words (bytes of a pre-token) for a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = "</w>"):
        self.end, self.name = end, {i: t for t, i in vocab.items()}
        chars = byte_symbols()
        self.inner = [vocab.get(c) for c in chars]
        self.final = [vocab.get(c + end) for c in chars]
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            whole = vocab[a + b]
            if whole in self.rank:
                raise ValueError(f"two merges make {a + b!r}")
            self.split[whole], self.rank[whole] = (vocab[a], vocab[b]), r
            self.joined[vocab[a], vocab[b]] = r
        # A token comes up only if both its parts do and nothing merges across their border before it is made.
        self.made: set[int] = {t for t in [*self.inner, *self.final] if t is not None}
        for t, (a, b) in sorted(self.split.items(), key=lambda x: self.rank[x[0]]):
            if a in self.made and b in self.made and self.compatible(a, b, self.rank[t]):
                self.made.add(t)
        self.shift = max(vocab.values(), default=0).bit_length() + 1
        self._automaton()
        self.known_pairs: dict[int, bool] = {}
        self.moves: list[dict[int, int]] = [{} for _ in self.go]
        self.ends: list[tuple | None] = [None] * len(self.go)

    def _spelled(self, token: int) -> list[int]:
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.split:
                a, b = self.split[t]
                todo += [b, a]
            else:
                out.append(t)
        return out

    def _automaton(self) -> None:
        base = sorted({t for t in [*self.inner, *self.final] if t is not None})
        go, token, length = [{}], [None], [0]
        for t in [*base, *(t for t in self.split if t in self.made)]:
            at = 0
            for s in self._spelled(t):
                if s not in go[at]:
                    go[at][s] = len(go)
                    go.append({})
                    token.append(None)
                    length.append(length[at] + 1)
                at = go[at][s]
            token[at] = t
        fail, shorter = [0] * len(go), [0] * len(go)
        todo = deque(go[0].values())
        while todo:
            at = todo.popleft()
            for s, to in go[at].items():
                f = fail[at]
                while f and s not in go[f]:
                    f = fail[f]
                fail[to] = go[f].get(s, 0)
                todo.append(to)
            shorter[at] = fail[at] if token[fail[at]] is not None else shorter[fail[at]]
        self.go, self.token, self.length, self.fail, self.shorter = go, token, length, fail, shorter

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether BPE leaves the boundary between two tokens alone (in the merges of ranks below ``before``).

        Merges are undone from the latest to the earliest; at each moment the pair at the
        cut must not be one that BPE merges before the merge undone last.
        """
        rank, split, joined = self.rank, self.split, self.joined
        a, b, before = left, right, len(rank) if before is None else before
        while True:
            r = joined.get((a, b))
            if r is not None and r < before:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # On equal ranks the left one merges first, so the right one is undone first.
            if ra > rb:
                before, a = ra, split[a][1]
            else:
                before, b = rb + 1, split[b][0]

    def _step(self, at: int, symbol: int) -> int:
        """Automaton step, kept for the next time."""
        first = at
        while at and symbol not in self.go[at]:
            at = self.fail[at]
        to = self.go[at].get(symbol, 0)
        self.moves[first][symbol] = to
        if self.ends[to] is None:
            found, state = [], to if self.token[to] is not None else self.shorter[to]
            while state:
                found.append((self.token[state], self.length[state]))
                state = self.shorter[state]
            self.ends[to] = tuple(found)
        return to

    def encode(self, word: bytes) -> list[int]:
        if not word:
            return []
        inner, moves, ends, known, shift = self.inner, self.moves, self.ends, self.known_pairs, self.shift
        symbols = [inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        if None in symbols:  # a symbol that the vocabulary lacks has no token
            symbols = [s for s in symbols if s is not None]
        last: list[int] = []
        widths: list[int] = []
        at, i = 0, 0
        for s in symbols:
            to = moves[at].get(s)
            at = self._step(at, s) if to is None else to
            i += 1
            for t, n in ends[at]:
                if n == i:
                    break
                key = last[i - n - 1] << shift | t
                ok = known.get(key)
                if ok is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    ok = known[key] = self.compatible(key >> shift, t)
                if ok:
                    break
            last.append(t)
            widths.append(n)
        out, i = [], len(symbols) - 1
        while i >= 0:
            out.append(last[i])
            i -= widths[i]
        return out[::-1]


class Tokenizer:
    """The whole chain of a lower-casing word BPE: special strings, normalisation, words, ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        model = spec["model"]
        self.bpe = WordBpe(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.names = dict(self.bpe.name) | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.general = regex.compile(pattern).findall
        # The same pattern spelled out for texts of the first 256 characters, in lower case.
        letters, space = "a-zªµºß-öø-ÿ", " \t\n\x0b\x0c\r\x85\xa0"
        numbers = "0-9²³¹¼-¾"
        self.narrow = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall if pattern == WORDS else None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda s: [s]
        self.spelled = {str(i): t for i, t in self.names.items()}
        self.known: dict[str, tuple[int, str]] = {}
        self.older: dict[str, tuple[int, str]] = {}

    def words(self, text: str) -> list[str]:
        if self.narrow:
            try:
                text.encode("latin-1")
                return self.narrow(text)
            except UnicodeEncodeError:
                pass
        return self.general(text)

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (a final sigma isn't special)."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _word(self, word: str) -> tuple[int, str]:
        entry = self.older.get(word)
        if entry is None:
            ids = self.bpe.encode(word.encode("utf-8", "surrogatepass"))
            entry = (len(ids), " ".join(map(str, ids)))
        if len(word) <= CACHE_WORD_LEN:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = entry
        return entry

    def pieces(self, text: str) -> list[tuple[int, str]]:
        """For each word: number of ids, and the ids joined by a space."""
        out: list[tuple[int, str]] = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append((1, str(self.special[part])))
            elif part:
                words = self.words(self.normalise(part))
                got = list(map(self.known.get, words))
                if None in got:
                    got = [g or self._word(w) for g, w in zip(got, words, strict=True)]
                out += got if all(g[0] for g in got) else [g for g in got if g[0]]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for p in self.pieces(text or "") for x in p[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder gives them."""
        return self.decode_line(" ".join(map(str, ids)))

    def decode_line(self, ids: str) -> str:
        """The same from decimal ids joined by a space."""
        try:
            return " ".join(map(self.spelled.__getitem__, ids.split()))
        except KeyError:  # ids beyond the vocabulary have no token
            return " ".join(self.spelled[i] for i in ids.split() if i in self.spelled)


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    ``path`` must name the vocabulary file on every executor. Null text is empty and has
    no ids. Repeated rows are encoded alike; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        t = tokenizer(path)
        sha = hashlib.sha256
        for b in batches:
            n, ids, dec, a, d = [], [], [], [], []
            for text in b.column(1).to_pylist():
                got = t.pieces(text)
                x = " ".join([p[1] for p in got])
                y = t.decode_line(x)
                n.append(sum([p[0] for p in got]))
                a.append(sha(x.encode()).hexdigest())
                d.append(sha(y.encode()).hexdigest())
                if with_ids:
                    ids.append([int(i) for i in x.split(" ")] if x else [])
                    dec.append(y)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(dec, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return rows.mapInArrow(run, schema)
