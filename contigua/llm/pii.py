"""Personal data by weak supervision.

Candidate spans come from regular expressions: four base kinds, whose valid matches
always count, and added kinds that need judgement. Three labelers (form, gazetteer,
context) vote for, against or not at all on every candidate. The counts of vote
patterns over all documents are a table of bounded size; expectation-maximisation on it
estimates each labeler's reliability per kind and the share of true spans, without
labels. The posteriors then train a span classifier: a logistic regression on the votes
and on what the labelers don't see of a span (its length, its share of digits, what
stands before and after it), which decides on added spans and scores all of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import ship

# Kinds in their order, base kinds first.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["email_spelled", "phone_local", "national_id", "iban", "person"]
KINDS = BASE_KINDS + ADDED_KINDS

# Gazetteers and context words (lower case).
DOMAINS = frozenset((
    "com net org edu gov mil int info biz name pro eu io co ai app dev me tv cc online site shop tech cloud blog example test invalid "
    "at au be br ca ch cl cn cz de dk es fi fr gr hk hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sg si sk tr tw ua uk us za"
).split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
# Calling codes: those of one or two digits, and the first two digits of those of three.
CALLING = tuple((
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 85 88 96 97 99"
).split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sra")
NAMES = frozenset((
    "adam alan albert alex alice amy andrew anna anne arthur barbara ben brian carol charles charlotte chris daniel david diana donald edward elizabeth emily emma eric frank george grace hannah helen henry jack "
    "james jane jennifer john joseph julia karen kevin laura linda lisa lucy mark martin mary michael nancy nicole oliver patricia paul peter rachel richard robert ruth sam sarah scott sophie steven susan thomas "
    "tom william andreas bernd dieter frank franz gerd hans heike heinz ingrid jens jürgen karin karl klaus lukas manfred monika petra sabine stefan ursula uwe wolfgang antoine camille chantal chloe claire "
    "françois isabelle jacques jean julien luc marie michel monique nathalie nicolas philippe pierre rene alejandro ana antonio carlos carmen diego elena fernando francisco javier jorge jose juan lucia luis "
    "manuel maria miguel pablo pedro pilar rosa"
).split())
CUES = {
    "email": ("mail", "contact", "kontakt", "correo", "write", "courriel"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("call", "tel", "phone", "fax", "mobile", "appel", "anruf"),
    "email_spelled": ("mail", "contact", "kontakt", "correo", "write"),
    "phone_local": ("call", "tel", "phone", "fax", "mobile"),
    "national_id": ("ssn", "social", "security", "id"),
    "iban": ("iban", "bank", "account", "konto"),
    "person": ("dear", "name", "signed", "by", "contact"),
}
CONTEXT = 40

_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPELLED = re.compile(r"\b[A-Za-z0-9._-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,40}(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z]{2,10}\b")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PERSON = re.compile(r"(?<!\w)(?:" + "|".join(TITLES) + r")\.? [^\W\d_][\w'-]{1,30}")
_DIGIT = re.compile(r"[0-9]").search
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in time linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return out


def added_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of spans of the added kinds that the classifier judges; none overlaps a base span."""
    out = []
    if "[at]" in text or "(at)" in text:
        out += [(m.start(), 4, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT(text):
        out += [(m.start(), 5, m.end()) for m in _LOCAL_PHONE.finditer(text)]
        out += [(m.start(), 6, m.end()) for m in _NATIONAL.finditer(text)]
        out += [(m.start(), 7, m.end()) for m in _IBAN.finditer(text)]
    if any(t + " " in text or t + ". " in text for t in TITLES):
        out += [(m.start(), 8, m.end()) for m in _PERSON.finditer(text)]
    if not out or not base:
        return out
    base = sorted(base)
    reach = list(accumulate((e for _, _, e in base), max))
    return [x for x in out if not (i := bisect_left(base, (x[2],))) or reach[i - 1] <= x[0]]


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, int, int]:
    """What the three labelers say: 1 personal, -1 not, 0 nothing."""
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s) if kind not in (0, 4, 8) else ""
    form = place = 0
    if kind in (0, 4):
        host = s.rpartition("@")[2] if kind == 0 else re.split(r"at[\])] ?", s)[-1]
        top = re.split(r"[. \])]+", host)[-1].lower()
        form = -1 if ".." in s or s[0] in ".-" or len(s) > 120 else 1
        place = 1 if top in DOMAINS else -1 if len(top) < 2 or top.isdigit() else 0
    elif kind == 1:
        first = int(s.split(".")[0])
        form = -1 if any(len(x) > 1 and x[0] == "0" for x in s.split(".")) or first == 0 else 1
        place = -1 if first in (0, 10, 127, 255) or s.startswith(("192.168.", "169.254.")) else 1
    elif kind == 2:
        form = 1 if len(digits) in (13, 15, 16, 19) else -1
        place = 1 if digits.startswith(ISSUERS) else -1
    elif kind == 3:
        form = 1 if s.count("(") == s.count(")") and ".." not in s else -1
        place = 1 if digits.startswith(CALLING) else -1
    elif kind == 5:
        form = -1 if len(set(digits)) < 3 else 1
        place = -1 if digits[0] in "01" or digits[3] in "01" else 1
    elif kind == 6:
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == 7:
        c = s.replace(" ", "")
        form = 1 if int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1 else -1
        place = 1 if s[:2] in COUNTRIES else -1
    else:
        name = s.split(" ", 1)[1]
        form = 1 if name[0].isupper() and not name[1:].isupper() else -1
        place = 1 if name.lower() in NAMES else 0
    before = text[max(0, start - CONTEXT) : start].lower()
    context = 1 if any(c in before for c in CUES[KINDS[kind]]) else 0
    return form, place, context


def side(text: str, at: int) -> int:
    """What stands at a place: 0 nothing or white space, 1 a mark, 2 a letter or digit."""
    if not 0 <= at < len(text) or text[at].isspace():
        return 0
    return 2 if text[at].isalnum() else 1


def pattern(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """kind, the votes, and what only the classifier sees: buckets of length and of the digits' share, what stands on both sides."""
    digits = sum(c.isdigit() for c in text[start:end])
    share = 0 if not digits else 1 if 2 * digits < end - start else 2
    return (kind, *votes(text, start, kind, end), min(3, (end - start) // 8), share, side(text, start - 1), side(text, end))


#: Values that each place of a pattern after the votes can take.
SEEN = (4, 3, 3, 3)


class SpanModel:
    """Reliabilities of the labelers and the classifier, from counts of patterns."""

    def __init__(self, counts: dict[tuple, int], rounds: int = 50):
        keys = sorted(counts)
        n = np.array([counts[k] for k in keys], float)
        v = np.array([k[1:4] for k in keys], float).reshape(-1, 3)
        kind = np.array([k[0] for k in keys], int)
        post = np.zeros(len(keys))
        self.share, self.reliability = {}, {}
        for k in sorted(set(kind.tolist())):
            at = kind == k
            # prior: labelers are right four times in five, as if 8 of 10 seen spans showed it
            share, right = 0.7, np.full(3, 0.8)
            for _ in range(rounds):
                plus = np.log(share) + (np.log(right) * (v[at] > 0) + np.log(1 - right) * (v[at] < 0)).sum(1)
                minus = np.log(1 - share) + (np.log(1 - right) * (v[at] > 0) + np.log(right) * (v[at] < 0)).sum(1)
                p = 1 / (1 + np.exp(minus - plus))
                w = n[at]
                share = (w @ p + 7) / (w.sum() + 10)
                agree = ((v[at] > 0) * p[:, None] + (v[at] < 0) * (1 - p)[:, None]) * w[:, None]
                right = np.clip((agree.sum(0) + 8) / (((v[at] != 0) * w[:, None]).sum(0) + 10), 0.5, 0.99)
            post[at] = p
            self.share[k], self.reliability[k] = float(share), right.tolist()
        self.weights = self._fit(keys, n, post)

    @staticmethod
    def features(key: tuple) -> np.ndarray:
        k = len(KINDS)
        x = np.zeros(k + 6 + sum(SEEN))
        x[key[0]] = 1
        x[k : k + 3] = [v > 0 for v in key[1:4]]
        x[k + 3 : k + 6] = [v < 0 for v in key[1:4]]
        at = k + 6
        for n, value in zip(SEEN, key[4:], strict=True):
            x[at + value] = 1
            at += n
        return x

    def _fit(self, keys: list[tuple], n: np.ndarray, post: np.ndarray) -> np.ndarray:
        w = np.zeros(len(KINDS) + 6 + sum(SEEN))
        if not keys:
            return w
        x, n = np.array([self.features(k) for k in keys]), n / n.sum()
        for _ in range(30):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-x @ w))
            g = x.T @ (n * (p - post)) + 1e-4 * w
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            w -= np.linalg.solve(h, g)
        return w

    def score(self, key: tuple) -> float:
        return float(1 / (1 + np.exp(-self.features(key) @ self.weights)))


def pattern_counts(docs: DataFrame, text_col: str = "text") -> dict[tuple, int]:
    """How often each pattern comes up over all documents; at most 9 x 27 x 108 rows reach the driver."""
    ship(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    seen.update(pattern(text, *s) for s in base + added_candidates(text, base))
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({c: pa.array([k[i] for k in keys], pa.int32()) for i, c in enumerate("kabcldxy")} | {"n": pa.array([seen[k] for k in keys], pa.int64())})

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "k int, a int, b int, c int, l int, d int, x int, y int, n long")
    return {tuple(r[:8]): r[8] for r in counted.groupBy(*"kabcldxy").agg(F.sum("n").alias("n")).collect()}


def tell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def judged(text: str, scores: dict[tuple, float], threshold: float) -> tuple[list, list]:
    """Base spans and the added spans that the classifier takes."""
    base = base_spans(text)
    return base, [s for s in added_candidates(text, base) if scores.get(pattern(text, *s), 0.0) >= threshold]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, full: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if ``full``, found (with scores).

    Offsets are code points, ends exclusive; spans of different kinds may overlap. Null
    text is empty. Equal rows give equal rows; an empty table gives none; other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    model = SpanModel(counts := pattern_counts(docs, text_col))
    scores = {k: model.score(k) for k in counts}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            out: dict[str, list] = {c: [] for c in ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]}
            for text in b.column(1).to_pylist():
                base, more = judged(text, scores, threshold)
                n = Counter(k for _, k, _ in base)
                for k, c in enumerate(["n_email", "n_ip", "n_card", "n_phone"]):
                    out[c].append(n[k])
                out["base_sha256"].append(hashlib.sha256(tell(base).encode()).hexdigest())
                out["spans"].append(tell(base + more))
                if full:
                    out["found"].append([{"kind": KINDS[k], "start": s, "end": e, "score": scores.get(pattern(text, s, k, e), 0.0)} for s, k, e in sorted(base + more)])
            cols = [b.column(0), *[pa.array(out[c], pa.int64()) for c in list(out)[:4]], pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string())]
            names = ["doc_id", *list(out)[:6]]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(out["found"], kind)] if full else []), names=names + ["found"] * full)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema + (", found array<struct<kind:string,start:long,end:long,score:double>>" if full else ""))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each found span of the text replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first. A null text
    stays null; other columns stay as they are. ``n_chars``, where there is one, follows.
    Repeated rows are redacted alike, an empty table stays empty.
    """
    ship(docs.sparkSession)
    model = SpanModel(counts := pattern_counts(docs, text_col))
    scores = {k: model.score(k) for k in counts}
    names, at = docs.columns, docs.columns.index(text_col)
    length = names.index("n_chars") if names.count("n_chars") == 1 else None

    def run(batches):
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                if not text:
                    texts.append(text)
                    continue
                base, more = judged(text, scores, threshold)
                parts, end = [], 0
                for s, k, e in sorted(base + more):
                    if s >= end:
                        parts += [text[end:s], f"[{KINDS[k].upper()}]"]
                    end = max(end, e)
                texts.append("".join([*parts, text[end:]]) if parts else text)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if length is not None:
                cols[length] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
