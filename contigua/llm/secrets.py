"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression yields a Boolean query over trigrams that any match must
contain (in lower case). Postings (trigram, document) of the queries' trigrams are one
table; a rule's candidates are the documents whose postings meet all trigrams of one of
its clauses, and only candidates are verified with the expression itself. A rule without
mandatory trigrams scans all documents.
"""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.session import cut

#: kind -> (expression, group whose length counts, least length of it). The first three.
BASE_RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
ADDED_RULES = {
    "hosted": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "cloud": (r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 38),
}
MOST_STRINGS, MOST_CLAUSES = 64, 32


def trigram_query(expression: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams, one of which every match contains whole; None if there's no such need."""
    factors: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if strings and frozenset() not in clauses:
            least = [c for c in clauses if not any(d < c for d in clauses)]
            factors.append(sorted(least, key=sorted))

    def exact(items) -> set[str] | None:
        """All strings (lower case) that a sequence matches, if they are few."""
        out = {""}
        for item in items:
            one = exact_item(item)
            if one is None or len(out) * len(one) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, one)}
        return out

    def exact_item(item) -> set[str] | None:
        op, arg = item
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            out: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    out.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return exact(arg[3])
        if op is sre.BRANCH:
            parts = [exact(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[1] != sre.MAXREPEAT and arg[1] <= 5:
            one = exact(arg[2])
            if one is None or sum(len(one) ** n for n in range(arg[0], arg[1] + 1)) > MOST_STRINGS:
                return None
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(sorted(one), repeat=n)}
        return None

    def walk(items) -> None:
        run = {""}
        for item in items:
            one = exact_item(item)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, one)}
                continue
            flush(run)
            run = {""} if one is None else one
            if one is None:
                op, arg = item
                if op is sre.SUBPATTERN:
                    walk(arg[3])
                elif op is sre.MAX_REPEAT and arg[0] > 0:
                    walk(arg[2])
        flush(run)

    walk(sre_parser.parse(expression))
    if not factors:
        return None
    clauses = {frozenset()}
    for f in sorted(factors, key=len):
        if len(clauses) * len(f) > MOST_CLAUSES:
            break  # fewer conditions: more candidates, none lost
        clauses = {a | b for a, b in product(clauses, f)}
    # Where even the shortest factor has too many clauses there's no condition: a full scan.
    return None if clauses == {frozenset()} else sorted(clauses, key=sorted)


def is_run(expression: str) -> bool:
    """Whether it is one character or class, once or more, and nothing else."""
    items = sre_parser.parse(expression)
    return len(items) == 1 and expression.endswith("+") and items[0][0] is sre.MAX_REPEAT and items[0][1][0] == 1 and len(items[0][1][2]) == 1 and items[0][1][2][0][0] in (sre.IN, sre.LITERAL)


def present(text: Column, trigrams: list[str]) -> Column:
    """Those trigrams that the text has in lower case, lowered once."""
    return F.transform(F.array(F.lower(text)), lambda low: F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t)))[0]


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for ``trigrams``: a row (trigram, doc_id) for each document that has it."""
    return rows.select("doc_id", F.explode(present(F.col("text"), trigrams)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, rules): bits of the rules that have a clause whose postings all hold the document."""
    spark = index.sparkSession
    wanted = [(t, rule, c, 1 << i, (1 << len(clause)) - 1) for rule, clauses in queries.items() for c, clause in enumerate(clauses) for i, t in enumerate(sorted(clause))]
    names = ("trigram", "rule", "clause", "bit", "whole")
    given = [F.struct(*[(F.lit(v) if i < 3 else F.lit(v).cast("long")).alias(n) for i, (n, v) in enumerate(zip(names, w, strict=True))]) for w in wanted]
    conditions = spark.range(1).select(F.inline(F.array(*given)))  # bounded by the rules
    met = index.join(F.broadcast(conditions), "trigram").groupBy("doc_id", "rule", "clause", "whole").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def spans(text: Column, rule: tuple[str, int, int], order: int) -> Column:
    """Matches as array of (start, order, end), in code points; those that are too short drop out."""
    expression, group, least = rule
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    between = F.split(text, expression, -1)
    part = F.zip_with(
        found, between,
        lambda m, g: F.struct(
            F.char_length(g).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("own"),
            (F.char_length(F.regexp_extract(m, expression, group) if group else m) >= least).alias("ok"),
        ),
    )
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.aggregate(
        part, start,
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["own"]).alias("at"),
            F.when(x["ok"], F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(order).alias("kind"), (a["at"] + x["gap"] + x["own"]).alias("end")))))
            .otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )


def line(found: Column, names: list[str]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of start, kind, end), n_assign, n_access, n_hex, base_sha256, spans.

    Kinds are numbers in the order of the rules, base rules first. Offsets are code
    points, ends exclusive; overlapping spans of different kinds all count. Null text is
    empty. Rows that repeat an id are each scanned (they share their candidates); rows
    without an id are scanned by every rule. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    rules = BASE_RULES | (ADDED_RULES if added is None else added)
    names, n_base = list(rules), len(BASE_RULES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {k: q for k, (e, _, _) in enumerate(rules.values()) if (q := trigram_query(e)) is not None}
    index = cut(postings(rows.where("doc_id is not null"), sorted({t for q in queries.values() for c in q for t in c})), "postings")
    hits = candidates(index, queries).withColumnRenamed("doc_id", "c_id")
    # Rows without an id have no postings of their own; their texts deal them out over the tasks.
    key = F.coalesce("doc_id", F.xxhash64("text"))
    joined = rows.withColumn("key", key).join(hits, F.col("key") == F.col("c_id"), "left")
    text = F.col("text")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    each = []
    for k, rule in enumerate(rules.values()):
        expression, group, least = rule
        # A full scan looks for a run that is long enough first; a match of it is there exactly if one stays.
        quick = expression[:-1] + f"{{{least},}}" if k not in queries and not group and is_run(expression) else expression
        maybe = text.rlike(quick) if k not in queries else (F.col("doc_id").isNull() | (F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << k) != 0)) & text.rlike(expression)
        longer = (quick, group, least)
        each.append(F.when(maybe, spans(text, longer, k)).otherwise(none))
    found = joined.select("doc_id", F.concat(*each[:n_base]).alias("base"), F.concat(*each[n_base:]).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line(F.col("base"), names), 256).alias("base_sha256"), line(F.concat("base", "more"), names).alias("spans"), F.array_sort(F.concat("base", "more")).alias("found"),
    )
