"""Scans: one pass over each key's rows in order, as a stream of sorted Arrow batches.

A key's rows never are one array: Spark sorts each partition (and spills), and a task holds
one batch and the state of the key it is at. A hot key is one task's stream, in time linear
in its rows but for what the state costs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from contigua.session import fresh_name, ship

#: Values of a batch that a scan gives.
BATCH = 10_000


def scan(df: DataFrame, keys: list[str], values: list[Column], make: Callable, fields: list[StructField]) -> DataFrame:
    """(keys, fields): what a state gives for the rows of each key in the order of ``values``, nulls first.

    ``make()`` begins a key; the state's ``step(*values)`` and, after the last row, ``end()``
    return lists of tuples of ``fields``. Null is a key as any other; an empty table gives no rows.
    """
    ship(df.sparkSession)
    schema = StructType([df.schema[k] for k in keys] + fields)
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches):
        key, state, out, size = None, None, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or row[:n] != key:
                    new = [key + x for x in state.end()] if state is not None else []
                    key, state = row[:n], make()
                    out += new
                    size += sum(len(v) if isinstance(v, list) else 1 for x in new for v in x)
                new = state.step(*row[n:])
                if new:
                    out += [key + x for x in new]
                    size += len(new) * len(arrow)
                if size >= BATCH:
                    yield batch()
                    out, size = [], 0
        if state is not None:
            out += [key + x for x in state.end()]
        if out:
            yield batch()

    names = []
    for i in range(len(values)):
        names.append(fresh_name(f"v{i}", [*keys, *names]))
    rows = df.select(*keys, *[c.alias(x) for c, x in zip(values, names, strict=True)])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *names).mapInArrow(run, schema)


class Chain:
    """A chain by its last row: what came before is shared with other chains."""

    __slots__ = ("loss", "n", "at", "row", "before")

    def __init__(self, before: Chain | None, gain: int, at: int, row: tuple):
        self.loss, self.n = (before.loss - gain, before.n + 1) if before else (-gain, 1)
        self.at, self.row, self.before = at, row, before

    def rows(self) -> list[tuple]:
        out, c = [], self
        while c:
            out.append(c.row)
            c = c.before
        return out[::-1]


def first(a: Chain, b: Chain | None) -> bool:
    """Whether ``a`` is the better chain: greater gain, then fewer rows, then rows that come first. Any is better than none."""
    if b is None:
        return True
    if (a.loss, a.n) != (b.loss, b.n):
        return (a.loss, a.n) < (b.loss, b.n)
    out = False
    while a is not b:
        if a.at != b.at:
            out = a.at < b.at
        a, b = a.before, b.before
    return out
