"""Connected components by passing on the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import cut

#: Bytes that a task should write at least: narrow tables are small whatever the number of shuffle partitions.
TASK_BYTES = 16 << 20


def compact(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """``df`` in no more tasks than its ``rows`` (at most so many) of some ``row_bytes`` need; tasks grow with the rows.

    For tables whose last step is a join or an aggregate: few files in place of one for
    every shuffle partition.
    """
    return df.coalesce(max(1, -(-rows * row_bytes // TASK_BYTES)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it is connected to.

    A round takes each node's smallest label among its neighbours and then that label's
    own label, so chains shrink geometrically. All tables stay distributed; aggregates on
    a node combine before the shuffle, so one with very many neighbours is no burden.
    """
    rows = 2 * edges.count()
    both = cut(compact(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), rows), "edges")
    labels = cut(compact(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), rows), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = cut(compact(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), rows), "labels")
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = cut(compact(step.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), rows), "labels")
        labels = step.select("node", "label")
        if not step.where("label <> old").head(1):
            return labels
