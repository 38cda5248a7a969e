"""Connected components by minimum labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Into how many parts the rows of one key are dealt in a salted join.
SALTS = 8


def salted(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`left` joined with the narrow table `right` on `key`. Rows of one key are dealt into `salts` parts by a hash of
    `by`, so that a key with a large share of `left` is no single task's; `right` is repeated for that."""
    salt, taken = "salt", {c.lower() for c in left.columns + right.columns}
    while salt in taken:
        salt = f"_{salt}"
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(many, [key, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), label being the least node of its component.

    Each round takes the least label among a node and its neighbours, then that label's own label, so a chain of n
    nodes needs about log(n) rounds. Only narrow rows are shuffled; labels are kept in the checkpoint folder. A hub's
    edges, and the nodes of one label, are dealt to several tasks.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        of = labels.select(F.col("node").alias("b"), "label")
        heard = salted(both, of, "b", F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        new = cut(new)
        used = new.select("label").distinct()
        far = used.join(new.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        jumped = cut(
            salted(new, far, "label", F.col("node")).select("node", "old", F.least("label", "further").alias("label"))
        )
        if jumped.filter("old <> label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
