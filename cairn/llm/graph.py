"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut

__all__ = ["components"]

#: Parts over which the members of one component are dealt while their labels are looked up.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge; the component is the smallest
    node reachable.

    ``edges`` has two long columns, source and target. Each round looks up the
    label of each label (so distances halve) and takes the smallest one among
    neighbours, until nothing changes. Only the edges given are joined, never
    the members of a component with each other; what is looked up by label is
    salted, since one label may belong to most nodes. Joins are merged: labels
    take far less room in their file than in memory, and none of their salts,
    so by the file Spark would broadcast them. Rows with a null end are left
    out; an empty table gives an empty one.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    pairs = edges.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ways = F.array(*[F.struct(F.col(x).alias("s"), F.col(y).alias("t")) for x in "ab" for y in "ab"])
    both = cut(pairs.select(F.explode(ways).alias("e")).select("e.s", "e.t").distinct())
    labels = cut(both.groupBy(F.col("t").alias("node")).agg(F.min("s").alias("label")))
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"), F.explode(salts).alias("salt"))
        jumped = labels.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(up.hint("merge"), ["label", "salt"]).select("node", F.col("label").alias("old"), "higher")
        new = (both.join(jumped.hint("merge"), both.s == jumped.node).groupBy(F.col("t").alias("node"))
               .agg(F.min("higher").alias("label"), F.max(F.when(F.col("s") == F.col("t"), F.col("old"))).alias("old")))
        new = cut(new)
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
