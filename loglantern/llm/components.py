"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.plans.scratch import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node reachable over the links, for every node that has one.

    Each round a node takes the least label of its neighbours, hands it to the node its own label
    names, and takes the label of that node, so paths shrink by a factor in every round.
    Links of null or of a node with itself are ignored. A round's labels are written before
    the next one reads them; nothing but one count a round reaches the driver."""
    pairs = links.filter(F.col(a) != F.col(b))
    both = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("x")
    edges = stored(pairs.select(both).select("x.u", "x.v").distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        old = labels.select("node", "label")
        near = edges.join(old, edges["v"] == old["node"]).groupBy("u").agg(F.min("label").alias("low"))
        rows = old.join(near, old["node"] == near["u"])
        rows = rows.select(
            F.explode(
                F.array(
                    F.struct("node", F.least("label", "low").alias("label"), F.col("label").alias("own")),
                    F.struct(F.col("label").alias("node"), F.least("label", "low").alias("label"), F.lit(None).cast(old.schema["label"].dataType).alias("own")),
                )
            ).alias("x")
        ).select("x.*")
        to = old.select(F.col("node").alias("at"), F.col("label").alias("there"))
        jumps = old.join(to, old["label"] == to["at"]).select("node", F.col("there").alias("label"), F.lit(None).cast(old.schema["label"].dataType).alias("own"))
        new = rows.unionByName(jumps).groupBy("node").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        labels = stored(new.select("node", "label", (F.col("label") < F.col("own")).alias("moved")), "labels")
    return labels.select("node", F.col("label").alias("component"))
