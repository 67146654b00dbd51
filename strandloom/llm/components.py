"""Connected components of a table of links, by least labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links lead to) of every end of `links` (a, b).

    Each round gives a node the least label among its neighbours and then the
    label of that label, so that long chains shrink by half; rounds go on until
    nothing changes. Each round is a written table. No links: no rows. Repeated links, both directions and loops (a, a)
    count once; null ends have no place here.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("node"), F.least("a", "_least").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("_near"))
        stepped = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("_before"), F.least("component", "_near").alias("component"))
        jumped = (
            stepped.join(labels.select(F.col("node").alias("component"), F.col("component").alias("_beyond")), "component", "left")
            .select("node", "_before", F.least("component", F.coalesce("_beyond", "component")).alias("component"))
        )
        after = written(jumped, "labels")
        if after.filter("component <> _before").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
