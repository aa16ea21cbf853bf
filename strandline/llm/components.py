"""Connected components of a table of links, by smallest-label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared


def components(links: DataFrame, shared: Shared, name: str) -> DataFrame:
    """``(v, root)`` for each end of the links ``(a, b)``; root is the smallest vertex reachable.

    A round takes the smallest label among the neighbours and then the label of that label, so the number of rounds
    grows with the logarithm of the longest chain; every round's labels are a written table. Self-links and repeated links
    are harmless, null ends are ignored.
    """
    links = links.where("a is not null and b is not null")
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = shared.write(both, f"{name}-links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    labels = shared.write(labels, f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("seen"))
        lower = labels.join(seen, labels.v == seen.a, "left").select("v", F.col("root").alias("old"), F.least("root", "seen").alias("near"))
        jump = labels.select(F.col("v").alias("near"), F.col("root").alias("far"))
        after = lower.join(jump, "near", "left").select("v", "old", F.least("near", "far").alias("root"))
        after = shared.write(after, f"{name}-{step}")
        changed = after.where("root <> old").limit(1).count()
        shared.drop(f"{name}-{step - 1}")
        labels = after.select("v", "root")
        if not changed:
            shared.drop(f"{name}-links")
            return labels
