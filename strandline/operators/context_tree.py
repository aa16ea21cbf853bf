"""Next-key prediction from contexts of variable depth.

A context is a suffix of the keys before. The tree is grown level by level: a suffix of ``d`` keys is counted only below a suffix of
``d - 1`` keys seen ``least`` times or more, itself so often. A longer context says something new as far as its next keys differ from
those of the suffix one shorter: ``gain = sum(count * ln(p(key | longer) / p(key | shorter)))``. Contexts with a gain below ``worth``
are pruned from the deepest level up, unless a longer one above them is kept. A window is answered by its longest kept suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.count_detectors import NextEventModel
from strandline.plans.lookup import lookup_join
from strandline.session import written


def suffix(context: Column, width: int, n: int) -> Column:
    """The last ``n`` of ``width`` keys as text."""
    return F.array_join(F.slice(context, width - n + 1, n), " ") if n else F.lit("")


class ContextTree(NextEventModel):
    """Top-``g`` candidates of the kept contexts; ``nodes`` has ``order, suffix, total, gain`` of each."""

    def __init__(self, windows: DataFrame, width: int, g: int, least: int = 2, worth: float = 2.0):
        counted = written(windows.groupBy("context", "next_key").agg(F.count(F.lit(1)).alias("cnt")))
        levels: list[DataFrame] = []
        for n in range(width + 1):
            here = counted
            if n:
                grown = levels[-1].select(F.col("suffix").alias("_s")).distinct()
                here = lookup_join(counted.withColumn("_s", suffix(F.col("context"), width, n - 1)), grown, ["_s"], "inner", F.struct("context", "next_key"))
            summed = here.withColumn("suffix", suffix(F.col("context"), width, n)).groupBy("suffix", "next_key").agg(
                F.sum("cnt").alias("cnt"), F.min(suffix(F.col("context"), width, max(n - 1, 0))).alias("shorter")
            )
            totals = summed.groupBy("suffix").agg(F.sum("cnt").alias("total"))
            if n:
                totals = totals.where(F.col("total") >= least)
            made = lookup_join(summed, totals, ["suffix"], "inner", F.col("next_key"))
            levels.append(written(made.withColumn("order", F.lit(n))))
        self.nodes = written(self._kept(levels, worth))
        kept = self.nodes.select("order", "suffix")
        rows = None
        for n, level in enumerate(levels):
            found = level.join(kept.where(F.col("order") == n).select("suffix").hint("merge"), "suffix", "left_semi").select("order", "suffix", "next_key", "cnt")
            rows = found if rows is None else rows.unionByName(found)
        self.width, self.g = width, g
        self.candidates = written(self.best_of(rows, g))

    @staticmethod
    def _kept(levels: list[DataFrame], worth: float) -> DataFrame:
        kept: DataFrame | None = None
        for n in range(len(levels) - 1, -1, -1):
            level = levels[n]
            if n == 0:
                nodes = level.groupBy("order", "suffix").agg(F.sum("cnt").alias("total")).withColumn("gain", F.lit(0.0))
                return nodes if kept is None else nodes.unionByName(kept.select("order", "suffix", "total", "gain"))
            before = levels[n - 1].select(F.col("suffix").alias("shorter"), "next_key", (F.col("cnt") / F.col("total")).alias("_p"))
            met = lookup_join(level, before, ["shorter", "next_key"], "inner", F.struct("suffix", "next_key"))
            gain = F.sum(F.col("cnt") * F.ln(F.col("cnt") / F.col("total") / F.col("_p")))
            nodes = met.groupBy("order", "suffix", "shorter", "total").agg(gain.alias("gain"))
            wanted = F.col("gain") >= worth
            if kept is not None:
                carried = kept.where(F.col("order") == n + 1).select(F.col("shorter").alias("suffix")).distinct().withColumn("_held", F.lit(True))
                nodes = nodes.join(carried.hint("merge"), "suffix", "left")
                wanted = wanted | F.coalesce("_held", F.lit(False))
            nodes = written(nodes.where(wanted).select("order", "suffix", "shorter", "total", "gain"))
            kept = nodes if kept is None else kept.unionByName(nodes)
        raise AssertionError("the levels begin with the empty context")
