"""Confusion counts, threshold sweeps, ranking areas and result rows.

Scores are reduced to one row per distinct score (or per threshold slot) before anything is ordered, so a sweep costs
one aggregation of the scored table whatever the number of thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.running import running, value_blocks

EPSILON = 1e-8


def confusion(predicted: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """TP, FP, FN, TN and P, R, F1 in percent, rounded to 4 places."""
    positive, wrong = F.col(pred) == 1, F.col(label) == 1
    counts = predicted.agg(
        F.count(F.when(positive & wrong, 1)).alias("TP"),
        F.count(F.when(positive & ~wrong, 1)).alias("FP"),
        F.count(F.when(~positive & wrong, 1)).alias("FN"),
        F.count(F.when(~positive & ~wrong, 1)).alias("TN"),
    )
    p = F.col("TP") / (F.col("TP") + F.col("FP") + F.lit(EPSILON))
    r = F.col("TP") / (F.col("TP") + F.col("FN") + F.lit(EPSILON))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return counts.select(
        "TP", "FP", "FN", "TN",
        F.round(p * 100, 4).alias("P"), F.round(r * 100, 4).alias("R"), F.round(f1 * 100, 4).alias("F1"),
    )


def threshold_slot(score: Column, step: float, count: int) -> Column:
    """Largest ``i < count`` with ``i * step <= score`` (-1 when none): how far up the grid a score still counts."""
    guess = F.floor(score / F.lit(step)).cast("long")
    exact = (
        F.when((guess + 1) * F.lit(step) <= score, guess + 1)
        .when(guess * F.lit(step) > score, guess - 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(-1).cast("long"), F.least(exact, F.lit(count - 1).cast("long")))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Percent precision, recall, F1 and MCC; 0 where a denominator is 0."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    zero = F.lit(0.0)
    p = F.when(tp + fp != 0, 100 * tp / (tp + fp)).otherwise(zero)
    r = F.when(tp + fn != 0, 100 * tp / (tp + fn)).otherwise(zero)
    f1 = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(zero)
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(spread != 0, 100 * (tp * tn - fp * fn) / F.sqrt(spread)).otherwise(zero)
    return {"P": p, "R": r, "F1": f1, "MCC": mcc}


def grid_counts(scored: DataFrame, step: float, count: int, by: list[str] | None = None) -> DataFrame:
    """TP, FP, TN, FN at every threshold ``i * step``; a row is flagged when ``score >= threshold``."""
    by = by or []
    slots = scored.groupBy(*by, threshold_slot(F.col("score"), step, count).alias("i")).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
    )
    totals = slots.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    spine = totals.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    filled = spine.join(slots, [*by, "i"], "left")
    above = Window.partitionBy(*by).orderBy(F.desc("i"))
    flagged = filled.withColumn("TP", F.sum(F.coalesce("pos", F.lit(0))).over(above)).withColumn(
        "FP", F.sum(F.coalesce("neg", F.lit(0))).over(above)
    )
    return flagged.select(
        *by, "i", (F.col("i") * F.lit(float(step))).alias("thr"), "TP", "FP",
        (F.col("all_neg") - F.col("FP")).alias("TN"), (F.col("all_pos") - F.col("TP")).alias("FN"),
    )


def best_threshold(scored: DataFrame, step: float = 0.001, count: int = 1000, by: list[str] | None = None) -> DataFrame:
    """The lowest threshold with the best MCC, with its counts and rates."""
    by = by or []
    rated = grid_counts(scored, step, count, by)
    measures = rates(F.col("TP"), F.col("FP"), F.col("TN"), F.col("FN"))
    rated = rated.select("*", *[c.alias(n) for n, c in measures.items()])
    best = rated.groupBy(*by).agg(
        F.max_by(F.struct("thr", "TP", "FP", "TN", "FN", "P", "R", "F1", "MCC"), F.struct("MCC", -F.col("i"))).alias("_b")
    )
    return best.select(*by, "_b.*")


def best_f1_threshold(flag_counts: DataFrame, count: int = 10) -> DataFrame:
    """The lowest integer threshold in ``0..count-1`` with the best F1; a row is flagged when ``score > threshold``.

    Thresholds without a true positive are skipped.
    """
    shifted = flag_counts.withColumn("score", F.col("score") - 1)
    rated = grid_counts(shifted, 1.0, count).filter(F.col("TP") > 0)
    measures = rates(F.col("TP"), F.col("FP"), F.col("TN"), F.col("FN"))
    rated = rated.select("*", *[c.alias(n) for n, c in measures.items()])
    best = rated.agg(F.max_by(F.struct("thr", "TP", "FP", "TN", "FN", "P", "R", "F1"), F.struct("F1", -F.col("i"))).alias("_b"))
    return best.select("_b.*")


def at_threshold(scored: DataFrame, threshold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of ``scored`` at the one threshold (per ``by``) found elsewhere."""
    by = by or []
    histogram = scored.groupBy(*by, "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
    )
    chosen = threshold.select(*by, "thr").withColumn("_k", F.lit(1))
    # One threshold per group of results: a handful of rows.
    paired = histogram.withColumn("_k", F.lit(1)).join(F.broadcast(chosen), [*by, "_k"])
    hit = F.col("score") >= F.col("thr")
    counts = paired.groupBy(*by, "thr").agg(
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("TP"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("FP"),
        F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("TN"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("FN"),
    )
    measures = rates(F.col("TP"), F.col("FP"), F.col("TN"), F.col("FN"))
    return counts.select("*", *[c.alias(n) for n, c in measures.items()])


def areas(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUROC and AUPRC by the trapezoid rule over distinct scores.

    The precision-recall curve is anchored at recall 0, precision 1. Distinct scores are accumulated from the highest
    down, block by block; each step needs only its own counts and what came before, so no second ordering is needed.
    An area over a class without rows is NaN.
    """
    by = by or []
    histogram = scored.groupBy(*by, "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
    )
    block = -value_blocks("score")
    summed = running(
        histogram, [F.desc("score")], block, {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
        within=by, totals={"p": "tp", "n": "fp"},
    )
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    roc = F.col("neg") * (F.col("tp") + before_tp) / 2.0
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    precision_before = F.when(before_tp + before_fp > 0, before_tp / (before_tp + before_fp)).otherwise(F.lit(1.0))
    pr = F.col("pos") * (precision + precision_before) / 2.0
    return summed.groupBy(*by).agg(
        _area(F.sum(roc), F.first("p") * F.first("n")).alias("AUROC"),
        _area(F.sum(pr), F.first("p")).alias("AUPRC"),
    )


def _area(total: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(total / whole)


def result_rows(scored: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """``thr, TP, TN, FP, FN, P, R, F1, MCC, AUROC, AUPRC, samples`` per ``by`` group."""
    rated = at_threshold(scored, thresholds, by)
    samples = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"))
    return rated.join(areas(scored, by), by).join(samples, by).select(
        *by, "thr", "TP", "TN", "FP", "FN", "P", "R", "F1", "MCC", "AUROC", "AUPRC", "samples"
    )


def exact_quantile(values: DataFrame, column: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Quantile with linear interpolation between order statistics: ``by, quantile``.

    Built from the histogram of distinct values and block-wise counts, so no task holds all values.
    """
    by = by or []
    histogram = values.groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(
        histogram, ["_v"], value_blocks("_v"), {"_upto": ("sum", F.col("_n"))},
        within=by, totals={"_total": "_upto"},
    )
    at = F.lit(q) * (F.col("_total") - 1)
    low, high = F.floor(at), F.ceil(at)
    below = F.col("_upto") - F.col("_n")

    def statistic(index):
        return F.max(F.when((below <= index) & (index < F.col("_upto")), F.col("_v")))

    picked = ranked.groupBy(*by).agg(
        statistic(low).alias("_low"), statistic(high).alias("_high"), F.first(at - low).alias("_f")
    )
    return picked.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_f")).alias("quantile"))


def window_and_session_metrics(flagged: DataFrame) -> DataFrame:
    """Share of windows whose best candidate was right, and accuracy, F1, recall, precision of the session verdicts."""
    windows = flagged.groupBy("seq_id").agg(
        F.sum("first").alias("_right"), F.count(F.lit(1)).alias("_windows"), F.max("flag").alias("p"), F.max("label").alias("y")
    )
    sums = windows.agg(
        F.sum("_right").alias("right"), F.sum("_windows").alias("windows"),
        *[
            F.count(F.when((F.col("p") == p) & (F.col("y") == y), 1)).alias(name)
            for name, p, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))
        ],
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return sums.select(
        (F.col("right") / F.col("windows")).alias("window_acc"),
        ((tp + tn) / (tp + fp + fn + tn)).alias("session_acc"),
        F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(zero).alias("f1"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero).alias("recall"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero).alias("precision"),
    )
