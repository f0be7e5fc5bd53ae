"""Detection quality of scored windows (columns ``score`` and boolean ``label``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .quantiles import exact_percentile

THRESHOLD_PERCENTILE = 95  # fixed value
HISTOGRAM_EDGES = 80  # fixed value


def fit_threshold(validation: DataFrame, percentile: float = THRESHOLD_PERCENTILE, score: str = "score") -> DataFrame:
    return exact_percentile(validation, score, percentile)


#: Size of a sketch of scores, and the rank error it keeps with a probability of 99 %, also after merging.
SKETCH_SIZE, SKETCH_ERROR = 4_096, 0.0015


def score_sketches(scored: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """One sketch of the scores (some ten kilobytes) per ``by``, such as day and label: to be stored, and merged over any of them."""
    return scored.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"))


def sketch_percentile(sketches: DataFrame, percentile: float, *by: str) -> DataFrame:
    """``threshold`` and number ``n`` of scores from merged sketches; its rank is off by at most ``SKETCH_ERROR``."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"),
                         F.kll_sketch_get_quantile_double("sketch", F.lit(percentile / 100)).alias("threshold"))


def sketch_sweep(sketches: DataFrame, thresholds: list[float], *by: str) -> DataFrame:
    """Scores above each threshold, about, from merged sketches: no window is scored or read again."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    n = F.kll_sketch_get_n_double("sketch")
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.round(n * (1 - F.kll_sketch_get_rank_double("sketch", F.lit(float(t))))).cast("bigint").alias("above"))
            for t in thresholds]
    return merged.select(*by, n.alias("n"), F.inline(F.array(*rows)))


def ml_anomalies(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return scored.where(F.col(score) > F.lit(threshold))


def predict(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return scored.withColumn("predicted", F.col(score) > F.lit(threshold))


def align_predictions(predictions: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Predictions beside the truth of the same window; ``on`` identifies one window."""
    return predictions.join(truth, on, "inner")


def confusion_matrix(predicted: DataFrame, *by: str) -> DataFrame:
    return predicted.groupBy(*by, F.col("label").cast("int").alias("truth"),
                             F.col("predicted").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def classification_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cell = {
        (t, p): F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("prediction") == p), F.col("n"))), F.lit(0))
        for t in (0, 1) for p in (0, 1)
    }
    counts = confusion_matrix(predicted).agg(
        cell[0, 0].alias("tn"), cell[0, 1].alias("fp"), cell[1, 0].alias("fn"), cell[1, 1].alias("tp"))

    def share(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    def scores(hit, guessed, real):
        p, r = share(hit, guessed), share(hit, real)
        return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p0, r0, f0 = scores(tn, tn + fn, tn + fp)
    p1, r1, f1 = scores(tp, tp + fp, tp + fn)
    wide = counts.select(
        "*", p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), p1.alias("p1"), r1.alias("r1"), f1.alias("f1"),
        (tn + fp).alias("s0"), (tp + fn).alias("s1"), (tn + fp + fn + tp).alias("total"))
    accuracy = share(F.col("tn") + F.col("tp"), F.col("total"))

    def row(name, p, r, f, support):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        support.cast("bigint").alias("support"))

    def mean(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return share(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), F.col("total"))

    return wide.select(F.inline(F.array(
        row("Normal", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("Anomalie", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", accuracy, accuracy, accuracy, F.col("total")),
        row("macro avg", mean("p"), mean("r"), mean("f"), F.col("total")),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("total")),
    )))


def score_histogram(scored: DataFrame, threshold: float, edges: int = HISTOGRAM_EDGES, score: str = "score") -> DataFrame:
    """Density per label over equal bins of [0, min(max, 3 x threshold)]; scores beyond are left out."""
    bins = edges - 1
    limit = scored.agg(F.least(F.max(score), F.lit(3.0 * threshold)))
    inside = scored.withColumn("_limit", limit.scalar()).where((F.col(score) >= 0) & (F.col(score) <= F.col("_limit")))
    width = F.col("_limit") / bins
    bin_of = F.least(F.floor(F.col(score) / width), F.lit(bins - 1).cast("bigint"))
    counted = inside.groupBy("label", bin_of.alias("bin"), width.alias("width")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("label").agg(F.sum("n").alias("_total"))
    # At most two labels and `bins` bins per side, so the totals are two rows.
    return (
        counted.join(F.broadcast(totals), "label")
        .withColumn("density", F.col("n") / (F.col("_total") * F.col("width"))).drop("_total")
    )


def detection_rate(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    over = F.col(score) > F.lit(threshold)
    return scored.agg(
        F.count("*").alias("windows"), F.count_if(over).alias("detected"),
        (F.avg(over.cast("double")) * 100).alias("detected_pct"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], score: str = "score") -> DataFrame:
    """Confusion counts for each threshold, in one pass over the scores."""
    label = F.col("label")
    counts = scored.agg(*[
        c.alias(f"{name}_{i}")
        for i, t in enumerate(thresholds)
        for name, c in (
            ("tp", F.count_if(label & (F.col(score) > F.lit(t)))), ("fp", F.count_if(~label & (F.col(score) > F.lit(t)))),
            ("fn", F.count_if(label & (F.col(score) <= F.lit(t)))), ("tn", F.count_if(~label & (F.col(score) <= F.lit(t)))),
        )
    ])
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
        for i, t in enumerate(thresholds)
    ]
    return counts.select(F.inline(F.array(*rows)))
