"""Scores of predictions, and tables of runs. Predictions have label, pred and columns to group by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_padding(pred: DataFrame, label: str = "label", padding: int = -1) -> DataFrame:
    """E8"""
    return pred.filter(F.col(label) != padding)


def confusion_matrix(pred: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Label, pred, n: weighted counts. A cell whose rows all weigh 0 stays, and so do its classes."""
    return pred.groupBy(*by, "label", "pred").agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))


def class_scores(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class of label or prediction: tp, support, predicted; from the confusion matrix alone."""
    as_label = confusion.select(*by, F.col("label").alias("class"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).alias("predicted"))
    as_pred = confusion.select(*by, F.col("pred"), F.lit(0), F.lit(0), F.col("n"))
    return as_label.union(as_pred).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class, precision, recall, f1, support; 0 where undefined."""
    return _scored(confusion, by).drop("tp", "predicted")


def _scored(confusion: DataFrame, by: Sequence[str]) -> DataFrame:
    s = class_scores(confusion, by)
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    scores = [_ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), f1.alias("f1")]
    return s.select(*by, "class", *scores, "support", "tp", "predicted")


def report_with_averages(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report with class as text, and after the classes macro, weighted and micro averages over all of them.

    One grouping gives the rows of classes and the averages. Weighted: by support. Micro: of all classes' sums, where
    precision, recall and f1 are the same. An average's support is the sum.
    """
    s = _scored(confusion, by)
    scores = ("precision", "recall", "f1")
    micro = {
        "precision": _ratio(F.sum("tp"), F.sum("predicted")), "recall": _ratio(F.sum("tp"), F.sum("support")),
        "f1": _ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")),
    }
    row = lambda name, made: F.struct(name.alias("class"), *[made[x].alias(x) for x in scores])
    averages = {
        "macro": {x: F.avg(x) for x in scores},
        "weighted": {x: _ratio(F.sum(F.col(x) * F.col("support")), F.sum("support")) for x in scores},
        "micro": micro,
    }
    rows = s.groupingSets([[*by, "class"], list(by)], *by, "class").agg(
        F.grouping("class").alias("_all"), F.sum("support").alias("support"), row(F.col("class").cast("string"), averages["macro"]).alias("_one"),
        F.array(*[row(F.lit(name), made) for name, made in averages.items()]).alias("_averages"),
    )
    each = F.when(F.col("_all") == 0, F.array("_one")).otherwise(F.col("_averages"))
    return rows.select(*by, F.inline(each), "support")


def accuracy(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E2"""
    return confusion.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("wa"))


def summary_scores(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E2 to E4 at once: wa, uar, macro_f1, weighted_f1 over all classes of labels and predictions."""
    s = classification_report(confusion, by)
    tp = F.sum(F.col("recall") * F.col("support"))
    return s.groupBy(*by).agg(F.try_divide(tp, F.sum("support")).alias("wa"), F.avg("recall").alias("uar"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def micro_f1(confusion: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """E5: over a subset of the labels."""
    s = class_scores(confusion, by).filter(F.col("class").isin(*labels))
    return s.groupBy(*by).agg(_ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")).alias("micro_f1"))


def class_f1(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 of each class to 3 decimals, null where undefined."""
    s = class_scores(confusion, by)
    return s.select(*by, "class", F.round(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), 3).alias("f1"))


def topk_accuracy(pred: DataFrame, logits: Column, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Percent of rows with fewer than k scores above the true class's."""
    true = F.get(logits, F.col("label").cast("int"))
    hit = F.size(F.filter(logits, lambda x: x > true)) < k
    return pred.groupBy(*by).agg((F.avg(hit.cast("int")) * 100).alias("topk"))


def running_mean(metrics: DataFrame, value: str, n: str, order: str, by: Sequence[str]) -> DataFrame:
    """Count-weighted mean of a run's batches up to each one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return metrics.withColumn("mean", F.try_divide(F.sum(F.col(value) * F.col(n)).over(w), F.sum(n).over(w)))


def masked_nll(pred: DataFrame, logp: Column, mask: Column, weights: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """-sum(w logp mask) / sum(w mask), w the label's weight or 1."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("label").cast("int") + 1) if weights else F.lit(1.0)
    return pred.groupBy(*by).agg(F.try_divide(F.sum(-w * logp * mask), F.sum(w * mask)).alias("nll"))


def masked_mse(pred: DataFrame, value: Column, target: Column, mask: Column, by: Sequence[str] = ()) -> DataFrame:
    """E12"""
    return pred.groupBy(*by).agg(F.try_divide(F.sum((value - target) * (value - target) * mask), F.sum(mask)).alias("mse"))


def best_epoch(metrics: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """The first epoch with the highest score."""
    return metrics.groupBy(*by).agg(F.max_by(F.struct("epoch", score), F.struct(F.col(score), -F.col("epoch"))).alias("b")).select(*by, "b.*")


def latest_log_per_run(logs: DataFrame, run: str, path: str = "path") -> DataFrame:
    """Of each run the file whose name holds the latest time, none_%Y-%m-%d-%H.%M.%S.log."""
    stamp = F.to_timestamp(F.regexp_extract(path, r"none_(\d{4}-\d\d-\d\d-\d\d\.\d\d\.\d\d)\.log", 1), "yyyy-MM-dd-HH.mm.ss")
    return logs.withColumn("logged_at", stamp).groupBy(run).agg(F.max_by(path, F.struct("logged_at", path)).alias(path), F.max("logged_at").alias("logged_at"))


def summarise_runs(results: DataFrame, by: Sequence[str], val: str, metrics: Sequence[str], order: str = "run") -> DataFrame:
    """The mean of a configuration's runs without the one of the lowest validation score, the first of equals, and
    the first two of those runs. A configuration of one run has nulls."""
    w = Window.partitionBy(*by)
    ranked = results.withColumn("_low", F.row_number().over(w.orderBy(val, order)) == 1)
    ranked = ranked.withColumn("_k", F.when(~F.col("_low"), F.row_number().over(w.orderBy("_low", order))))
    means = [F.avg(F.when(~F.col("_low"), F.col(m))).alias(f"mean_{m}") for m in metrics]
    firsts = [F.max(F.when(F.col("_k") == k, F.col(m))).alias(f"{m}_{k}") for m in metrics for k in (1, 2)]
    return ranked.groupBy(*by).agg(*means, *firsts)


def cv_table(results: DataFrame, metrics: Sequence[str], fold: str = "fold") -> DataFrame:
    """A row a fold, four decimals."""
    return results.select(fold, *[F.format_number(m, 4).alias(m) for m in metrics])
