"""Context graphs, evaluation and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark.operators import context as X
from convspark.operators import evaluation as E
from convspark.operators import ml

from convspark.plans.fixtures import fixture, with_sql
from convspark.plans.registry import query

PREDS = with_sql("preds")
SPEAKERS = ["user", "assistant", "system"]
CONV = with_sql("conv")
INDEX = "CASE {} WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END"
EDGES = "e AS (SELECT a.dialog_id, a.pos AS src, b.pos AS dst, a.speaker AS src_speaker, b.speaker AS dst_speaker FROM conv a JOIN conv b ON a.dialog_id = b.dialog_id AND {})"


def conv(spark, d):
    return fixture(spark, d, "conv")


def preds(spark, d):
    return fixture(spark, d, "preds")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("G1_window_edges", f"{CONV}, {EDGES.format('b.pos BETWEEN a.pos - 2 AND a.pos + 1')} SELECT dialog_id, src, dst FROM e")
def g1(spark, d):
    return X.window_edges(conv(spark, d), 2, 1).select("dialog_id", "src", "dst")


@query("G2_typed_edges", f"{CONV}, {EDGES.format('b.pos BETWEEN a.pos - 3 AND a.pos + 3')} SELECT dialog_id, src, dst, CAST(2 * ({INDEX.format('src_speaker')} * 3 + {INDEX.format('dst_speaker')}) + CASE WHEN src < dst THEN 0 ELSE 1 END AS BIGINT) AS rel FROM e")
def g2(spark, d):
    return X.typed_edges(X.window_edges(conv(spark, d), 3, 3), SPEAKERS).select("dialog_id", "src", "dst", "rel")


@query("G3_typed_edges_same_speaker", f"{CONV}, {EDGES.format('b.pos BETWEEN a.pos - 3 AND a.pos + 3')} SELECT dialog_id, src, dst, CASE WHEN src_speaker = dst_speaker THEN 0 ELSE 2 END + CASE WHEN src < dst THEN 0 ELSE 1 END AS rel FROM e")
def g3(spark, d):
    return X.typed_edges(X.window_edges(conv(spark, d), 3, 3), SPEAKERS, "same_speaker").select("dialog_id", "src", "dst", "rel")


@query("G4_global_node_ids", f"{CONV} SELECT dialog_id, pos, row_number() OVER (ORDER BY dialog_id, pos) - 1 AS node FROM conv")
def g4(spark, d):
    return X.global_node_ids(conv(spark, d))


@query("G5_edge_counts", f"{CONV}, {EDGES.format('b.pos >= a.pos - 1')} SELECT dialog_id, count(*) AS n_edges FROM e GROUP BY 1")
def g5(spark, d):
    return X.edge_counts(conv(spark, d), 1, -1)


@query("G6_context_pairs", f"{CONV}, {EDGES.format('TRUE')} SELECT 'global' AS mode, count(*) AS n FROM e UNION ALL SELECT 'intra', count(*) FROM e WHERE src_speaker = dst_speaker UNION ALL SELECT 'inter', count(*) FROM e WHERE src_speaker <> dst_speaker OR src = dst UNION ALL SELECT 'local', count(*) FROM e WHERE abs(src - dst) < 3")
def g6(spark, d):
    return X.context_pair_counts(conv(spark, d))


CM = f"{PREDS}, cm AS (SELECT run, label, pred, sum(mask) AS n FROM preds GROUP BY 1, 2, 3)"
CLS = f"{CM}, cls AS (SELECT run, class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (SELECT run, label AS class, CASE WHEN label = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cm UNION ALL SELECT run, pred, 0, 0, n FROM cm) GROUP BY 1, 2), rep AS (SELECT run, class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1, CAST(support AS BIGINT) AS support FROM cls)"


def confusion(spark, d):
    return E.confusion_matrix(preds(spark, d), ["run"], F.col("mask"))


@query("E1_confusion_matrix", f"{CM} SELECT run, label, pred, CAST(n AS BIGINT) AS n FROM cm")
def e1(spark, d):
    return confusion(spark, d)


@query("E2_accuracy", f"{PREDS} SELECT run, round(sum(CASE WHEN label = pred THEN mask ELSE 0 END) / sum(mask), 6) AS wa FROM preds GROUP BY 1")
def e2(spark, d):
    return rounded(E.accuracy(confusion(spark, d), ["run"]), "wa")


@query("E3_uar", f"{CLS} SELECT run, round(avg(recall), 6) AS uar FROM rep GROUP BY 1")
def e3(spark, d):
    return rounded(E.summary_scores(confusion(spark, d), ["run"]).select("run", "uar"), "uar")


@query("E4_macro_weighted_f1", f"{CLS} SELECT run, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rep GROUP BY 1")
def e4(spark, d):
    return rounded(E.summary_scores(confusion(spark, d), ["run"]).select("run", "macro_f1", "weighted_f1"), "macro_f1", "weighted_f1")


@query("E5_micro_f1", f"{CLS} SELECT run, round(2 * sum(tp) / (sum(support) + sum(predicted)), 6) AS micro_f1 FROM cls WHERE class BETWEEN 1 AND 6 GROUP BY 1")
def e5(spark, d):
    return rounded(E.micro_f1(confusion(spark, d), range(1, 7), ["run"]), "micro_f1")


@query("E6_class_f1", f"{CLS} SELECT run, class, round(f1, 3) AS f1 FROM rep")
def e6(spark, d):
    return E.class_f1(confusion(spark, d), ["run"])


E7_SQL = f"""{CLS}, averages AS (
  SELECT run, 'macro' AS class, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support) AS support FROM rep GROUP BY run
  UNION ALL
  SELECT run, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
         sum(support) FROM rep GROUP BY run
  UNION ALL
  SELECT run, 'micro', sum(tp) / sum(predicted), sum(tp) / sum(support), 2 * sum(tp) / (sum(support) + sum(predicted)), sum(support)
  FROM cls GROUP BY run)
SELECT run, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM (SELECT run, CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM rep UNION ALL SELECT * FROM averages)"""


@query("E7_classification_report", E7_SQL)
def e7(spark, d):
    return rounded(E.report_with_averages(confusion(spark, d), ["run"]), "precision", "recall", "f1")


@query("E8_drop_padding", f"{PREDS} SELECT run, count(*) AS n FROM preds WHERE mask = 1 GROUP BY 1")
def e8(spark, d):
    padded = preds(spark, d).withColumn("label", F.when(F.col("mask") == 1, F.col("label")).otherwise(-1))
    return E.drop_padding(padded).groupBy("run").agg(F.count("*").alias("n"))


@query("E9_topk_accuracy", f"{PREDS} SELECT run, round(avg(CAST(CAST((event_id * (label + 3) % 11 < event_id * 3 % 11) AS INT) + CAST((event_id * (label + 3) % 11 < event_id * 5 % 11) AS INT) + CAST((event_id * (label + 3) % 11 < event_id * 7 % 11) AS INT) < 2 AS INT)) * 100, 6) AS topk FROM preds GROUP BY 1")
def e9(spark, d):
    rows = preds(spark, d)
    # the score of the true class against those of three others, as a vector whose first seven entries stand for labels
    logits = F.array(*[F.expr(f"IF(label = {k}, event_id * (label + 3) % 11, -1)") for k in range(7)], *[F.expr(f"event_id * {k} % 11") for k in (3, 5, 7)])
    return rounded(E.topk_accuracy(rows, logits, 2, ["run"]), "topk")


@query("E10_running_mean", f"{PREDS}, b AS (SELECT run, epoch, avg(CAST(label = pred AS INT)) AS v, count(*) AS n FROM preds GROUP BY 1, 2) SELECT run, epoch, round(sum(v * n) OVER w / sum(n) OVER w, 6) AS mean FROM b WINDOW w AS (PARTITION BY run ORDER BY epoch)")
def e10(spark, d):
    batches = preds(spark, d).groupBy("run", "epoch").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("v"), F.count("*").alias("n"))
    return rounded(E.running_mean(batches, "v", "n", "epoch", ["run"]), "mean").select("run", "epoch", "mean")


@query("E11_masked_nll", f"{PREDS} SELECT run, round(sum(-(label + 1) * ln((event_id % 9 + 1) / 10) * mask) / sum((label + 1) * mask), 6) AS nll FROM preds GROUP BY 1")
def e11(spark, d):
    return rounded(E.masked_nll(preds(spark, d), F.log((F.col("event_id") % 9 + 1) / 10), F.col("mask"), [1, 2, 3, 4, 5, 6, 7], ["run"]), "nll")


@query("E12_masked_mse", f"{PREDS} SELECT run, round(sum((label - pred) * (label - pred) * mask) / sum(mask), 6) AS mse FROM preds GROUP BY 1")
def e12(spark, d):
    return rounded(E.masked_mse(preds(spark, d), F.col("pred"), F.col("label"), F.col("mask"), ["run"]), "mse")


METRICS = "SELECT run, epoch, part, round(avg(CAST(label = pred AS INT)), 6) AS wa FROM preds GROUP BY 1, 2, 3"


def metrics(spark, d):
    return rounded(preds(spark, d).groupBy("run", "epoch", "part").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("wa")), "wa")


@query("E13_best_epoch", f"{PREDS}, m AS ({METRICS}) SELECT run, epoch, wa FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY wa DESC, epoch) AS k FROM m WHERE part = 0) WHERE k = 1")
def e13(spark, d):
    return E.best_epoch(metrics(spark, d).filter("part = 0"), "wa", ["run"])


_STAMP = "'none_2023-01-' || lpad(CAST(epoch + 1 AS STRING), 2, '0') || '-0' || CAST(run AS STRING) || '.30.0' || CAST(part AS STRING) || '.log'"


@query("E14_latest_log_per_run", f"{PREDS} SELECT run, 'none_2023-01-' || lpad(CAST(max(epoch) + 1 AS STRING), 2, '0') || '-0' || CAST(run AS STRING) || '.30.01.log' AS path FROM preds GROUP BY 1")
def e14(spark, d):
    return E.latest_log_per_run(preds(spark, d).select("run", F.expr(_STAMP).alias("path")).distinct(), "run").drop("logged_at")


@query("E15_summarise_runs", f"{PREDS}, m AS ({METRICS}), v AS (SELECT a.run, a.epoch, a.wa AS val, b.wa AS tst FROM m a JOIN m b ON a.run = b.run AND a.epoch = b.epoch AND a.part = 0 AND b.part = 1), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val, epoch) AS low FROM v), s AS (SELECT *, row_number() OVER (PARTITION BY run, low > 1 ORDER BY epoch) AS k FROM r) SELECT run, round(avg(tst) FILTER (WHERE low > 1), 6) AS mean_tst, max(tst) FILTER (WHERE low > 1 AND k = 1) AS tst_1, max(tst) FILTER (WHERE low > 1 AND k = 2) AS tst_2 FROM s GROUP BY 1")
def e15(spark, d):
    wide = metrics(spark, d).groupBy("run", "epoch").pivot("part", [0, 1]).agg(F.first("wa")).select("run", "epoch", F.col("0").alias("val"), F.col("1").alias("tst")).dropna()
    return rounded(E.summarise_runs(wide, ["run"], "val", ["tst"], "epoch"), "mean_tst")


@query("E16_cv_table", f"{PREDS} SELECT run AS fold, format('{{:.4f}}', CAST(round(avg(CAST(label = pred AS INT)), 4) AS DOUBLE)) AS wa FROM preds GROUP BY 1")
def e16(spark, d):
    scores = preds(spark, d).groupBy(F.col("run").alias("fold")).agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("int")), 4).alias("wa"))
    return E.cv_table(scores, ["wa"])


@query("E17_baseline_classifier")
def e17(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("set_name", F.when(F.col("vec_id") % 5 < 4, "train").otherwise("test"))
    scored = ml.baseline_classifier(emb, "label", "embedding")
    return E.summary_scores(E.confusion_matrix(scored, ["set_name"]), ["set_name"])
