"""Fitted models are where no step improves them, and their tables give what they predict."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspark.operators import ml


@pytest.fixture(scope="module")
def emb(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter("label < 4")
    return rows.withColumn("set_name", F.when(F.col("vec_id") % 5 < 4, "train").otherwise("test"))


def test_centres_are_means_of_the_nearest(emb):
    centres = ml.fit_kmeans(emb, "embedding", 4)
    c = np.array([r.centre for r in centres.orderBy("cluster").collect()])
    rows = ml.nearest_centre(emb, centres, "embedding").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    away = np.linalg.norm(x[:, None] - c[None], axis=2)
    own = np.array([r.cluster for r in rows])
    assert (own == away.argmin(axis=1)).all() and np.allclose([r.distance for r in rows], away.min(axis=1))
    assert len(c) == 4 and np.allclose(c, [x[own == k].mean(axis=0) for k in range(4)], atol=1e-6)
    again = ml.cluster_kmeans(emb.repartition(1), "embedding", 4).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in again) == len(rows)


def test_gradient_of_the_classifier_is_zero(emb):
    model = ml.fit_classifier(emb.filter("set_name = 'train'"), "label", "embedding", max_iter=500, reg=0.01)
    m = model.orderBy("label").collect()
    w, b = np.array([r.coefficients for r in m]), np.array([r.intercept for r in m])
    rows = ml.apply_classifier(emb, model, "embedding").collect()
    logits = np.array([r.logits for r in rows])
    x, y = np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])
    assert np.allclose(logits, x @ w.T + b) and [r.pred for r in rows] == logits.argmax(axis=1).tolist()
    train = np.array([r.set_name == "train" for r in rows])
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = (p / p.sum(axis=1, keepdims=True))[train]
    off = p - np.eye(len(m))[y[train]]
    assert np.abs(off.mean(axis=0)).max() < 1e-4 and np.abs(off.T @ x[train] / train.sum() + 0.01 * w).max() < 1e-4


def test_report_of_the_baseline(emb):
    scored = ml.baseline_classifier(emb, "label", "embedding")
    assert scored.count() == emb.count() and {"pred", "logits"} <= set(scored.columns)
