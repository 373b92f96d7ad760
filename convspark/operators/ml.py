"""Classifier and clustering: fitted on Spark ML, kept as tables, applied as columns.

A fitted model is a table of a few rows, which can be stored, read and checked; applying it needs no Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.functions import vectors as V
from convspark.functions.keys import argmax


def fit_classifier(train: DataFrame, label: str, vector: str, max_iter: int = 20, reg: float = 0.01) -> DataFrame:
    """Label, intercept, coefficients of a multinomial logistic regression, penalised by reg / 2 times the squares of
    the coefficients as they are; a row a class from 0 to the largest label."""
    rows = train.select(F.col(label).cast("double").alias("_y"), array_to_vector(V.doubles(F.col(vector))).alias("_x"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter, regParam=reg, standardization=False, family="multinomial", tol=1e-9).fit(rows)
    weights, offsets = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    return train.sparkSession.createDataFrame([(k, b, w) for k, (w, b) in enumerate(zip(weights, offsets, strict=True))], "label int, intercept double, coefficients array<double>")


def apply_classifier(features: DataFrame, model: DataFrame, vector: str) -> DataFrame:
    """Features with logits, a score for each class, and pred, the class of the largest, the first of equals."""
    classes = model.agg(F.array_sort(F.collect_list(F.struct("label", "intercept", "coefficients"))).alias("_model"))  # one row a class
    own = V.doubles(F.col(vector))
    rows = features.crossJoin(F.broadcast(classes)).withColumn("logits", F.transform("_model", lambda k: k["intercept"] + V.dot(own, k["coefficients"])))
    best = F.get(F.transform("_model", lambda k: k["label"]), argmax(F.col("logits")).cast("int"))
    return rows.withColumn("pred", best).drop("_model")


def baseline_classifier(features: DataFrame, label: str, vector: str, max_iter: int = 20, reg: float = 0.01) -> DataFrame:
    """Fitted on rows of set_name train; all rows with pred and logits."""
    return apply_classifier(features, fit_classifier(features.filter("set_name = 'train'"), label, vector, max_iter, reg), vector)


def fit_kmeans(emb: DataFrame, vector: str, k: int, seed: int = 0, max_iter: int = 100, tol: float = 1e-9) -> DataFrame:
    """cluster, centre of k-means from k-means|| starts, until no centre moves further than tol; at most k rows."""
    rows = emb.select(array_to_vector(V.doubles(F.col(vector))).alias("_x"))
    model = KMeans(featuresCol="_x", k=k, seed=seed, initMode="k-means||", maxIter=max_iter, tol=tol).fit(rows)
    return emb.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")


def nearest_centre(emb: DataFrame, centres: DataFrame, vector: str) -> DataFrame:
    """emb with cluster and distance of its nearest centre, the first of equals."""
    every = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("_centres"))  # k rows
    own = V.doubles(F.col(vector))
    away = F.transform("_centres", lambda c: F.struct(V.euclidean(own, c["centre"]).alias("distance"), c["cluster"].alias("cluster")))
    return emb.crossJoin(F.broadcast(every)).withColumn("_best", F.array_min(away)).withColumns({"cluster": F.col("_best.cluster"), "distance": F.col("_best.distance")}).drop("_best", "_centres")


def cluster_kmeans(emb: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """rows with cluster and distance, by k-means||."""
    return nearest_centre(emb, fit_kmeans(emb, vector, k, seed), vector)
