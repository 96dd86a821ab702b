"""Drift detectors over ordered records: count-based sliding windows, lagged thresholds, alarm summaries, calibration by windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(df: DataFrame, pos: str, width: int, slide: int, total: int) -> DataFrame:
    """Each row once for every window of ``width`` rows that holds it (``width / slide`` at most): adds ``window``.

    There are ``(total - width) / slide + 1`` windows; plain arithmetic on the position, no shuffle.
    """
    last = (total - width) // slide
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - width + 1) / F.lit(float(slide))).cast("long"))
    upto = F.least(F.lit(last).cast("long"), F.floor(F.col(pos) / slide))
    return df.where(first <= upto).withColumn("window", F.explode(F.sequence(first, upto)))


def lagged_alarms(steps: DataFrame, groups: list[str], step: str, score: str, threshold: str) -> DataFrame:
    """Adds ``alarm``: the score exceeds the threshold of the step before (never at the first step)."""
    before = F.lag(threshold).over(Window.partitionBy(*groups).orderBy(step))
    return steps.withColumn("used_threshold", before).withColumn("alarm", F.coalesce(F.col(score) > before, F.lit(False)))


def alarm_summary(steps: DataFrame, groups: list[str], start: str, boundary: int, slide: int) -> DataFrame:
    """Per run: alarm at the boundary, alarms before and after it, and the delay of the first one from it on, in sub-windows."""
    at, alarm = F.col(start), F.col("alarm")
    first = F.min(F.when(alarm & (at >= boundary), at))
    return steps.groupBy(*groups).agg(
        F.bool_or(alarm & (at == boundary)).alias("boundary_hit"), F.count_if(alarm & (at < boundary)).alias("pre_alarms"), F.count_if(alarm & (at > boundary)).alias("later_alarms"),
        first.alias("first_post_start"), F.floor((first - boundary) / slide).alias("delay"), F.count_if(alarm).alias("total_alarms"), F.count("*").alias("n_steps"),
    )


def trimmed_max(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """The largest value strictly between two exact quantiles, and how many there are."""
    q = df.agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("q"))
    inner = df.crossJoin(F.broadcast(q)).where((F.col(value) > F.col("q")[0]) & (F.col(value) < F.col("q")[1]))
    return inner.agg(F.max(value).alias("threshold"), F.count("*").alias("n_inside"))


def latest_records(records: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last record of each key: what an append-only log means."""
    return records.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(sequence).desc()))).where("_rn = 1").drop("_rn")


def selected_kmeans(df: DataFrame, vector: str, key: str, ks=range(2, 11), sample: int = 2000, seeds: tuple[int, ...] = (1, 2, 3)):
    """(k, silhouettes by k, rows with cluster): the k of the best mean silhouette, the smaller on a tie.

    Silhouettes are Euclidean, over a sample of at most ``sample`` rows by key.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).cache()
    best, scores = None, []
    for k in ks:
        model = min((KMeans(k=k, seed=s, maxIter=50).fit(rows) for s in seeds), key=lambda m: m.summary.trainingCost)
        pdf = model.transform(rows).orderBy(key).limit(sample).select(vector, "prediction").toPandas()
        x, label = np.stack([np.asarray(v, float) for v in pdf[vector]]), pdf.prediction.to_numpy()
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
        groups = np.unique(label)
        mean = np.stack([d[:, label == g].sum(axis=1) for g in groups], axis=1)
        sizes = np.array([(label == g).sum() for g in groups])
        own = np.searchsorted(groups, label)
        a = mean[np.arange(len(x)), own] / np.maximum(sizes[own] - 1, 1)
        other = mean / sizes
        other[np.arange(len(x)), own] = np.inf
        b = other.min(axis=1)
        s = float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean()) if len(groups) > 1 else -1.0
        scores.append((k, s))
        if best is None or s > best[1] + 1e-12:
            best = (k, s, model)
    return best[0], scores, best[2].transform(rows).select(key, F.col("prediction").alias("cluster"))


def calibration_distances(spark, pool: np.ndarray, reference: np.ndarray, size: int, replicates: int, seed: int = 42) -> DataFrame:
    """``replicate, distance``: Fréchet distances of seeded windows of the pool from the reference, in parallel tasks.

    Every replicate has a seed of its own, so a resumed run needs only the missing ones.
    """
    shipped = spark.sparkContext.broadcast((pool, reference.mean(0), np.cov(reference.T)))

    def run(frames):
        x, m0, s0 = shipped.value
        values, axes = np.linalg.eigh(s0)
        half = (axes * np.sqrt(np.maximum(values, 0))) @ axes.T
        for f in frames:
            out = []
            for r in f.id:
                w = x[np.random.default_rng([seed, int(r)]).choice(len(x), size, replace=False)]
                s = np.cov(w.T)
                cross = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ s @ half), 0)).sum()
                out.append((int(r), float(np.linalg.norm(w.mean(0) - m0) + np.trace(s) + np.trace(s0) - 2 * cross)))
            yield pd.DataFrame(out, columns=["replicate", "distance"])

    return spark.range(0, replicates, 1, 8).mapInPandas(run, "replicate long, distance double")
