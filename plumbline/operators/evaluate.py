"""Evaluation: exact AUROC by ranks, cluster bootstrap, Spearman correlation, one-vs-rest logistic probes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import average_rank


def auroc(scores: DataFrame, groups: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """``*groups, n_pos, n_neg, auroc`` with ties counted half; null where only one class occurs.

    Weighted by ``weight`` (a multiplicity). Rows are first summed up by score, so the window runs
    over distinct scores: a positive of a score beats all negatives below and half of those equal.
    """
    from pyspark.sql import Window

    w = F.lit(1) if weight is None else weight
    s = scores.groupBy(*groups, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("_q"))
    below = F.sum("_q").over((Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_q")
    won = s.withColumn("_won", F.col("_p") * (below + F.col("_q") / 2))
    out = won.groupBy(*groups).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum("_won").alias("_won"))
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.select(*groups, "n_pos", "n_neg", F.when(both > 0, F.col("_won") / F.when(both > 0, both)).alias("auroc"))


def spearman(df: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Correlation of average ranks within groups."""
    ranked = average_rank(average_rank(df, a, groups, "_ra"), b, groups, "_rb")
    return ranked.groupBy(*groups).agg(F.corr("_ra", "_rb").alias("rho"))


#: Rows of an evaluation table that a bootstrap takes to the driver; more are an error.
MOST_ROWS = 5_000_000


def _evaluation(df: DataFrame, cluster: str, code: str, score: str, label: str) -> tuple:
    """The arrays of one cohort: cluster of each row, scores and labels, rows of each code by score, and how many clusters."""
    rows = df.select(cluster, code, score, label).limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"an evaluation table has at most {MOST_ROWS} rows")
    clusters, at = np.unique(rows[cluster], return_inverse=True)
    s, which = rows[score].to_numpy(float), np.unique(rows[code], return_inverse=True)[1]
    order = [p[np.argsort(s[p], kind="stable")] for p in (np.flatnonzero(which == c) for c in range(which.max() + 1))]
    return at, s, rows[label].to_numpy(int), order, len(clusters)


def _macro(cohort: tuple, rng: np.random.Generator) -> float | None:
    """Macro AUROC of one resample of clusters; none where a code has one class only."""
    at, s, y, order, n = cohort
    times = np.bincount(rng.integers(0, n, n), minlength=n)
    aucs = []
    for o in order:
        w, values = times[at[o]], s[o]
        p, q = w * (y[o] == 1), w * (y[o] == 0)
        if not p.sum() or not q.sum():
            return None
        g = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1
        pg, qg = np.bincount(g, p), np.bincount(g, q)
        aucs.append(float((pg * (np.cumsum(qg) - qg / 2)).sum() / (pg.sum() * qg.sum())))
    return float(np.mean(aucs))


def _resampled(cohorts: list[DataFrame], columns: tuple, replicates: int, seed: int, batch: int, most_factor: int) -> list[tuple]:
    spark = cohorts[0].sparkSession
    shipped = spark.sparkContext.broadcast([_evaluation(c, *columns) for c in cohorts])

    def run(frames):
        for f in frames:
            out = []
            for r in f.id:
                rng = np.random.default_rng([seed, int(r)])  # the cohorts draw from it one after the other
                aucs = [_macro(c, rng) for c in shipped.value]
                if None not in aucs:
                    out.append((int(r), aucs))
            yield pd.DataFrame(out, columns=["id", "aucs"])

    found: list = []
    start = 0
    while len(found) < replicates:
        if start >= most_factor * replicates:
            raise ValueError("too few valid resamples")
        size = max(batch, replicates - len(found))
        found += [tuple(r) for r in spark.range(start, start + size, 1, 8).mapInPandas(run, "id long, aucs array<double>").collect()]
        start += size
    return [aucs for _, aucs in sorted(found)[:replicates]]


def cluster_bootstrap(scores: DataFrame, cluster: str, code: str, score: str, label: str, replicates: int, seed: int = 42, batch: int = 64, most_factor: int = 100) -> DataFrame:
    """``replicate, macro_auc`` of ``replicates`` valid resamples of clusters with replacement.

    A resample in which any code has one class only is redrawn whole. Resamples are drawn from seeds
    of their own, in batches of parallel tasks over the evaluation table (``MOST_ROWS`` at most);
    more batches follow until enough are valid.
    """
    found = _resampled([scores], (cluster, code, score, label), replicates, seed, batch, most_factor)
    return scores.sparkSession.createDataFrame([(k, a) for k, (a,) in enumerate(found)], "replicate int, macro_auc double")


def paired_bootstrap(source: DataFrame, target: DataFrame, cluster: str, code: str, score: str, label: str, replicates: int, seed: int = 42, batch: int = 64, most_factor: int = 100) -> DataFrame:
    """``replicate, source_auc, target_auc, delta``: both cohorts are drawn jointly, and redrawn jointly where either isn't valid."""
    found = _resampled([source, target], (cluster, code, score, label), replicates, seed, batch, most_factor)
    return source.sparkSession.createDataFrame([(k, a, b, b - a) for k, (a, b) in enumerate(found)], "replicate int, source_auc double, target_auc double, delta double")


def tuned_probe(train: DataFrame, dev: DataFrame, vector: str, label: str, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), most_iterations: int = 200):
    """(best C, development AUROC by C, model): L2 logistic regression; the smaller C wins a tie; failure to converge is an error.

    ``regParam = 1 / (C n)``; features aren't standardised. Test data never enter.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def ready(df):
        return df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))

    a, b = ready(train).cache(), ready(dev)
    n, results, best = a.count(), [], None
    for c in sorted(grid):
        model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=most_iterations, tol=1e-8).fit(a)
        if model.summary.totalIterations >= most_iterations:
            raise ValueError(f"C={c} didn't converge")
        scored = model.transform(b).select(F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction")[1].alias("s"))
        auc = auroc(scored, [], "s", "y").first().auroc
        results.append((c, auc))
        if best is None or auc > best[1]:
            best = (c, auc, model)
    a.unpersist()
    return best[0], results, best[2]


def one_vs_rest(train: DataFrame, vector: str, code: str, codes: list, c: float = 1.0, most_iterations: int = 200) -> dict:
    """A logistic model for each code against the rest, by code; failure to converge is an error."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), code).cache()
    n, models = rows.count(), {}
    for x in codes:
        fitter = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=most_iterations, tol=1e-8)
        models[x] = fitter.fit(rows.select("features", (F.col(code) == x).cast("double").alias("label")))
        if models[x].summary.totalIterations >= most_iterations:
            raise ValueError(f"the model of {x} didn't converge")
    rows.unpersist()
    return models


def coefficient_table(spark, models: dict) -> DataFrame:
    """``label_index, code, intercept, pc_01, ...``: one row for each model."""
    rows = [(k, str(c), float(m.intercept), *map(float, m.coefficients)) for k, (c, m) in enumerate(models.items())]
    return spark.createDataFrame(rows, "label_index int, code string, intercept double, " + ", ".join(f"pc_{k:02d} double" for k in range(1, len(rows[0]) - 2)))
