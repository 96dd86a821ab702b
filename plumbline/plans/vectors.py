"""Vector queries over embeddings: labels 0-4 are the baseline, 5-9 the target."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import vectors as op
from plumbline.operators.sampling import sample_n
from plumbline.plans.base import query, table

SIGMA = 8.0
_D = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_E = "e AS (SELECT vec_id, label, label < 5 AS base, embedding::DOUBLE[] AS e FROM embeddings)"
_K = f"exp(-{_D} / (2 * {SIGMA} * {SIGMA}))"


def _sides(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("label < 5"), e.where("label >= 5")


def _row(spark, values, schema):
    return spark.createDataFrame([values], schema)


@query(f"WITH {_E} SELECT round(avg({_K}), 6) AS mean_kernel FROM e a, e b WHERE a.base AND NOT b.base")
def rbf_mean(spark, d):
    base, target = _sides(spark, d)
    sums = op.kernel_means(base, "vec_id", "embedding", {"k": target}, SIGMA)
    return sums.agg(F.round(F.try_divide(F.avg("k"), F.lit(target.count())), 6).alias("mean_kernel"))


@query(f"WITH {_E}, k AS (SELECT a.base AS x, b.base AS y, avg({_K}) AS m FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2) SELECT round(max(m) FILTER (x AND y) + max(m) FILTER (NOT x AND NOT y) - 2 * max(m) FILTER (x AND NOT y), 6) AS mmd2 FROM k")
def mmd2_unbiased(spark, d):
    base, target = _sides(spark, d)
    return _row(spark, (round(op.mmd2(base, target, "vec_id", "embedding", SIGMA), 6),), "mmd2 double")


@query(f"WITH {_E}, s AS (SELECT * FROM e ORDER BY vec_id LIMIT 300) SELECT round(sqrt(median({_D}) / 2), 6) AS sigma FROM s a, s b WHERE a.vec_id < b.vec_id")
def median_sigma(spark, d):
    sample = op.collected(table(spark, d, "embeddings").orderBy("vec_id").limit(300), "embedding", "vec_id")
    return _row(spark, (round(op.median_sigma(sample), 6),), "sigma double")


@query(f"WITH {_E} SELECT a.vec_id, round(avg({_K}) FILTER (NOT b.base) - avg({_K}) FILTER (b.base), 6) AS witness FROM e a, e b GROUP BY 1")
def witness_scores(spark, d):
    base, target = _sides(spark, d)
    samples = {"t": target, "b": base}
    sums = op.kernel_means(table(spark, d, "embeddings"), "vec_id", "embedding", samples, SIGMA)
    # a vec_id given twice has one score, the mean over its pairs; no rows, no mean
    t, b = (F.try_divide(F.avg(c), F.lit(n)) for c, n in (("t", target.count()), ("b", base.count())))
    return sums.groupBy("vec_id").agg(F.round(t - b, 6).alias("witness"))


@query(f"WITH {_E}, m AS (SELECT x AS f, g.mult, 0 AS z FROM (VALUES (1)) v(x), (VALUES (0.5), (1.0), (2.0)) g(mult)), k AS (SELECT mult, a.base AS x, b.base AS y, avg(exp(-{_D} / (2 * {SIGMA} * {SIGMA} * mult * mult))) AS k FROM e a, e b, m WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3) SELECT mult::DOUBLE AS multiplier, round(max(k) FILTER (x AND y) + max(k) FILTER (NOT x AND NOT y) - 2 * max(k) FILTER (x AND NOT y), 6) AS mmd2 FROM k GROUP BY 1")
def sensitivity_bandwidth(spark, d):
    base, target = _sides(spark, d)
    multipliers = (0.5, 1.0, 2.0)
    found = op.mmd2_grid([base], target, "vec_id", "embedding", [SIGMA * m for m in multipliers])[0]
    return spark.createDataFrame([(m, round(v, 6)) for m, v in zip(multipliers, found, strict=True)], "multiplier double, mmd2 double")


@query("SELECT count(*) AS n, 0::BIGINT AS n_nonfinite, count(*) FILTER (list_max(list_transform(embedding, lambda x: abs(x))) = 0) AS n_zero, max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS max_abs FROM embeddings")
def embedding_inspection(spark, d):
    return op.inspection(table(spark, d, "embeddings"), "embedding")


_CENTROID = "c AS (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM e) GROUP BY 1, 2), cent AS (SELECT label, list(m ORDER BY d) AS m FROM c GROUP BY 1), dist AS (SELECT e.vec_id, e.label, sqrt(list_sum(list_transform(list_zip(e.e, cent.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM e JOIN cent USING (label))"


@query(f"WITH {_E}, {_CENTROID} SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9), vec_id)::INT AS prototype_rank, round(dist, 6) AS distance FROM dist QUALIFY prototype_rank <= 4")
def prototypes_per_cluster(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    means = op.mean_vectors(e, "embedding", ["label"])  # a vector for each cluster
    rows = e.join(F.broadcast(means), "label").select("label", "vec_id", F.sqrt(op.squared_distance(F.col("embedding"), F.col("mean"))).alias("dist"))
    w = Window.partitionBy("label").orderBy(F.round("dist", 9), "vec_id")
    return rows.withColumn("prototype_rank", F.row_number().over(w)).where("prototype_rank <= 4").select("label", "vec_id", "prototype_rank", F.round("dist", 6).alias("distance"))


@query(f"WITH {_E}, c AS (SELECT d, avg(x) AS m FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS d FROM e WHERE base) GROUP BY 1), cent AS (SELECT list(m ORDER BY d) AS m FROM c) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(e.e, cent.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM e, cent WHERE base ORDER BY distance, vec_id LIMIT 3")
def exemplars_by_centroid(spark, d):
    base, _ = _sides(spark, d)
    mean = op.mean_vectors(base, "embedding", [])
    rows = base.crossJoin(F.broadcast(mean)).select("vec_id", F.round(F.sqrt(op.squared_distance(F.col("embedding"), F.col("mean"))), 6).alias("distance"))
    return rows.orderBy("distance", "vec_id").limit(3)


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE 0 END) AS v, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT sqrt(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS delta FROM n) SELECT count(*) AS n, count(*) FILTER (delta > 1e-9) AS n_changed, round(median(delta), 6) AS median_delta, round(avg(delta), 6) AS mean_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta FROM x")
def replacement_diagnostics(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "embedding")
    new = old.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.when(F.col("vec_id") % 4 == 0, 0.5).otherwise(0.0)).alias("v"))
    delta = old.join(new, "vec_id").select(F.sqrt(op.squared_distance(F.col("embedding"), F.col("v"))).alias("x"))
    return delta.agg(F.count("*").alias("n"), F.count_if(F.col("x") > 1e-9).alias("n_changed"), *[F.round(f("x"), 6).alias(f"{n}_delta") for n, f in (("median", F.median), ("mean", F.avg), ("min", F.min), ("max", F.max))])


@query()
def pca_explained(spark, d):
    """Cumulative variance of the baseline's components; SQL has no eigenvalues."""
    pca = op.fitted_pca(_sides(spark, d)[0], "embedding")
    total = np.cumsum(pca["ratio"])
    return spark.createDataFrame([(k + 1, round(float(r), 6), round(float(c), 6), bool(k < int(pca["k"]))) for k, (r, c) in enumerate(zip(pca["ratio"], total, strict=True))], "component int, ratio double, cumulative double, kept boolean")


@query()
def permutation_test(spark, d):
    base, target = _sides(spark, d)
    x, y = (op.collected(sample_n(s, "vec_id", 1000, 42), "embedding", "vec_id") for s in (base, target))
    r = op.permutation_test(x, y, SIGMA, spark, replicates=200)
    return _row(spark, (round(r["mmd2"], 6), r["p_value"], round(r["threshold"], 6), r["drift"]), "mmd2 double, p_value double, threshold double, drift boolean")


@query()
def projected_drift(spark, d):
    """The statistic on PCA coordinates, with the bandwidth from the pooled median."""
    base, target = _sides(spark, d)
    pca = op.fitted_pca(base, "embedding")
    x, y = (op.projected(s, "embedding", pca).select("vec_id", "projected") for s in (base, target))
    sigma = op.median_sigma(np.concatenate([op.collected(sample_n(s, "vec_id", 250, 42), "projected", "vec_id") for s in (x, y)]))
    return _row(spark, (int(pca["k"]), round(sigma, 6), round(op.mmd2(x, y, "vec_id", "projected", sigma), 6)), "k int, sigma double, mmd2 double")


@query()
def frechet_terms(spark, d):
    r = op.frechet(*_sides(spark, d), "embedding")
    return _row(spark, tuple(round(r[k], 6) for k in ("mean_term", "trace_term", "distance")), "mean_term double, trace_term double, distance double")
