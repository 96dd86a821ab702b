"""Evaluation queries: documents' lengths as scores of the reviewers' labels, by language and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluate as op
from plumbline.plans.base import query, table

_ROWS = "r AS (SELECT d.doc_id, d.lang, d.source, d.n_chars AS s, l.quality AS y, l.toxic AS t FROM documents d JOIN labels l USING (doc_id))"


def _auc_sql(groups, y="y", where="true", w="1"):
    g = ", ".join(groups) + ", " if groups else ""
    on = " AND ".join(f"a.{x} = b.{x}" for x in groups) or "true"
    sel = ", ".join(f"a.{x}" for x in groups)
    return f"SELECT {sel + ', ' if sel else ''}sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END * a.w * b.w) / sum(a.w * b.w) AS auc FROM (SELECT *, {w} AS w FROM r WHERE {y} = 1 AND {where}) a JOIN (SELECT *, {w} AS w FROM r WHERE {y} = 0 AND {where}) b ON {on}" + (f" GROUP BY {sel}" if sel else "")


def _rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("s"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("t")), "doc_id")


@query(f"WITH {_ROWS}, u AS ({_auc_sql(['lang'])}), n AS (SELECT lang, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY 1) SELECT n.lang, n.p::BIGINT AS n_pos, n.q::BIGINT AS n_neg, round(u.auc, 6) AS auroc FROM n LEFT JOIN u USING (lang)")
def auroc_per_code(spark, d):
    return op.auroc(_rows(spark, d), ["lang"], "s", "y").withColumn("auroc", F.round("auroc", 6))


@query(f"WITH {_ROWS}, u AS ({_auc_sql(['lang'])}) SELECT round(avg(auc), 6) AS macro_auroc, count(auc) AS n_codes FROM u")
def macro_auroc(spark, d):
    return op.auroc(_rows(spark, d), ["lang"], "s", "y").agg(F.round(F.avg("auroc"), 6).alias("macro_auroc"), F.count("auroc").alias("n_codes"))


@query(f"WITH {_ROWS}, a AS ({_auc_sql(['lang'], where='doc_id % 2 = 0')}), b AS ({_auc_sql(['lang'], where='doc_id % 2 = 1')}) SELECT a.lang, round(a.auc, 6) AS source_auroc, round(b.auc, 6) AS target_auroc, round(b.auc - a.auc, 6) AS delta FROM a JOIN b USING (lang)")
def auc_delta(spark, d):
    both = op.auroc(_rows(spark, d).withColumn("side", F.col("doc_id") % 2), ["lang", "side"], "s", "y")
    out = both.groupBy("lang").agg(F.max(F.when(F.col("side") == 0, F.col("auroc"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("auroc"))).alias("b")).where("a is not null and b is not null")
    return out.select("lang", F.round("a", 6).alias("source_auroc"), F.round("b", 6).alias("target_auroc"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query(f"WITH {_ROWS}, reps AS (SELECT unnest(generate_series(0, 19))::INT AS rep), r2 AS (SELECT reps.rep, r.*, (doc_id * 7 + rep * 13) % 3 AS w FROM r, reps), g AS (SELECT rep, s, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM r2 GROUP BY 1, 2), c AS (SELECT *, sum(q) OVER (PARTITION BY rep ORDER BY s) - q AS below FROM g), a AS (SELECT rep, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) AS auc FROM c GROUP BY 1) SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, round(avg(auc), 6) AS mean, count(*) AS n FROM a")
def bootstrap_ci(spark, d):
    """Multiplicities are a formula of row and replicate here, so that SQL can draw the same resamples."""
    reps = spark.range(20).select(F.col("id").cast("int").alias("rep"))
    rows = _rows(spark, d).crossJoin(F.broadcast(reps))  # twenty rows
    auc = op.auroc(rows, ["rep"], "s", "y", (F.col("doc_id") * 7 + F.col("rep") * 13) % 3)
    return auc.agg(F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.round(F.avg("auroc"), 6).alias("mean"), F.count("auroc").alias("n")).select(F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"), "mean", "n")


@query()
def cluster_bootstrap(spark, d):
    """Seeded resamples of sources; SQL has no seeded draws of that kind."""
    b = op.cluster_bootstrap(_rows(spark, d).withColumn("code", F.lit("quality")), "source", "code", "s", "y", 200)
    return b.agg(F.count("*").alias("n"), F.percentile("macro_auc", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))


@query("WITH x AS (SELECT event_type, value, user_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS ra, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS rb FROM events) SELECT event_type, round(corr(ra, rb), 6) AS rho FROM x GROUP BY 1")
def spearman_scores(spark, d):
    return op.spearman(table(spark, d, "events").select("event_type", "value", "user_id"), "value", "user_id", ["event_type"]).withColumn("rho", F.round("rho", 6))


@query()
def logistic_tune(spark, d):
    """A probe of the embeddings for a label, tuned on a development split; compared by held-out AUROC only."""
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    _, results, _ = op.tuned_probe(e.where("vec_id % 5 < 3"), e.where("vec_id % 5 = 3"), "embedding", "y")
    return spark.createDataFrame([(float(c), round(float(a), 4)) for c, a in results], "c double, dev_auroc double")


@query()
def paired_bootstrap(spark, d):
    """Two cohorts drawn jointly by source; tests compare with a plain recomputation of each resample."""
    rows = _rows(spark, d).withColumn("code", F.lit("quality"))
    b = op.paired_bootstrap(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "source", "code", "s", "y", 200)
    ci = [F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{c}_ci") for c in ("source_auc", "target_auc", "delta")]
    return b.agg(F.count("*").alias("n"), *ci)


@query()
def probe_coefficients(spark, d):
    """One model for each of the ten labels; an iterative fit has no SQL form."""
    e = table(spark, d, "embeddings")
    codes = [r.label for r in e.select("label").distinct().orderBy("label").limit(100).collect()]
    return op.coefficient_table(spark, op.one_vs_rest(e.where("vec_id % 5 < 3"), "embedding", "label", codes, 0.1))
