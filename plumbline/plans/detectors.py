"""Detector queries over events, in the order of their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import detectors as op
from plumbline.operators import vectors
from plumbline.operators.sampling import sample_n
from plumbline.plans.base import query, table

WIDTH, SLIDE = 1000, 100
_WINDOWS = f"w AS (SELECT e.*, unnest(generate_series(greatest(0, ceil((event_id - {WIDTH} + 1) / {SLIDE}.0)::BIGINT), least((n - {WIDTH}) // {SLIDE}, event_id // {SLIDE}))) AS win FROM events e, (SELECT count(*) AS n FROM events) WHERE n >= {WIDTH})"
_STEPS = f"{_WINDOWS}, s AS (SELECT win, avg(value) AS score, avg(value) + 0.2 * stddev_pop(value) / sqrt(10) AS threshold FROM w GROUP BY 1), l AS (SELECT *, lag(threshold) OVER (ORDER BY win) AS used FROM s), a AS (SELECT *, coalesce(score > used, false) AS alarm, win * {SLIDE} AS start FROM l)"


def _windows(spark, d):
    events = table(spark, d, "events")
    return op.sliding_windows(events, "event_id", WIDTH, SLIDE, events.count())


def _steps(spark, d):
    s = _windows(spark, d).groupBy("window").agg(F.avg("value").alias("score"), (F.avg("value") + 0.2 * F.stddev_pop("value") / F.sqrt(F.lit(10.0))).alias("threshold"))
    rows = s.withColumn("run", F.lit(0))  # a run has one row for each step
    return op.lagged_alarms(rows, ["run"], "window", "score", "threshold").withColumn("start", F.col("window") * SLIDE)


@query(f"WITH {_WINDOWS} SELECT win AS window_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, round(avg(value), 6) AS mean FROM w GROUP BY 1")
def sliding_windows(spark, d):
    return _windows(spark, d).groupBy(F.col("window").alias("window_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {_STEPS} SELECT win AS window_id, round(score, 6) AS score, round(used, 6) AS used_threshold, alarm FROM a")
def lagged_threshold(spark, d):
    return _steps(spark, d).select(F.col("window").alias("window_id"), F.round("score", 6).alias("score"), F.round("used_threshold", 6).alias("used_threshold"), "alarm")


@query(f"WITH {_STEPS} SELECT bool_or(alarm AND start = 5000) AS boundary_hit, count(*) FILTER (alarm AND start < 5000) AS pre_alarms, count(*) FILTER (alarm AND start > 5000) AS later_alarms, min(start) FILTER (alarm AND start >= 5000) AS first_post_start, (min(start) FILTER (alarm AND start >= 5000) - 5000) // {SLIDE} AS delay, count(*) FILTER (alarm) AS total_alarms, count(*) AS n_steps FROM a")
def alarm_summary(spark, d):
    return op.alarm_summary(_steps(spark, d), ["run"], "start", 5000, SLIDE).drop("run")


@query("WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT max(value) AS threshold, count(*) AS n_inside FROM events, q WHERE value > lo AND value < hi")
def threshold_trim_max(spark, d):
    return op.trimmed_max(table(spark, d, "events"), "value")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_record_wins(spark, d):
    return op.latest_records(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("WITH r AS (SELECT user_id % 20 AS seed, bool_or(value > 80 AND event_id % 7 = 0) AS hit, count(*) FILTER (value > 95) AS alarms FROM events GROUP BY 1) SELECT count(*) AS n_runs, count(*) FILTER (hit) AS n_hits, sum(alarms)::BIGINT AS false_alarms, round(median(alarms), 6) AS median_alarms, round(quantile_cont(alarms, 0.25), 6) AS q1, round(quantile_cont(alarms, 0.75), 6) AS q3 FROM r")
def cross_seed_rollup(spark, d):
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("seed")).agg(F.bool_or((F.col("value") > 80) & (F.col("event_id") % 7 == 0)).alias("hit"), F.count_if(F.col("value") > 95).alias("alarms"))
    q = F.percentile("alarms", F.array(F.lit(0.25), F.lit(0.75)))
    out = runs.agg(F.count("*").alias("n_runs"), F.count_if("hit").alias("n_hits"), F.sum("alarms").alias("false_alarms"), F.round(F.median("alarms"), 6).alias("median_alarms"), q.alias("q"))
    return out.select("n_runs", "n_hits", "false_alarms", "median_alarms", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("q3"))


@query()
def kmeans_prototypes(spark, d):
    """Model selection by silhouette; iterative, so without a SQL form."""
    k, _, rows = op.selected_kmeans(table(spark, d, "embeddings"), "embedding", "vec_id", range(2, 11), seeds=(1,))
    return rows.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@query()
def calibrated_threshold(spark, d):
    """Windows of the baseline against itself give the threshold; then the target's percentile among them."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    # a seeded sample of the baseline is the pool, so that its size has a bound
    base = vectors.collected(sample_n(e.where("label < 5"), "vec_id", vectors.MOST_ROWS, 42), "v", "vec_id")
    target = vectors.frechet(e.where("label < 5"), e.where("label >= 5"), "v")["distance"]
    distances = op.calibration_distances(spark, base, base, max(10, min(1000, len(base) // 4)), 10_000).persist()
    below = distances.agg(F.round(100 * F.avg((F.col("distance") <= target).cast("double")), 4).alias("percentile"))
    return op.trimmed_max(distances, "distance").crossJoin(below).select(F.round("threshold", 6).alias("threshold"), "n_inside", "percentile")
