"""Ranking and selection queries over events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import ranking as op
from plumbline.plans.base import query, table


@query("SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events")
def rank_by_score(spark, d):
    return op.ranked_by_score(table(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def top_per_group(spark, d):
    return op.ranked_by_score(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "event_id", ["event_type"]).where("rank <= 5").drop("value")


@query("""WITH t AS (SELECT event_id, value, 'top' AS selection FROM events ORDER BY value DESC, event_id LIMIT 50),
b AS (SELECT event_id, value, 'bottom' AS selection FROM events WHERE event_id NOT IN (SELECT event_id FROM t) ORDER BY value, event_id LIMIT 50),
r AS (SELECT event_id, value, 'random' AS selection FROM events WHERE event_id NOT IN (SELECT event_id FROM t UNION ALL SELECT event_id FROM b) ORDER BY md5('42:' || event_id), event_id LIMIT 50)
SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM r""")
def stratified_selection(spark, d):
    draw = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")))
    return op.stratified(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 50, draw)


@query("""WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS ra, row_number() OVER (PARTITION BY event_type ORDER BY value * (1 + (event_id % 5) / 10) DESC, event_id) AS rb FROM events)
SELECT event_type, round(median(abs(ra - rb)), 6) AS median_shift, round(avg(abs(ra - rb)), 6) AS mean_shift, round(quantile_cont(abs(ra - rb), 0.9), 6) AS p90_shift, max(abs(ra - rb)) AS max_shift, count(*) FILTER (ra <= 50 AND rb <= 50) AS kept_top_50 FROM a GROUP BY 1""")
def rank_shift(spark, d):
    w = Window.partitionBy("event_type")
    other = F.col("value") * (1 + (F.col("event_id") % 5) / 10)
    rows = table(spark, d, "events").withColumn("ra", F.row_number().over(w.orderBy(F.col("value").desc(), "event_id"))).withColumn("rb", F.row_number().over(w.orderBy(other.desc(), F.col("event_id"))))
    shift = F.abs(F.col("ra") - F.col("rb"))
    return rows.groupBy("event_type").agg(F.round(F.median(shift), 6).alias("median_shift"), F.round(F.avg(shift), 6).alias("mean_shift"), F.round(F.percentile(shift, F.lit(0.9)), 6).alias("p90_shift"), F.max(shift).alias("max_shift"), F.count_if((F.col("ra") <= 50) & (F.col("rb") <= 50)).alias("kept_top_50"))


@query("SELECT c.event_id, c.new_score, 1 + (SELECT count(*) FROM events e WHERE e.event_id <> c.event_id AND (e.value > c.new_score OR (e.value = c.new_score AND e.event_id < c.event_id))) AS new_rank FROM (SELECT event_id, value + 1 AS new_score FROM events ORDER BY event_id LIMIT 20) c")
def counterfactual_rank(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    changed = events.orderBy("event_id").limit(20).select("event_id", (F.col("value") + 1).alias("new_score"))
    return op.counterfactual_rank(events, "value", "event_id", changed)


@query("SELECT p.event_id, p.value AS probe, round(100 * avg((e.value <= p.value)::INT), 6) AS percentile FROM (SELECT event_id, value FROM events ORDER BY event_id LIMIT 10) p CROSS JOIN events e GROUP BY 1, 2")
def empirical_percentile(spark, d):
    events = table(spark, d, "events")
    probes = events.orderBy("event_id").limit(10).select("event_id", F.col("value").alias("probe"))
    return op.empirical_percentile(events, "value", probes, "probe")


@query("WITH s AS (SELECT event_id, round(value, 2) AS v FROM events), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, event_id) AS rank FROM s) SELECT a.rank AS boundary, a.v AS upper, b.v AS lower, a.v = b.v AS tied FROM r a JOIN r b ON b.rank = a.rank + 1 WHERE a.rank IN (50, 2450)")
def rank_boundary_ties(spark, d):
    ranked = op.ranked_by_score(table(spark, d, "events").select("event_id", F.round("value", 2).alias("v")), "v", "event_id").where("rank in (50, 51, 2450, 2451)")
    pairs = ranked.withColumn("boundary", F.when(F.col("rank") <= 51, 50).otherwise(2450).cast("long"))
    out = pairs.groupBy("boundary").agg(F.min_by("v", "rank").alias("upper"), F.max_by("v", "rank").alias("lower"), F.count("*").alias("n")).where("n = 2")
    return out.select("boundary", "upper", "lower", (F.col("upper") == F.col("lower")).alias("tied"))


@query("SELECT event_id, value FROM events, (SELECT median(value) AS m FROM events) ORDER BY abs(value - m), event_id LIMIT 5")
def nearest_to_median(spark, d):
    return op.nearest_to_median(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 5)


@query("""WITH p AS (SELECT event_id, value / 100 AS ratio FROM events), pool AS (SELECT * FROM p WHERE ratio >= 0.8 OR (SELECT count(*) FILTER (ratio >= 0.8) FROM p) = 0)
SELECT event_id, ratio, 'lowest' AS pick FROM (SELECT * FROM p ORDER BY ratio, event_id LIMIT 5)
UNION ALL SELECT event_id, ratio, 'middle' FROM (SELECT p.* FROM p, (SELECT median(ratio) AS m FROM p) ORDER BY abs(ratio - m), event_id LIMIT 5)
UNION ALL SELECT event_id, ratio, 'highest' FROM (SELECT * FROM pool ORDER BY ratio DESC, event_id LIMIT 10)""")
def review_selection(spark, d):
    p = table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("ratio"))
    # the pool of the highest falls back to all rows if none reaches 0.8
    high = p.crossJoin(F.broadcast(p.agg(F.count_if(F.col("ratio") >= 0.8).alias("n_high")))).where("ratio >= 0.8 or n_high = 0").drop("n_high")
    picks = [(p.orderBy("ratio", "event_id").limit(5), "lowest"), (op.nearest_to_median(p, "ratio", "event_id", 5), "middle"), (high.orderBy(F.col("ratio").desc(), "event_id").limit(10), "highest")]
    first, *rest = [x.withColumn("pick", F.lit(name)) for x, name in picks]
    for x in rest:
        first = first.unionByName(x)
    return first.dropDuplicates(["event_id", "pick"])


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) AS rn FROM events) SELECT user_id, event_id FROM e WHERE rn <= 3")
def per_group_cap(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string"))), F.col("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_id")


@query("WITH s AS (SELECT k, sum(n) OVER (ORDER BY k DESC) AS at_least, sum(n) OVER (ORDER BY k) AS at_most FROM (SELECT floor(value / 10)::INT AS k, count(*) AS n FROM events GROUP BY 1)) SELECT k, at_least, at_most FROM s")
def survival_counts(spark, d):
    counts = table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).cast("int").alias("k")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("k")  # one row for each bin, not for each event
    return counts.select("k", F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("at_least"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("at_most"))
