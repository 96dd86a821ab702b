"""Experiment, contract, calibration and streaming-window queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import calibration
from plumbline.functions import text as tx
from plumbline.operators import contracts
from plumbline.operators import experiments as op
from plumbline.plans.base import query, table
from plumbline.streaming.windows import windowed_drift



@query("WITH RECURSIVE p(k, v) AS (SELECT 0, pow(0.5, 200)::DOUBLE UNION ALL SELECT k + 1, v * (200 - k) / (k + 1) FROM p WHERE k < 200), t AS (SELECT d, (SELECT sum(v) FROM p WHERE k >= 100 + d) AS tail FROM range(1, 101) r(d)) SELECT d::INT AS threshold, round(tail, 9) AS probability FROM t WHERE tail < 0.05 ORDER BY d LIMIT 1")
def alarm_threshold(spark, d):
    n, p = calibration.alarm_threshold()
    return spark.createDataFrame([(n, round(float(p), 9))], "threshold int, probability double")


@query("WITH RECURSIVE g AS (SELECT i / 100.0::DOUBLE AS p FROM range(0, 101) r(i)), b(p, k, v) AS (SELECT p, 0, pow(1 - p, 100)::DOUBLE FROM g WHERE p < 1 UNION ALL SELECT p, k + 1, v * (100 - k) / (k + 1) * p / (1 - p) FROM b WHERE k < 100), pmf AS (SELECT * FROM b UNION ALL SELECT 1.0::DOUBLE, k, CASE WHEN k = 100 THEN 1 ELSE 0 END FROM range(0, 101) r(k)), s AS (SELECT p, k, sum(v) OVER (PARTITION BY p ORDER BY k DESC) AS above FROM pmf), t AS (SELECT a.p AS p_pos, c.p AS p_neg, sum(c.v * a.above) AS tail FROM pmf c JOIN s a ON a.k = c.k + 13 AND c.p >= a.p GROUP BY 1, 2) SELECT (SELECT count(*) FROM g x, g y WHERE y.p >= x.p) AS n_points, round(max(tail), 9) AS max_probability, count(*) FILTER (tail >= 0.05) AS n_at_or_above FROM t")
def null_grid(spark, d):
    """The directional null (p_neg >= p_pos) on a grid of 101 x 101 points, n = 100 an arm: one arm's pmf joined with the other's survival."""
    n, steps = 100, 100
    threshold = calibration.alarm_threshold(n)[0]
    pmf = spark.createDataFrame([(i / steps, k, v) for i in range(steps + 1) for k, v in enumerate(calibration.binomial_pmf(n, i / steps))], "p double, k int, v double")
    above = pmf.withColumn("above", F.sum("v").over(Window.partitionBy("p").orderBy(F.col("k").desc())))
    a, b = above.select(F.col("p").alias("p_pos"), (F.col("k") - threshold).alias("k"), "above"), pmf.toDF("p_neg", "k", "v")  # 10,201 fixed rows each
    tails = b.join(F.broadcast(a), "k").where("p_neg >= p_pos").groupBy("p_pos", "p_neg").agg(F.sum(F.col("v") * F.col("above")).alias("tail"))
    return tails.agg(F.lit((steps + 1) * (steps + 2) // 2).cast("long").alias("n_points"), F.round(F.max("tail"), 9).alias("max_probability"), F.count_if(F.col("tail") >= 0.05).alias("n_at_or_above"))


@query("WITH a AS (SELECT user_id, event_id AS chosen FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), b AS (SELECT user_id, event_id AS chosen FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 0 ELSE 1 END, event_id DESC) = 1) SELECT count(*) AS n, count(*) FILTER (a.chosen <> b.chosen) AS n_changed, round(100.0 * count(*) FILTER (a.chosen <> b.chosen) / count(*), 6) AS pct_changed FROM a JOIN b USING (user_id)")
def selection_exposure(spark, d):
    events = table(spark, d, "events")
    first_type = events.agg(F.min("event_type").alias("t0"))
    rows = events.crossJoin(F.broadcast(first_type))
    # both choices of a key come from one aggregate
    both = rows.groupBy("user_id").agg(F.max("event_id").alias("a"), F.coalesce(F.max(F.when(F.col("event_type") == F.col("t0"), F.col("event_id"))), F.max("event_id")).alias("b"))
    changed = F.count_if(F.col("a") != F.col("b"))
    return both.agg(F.count("*").alias("n"), changed.alias("n_changed"), F.round(100.0 * changed / F.count("*"), 6).alias("pct_changed"))


@query("WITH w AS (SELECT lang, doc_id % 2 AS half, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), c AS (SELECT lang, half, word, count(*) AS n FROM w GROUP BY 1, 2, 3), v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, half ORDER BY n DESC, word) <= 200), s AS (SELECT lang, count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b FROM v GROUP BY 1), i AS (SELECT lang, count(*) AS n FROM (SELECT lang, word FROM v GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1) SELECT lang, round(coalesce(i.n, 0) / (a + b - coalesce(i.n, 0)), 6) AS jaccard FROM s LEFT JOIN i USING (lang)")
def jaccard_propagation(spark, d):
    from pyspark.sql import Window

    counts = table(spark, d, "documents").select("lang", (F.col("doc_id") % 2).alias("half"), F.explode(tx.words(F.col("text"))).alias("word")).groupBy("lang", "half", "word").agg(F.count("*").alias("n"))
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("lang", "half").orderBy(F.col("n").desc(), "word"))).where("rn <= 200")
    sets = top.groupBy("lang").agg(F.collect_set(F.when(F.col("half") == 0, F.col("word"))).alias("a"), F.collect_set(F.when(F.col("half") == 1, F.col("word"))).alias("b"))
    return sets.select("lang", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("SELECT a.doc_id, abs(a.n_chars - b.n_chars) <= 1e-6 + 1e-5 * abs(b.n_chars) AS close FROM documents a JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 9 = 0 THEN 5 ELSE 0 END AS n_chars FROM documents) b USING (doc_id) WHERE abs(a.n_chars - b.n_chars) > 1e-6 + 1e-5 * abs(b.n_chars)")
def tolerance_gate(spark, d):
    a = table(spark, d, "documents").select("doc_id", "n_chars")
    b = a.withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 9 == 0, 5).otherwise(0))
    return contracts.same_within(a, b, ["doc_id"], ["n_chars"], 1e-6, 1e-5).withColumn("close", F.lit(False))


@query("SELECT g.lang, g.source FROM (SELECT * FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)) g WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = g.lang AND d.source = g.source AND l.toxic = 1)")
def grid_completeness(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    grid = docs.select("lang").distinct().crossJoin(docs.select("source").distinct())
    return contracts.missing_cells(grid, docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id"), ["lang", "source"])


@query("WITH s AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM documents), o AS (SELECT count(*) AS id_overlap FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)), u AS (SELECT count(*) AS subject_overlap FROM (SELECT source FROM s WHERE source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)), c AS (SELECT count(*) FILTER (lo = hi) AS undefined FROM (SELECT lang, split, min(toxic) AS lo, max(toxic) AS hi FROM s JOIN labels USING (doc_id) GROUP BY 1, 2)) SELECT n, id_overlap, subject_overlap, undefined, CASE WHEN id_overlap + subject_overlap + undefined = 0 THEN 'GO' ELSE 'REVIEW REQUIRED' END AS status FROM (SELECT count(*) AS n FROM documents), o, u, c")
def contract_report(spark, d):
    """The advisory gate: ids or subjects (here sources) in both splits, and codes (here languages) whose AUROC is undefined in a split."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test").alias("split"))

    def shared(key):
        return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias(f"{key}_overlap"))

    cells = docs.join(table(spark, d, "labels"), "doc_id").groupBy("lang", "split").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    undefined = cells.agg(F.count_if(F.col("lo") == F.col("hi")).alias("undefined"))
    row = docs.agg(F.count("*").alias("n"))
    for one in (shared("doc_id"), shared("source"), undefined):
        row = row.crossJoin(F.broadcast(one))  # one row each
    row = row.withColumnsRenamed({"doc_id_overlap": "id_overlap", "source_overlap": "subject_overlap"})
    return row.withColumn("status", contracts.gate_status(F.col("id_overlap") + F.col("subject_overlap"), F.col("undefined")))


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY time_bucket(INTERVAL '6 hours', ts), event_type")
def windowed_drift_batch(spark, d):
    w = windowed_drift(table(spark, d, "events"), "ts", ["event_type"], "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


#: Donor reports that are drawn, the operator's own limit.
DONOR_LIMIT = 6000


@query()
def replacement_variants(spark, d):
    """Seeded greedy replacement of host bodies by donor chunks."""
    from plumbline.operators.sampling import sample_n

    docs = table(spark, d, "documents").where("text is not null")
    hosts = sample_n(docs, "doc_id", 20, 42).select(F.col("doc_id").alias("host"), F.col("source").alias("subject"), F.lit(400).alias("target"))
    reports = sample_n(docs, "doc_id", DONOR_LIMIT, 43).select(F.col("doc_id").alias("donor"), F.col("source").alias("subject"), F.concat(F.lit("FINDINGS: "), "text", F.lit(" IMPRESSION: none")).alias("report"))
    donors = op.donor_chunks(reports, "report").where("chunk is not null").drop("report")
    return op.replacement_bodies(hosts, donors, "host", "target").select("host", "n_chunks", "length", "complete", F.sha2("body", 256).alias("body_sha"))


@query("""WITH e AS (SELECT event_type AS cohort, event_id, user_id, -value AS v, md5('42:' || event_id) AS r, event_id % 3 <> 0 AS ok FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY v, event_id) AS pv, row_number() OVER (PARTITION BY cohort ORDER BY r, event_id) AS pr FROM e),
b AS (SELECT * FROM o WHERE ok QUALIFY row_number() OVER (PARTITION BY cohort, user_id ORDER BY pv) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY pv) AS k FROM b QUALIFY k <= 10),
c AS (SELECT * FROM o WHERE ok AND NOT EXISTS (SELECT 1 FROM t WHERE t.cohort = o.cohort AND t.user_id = o.user_id) QUALIFY row_number() OVER (PARTITION BY cohort, user_id ORDER BY pr) = 1), u AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY pr) AS k FROM c QUALIFY k <= 10)
SELECT cohort, event_id, user_id, 'top' AS arm, k AS selection_order, pv - k AS passed_over FROM t UNION ALL SELECT cohort, event_id, user_id, 'random', k, pr - k FROM u""")
def greedy_hosts(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("cohort"), "event_id", "user_id", "value", (F.col("event_id") % 3 != 0).alias("eligible"))
    return op.greedy_hosts(events, "cohort", "user_id", "value", "event_id", "eligible", 10)


@query()
def hashed_embeddings(spark, d):
    """Windows, encoder, mean pooling; the encoder is a deterministic stand-in."""
    rows = table(spark, d, "documents").select("doc_id", tx.token_windows(tx.whitespace_tokens(F.col("text"))).alias("w"))
    return op.embedded(rows, "doc_id", "w", op.HashingEncoder(32))
