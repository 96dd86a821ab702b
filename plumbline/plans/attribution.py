"""Attribution queries: a user's first six events are the votes of a record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import attribution as op
from plumbline.plans.base import query, table

CATEGORIES = ("Structural", "Clinical", "Administrative")
_VOTES = """e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run_no FROM events),
v AS (SELECT user_id, run_no, nullif(['Structural', 'Clinical', 'Administrative', 'invalid'][(CASE WHEN event_id % 29 = 0 THEN 4 ELSE 1 + event_id % 3 END)::INT], 'invalid') AS category, CASE WHEN value > 66 THEN 'High' WHEN value > 33 THEN 'Medium' ELSE 'Low' END AS confidence FROM e WHERE run_no < 6)"""
_RESOLVED = _VOTES + """, c AS (SELECT user_id, category, count(*) AS n, CASE category WHEN 'Structural' THEN 0 WHEN 'Clinical' THEN 1 ELSE 2 END AS o FROM v WHERE run_no > 0 AND category IS NOT NULL GROUP BY 1, 2),
w AS (SELECT user_id, category AS cat, n AS top FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) = 1),
s AS (SELECT c.user_id, sum(n) AS valid, count(*) FILTER (n = top) AS modes FROM c JOIN w USING (user_id) GROUP BY 1),
b AS (SELECT v.user_id, v.confidence AS conf FROM v JOIN w ON w.user_id = v.user_id AND w.cat = v.category WHERE run_no > 0 QUALIFY row_number() OVER (PARTITION BY v.user_id ORDER BY CASE v.confidence WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, run_no) = 1),
d AS (SELECT user_id, category AS det FROM v WHERE run_no = 0),
r AS (SELECT u.user_id, CASE WHEN valid >= 5 THEN cat END AS category, CASE WHEN valid >= 5 THEN conf END AS confidence, CASE WHEN valid >= 5 THEN round(top / 5, 3) END AS consistency_rate, coalesce(valid, 0)::BIGINT AS n_valid_runs, det AS deterministic_category, CASE WHEN valid >= 5 THEN det = cat END AS stable, CASE WHEN valid >= 5 THEN CASE WHEN modes = 1 THEN 'unique_modal' ELSE 'stochastic_tie_break' END ELSE '' END AS resolution
FROM (SELECT DISTINCT user_id FROM v) u LEFT JOIN w USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN d USING (user_id))"""


def _votes(spark, d):
    run = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    k = F.col("event_id")
    category = F.when(k % 29 == 0, None).when(k % 3 == 0, CATEGORIES[0]).when(k % 3 == 1, CATEGORIES[1]).otherwise(CATEGORIES[2])
    confidence = F.when(F.col("value") > 66, "High").when(F.col("value") > 33, "Medium").otherwise("Low")
    return table(spark, d, "events").withColumn("run_no", run).where("run_no < 6").select("user_id", "run_no", category.alias("category"), confidence.alias("confidence"))


@query(f"WITH {_RESOLVED} SELECT * FROM r")
def vote_resolution(spark, d):
    return op.resolved(_votes(spark, d), "user_id", CATEGORIES)


@query(f"WITH {_RESOLVED} SELECT user_id % 4 AS grp, count(*) FILTER (category = 'Structural') AS Structural, count(*) FILTER (category = 'Clinical') AS Clinical, count(*) FILTER (category = 'Administrative') AS Administrative FROM r WHERE category IS NOT NULL GROUP BY 1")
def vote_crosstab(spark, d):
    rows = op.resolved(_votes(spark, d), "user_id", CATEGORIES).where("category is not null").withColumn("grp", F.col("user_id") % 4)
    return op.crosstab(rows, "grp", "category", CATEGORIES)


@query(f"WITH {_RESOLVED} SELECT count(*) FILTER (stable) AS n_stable, count(*) FILTER (NOT stable) AS n_unstable, count(*) FILTER (stable IS NULL) AS n_indeterminate, round(avg(consistency_rate), 6) AS mean_consistency, min(consistency_rate) AS min_consistency, max(consistency_rate) AS max_consistency FROM r")
def attribution_summary(spark, d):
    r = op.resolved(_votes(spark, d), "user_id", CATEGORIES)
    return r.agg(F.count_if("stable").alias("n_stable"), F.count_if(~F.col("stable")).alias("n_unstable"), F.count_if(F.col("stable").isNull()).alias("n_indeterminate"), F.round(F.avg("consistency_rate"), 6).alias("mean_consistency"), F.min("consistency_rate").alias("min_consistency"), F.max("consistency_rate").alias("max_consistency"))


_RAW_SQL = """CASE doc_id % 7 WHEN 0 THEN '{"category": "Structural", "confidence": "High", "reasoning": "r' || doc_id || '", "secondary_evidence": "s"}'
WHEN 1 THEN E'```json\n{"category": "Clinical", "confidence": "Low", "reasoning": "r"}\n```' WHEN 2 THEN 'Sure. {"category": "Administrative", "confidence": "Medium", "reasoning": "r", "secondary_evidence": "x"} Done.'
WHEN 3 THEN '<think>{"category": "Clinical"}</think>{"category": "Structural", "confidence": "High", "reasoning": "t", "secondary_evidence": "none"}' WHEN 4 THEN '{"category": "Unknown", "confidence": "High", "reasoning": "r"}' WHEN 5 THEN '{"category": "Structural", "confidence"' ELSE '' END"""


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Structural' WHEN 1 THEN 'Clinical' WHEN 2 THEN 'Administrative' WHEN 3 THEN 'Structural' END AS category, CASE doc_id % 7 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' END AS confidence, CASE doc_id % 7 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 'r' WHEN 2 THEN 'r' WHEN 3 THEN 't' END AS reasoning, CASE doc_id % 7 WHEN 0 THEN 's' WHEN 1 THEN 'none' WHEN 2 THEN 'x' WHEN 3 THEN 'none' END AS secondary_evidence FROM documents")
def parse_judge_json(spark, d):
    raw = F.expr(_RAW_SQL.replace("E'", "'"))
    p = op.parsed_answer(raw, CATEGORIES)
    return table(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.category", "p.confidence", "p.reasoning", "p.secondary_evidence")


@query("SELECT doc_id::VARCHAR AS record_id, lang AS \"group\", sha256(text) AS sha FROM documents")
def blinded_input(spark, d):
    return op.blinded(table(spark, d, "documents"), "doc_id", "lang", "text").select("record_id", "group", F.sha2("note_text", 256).alias("sha"))
