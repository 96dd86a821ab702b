"""Cohort queries over orders, customers, nations and regions.

Orders stand for dated records of a key (the customer), an order that is finished ('F') for the
outcome flag, and regions for groups.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import stripped
from plumbline.operators import cohort as op
from plumbline.plans.base import query, table

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _day():
    return F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")


def _placed(spark, d):
    """Orders with customer, nation and region: the four-way inner join."""
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


_PLACED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _order():
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


@query(f"SELECT o_custkey, o_orderkey, {_DAY} AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus <> 'O') WHERE rn = 1")
def latest_per_key(spark, d):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return op.latest_per_key(table(spark, d, "orders"), ["o_custkey"], _order(), eligible=status.isNull() | (status != "O")).select("o_custkey", "o_orderkey", _day())


@query(f"SELECT o_custkey, o_orderkey, o_orderpriority, {_DAY} AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_preferred_per_key(spark, d):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return op.latest_per_key(table(spark, d, "orders"), ["o_custkey"], _order(), priority=urgent).select("o_custkey", "o_orderkey", "o_orderpriority", _day())


@query(f"SELECT o_custkey, o_orderkey, {_DAY} AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderpriority = '1-URGENT') WHERE rn = 1")
def latest_filtered_per_key(spark, d):
    return op.latest_per_key(table(spark, d, "orders"), ["o_custkey"], _order(), eligible=F.col("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderkey", _day())


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND p IS NOT NULL")
def latest_null_after(spark, d):
    rows = table(spark, d, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return op.latest_per_key(rows, ["o_custkey"], _order(), required="p", null_policy="after").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, rn_all, rn_flagged FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn_all, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) END AS rn_flagged FROM orders) WHERE rn_all = 1 OR rn_flagged = 1")
def concurrent_rankings(spark, d):
    ranked = op.concurrent_rankings(table(spark, d, "orders"), ["o_custkey"], _order(), F.col("o_orderstatus") == "F")
    return ranked.where("rn_all = 1 or rn_flagged = 1").select("o_custkey", "o_orderkey", "rn_all", "rn_flagged")


@query(f"SELECT o_custkey, o_orderkey, {_DAY} AS day FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_orderdate")
def group_max_keep_ties(spark, d):
    return op.group_max_keep_ties(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", _day())


@query(f"SELECT r_name, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS n_flag, round(sum((o_orderstatus = 'F')::INT) / count(*), 4) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {_PLACED}) WHERE rn = 1 GROUP BY r_name")
def latest_base_rates(spark, d):
    latest = op.latest_per_key(table(spark, d, "orders"), ["o_custkey"], _order())
    placed = latest.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.groupBy("r_name").agg(*op.rate(F.col("o_orderstatus") == "F"))


@query("SELECT count(*) AS n, sum((o_orderstatus = 'F')::INT) AS n_flag, round(sum((o_orderstatus = 'F')::INT) / count(*), 4) AS rate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def linked_rate(spark, d):
    linked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(linked, "o_orderkey", "left_semi").agg(*op.rate(F.col("o_orderstatus") == "F"))


@query("SELECT o_orderpriority, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS n_flag, round(sum((o_orderstatus = 'F')::INT) / count(*), 4) AS rate FROM orders WHERE nullif(o_orderpriority, '3-MEDIUM') <> '5-LOW' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def high_acuity_rate(spark, d):
    rows = table(spark, d, "orders").where((F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")) != "5-LOW") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"))
    return rows.groupBy("o_orderpriority").agg(*op.rate(F.col("o_orderstatus") == "F"))


@query(f"SELECT r_name, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS n_flag, round(sum((o_orderstatus = 'F')::INT) / count(*), 4) AS rate FROM {_PLACED} WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY 1")
def population_rate(spark, d):
    return _placed(spark, d).where(F.col("r_name").isin("ASIA", "EUROPE", "AMERICA")).groupBy("r_name").agg(*op.rate(F.col("o_orderstatus") == "F"))


@query("SELECT '1_all' AS stage, count(*) AS n, count(DISTINCT o_custkey) AS n_subjects FROM orders UNION ALL SELECT '2_closed', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT '3_linked', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def cohort_accounting(spark, d):
    linked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("has", F.lit(True))
    rows = table(spark, d, "orders").join(linked, F.col("o_orderkey") == F.col("k"), "left")
    closed = F.col("o_orderstatus") != "O"
    # one pass: every stage is a conditional count over the same rows
    stages = [("1_all", F.lit(True)), ("2_closed", closed), ("3_linked", closed & F.coalesce("has", F.lit(False)))]
    one = rows.agg(*[F.struct(F.lit(s).alias("stage"), F.count_if(c).alias("n"), F.count_distinct(F.when(c, F.col("o_custkey"))).alias("n_subjects")).alias(s) for s, c in stages])
    return one.select(F.inline(F.array(*[F.col(f"`{s}`") for s, _ in stages])))


@query("SELECT o_orderkey, max(CASE WHEN v = 9 THEN 1 ELSE 0 END) AS has_9, max(CASE WHEN v <> 9 THEN 1 ELSE 0 END) AS has_other FROM (SELECT l_orderkey AS o_orderkey, nullif(9 + (l_suppkey % 3), 11) AS v FROM lineitem) GROUP BY 1")
def version_flags(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.nullif(F.lit(9) + F.col("l_suppkey") % 3, F.lit(11)).alias("v"))
    return rows.groupBy("o_orderkey").agg(F.max(F.when(F.col("v") == 9, 1).otherwise(0)).alias("has_9"), F.max(F.when(F.col("v") != 9, 1).otherwise(0)).alias("has_other"))


_SPLIT = "CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'dev' ELSE 'test' END"


@query(f"SELECT {_SPLIT} AS split, count(DISTINCT o_orderkey) AS n_ids, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS n_any, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN o_orderkey END) AS n_other, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS n_none FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END")
def coverage_by_split(spark, d):
    k = F.col("o_orderkey") % 10
    orders = table(spark, d, "orders").select("o_orderkey", F.when(k < 6, "train").when(k < 8, "dev").otherwise("test").alias("split"))
    # lines are first reduced to flags by order: the distinct counts become plain sums
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "N").alias("o"))
    out = orders.dropDuplicates(["o_orderkey"]).join(flags, "o_orderkey", "left").groupBy("split").agg(F.count("*").alias("n_ids"), F.count_if("r").alias("n_any"), F.count_if("o").alias("n_other"), F.count_if(F.col("r").isNull()).alias("n_none"))
    return out.orderBy(F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2))


@query("""WITH r AS (SELECT o_custkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) AS rf FROM orders),
p AS (SELECT a.o_custkey, a.o_totalprice AS len_all, f.o_totalprice AS len_flag, CASE WHEN f.o_totalprice > 0 THEN a.o_totalprice / f.o_totalprice END AS ratio FROM r a LEFT JOIN (SELECT * FROM r WHERE o_orderstatus = 'F' AND rf = 1) f ON f.o_custkey = a.o_custkey WHERE a.rn = 1)
SELECT count(*) AS n_pairs, count(len_flag) AS n_with_flag, round(median(len_all), 6) AS median_all, round(median(len_flag), 6) AS median_flag, round(avg(ratio), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio, count(*) FILTER (ratio < 0.25) AS lt_25, count(*) FILTER (ratio < 0.5) AS lt_50, count(*) FILTER (ratio >= 0.8) AS ge_80 FROM p""")
def paired_lengths(spark, d):
    flagged = F.col("o_orderstatus") == "F"
    r = op.concurrent_rankings(table(spark, d, "orders"), ["o_custkey"], _order(), flagged)
    # both rows of a key meet in one aggregate instead of a self join
    p = r.groupBy("o_custkey").agg(F.max(F.when(F.col("rn_all") == 1, F.col("o_totalprice"))).alias("len_all"), F.max(F.when(F.col("rn_flagged") == 1, F.col("o_totalprice"))).alias("len_flag"))
    p = p.withColumn("ratio", F.when(F.col("len_flag") > 0, F.col("len_all") / F.col("len_flag")))
    return p.agg(
        F.count("*").alias("n_pairs"), F.count("len_flag").alias("n_with_flag"), F.round(F.median("len_all"), 6).alias("median_all"), F.round(F.median("len_flag"), 6).alias("median_flag"),
        F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.median("ratio"), 6).alias("median_ratio"), F.count_if(F.col("ratio") < 0.25).alias("lt_25"), F.count_if(F.col("ratio") < 0.5).alias("lt_50"), F.count_if(F.col("ratio") >= 0.8).alias("ge_80"),
    )


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_parents(spark, d):
    return op.missing_parents(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT coalesce(nullif(o_orderpriority, '5-LOW'), '<NULL>') AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts_with_null(spark, d):
    return op.value_counts(table(spark, d, "orders").select(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p")), "p")


@query("SELECT CASE WHEN year(o_orderdate) <= 1998 THEN 'early' ELSE 'late' END AS period, count(*) AS n, round(avg(o_totalprice), 6) AS mean_value FROM orders GROUP BY 1")
def year_split(spark, d):
    return table(spark, d, "orders").groupBy(F.when(F.year("o_orderdate") <= 1998, "early").otherwise("late").alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_value"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


_BLANKS_SQL = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"SELECT doc_id, sha256(s) AS text_sha, length(s) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '^{_BLANKS_SQL}', ''), '{_BLANKS_SQL}$', '') AS s FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN chr(160) || ' ' WHEN 1 THEN ' ' || chr(8195) || text || chr(12288) || chr(10) WHEN 2 THEN NULL ELSE text END AS t FROM documents)) WHERE s <> ''")
def null_trim_drop(spark, d):
    """Null, blank and padded variants of whole texts; digests stand for the texts."""
    k = F.col("doc_id") % 7
    t = F.when(k == 0, "\u00a0 ").when(k == 1, F.concat(F.lit(" \u2003"), "text", F.lit("\u3000\n"))).when(k == 2, None).otherwise(F.col("text"))
    kept = table(spark, d, "documents").select("doc_id", stripped(t).alias("s")).where("s is not null and s <> ''")
    return kept.select("doc_id", F.sha2("s", 256).alias("text_sha"), F.length("s").alias("n"))


@query("SELECT event_id, try_cast(CASE event_id % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN user_id::VARCHAR ELSE '' END AS BIGINT) AS coerced FROM events")
def numeric_coercion(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, "n/a").when(k == 1, F.col("user_id").cast("string")).otherwise("")
    return table(spark, d, "events").select("event_id", raw.try_cast("bigint").alias("coerced"))


@query("SELECT h.c_custkey AS host, count(*) AS n_donors, min(s.c_custkey) AS first_donor FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20) h JOIN customer s ON s.c_nationkey <> h.c_nationkey AND NOT coalesce(nullif(s.c_mktsegment, 'BUILDING') = nullif(h.c_mktsegment, 'BUILDING'), false) GROUP BY 1")
def donor_exclusion(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    hosts = customers.orderBy("c_custkey").limit(20).toDF("host", "h_nation", "h_seg")
    return op.matched_unlike(hosts, customers, "h_nation", "c_nationkey", "h_seg", "seg").groupBy("host").agg(F.count("*").alias("n_donors"), F.min("c_custkey").alias("first_donor"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one_join(spark, d):
    return op.one_to_one(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT ord, m.doc_id, d.n_chars FROM (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS ord, doc_id FROM labels WHERE toxic = 1) m JOIN documents d USING (doc_id) ORDER BY ord")
def ordered_alignment(spark, d):
    from plumbline.operators.ranking import with_positions

    manifest = with_positions(table(spark, d, "labels").where("toxic = 1").select("doc_id"), [F.col("doc_id").desc()], "ord")
    return manifest.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("ord", "doc_id", "n_chars").orderBy("ord")


@query("SELECT l_partkey % 100 AS part_group, count(DISTINCT l_suppkey) AS n_values FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def lookup_conflicts(spark, d):
    rows = table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_partkey") % 100).alias("part_group"), "l_suppkey")
    return op.lookup_conflicts(rows, "part_group", "l_suppkey")


@query("SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.v ELSE o.o_totalprice END AS o_totalprice, n.o_orderkey IS NOT NULL AS replaced FROM orders o LEFT JOIN (SELECT o_orderkey, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 50 = 0) n ON n.o_orderkey = o.o_orderkey")
def row_replacement(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = base.where("o_orderkey % 50 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return op.replace_rows(base, new, "o_orderkey", ["o_totalprice"]).withColumnRenamed("_replaced", "replaced")


@query("SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def set_equality(spark, d):
    return op.set_difference_report(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, d):
    return op.remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def distribution_profile(spark, d):
    q = op.quantiles("value", [0.1, 0.25, 0.5, 0.75, 0.9])
    rows = table(spark, d, "events").groupBy("event_type").agg(q.alias("q"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rows.select("event_type", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p10", "p25", "p50", "p75", "p90"))], "mean", "lo", "hi")
