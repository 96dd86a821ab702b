"""Label-space queries: an order's codes are the brands of its parts, splits are bands of the order key."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import labels as op
from plumbline.plans.base import query, table

K = 10
_SPLIT_SQL = "CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'dev' WHEN o_orderkey % 10 = 8 THEN 'test' ELSE 'target' END"
_CODES = f"""m AS (SELECT o_orderkey, o_custkey, {_SPLIT_SQL} AS split FROM orders),
c AS (SELECT DISTINCT o_orderkey, o_custkey, split, nullif(nullif(upper(trim(replace(CASE p_size % 9 WHEN 0 THEN ' nan ' WHEN 1 THEN '' ELSE ' ' || p_brand || '.' END, '.', ''))), 'NAN'), '') AS code FROM m JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
codes AS (SELECT * FROM c WHERE code IS NOT NULL),
top AS (SELECT row_number() OVER (ORDER BY n DESC, code) AS rank, code, n FROM (SELECT code, count(DISTINCT o_orderkey) AS n FROM codes WHERE split = 'train' GROUP BY 1) QUALIFY rank <= {K})"""


def _members(spark, d):
    k = F.col("o_orderkey") % 10
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(k < 6, "train").when(k < 8, "dev").when(k == 8, "test").otherwise("target").alias("split"))


def _codes(spark, d, members):
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 == 0, " nan ").when(F.col("p_size") % 9 == 1, "").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("."))).alias("raw"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    members, rows = op.coded_members(members, lines, part, "o_orderkey", "p_partkey")
    return members, op.distinct_codes(rows, "o_orderkey", F.col("raw"), ("split",))


def _parts(spark, d):
    members, codes = _codes(spark, d, _members(spark, d))
    return members, codes, op.top_codes(codes.where("split = 'train'"), "o_orderkey", K)


@query(f"WITH {_CODES} SELECT rank::INT AS rank, code, n FROM top")
def topk_codes_train(spark, d):
    return _parts(spark, d)[2]


@query(f"WITH {_CODES}, s AS (SELECT split, count(*) AS n_members FROM m GROUP BY 1), n AS (SELECT code, split, count(DISTINCT o_orderkey) AS n FROM codes GROUP BY 1, 2) SELECT top.code, s.split, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / n_members, 6) AS prevalence, n_members, coalesce(n.n, 0) > 0 AND coalesce(n.n, 0) < n_members AS auc_defined, coalesce(n.n, 0) < 10 AS sparse FROM top CROSS JOIN s LEFT JOIN n ON n.code = top.code AND n.split = s.split")
def support_table(spark, d):
    members, codes, top = _parts(spark, d)
    return op.support(codes, members, top, "o_orderkey", "split")


@query(f"WITH {_CODES}, s AS (SELECT split, count(*) AS size FROM m GROUP BY 1), n AS (SELECT top.code, s.split, count(DISTINCT o_orderkey) / any_value(size) AS p FROM top CROSS JOIN s LEFT JOIN codes ON codes.code = top.code AND codes.split = s.split GROUP BY 1, 2) SELECT code, round(max(p) FILTER (split = 'test'), 6) AS source_prevalence, round(max(p) FILTER (split = 'target'), 6) AS target_prevalence, round(max(p) FILTER (split = 'target') - max(p) FILTER (split = 'test'), 6) AS delta FROM n GROUP BY 1")
def label_prevalence(spark, d):
    members, codes, top = _parts(spark, d)
    sizes = members.groupBy().pivot("split", ["test", "target"]).count()
    counts = codes.where("split in ('test', 'target')").join(F.broadcast(top.select("code")), "code").groupBy("code").agg(F.count_if(F.col("split") == "test").alias("a"), F.count_if(F.col("split") == "target").alias("b"))
    rows = top.select("code").join(counts, "code", "left").crossJoin(F.broadcast(sizes))
    a, b = F.coalesce("a", F.lit(0)) / F.col("test"), F.coalesce("b", F.lit(0)) / F.col("target")
    return rows.select("code", F.round(a, 6).alias("source_prevalence"), F.round(b, 6).alias("target_prevalence"), F.round(b - a, 6).alias("delta"))


@query(f"WITH {_CODES} SELECT split, count(*) AS n_zero FROM m WHERE o_orderkey NOT IN (SELECT o_orderkey FROM codes JOIN top USING (code)) GROUP BY 1")
def all_zero_count(spark, d):
    members, codes, top = _parts(spark, d)
    return op.all_zero(members, codes, top, "o_orderkey").groupBy("split").agg(F.count("*").alias("n_zero"))


@query(f"WITH {_CODES} SELECT m.o_orderkey, string_agg(CASE WHEN c.code IS NULL THEN '0' ELSE '1' END, '' ORDER BY rank) AS labels FROM m CROSS JOIN top LEFT JOIN codes c ON c.o_orderkey = m.o_orderkey AND c.code = top.code WHERE m.split = 'dev' GROUP BY 1")
def multi_hot(spark, d):
    members, codes, top = _parts(spark, d)
    rows = op.multi_hot(members.where("split = 'dev'"), codes.where("split = 'dev'"), top, "o_orderkey")
    return rows.select("o_orderkey", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


@query(f"WITH m AS (SELECT o_custkey, {_SPLIT_SQL} AS split FROM orders) SELECT a.split AS left_split, b.split AS right_split, count(DISTINCT a.o_custkey) AS n_shared FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY 1, 2")
def split_overlap(spark, d):
    # each subject's splits are gathered once, then their pairs are counted: no self join
    s = _members(spark, d).groupBy("o_custkey").agg(F.sort_array(F.collect_set("split")).alias("s"))
    pairs = s.select(F.explode("s").alias("left_split"), "s").select("left_split", F.explode("s").alias("right_split")).where("left_split < right_split")
    return pairs.groupBy("left_split", "right_split").agg(F.count("*").alias("n_shared"))


@query(f"WITH m AS (SELECT o_orderkey, o_custkey, {_SPLIT_SQL} AS split FROM orders) SELECT o_orderkey, o_custkey FROM m WHERE split = 'target' AND o_custkey NOT IN (SELECT o_custkey FROM m WHERE split = 'train')")
def subject_disjoint_pool(spark, d):
    m = _members(spark, d)
    return op.disjoint_pool(m.where("split = 'target'"), m.where("split = 'train'"), "o_custkey").select("o_orderkey", "o_custkey")


@query(f"WITH {_CODES} SELECT split, count(*) AS n_codes, count(DISTINCT o_orderkey) AS n_ids FROM codes GROUP BY 1")
def code_dedup(spark, d):
    # codes are distinct by order: a second, smaller aggregate counts the orders
    return _parts(spark, d)[1].groupBy("split", "o_orderkey").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_codes"), F.count("*").alias("n_ids"))
