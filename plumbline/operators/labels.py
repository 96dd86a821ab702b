"""Label spaces: train-only top-K codes, support and prevalence tables, multi-hot vectors, split gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalised_code


#: Rows that a task joins and counts by key, about.
TASK_ROWS = 500_000
#: Rows of a table that is broadcast to a join rather than dealt out.
BROADCAST_ROWS = 500_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Dealt by the key into a task for each ``TASK_ROWS`` of ``rows``, which adaptive plans don't merge: sorts and hash tables don't grow with the input."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), key)


def coded_members(members: DataFrame, rows: DataFrame, codes: DataFrame, key: str, code_key: str) -> tuple[DataFrame, DataFrame]:
    """The members, and their ``rows`` with what ``codes`` holds by ``code_key``, both dealt by ``key``: later joins and counts by it stay in their tasks."""
    n = rows.count()
    if codes.count() > BROADCAST_ROWS:
        rows, codes = dealt(rows, code_key, n), dealt(codes, code_key, n).hint("merge")
    else:
        codes = F.broadcast(codes)
    members = dealt(members, key, n)
    return members, members.join(dealt(rows.join(codes, code_key), key, n), key)


def distinct_codes(rows: DataFrame, key: str, code: Column, extra: Sequence[str] = ()) -> DataFrame:
    """``key, *extra, code``: each normalised code once per key; rows without a code are left out."""
    return rows.select(key, *extra, normalised_code(code).alias("code")).where("code is not null").dropDuplicates([key, *extra, "code"])


def top_codes(codes: DataFrame, key: str, k: int) -> DataFrame:
    """``rank, code, n``: the k most frequent codes, ties by code. Fails if there are fewer than k.

    ``codes`` holds each code once per key, so a plain count is the distinct count; the ranking runs
    on k rows after a distributed top-k.
    """
    top = codes.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("code")).limit(k)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))).alias("l"))  # k rows
    checked = listed.withColumn("l", F.when(F.size("l") < k, F.raise_error(F.lit(f"fewer than {k} codes"))).otherwise(F.col("l")))
    return checked.select(F.posexplode("l").alias("p", "c")).select((F.col("p") + 1).cast("int").alias("rank"), F.col("c.code").alias("code"), (-F.col("c.m")).alias("n"))


def support(codes: DataFrame, members: DataFrame, top: DataFrame, key: str, split: str) -> DataFrame:
    """``code, split, n, prevalence, n_members, auc_defined, sparse`` for every top code and every split.

    The denominator is the split's size in ``members``, not the number of rows with codes. The small
    tables (top codes, splits) are crossed; the counts join them.
    """
    sizes = members.groupBy(split).agg(F.count("*").alias("n_members"))
    counts = codes.join(F.broadcast(top.select("code")), "code").groupBy("code", split).agg(F.count("*").alias("n"))
    grid = top.select("code").crossJoin(sizes)  # K codes by the few splits
    out = grid.join(counts, ["code", split], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("code", split, "n", F.round(F.col("n") / F.col("n_members"), 6).alias("prevalence"), "n_members", ((F.col("n") > 0) & (F.col("n") < F.col("n_members"))).alias("auc_defined"), (F.col("n") < 10).alias("sparse"))


def multi_hot(members: DataFrame, codes: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """``key, labels``: one 0/1 entry per top code in rank order, for every member."""
    order = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("order"))
    own = codes.join(F.broadcast(top.select("code")), "code").groupBy(key).agg(F.collect_set("code").alias("own"))
    rows = members.select(key).join(own, key, "left").crossJoin(F.broadcast(order))  # one row
    return rows.select(key, F.transform("order", lambda c: F.coalesce(F.array_contains("own", c), F.lit(False)).cast("int")).alias("labels"))


def all_zero(members: DataFrame, codes: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Members none of whose codes is a top code."""
    covered = codes.join(F.broadcast(top.select("code")), "code").select(key)
    return members.join(covered, key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count("*").alias("n"))


def disjoint_pool(pool: DataFrame, baseline: DataFrame, subject: str) -> DataFrame:
    """Rows of the pool whose subject the baseline doesn't have; rows with a null subject stay."""
    return pool.join(baseline.select(subject).distinct(), subject, "left_anti")
