"""Ranks, selections and percentiles that don't need all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """Adds each row's place in ``order`` (which should be total), without a window over all rows.

    Rows are range partitioned and sorted; a row's place is its place in the partition plus the
    sizes of the partitions before, which are the only values collected. The sorted rows are kept,
    since the bounds of the ranges are sampled anew when a plan runs again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r.p: r["count"] for r in rows.groupBy(F.shiftright("_id", 33).alias("p")).count().collect()}
    offsets, total = {}, start
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_id")
    lookup = F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv])
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, (F.element_at(lookup, F.shiftright("_id", 33)) + within).cast("long")).drop("_id")


def ranked_by_score(df: DataFrame, score: str, tie: str, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` 1..N by score descending, then ``tie`` ascending, within groups or overall."""
    if group:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))).cast("long"))
    return with_positions(df, [F.col(score).desc(), F.col(tie)], "rank", 1)


def average_rank(df: DataFrame, score: str, group: Sequence[str], name: str = "avg_rank") -> DataFrame:
    """Ranks of equal scores are averaged. Values are counted first, so the window sees each value once."""
    counts = df.groupBy(*group, score).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(score)
    below = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranks = counts.withColumn(name, below + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*group, score])


def stratified(df: DataFrame, score: str, tie: str, n: int, draw: Column) -> DataFrame:
    """``selection``: the n highest, then the n lowest, then n of the rest by ``draw``; a row is selected once.

    Each selection is a distributed top-n; the later ones leave the earlier ones out.
    """
    top = df.orderBy(F.col(score).desc(), F.col(tie)).limit(n).withColumn("selection", F.lit("top"))
    rest = df.join(F.broadcast(top.select(tie)), tie, "left_anti")
    bottom = rest.orderBy(F.col(score), F.col(tie)).limit(n).withColumn("selection", F.lit("bottom"))
    rest = rest.join(F.broadcast(bottom.select(tie)), tie, "left_anti")
    return top.unionByName(bottom).unionByName(rest.orderBy(draw, F.col(tie)).limit(n).withColumn("selection", F.lit("random")))


def counterfactual_rank(df: DataFrame, score: str, tie: str, changed: DataFrame) -> DataFrame:
    """For each row of ``changed (tie, new_score)``, the rank it would have if only its score changed.

    1 plus the others that score higher (or equal with a smaller id). ``changed`` is a bounded
    selection: it is broadcast against the scores, which are counted in one pass.
    """
    c = F.broadcast(changed.select(F.col(tie).alias("_id"), "new_score"))
    above = (F.col(tie) != F.col("_id")) & ((F.col(score) > F.col("new_score")) | ((F.col(score) == F.col("new_score")) & (F.col(tie) < F.col("_id"))))
    return df.select(tie, score).join(c, F.lit(True)).groupBy("_id", "new_score").agg((F.count_if(above) + 1).alias("new_rank")).withColumnRenamed("_id", tie)


def empirical_percentile(values: DataFrame, value: str, probes: DataFrame, probe: str) -> DataFrame:
    """``100 * share of values at or below`` for each row of the bounded table ``probes``."""
    return values.select(value).join(F.broadcast(probes), F.lit(True)).groupBy(*probes.columns).agg(F.round(100 * F.avg((F.col(value) <= F.col(probe)).cast("double")), 6).alias("percentile"))


def nearest_to_median(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    m = df.agg(F.median(value).alias("_m"))
    return df.crossJoin(F.broadcast(m)).orderBy(F.abs(F.col(value) - F.col("_m")), F.col(tie)).limit(n).drop("_m")
