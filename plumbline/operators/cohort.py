"""Cohort construction: latest-row selection, semi and anti joins, conditional counts, safe ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, eligible: Column | None = None, priority: Column | None = None, null_policy: str = "before", required: str | None = None) -> DataFrame:
    """One row per key: the first in ``order`` (give descending columns), after ``priority``.

    ``eligible`` filters before ranking. ``required`` names a column that must not be null, and
    ``null_policy`` says when: ``before`` ranks only rows that have it; ``after`` ranks all and then
    drops keys whose chosen row lacks it; ``keep`` ignores it. A row number needs one shuffle on
    the keys; Spark's window group limit keeps only the first row of each key on the map side.
    """
    if null_policy not in ("before", "after", "keep"):
        raise ValueError(f"null_policy {null_policy!r} is not known")
    rows = df if eligible is None else df.where(eligible)
    if required and null_policy == "before":
        rows = rows.where(F.col(required).isNotNull())
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*([] if priority is None else [priority]), *order)))
    out = ranked.where("_rn = 1").drop("_rn")
    return out.where(F.col(required).isNotNull()) if required and null_policy == "after" else out


def group_max_keep_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows whose value is the largest of their key, ties included, in one shuffle."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_max", F.max(value).over(w)).where(F.col(value) == F.col("_max")).drop("_max")


def concurrent_rankings(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flagged: Column) -> DataFrame:
    """``rn_all`` over all rows and ``rn_flagged`` over flagged rows only (null elsewhere), one shuffle for both."""
    w = Window.partitionBy(*keys)
    return df.withColumn("rn_all", F.row_number().over(w.orderBy(*order))).withColumn("rn_flagged", F.when(flagged, F.row_number().over(w.orderBy(F.when(flagged, 0).otherwise(1), *order))))


def rate(flag: Column, digits: int = 4) -> list[Column]:
    """Count, sum of the flag, and their ratio (null on no rows)."""
    return [F.count("*").alias("n"), F.sum(flag.cast("int")).alias("n_flag"), F.round(F.try_divide(F.sum(flag.cast("int")), F.count("*")), digits).alias("rate")]


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that fails the job if a key repeats on either side.

    The check travels with the join: each side carries its number of rows for the key, so no
    separate pass is needed.
    """
    w = Window.partitionBy(*on)
    a = left.withColumn("_nl", F.count("*").over(w))
    b = right.withColumn("_nr", F.count("*").over(w))
    bad = (F.coalesce("_nl", F.lit(1)) > 1) | (F.coalesce("_nr", F.lit(1)) > 1)
    return a.join(b, list(on), how).where(F.when(bad, F.raise_error(F.lit(f"keys {list(on)} repeat"))).otherwise(F.lit(True))).drop("_nl", "_nr")


def missing_parents(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*on).distinct(), list(on), "left_anti")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key has no finished row: what a resumed run has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def replace_rows(base: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with ``columns`` taken from ``new`` where it has the key; ``_replaced`` tells which."""
    n = new.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(n, key, "left")
    values = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*values, F.coalesce("_hit", F.lit(False)).alias("_replaced"))


def set_difference_report(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with ``side`` ``missing`` or ``extra``."""
    e, o = expected.select(key).distinct().withColumn("_e", F.lit(1)), observed.select(key).distinct().withColumn("_o", F.lit(1))
    both = e.join(o, key, "full_outer")
    return both.where("_e is null or _o is null").select(key, F.when(F.col("_o").isNull(), "missing").otherwise("extra").alias("side"))


def lookup_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are mapped to more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def value_counts(df: DataFrame, column: str, null_label: str = "<NULL>") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias("value")).agg(F.count("*").alias("n"))


def quantiles(column: str, ps: Sequence[float]) -> Column:
    """Exact linear-interpolation (type 7) quantiles."""
    return F.percentile(column, F.array(*[F.lit(float(p)) for p in ps]))


def matched_unlike(hosts: DataFrame, donors: DataFrame, host_subject: str, donor_subject: str, host_visit: str, donor_visit: str) -> DataFrame:
    """Host-donor pairs of another subject and another visit; null visits never match. ``hosts`` is a bounded selection and is broadcast."""
    unlike = (F.col(host_subject) != F.col(donor_subject)) & ~F.coalesce(F.col(host_visit) == F.col(donor_visit), F.lit(False))
    return donors.join(F.broadcast(hosts), unlike)
