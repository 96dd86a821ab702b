"""Seeded sampling that doesn't depend on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: a distributed top-n by seeded hash of the key."""
    return df.orderBy(seeded_order(key, seed), F.col(key)).limit(n)


def cap_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(seeded_order(key, seed), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def draws(n: int, size: int, seed: list[int] | int) -> np.ndarray:
    """Indexes into rows sorted by key, without replacement, from a generator of its own."""
    return np.random.default_rng(seed).choice(n, min(n, size), replace=False)


def multiplicities(n: int, seed: list[int] | int) -> np.ndarray:
    """How often each of n clusters occurs in a resample with replacement."""
    return np.bincount(np.random.default_rng(seed).integers(0, n, n), minlength=n)
