"""Reruns and their gates: frozen settings, provenance, replayed selections, substituted baselines, sample overlaps, variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import vectors
from plumbline.operators.contracts import ContractError
from plumbline.operators.ranking import with_positions


def rank_band(rank: Column, top_end: int = 50, bottom_start: int = 2451) -> Column:
    return F.when(rank <= top_end, "top").when(rank >= bottom_start, "bottom").otherwise("middle")


def corpus_class(label: Column, classes: Mapping[str, str]) -> Column:
    """The name of the first pattern found in the lower-cased label; a label that none fits fails the job."""
    out = F.raise_error(F.concat(F.lit("no corpus: "), F.coalesce(label, F.lit("null"))))
    for name, pattern in reversed(list(classes.items())):
        out = F.when(F.lower(label).rlike(pattern), name).otherwise(out)
    return out


def attached(selection: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The selection with ``text`` from ``texts``, and ``text_missing`` where there is none or it is null. Every selected row stays."""
    return selection.join(texts.select(key, text), key, "left").withColumn("text_missing", F.col(text).isNull())


def hashed_draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled_stream(baseline: DataFrame, target: DataFrame, key: str, seed: int, apart: int = 200_000) -> DataFrame:
    """Both sides shuffled independently (``seed`` and ``seed + apart``), the baseline first: adds ``side`` and ``pos`` from 0."""
    a = baseline.withColumn("side", F.lit("baseline")).withColumn("_draw", hashed_draw(key, seed))
    b = target.withColumn("side", F.lit("target")).withColumn("_draw", hashed_draw(key, seed + apart))
    return with_positions(a.unionByName(b), [F.col("side"), F.col("_draw"), F.col(key)]).drop("_draw")


def sample_overlaps(sides: Mapping[str, DataFrame], key: str, sizes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """For each seed, side and pair of sizes: how many rows the two independent samples share, and how many are expected.

    Each sample is a distributed top-n by hash, so only the samples themselves are joined.
    """
    spark = next(iter(sides.values())).sparkSession
    drawn, totals = [], []
    for name, df in sides.items():
        totals.append((name, df.count()))
        for seed in seeds:
            for size in sizes:
                draw = F.md5(F.concat(F.lit(f"{seed}:{size}:"), F.col(key).cast("string")))
                drawn.append(df.orderBy(draw, key).limit(size).select(F.lit(name).alias("side"), F.lit(seed).alias("seed"), F.lit(size).alias("size"), key))
    rows = reduce(DataFrame.unionByName, drawn)
    pairs = [(name, n, seed, a, b) for name, n in totals for seed in seeds for a, b in combinations(sorted(sizes), 2)]
    grid = spark.createDataFrame(pairs, "side string, n long, seed int, size_a int, size_b int")
    shared = rows.withColumnRenamed("size", "size_a").join(rows.withColumnRenamed("size", "size_b"), ["side", "seed", key]).where("size_a < size_b")
    shared = shared.groupBy("side", "seed", "size_a", "size_b").agg(F.count("*").alias("n_shared"))
    out = grid.join(shared, ["side", "seed", "size_a", "size_b"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("long"))
    expected = F.when(F.col("n") > 0, F.col("size_a").cast("double") * F.col("size_b") / F.col("n"))
    return out.select("side", "seed", "size_a", "size_b", "n_shared", expected.alias("expected"), (F.col("n_shared") == F.col("size_a")).alias("nested"))


def substitution(original: DataFrame, preferred: DataFrame, target: DataFrame, key: str, vector: str, sigma: float) -> dict[str, float]:
    """The statistic against either baseline, and its absolute and relative change (null if the original is zero)."""
    a, b = (v[0] for v in vectors.mmd2_grid([original, preferred], target, key, vector, [sigma]))
    return {"original": a, "preferred": b, "absolute_change": b - a, "relative_change_pct": 100 * (b - a) / a if a else None}


def frozen(settings: Mapping, required: Mapping) -> None:
    """All settings that differ from what was frozen, in one error."""
    if wrong := {k: (settings.get(k), v) for k, v in required.items() if k not in settings or settings[k] != v}:
        raise ContractError("; ".join(f"{k} is {got!r}, frozen at {v!r}" for k, (got, v) in wrong.items()))


def provenance(found: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest isn't the one listed: ``key, reason`` (changed, missing or unlisted). Empty if all hold."""
    x, y = found.select(key, F.col(digest).alias("_x"), F.lit(True).alias("_f")), expected.select(key, F.col(digest).alias("_y"), F.lit(True).alias("_e"))
    reason = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unlisted").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return x.join(y, key, "full_outer").select(key, reason.alias("reason")).where("reason is not null")


def pca_contract(pca: Mapping[str, np.ndarray], n_features: int, k: int, variance: float, tolerance: float) -> float:
    """The variance that the kept components explain, if the fitted model is the declared one; else an error."""
    got = np.shape(pca["components"])[::-1]
    explained = float(np.sum(pca["ratio"][: int(pca["k"])]))
    wrong = [] if got == (n_features, k) else [f"{got[0]} features and {got[1]} components, not {n_features} and {k}"]
    if not abs(explained - variance) <= tolerance:
        wrong.append(f"explained variance {explained:.9f}, not {variance:.9f}")
    if wrong:
        raise ContractError("; ".join(wrong))
    return explained


def selection_replay(replay: DataFrame, saved: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Per group: how many keys both selections have, which have one only, and whether sets and orders match."""
    x, y = replay.select(group, key, F.col(order).alias("_x"), F.lit(1).alias("_r")), saved.select(group, key, F.col(order).alias("_y"), F.lit(1).alias("_s"))
    both, one, other = F.col("_r").isNotNull() & F.col("_s").isNotNull(), F.col("_s").isNull(), F.col("_r").isNull()
    out = x.join(y, [group, key], "full_outer").groupBy(group).agg(
        F.count_if(both).alias("n_common"), F.count_if(one).alias("replay_only"), F.count_if(other).alias("saved_only"), F.count_if(both & (F.col("_x") != F.col("_y"))).alias("moved"),
    )
    same = (F.col("replay_only") == 0) & (F.col("saved_only") == 0)
    return out.withColumn("set_match", same).withColumn("order_match", same & (F.col("moved") == 0)).drop("moved")


def variants(hosts: DataFrame, text: str, start: str, end: str, filler: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``variant_text``, the text with the body [start, end) replaced by the filler, and where it came from.

    White space around the old body is kept. ``variant_order`` numbers the rows by key. Provenance:
    lengths of the old body, the filler and what replaced it, the change in characters, and the seed.
    """
    body = F.substr(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))
    rows = hosts.withColumn("variant_text", tx.spliced(F.col(text), F.col(start), F.col(end), F.col(filler)))
    change = F.length("variant_text") - F.length(text)
    rows = rows.select(
        *hosts.columns, "variant_text", F.length(body).alias("original_body_length"), F.length(filler).alias("inserted_filler_length"), (F.length(body) + change).alias("replacement_body_length"),
        change.alias("note_character_change"), F.format_string(f"[{seed},%d]", F.col(key)).alias("seed_sequence_json"),
    )
    rows = with_positions(rows, [F.col(key)], "variant_order", 1)
    return rows.withColumn("variant_id", F.format_string("variant_%03d", F.col("variant_order")))


def group_rank_profile(ranked: DataFrame, group: str, rank: str, top: int, bottom: int) -> DataFrame:
    """Least, median and greatest rank of each group, and how many of its rows lie in either end."""
    r = F.col(rank)
    return ranked.groupBy(group).agg(F.min(r).alias("min_rank"), F.median(r).alias("median_rank"), F.max(r).alias("max_rank"), F.count_if(r <= top).alias("n_top"), F.count_if(r >= bottom).alias("n_bottom"))
