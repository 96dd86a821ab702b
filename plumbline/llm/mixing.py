"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Targets: all sources share a budget by weight; a source never gets more than ``max_epochs`` times
its size, and what it cannot take is shared again by weight among the rest, until none is above.

Sampling: a source whose target is e times its size takes every document floor(e) times; the
fractional rest goes to the documents whose seeded hash falls in the first buckets of the hash
order, and the one bucket on the border gives each of its documents the same part. So a source
meets its target up to rounding, on any number of machines and in any order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Hash buckets for each source: 16 ** BUCKET_DIGITS.
BUCKET_DIGITS = 3
#: A table of sources is broadcast only when it has been counted to have no more rows.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 if null.

    A word starts where a character that isn't white space is first or follows white space: the
    doubled white space is squeezed first, so that words are one more than the separators.
    """
    t = F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.coalesce(F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... by code point of the source, null last, without a single-task window."""
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([*sources.schema.fields, T.StructField("rank", T.LongType())])
    return cut(spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema), "sources")


def water_filled(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` to the same with ``target``; sources weigh ``weights``, repeating in their order."""
    ranked = _ranked(sources.select("source", "source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    amount, level = budget * total, 0.0
    while total:
        # sources that the level so far puts at or above their cap are clamped; the rest shares what is left
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        clamped, open_weight = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        if (risen := (amount - clamped) / open_weight) <= level:
            break
        level = risen
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: str = SEED, **rule) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (of its source, in words) and ``taken`` (words, repeats counted).

    ``taken // size`` whole repetitions and a prefix of ``taken % size`` words make up a document's
    part in the mix. Null texts have size 0 and give nothing; a null source is a source like any
    other, last in order; rows that repeat an id are sampled alike, however many there are (they share
    one bucket); a text of any length is one row and is counted whole. Columns of ``docs`` with the
    added names are replaced, all others are carried along; an empty table gives an empty result.
    """
    added = ("size", "source_size", "target", "taken")
    base = docs.drop(*[c for c in added if c in docs.columns])
    src = F.col(source_col).cast("string")
    bucket = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, BUCKET_DIGITS)
    sizes = base.select(src.alias("source"), bucket.alias("bucket"), word_count(F.col(text_col)).alias("size"))
    by_bucket = cut(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    targets = cut(water_filled(by_bucket.groupBy("source").agg(F.sum("size").alias("source_size")), **rule), "targets")
    # per source: whole repetitions, the bucket on the border, and the part that its documents give
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = by_bucket.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bucket", "size"))).alias("b"))  # at most 16 ** BUCKET_DIGITS
    running = F.aggregate(
        "b",
        F.struct(F.lit(0.0).alias("sum"), F.lit("~").alias("edge"), F.lit(0.0).alias("part")),
        lambda a, x: F.when(
            (a["edge"] == "~") & (a["sum"] + x["size"] > F.col("rest")),
            F.struct(a["sum"].alias("sum"), x["bucket"].alias("edge"), ((F.col("rest") - a["sum"]) / x["size"]).alias("part")),
        ).otherwise(F.struct((a["sum"] + x["size"]).alias("sum"), a["edge"].alias("edge"), a["part"].alias("part"))),
    )
    plan = t.join(filled, t.source.eqNullSafe(filled.source)).select(t.source.alias("_source"), t.source_size.alias("source_size"), t.target.alias("target"), "whole", running.alias("_r"))
    plan = cut(plan.select("_source", "source_size", "target", "whole", F.col("_r.edge").alias("_edge"), F.col("_r.part").alias("_part")), "mix")
    side = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    # the row travels as one column, so that no name of its columns can clash with those used here
    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), src.alias("src"), bucket.alias("bucket"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = rows.join(side, F.col("src").eqNullSafe(F.col("_source")), "left")
    extra = F.when(F.col("bucket") < F.col("_edge"), F.col("size")).when(F.col("bucket") == F.col("_edge"), F.round(F.col("size") * F.col("_part"))).otherwise(0)
    return rows.select("row.*", "size", "source_size", "target", (F.col("size") * F.col("whole") + extra).cast("long").alias("taken"))
