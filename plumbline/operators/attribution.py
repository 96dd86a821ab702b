"""Vote-based attribution: prompts, guarded calls, parsing of answers, vote resolution and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = {"High": 3, "Medium": 2, "Low": 1}
_ANSWER = "category string, confidence string, reasoning string, secondary_evidence string"


def build_prompts(records: DataFrame, exemplars: DataFrame, note: str, instructions: str) -> DataFrame:
    """Adds ``prompt``: the instructions, the exemplars in order (a few rows), and the record's note."""
    shown = exemplars.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("exemplar_order", "text"))), lambda x: F.concat(F.lit("Example:\n"), x["text"])), "\n\n").alias("_shown"))
    return records.crossJoin(F.broadcast(shown)).withColumn("prompt", F.concat(F.lit(instructions + "\n\n"), "_shown", F.lit("\n\nNote:\n"), note)).drop("_shown")


def called(records: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str, int, float], str]], runs: int = 5, retries: int = 3) -> DataFrame:
    """``key, run_no, temperature, raw, error`` of ``runs`` stochastic calls and one (run 0) at temperature 0.

    ``client`` is a factory called once in each task. A call is tried ``retries`` times; what still
    fails is a row with its error, never a lost record.
    """
    kind = dict(records.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for f in frames:
            out = []
            for k, text in zip(f[key], f[prompt], strict=True):
                for r in range(runs + 1):
                    raw, error = None, None
                    for _ in range(retries):
                        try:
                            raw, error = ask(text, r, 0.7 if r else 0.0), None
                            break
                        except Exception as e:  # a client's failure is data here
                            error = f"{type(e).__name__}: {e}"
                    out.append((k, r, 0.7 if r else 0.0, raw, error))
            yield pd.DataFrame(out, columns=[key, "run_no", "temperature", "raw", "error"])

    return records.select(key, prompt).mapInPandas(run, f"{key} {kind}, run_no int, temperature double, raw string, error string")


def parsed_answer(raw: Column, categories: Sequence[str]) -> Column:
    """A struct of category, confidence, reasoning and secondary evidence, or null if no reading of the text is valid.

    Thoughts are cut out first. Then the whole text, the text without code fences, and the part from
    the first to the last brace are tried in this order; an answer needs a known category, a
    confidence and a reasoning, and missing secondary evidence is ``none``.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)<\|channel>thought\s*.*?<channel\|>", ""), r"(?s)<think>.*?</think>", ""))
    fenced = F.trim(F.regexp_replace(clean, r"(?s)```(?:json)?\s*(.*?)```", "$1"))
    braces = F.regexp_extract(clean, r"(?s)\{.*\}", 0)

    def valid(text: Column) -> Column:
        j = F.from_json(text, _ANSWER)
        whole = F.try_parse_json(text).isNotNull()
        ok = whole & j["category"].isin(*categories) & j["confidence"].isNotNull() & j["reasoning"].isNotNull()
        return F.when(ok, F.struct(j["category"].alias("category"), j["confidence"].alias("confidence"), j["reasoning"].alias("reasoning"), F.coalesce(j["secondary_evidence"], F.lit("none")).alias("secondary_evidence")))

    return F.coalesce(valid(clean), valid(fenced), valid(braces))


def resolved(votes: DataFrame, key: str, tie_order: Sequence[str], runs: int = 5) -> DataFrame:
    """One row for each record of ``votes (key, run_no, category, confidence)``; run 0 is the diagnostic.

    The modal category of the valid stochastic votes wins, ties by ``tie_order``; fewer than ``runs``
    valid votes leave the record incomplete (null category). ``stable`` compares with run 0 and is
    null where that is missing. The confidence is that of the modal category's most confident run,
    the first of equals. Everything is one aggregate over the record's few votes.
    """
    order = F.create_map(*[F.lit(x) for kv in ((c, k) for k, c in enumerate(tie_order)) for x in kv])
    level = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    counted = votes.where("run_no > 0 and category is not null").groupBy(key, "category").agg(F.count("*").alias("n"), F.min(F.struct((-F.coalesce(F.element_at(level, F.col("confidence")), F.lit(0))).alias("c"), "run_no", "confidence")).alias("best"))
    per = counted.groupBy(key).agg(
        F.sum("n").alias("n_valid_runs"),
        F.min(F.struct((-F.col("n")).alias("n"), F.coalesce(F.element_at(order, F.col("category")), F.lit(len(tie_order))).alias("o"), "category", "best")).alias("w"),
        F.max("n").alias("top"),
        F.collect_list("n").alias("ns"),
    )
    fixed = votes.where("run_no = 0").groupBy(key).agg(F.first("category", ignorenulls=True).alias("deterministic_category"))
    rows = votes.select(key).distinct().join(per, key, "left").join(fixed, key, "left")
    full = F.coalesce("n_valid_runs", F.lit(0)) >= runs
    category = F.when(full, F.col("w.category"))
    return rows.select(
        key,
        category.alias("category"),
        F.when(full, F.col("w.best.confidence")).alias("confidence"),
        F.when(full, F.round(F.col("top") / runs, 3)).alias("consistency_rate"),
        F.coalesce("n_valid_runs", F.lit(0)).alias("n_valid_runs"),
        "deterministic_category",
        F.when(full, F.col("deterministic_category") == category).alias("stable"),
        F.when(full, F.when(F.size(F.filter("ns", lambda n: n == F.col("top"))) == 1, "unique_modal").otherwise("stochastic_tie_break")).otherwise("").alias("resolution"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def blinded(records: DataFrame, key: str, group: str, note: str) -> DataFrame:
    """Only a record id, a group and the note; nothing that tells the score or the selection."""
    return records.select(F.col(key).cast("string").alias("record_id"), F.col(group).alias("group"), F.col(note).alias("note_text"))


def latest_votes(votes: DataFrame, key: str) -> DataFrame:
    """Of repeated calls of one run (a resumed sink) the last valid one."""
    w = Window.partitionBy(key, "run_no").orderBy(F.col("category").isNull(), F.col("call_no").desc())
    return votes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
