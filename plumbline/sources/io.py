"""Sources and sinks. All go through Spark's readers and writers, so they work on any file system Spark knows."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A parallel read of a database table, in ``parts`` ranges of ``key``."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header whose quoted fields may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id a line, with or without a header; blanks and what isn't a number are left out, fractions are an error."""
    text = spark.read.text(path).select(F.trim("value").alias("v"))
    number = F.col("v").try_cast("double")
    whole = F.when(number != F.floor(number), F.raise_error(F.concat(F.lit("not an integer: "), "v"))).otherwise(number.cast("long"))
    return text.where(number.isNotNull() & ~F.isnan(number)).select(whole.alias(name))


def read_code_list(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Exactly k different codes, normalised, in file order by line; else an error."""
    from plumbline.functions.text import normalised_code

    codes = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw")).select("line", normalised_code(F.col("raw")).alias("code")).where("code is not null")
    n, distinct = codes.agg(F.count("*"), F.count_distinct("code")).first()
    if n != k or distinct != k:
        raise ValueError(f"{n} codes of which {distinct} differ, not {k}")
    return codes


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Matrices in ``.npy`` files as ``path, pos, vector``; each file is read by one task."""

    def parse(frames):
        import io

        for f in frames:
            for p, content in zip(f.path, f.content, strict=True):
                m = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                yield pd.DataFrame({"path": p, "pos": np.arange(len(m)), "vector": list(m.astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, pos long, vector array<double>")


def newest(spark: SparkSession, pattern: str) -> str:
    """The path of the file that was changed last, the last by name of equals."""
    r = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").orderBy(F.col("modificationTime").desc(), F.col("path").desc()).first()
    if r is None:
        raise FileNotFoundError(pattern)
    return r.path


def fingerprints(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def concat_shards(shards: Sequence[DataFrame], key: str) -> DataFrame:
    """All shards in one table; a key that two rows have fails the job when it is read."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    n = F.count("*").over(Window.partitionBy(key))
    return out.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("_n")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_latest_jsonl(spark: SparkSession, path: str, schema: str, key: str, sequence: str) -> DataFrame:
    from plumbline.operators.detectors import latest_records

    return latest_records(spark.read.schema(schema).json(path), key, sequence)


def _same_run(spark: SparkSession, path: str, identity: dict) -> None:
    """Writes what a run is, or compares it with what is written there; another run is an error."""
    text = json.dumps(identity, sort_keys=True)
    try:
        known = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
    elif known.value.strip() != text:
        raise ValueError(f"the partial results belong to another run: {known.value.strip()}, not {text}")


def append_remaining(todo: DataFrame, done_path: str, key: str, work, identity: dict | None = None) -> DataFrame:
    """Does the work on rows that ``done_path`` lacks and appends the results; returns everything done. A rerun resumes.

    With an ``identity`` (model, settings, a digest of the manifest) only a run of the same identity resumes.
    """
    spark = todo.sparkSession
    if identity is not None:
        _same_run(spark, done_path.rstrip("/") + ".identity", identity)
    try:
        done = spark.read.parquet(done_path)
        todo = todo.join(done.select(key).distinct(), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    work(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def split_sink(df: DataFrame, error: str, good_path: str, bad_path: str) -> None:
    """Complete records to one place, incomplete ones to a side file with their raw answers."""
    df.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(good_path)
    df.where(F.col(error).isNotNull()).write.mode("append").parquet(bad_path)


def save_model(spark: SparkSession, model: dict[str, np.ndarray], path: str) -> None:
    """A model is a table: one row for each array with its shape."""
    rows = [(k, [int(x) for x in np.shape(v)], [float(x) for x in np.ravel(v)]) for k, v in model.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("errorifexists").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def _report_rows(df: DataFrame, most: int) -> list:
    """All rows of a report's table; a table that is too long for a report is an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    return rows


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    rows = _report_rows(df, most)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def latex_table(df: DataFrame, most: int = 1000) -> str:
    def safe(v):
        return "" if v is None else "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))

    body = " \\\\\n".join(" & ".join(safe(v) for v in r) for r in _report_rows(df, most))
    head = " & ".join(safe(c) for c in df.columns)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{head} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}"


def json_report(df: DataFrame) -> str:
    """A one-row report as JSON text."""
    row = df.limit(2).toJSON().collect()
    if len(row) != 1:
        raise ValueError("a report has one row")
    return json.dumps(json.loads(row[0]), indent=2, sort_keys=True)


def p_value_text(p, exceedances, replicates):
    """``p < 1/B`` where no replicate exceeds, else four decimals; columns in, column out."""
    return F.when(exceedances == 0, F.format_string("p < %.4f", 1 / replicates)).otherwise(F.format_string("p = %.4f", p))
