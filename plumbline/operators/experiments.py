"""Controlled experiments: section parsing, donor chunks, replacements, variants and greedy host selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Section names that bound a body, and those whose body may be chosen.
BOUNDARY_NAMES = (
    "Brief Hospital Course", "Hospital Course by", "Summary of Hospital Course", "Hospital Course",
    "History of Present Illness", "HPI", "Assessment and Plan", "Assessment", "Plan",
    "Discharge Medications", "Medications on Discharge", "Medications at Discharge",
    "Discharge Instructions", "Pertinent Results", "Pertinent Labs", "Pertinent Studies",
    "Past Medical History", "PMH", "Chief Complaint", "CC",
)
PRIMARY, SECONDARY = ("brief hospital course", "hospital course"), ("history of present illness",)

_HEADER = re.compile(r"^[ \t]*(" + "|".join(map(re.escape, BOUNDARY_NAMES)) + r")[ \t]*:", re.I | re.M)
_LABEL = re.compile(r"^[ \t]*[A-Z][A-Za-z /\-]{2,40}:[ \t]*", re.M)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def section_of(text: str | None, least: int) -> tuple | None:
    """(kind, header, start, end) of the longest primary body of ``least`` stripped characters, else secondary; the earliest of equals."""
    best: dict[str, tuple] = {}
    heads = list(_HEADER.finditer(text or ""))
    for head, following in zip(heads, [*heads[1:], None][: len(heads)], strict=True):
        name = head[1].casefold()
        kind = "primary" if name in PRIMARY else "secondary" if name in SECONDARY else None
        end = following.start() if following else len(text)
        if kind and len(text[head.end() : end].strip()) >= least and (kind not in best or end - head.end() > best[kind][3] - best[kind][2]):
            best[kind] = (kind, head[1], head.end(), end)
    return best.get("primary") or best.get("secondary")


def parsed_sections(df: DataFrame, text: str, least: int = 500) -> DataFrame:
    """Adds ``section``: a struct of kind, header, body_start and body_end, null if no body is long enough."""
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("header", T.StringType()), T.StructField("body_start", T.IntegerType()), T.StructField("body_end", T.IntegerType())])

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.DataFrame:
        found = [section_of(t, least) or (None, None, None, None) for t in texts]
        return pd.DataFrame(found, columns=kind.names).astype({"body_start": "Int32", "body_end": "Int32"})

    s = df.withColumn("section", parse(F.col(text)))
    return s.select(*df.columns, *[F.col(f"section.{c}").alias(c) for c in kind.names])


def _sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    marks = [m.span() for m in _SENTENCE_END.finditer(text, start, end)]
    return list(zip([start, *(b for _, b in marks)], [*(a for a, _ in marks), end], strict=True))


def report_chunks(text: str | None, long: int = 600, short: int = 20) -> list[tuple[int, int, str]] | None:
    """(start, end, collapsed text) of the pieces of a findings body; None without one.

    The body runs from the findings header to the impression header. Inner labels part it into
    pieces; pieces longer than ``long``, and a body without labels, fall into sentences.
    """
    text = text or ""
    opening = re.search(r"FINDINGS?:", text, re.I)
    if not opening:
        return None
    closing = re.compile(r"IMPRESSIONS?:", re.I).search(text, opening.end())
    lo, hi = opening.end(), closing.start() if closing else len(text)
    labels = [m.span() for m in _LABEL.finditer(text, lo, hi)]
    pieces = list(zip([lo, *(b for _, b in labels)], [*(a for a, _ in labels), hi], strict=True))
    out = []
    for a, b in pieces:
        for x, y in _sentence_spans(text, a, b) if not labels or b - a > long else [(a, b)]:
            body = text[x:y]
            x, y = x + len(body) - len(body.lstrip()), y - len(body) + len(body.rstrip())
            line = " ".join(text[x:y].split()) if x < y else ""
            if len(line) >= short:
                out.append((x, y, line))
    return out


def donor_chunks(reports: DataFrame, text: str) -> DataFrame:
    """One row for each chunk (``chunk_order, start, end, chunk``); a report without chunks keeps one row of nulls."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("chunk", T.StringType())]))

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "chunk": c} for a, b, c in report_chunks(t) or []] for t in texts])

    exploded = reports.withColumn("_c", parse(F.col(text))).select("*", F.posexplode_outer("_c").alias("chunk_order", "_x"))
    return exploded.select(*reports.columns, "chunk_order", "_x.start", "_x.end", "_x.chunk")


def permuted_sentences(df: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """Adds ``permuted`` (bulleted sentences in an order seeded by the key), ``n_sentences`` and ``same_multiset``; an identity is rolled by one."""
    kind = T.StructType([T.StructField("permuted", T.StringType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("same_multiset", T.BooleanType())])

    @F.pandas_udf(kind)
    def permute(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for k, t in zip(keys, texts, strict=True):
            s = [" ".join(x.split()) for x in _SENTENCE_END.split(t or "") if x.strip()]
            order = np.random.default_rng([seed, int(k or 0)]).permutation(len(s))
            if len(s) > 1 and (order == np.arange(len(s))).all():
                order = np.roll(order, -1)
            new = [s[i] for i in order]
            out.append(("\n".join(f"- {x}" for x in new), len(s), sorted(new) == sorted(s)))
        return pd.DataFrame(out, columns=kind.names)

    rows = df.withColumn("_p", permute(F.col(key), F.col(text)))
    return rows.select(*df.columns, "_p.permuted", "_p.n_sentences", "_p.same_multiset")


def replacement_bodies(hosts: DataFrame, donors: DataFrame, host: str, target: str, most_chunks: int = 80, seed: int = 42) -> DataFrame:
    """For each host, chunks of donors in a seeded order until their text reaches ``target`` characters.

    ``hosts (host, subject, target)`` and ``donors (subject, donor, chunk_order, chunk)``: a donor of
    the host's own subject is never used. Hosts are a bounded selection and are broadcast. A donor
    gives one chunk at least, so the first ``most_chunks`` donors of a host's order are enough: a
    limited window finds them before any chunk is joined. ``complete`` is false where the chunks
    run out or ``most_chunks`` is met.
    """
    chosen = F.broadcast(hosts.select(F.col(host).alias("_h"), F.col("subject").alias("_hs"), F.col(target).alias("_need")))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_h").cast("string"), F.col("donor").cast("string")))
    mine = Window.partitionBy("_h")
    places = donors.select("subject", "donor").distinct().join(chosen, F.col("subject") != F.col("_hs")).withColumn("_place", F.row_number().over(mine.orderBy(draw, "donor"))).where(F.col("_place") <= most_chunks)
    rows = donors.withColumn("_i", F.row_number().over(Window.partitionBy("donor").orderBy("chunk_order"))).where(F.col("_i") <= most_chunks)
    rows = rows.select("donor", "_i", "chunk").join(F.broadcast(places.select("_h", "_need", "donor", "_place")), "donor")
    order = mine.orderBy("_place", "_i")
    length = F.coalesce(F.sum(F.length("chunk") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1, F.lit(0))
    taken = rows.withColumn("_at", F.row_number().over(order)).withColumn("_before", length).where((F.col("_at") <= most_chunks) & (F.col("_before") < F.col("_need")))
    listed = taken.groupBy("_h").agg(F.sort_array(F.collect_list(F.struct("_at", "donor", "chunk"))).alias("l"))  # most_chunks entries
    out = hosts.select(F.col(host), F.col(target).alias("_need")).join(listed.withColumnRenamed("_h", host), host, "left")
    body = F.coalesce(F.array_join(F.transform("l", lambda x: x["chunk"]), "\n"), F.lit(""))
    names = F.coalesce(F.array_join(F.array_distinct(F.transform("l", lambda x: x["donor"].cast("string"))), ","), F.lit(""))
    return out.select(host, F.when(F.col("l").isNull(), 0).otherwise(F.size("l")).alias("n_chunks"), F.length(body).alias("length"), (F.length(body) >= F.col("_need")).alias("complete"), names.alias("donors"), body.alias("body"))


def greedy_hosts(candidates: DataFrame, cohort: str, subject: str, score: str, tie: str, eligible: str, n: int, seed: int = 42) -> DataFrame:
    """Per cohort: the n highest eligible rows and n of the rest in a seeded order, no subject twice over both arms.

    To go down an order and skip a subject that was taken is to take the best row of each subject:
    an aggregate and a limited window for each arm, over all candidates. ``passed_over`` counts
    the better rows that were skipped; the few selected rows are broadcast to count them.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(tie).cast("string")))
    rows = candidates.select(cohort, F.col(subject).alias("_s"), F.col(tie).alias("_t"), F.col(eligible).alias("_e"), (-F.col(score)).alias("_top"), draw.alias("_random"))

    def arm(pool: DataFrame, name: str) -> DataFrame:
        first = pool.groupBy(cohort, "_s").agg(F.min(F.struct(f"_{name}", "_t")).alias("_b"))
        place = F.row_number().over(Window.partitionBy(cohort).orderBy("_b"))
        found = first.withColumn("selection_order", place).where(F.col("selection_order") <= n).withColumnRenamed(cohort, "_c")
        above = (F.col(cohort) == F.col("_c")) & (F.struct(f"_{name}", "_t") < F.col("_b"))
        better = rows.select(cohort, f"_{name}", "_t").join(F.broadcast(found), above).groupBy("_c", "_s").agg(F.count("*").alias("_n"))
        out = found.join(F.broadcast(better), ["_c", "_s"], "left")
        return out.select(F.col("_c").alias(cohort), F.col("_b._t").alias(tie), F.col("_s").alias(subject), F.lit(name).alias("arm"), "selection_order", (F.coalesce("_n", F.lit(0)) - F.col("selection_order") + 1).cast("int").alias("passed_over"))

    top = arm(rows.where("_e"), "top")
    rest = rows.where("_e").join(F.broadcast(top.select(cohort, F.col(subject).alias("_s"))), [cohort, "_s"], "left_anti")
    return top.unionByName(arm(rest, "random"))


class HashingEncoder:
    """A deterministic stand-in for a text encoder: signed feature hashing of tokens, one vector for each window."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, windows: list[list[str]]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(windows), self.dimensions))
        for k, window in enumerate(windows):
            for token in window:
                h = crc32(token.encode())
                out[k, h % self.dimensions] += 1 if h >> 31 else -1
            if norm := np.linalg.norm(out[k]):
                out[k] /= norm
        return out


def embedded(df: DataFrame, key: str, windows: str, encoder: HashingEncoder, strict: bool = True) -> DataFrame:
    """``key, embedding, n_windows``: the mean of the encoder's vectors of all windows.

    Without windows the vector is zero. A vector that isn't finite fails the job if ``strict``,
    and is replaced by zeros otherwise.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = []
            for w in f[windows]:
                v = encoder.encode([list(x) for x in w]).mean(axis=0) if len(w) else np.zeros(encoder.dimensions)
                if not np.isfinite(v).all():
                    if strict:
                        raise ValueError("an embedding is not finite")
                    v = np.zeros(encoder.dimensions)
                vectors.append(v.astype(np.float32))
            yield pd.DataFrame({key: f[key], "embedding": vectors, "n_windows": [len(w) for w in f[windows]]})

    return df.select(key, windows).mapInPandas(run, f"{key} long, embedding array<float>, n_windows int")
