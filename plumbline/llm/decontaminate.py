"""Benchmark decontamination: a prefix-filtered join of document words with benchmark windows.

The words of all benchmark windows are ordered by rarity, counted over all documents. A document can
hold a window only where it has the window's rarest word, so that word alone is the window's
necessary prefix; its place in the window bounds where the window would start and end. Only places
that pass both bounds are verified word by word, over the whole window: by the hashes of the words
first, then by their bytes.

The benchmark is a stated query set: it is applied in blocks of at most ``BLOCK`` windows (16 MB of
hashes), each against all documents, so what is sent to the executors has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import _LOWER, cut, lean, span_hashes, spans

WINDOW = 10
BLOCK = 200_000

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@dataclass
class Words:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased: its bytes, their places and hashes."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def joined(self, at: int, n: int) -> bytes:
        """``n`` words from ``at``, each with a blank after it."""
        return b"".join(self.raw[x:y].tobytes() + b" " for x, y in zip(self.start[at : at + n], self.end[at : at + n], strict=True))


def benchmark_words(text: str | None) -> Words:
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    start, end = spans(raw, _WORD[raw])
    return Words(raw, start, end, span_hashes(raw, start, end))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(item ids, item of each window, length of each window, words of each window padded with 0, their bytes)."""
    items, of, lengths, rows, texts = [], [], [], [], []

    def block():
        return items, np.array(of, np.int64), np.array(lengths, np.int64), np.array(rows, np.uint64).reshape(-1, window), texts

    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = benchmark_words(r.t)
        if not len(words):
            continue
        items.append(r.i)
        for k in range(max(1, len(words) - window + 1)):
            part = words.hashes[k : k + window]
            of.append(len(items) - 1)
            lengths.append(len(part))
            texts.append(words.joined(k, len(part)))
            rows.append(np.pad(part, (0, window - len(part))))
            if len(rows) >= BLOCK:
                yield block()
                items, of, lengths, rows, texts = [r.i], [], [], [], []
    if rows:
        yield block()


def _counted(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the (sorted) vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0):
                words = benchmark_words(text.as_py()).hashes
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == words], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(text_col).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.word] = r.n  # at most one row for each word of the block
    return out


class _Matcher:
    """The windows of one block, reachable by their rarest word."""

    def __init__(self, items, of, lengths, rows, texts, vocabulary, counts):
        window = rows.shape[1]
        inside = np.arange(window) < lengths[:, None]
        rarity = np.where(inside, counts[np.searchsorted(vocabulary, rows).clip(0, len(vocabulary) - 1)], np.iinfo(np.int64).max)
        offset = rarity.argmin(axis=1)
        prefix = rows[np.arange(len(rows)), offset]
        order = np.argsort(prefix, kind="stable")
        self.items, self.of, self.lengths, self.rows, self.offset = items, of[order], lengths[order], rows[order], offset[order]
        self.texts = [texts[k] for k in order]
        self.prefix, self.first = np.unique(prefix[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(rows)))

    def match(self, text: Words, hit: np.ndarray) -> np.ndarray:
        """Marks the words inside occurrences in ``hit``; returns the indexes of the items that occur."""
        words = text.hashes
        at = np.minimum(np.searchsorted(self.prefix, words), len(self.prefix) - 1)
        place = np.flatnonzero(self.prefix[at] == words)
        if not len(place):
            return np.empty(0, np.int64)
        found = []
        for lo in range(0, len(place), 50_000):
            p = place[lo : lo + 50_000]
            n = self.count[at[p]]
            w = np.repeat(self.first[at[p]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(p, n) - self.offset[w]
            ok = (start >= 0) & (start + self.lengths[w] <= len(words))
            w, start = w[ok], start[ok]
            for k in range(self.rows.shape[1]):
                if not len(w):
                    break
                over = self.lengths[w] <= k
                ok = over | (words[np.where(over, start, start + k)] == self.rows[w, k])
                w, start = w[ok], start[ok]
            ok = np.array([text.joined(x, self.lengths[k]) == self.texts[k] for k, x in zip(w, start, strict=True)], bool)
            w, start = w[ok], start[ok]
            for length in np.unique(self.lengths[w]):
                s = np.unique(start[self.lengths[w] == length])
                hit[(s[:, None] + np.arange(length)).ravel()] = True
            found.append(np.unique(self.of[w]))
        return np.unique(np.concatenate(found))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None, drop: bool = False) -> DataFrame:
    """``row`` (a struct of the columns that ``carry`` names, all if None), ``n_words``, ``hit`` (packed
    bits, one for each word) and ``items`` (ids as strings, sorted) for every row of ``docs``.

    With ``drop``, contaminated documents are left out instead. Null texts have no words; rows that
    repeat a document, or have a null id, are judged by their own texts; benchmark items without words
    have no windows and a null item id counts as the empty string; an item that is there twice
    counts once; an empty benchmark marks nothing. Texts of any length are read whole.
    """
    carry = docs.columns if carry is None else carry
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    # the row travels as one column, so that no name of its columns can clash with those used here
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    step, first = docs.select(row, F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items")), True
    kept = step.schema["row"]
    block = next(blocks, None)
    while block is not None or first:
        following = next(blocks, None) if block is not None else None
        matcher = None
        if block is not None:
            inside = np.arange(window) < block[2][:, None]
            vocabulary = np.unique(block[3][inside])
            matcher = docs.sparkSession.sparkContext.broadcast(_Matcher(*block, vocabulary, _counted(docs, text_col, vocabulary)))
        last = following is None

        def apply(batches: Iterator[pa.RecordBatch], matcher=matcher, last=last) -> Iterator[pa.RecordBatch]:
            m = matcher.value if matcher else None
            for batch in batches:
                counts, hits, items = [], [], []
                for text, before, known in zip(*batch.columns[1:], strict=True):
                    words = benchmark_words(text.as_py())
                    hit = np.unpackbits(np.frombuffer(before.as_py(), np.uint8), count=len(words)).view(bool).copy() if before.is_valid else np.zeros(len(words), bool)
                    found = set(known.as_py() or ())
                    if m and len(words):
                        found |= {m.items[i] for i in m.match(words, hit)}
                    counts.append(len(words))
                    hits.append(np.packbits(hit).tobytes())
                    items.append(sorted(found))
                second = pa.array(counts, pa.int64()) if last else batch.column(1)
                out = pa.RecordBatch.from_arrays([batch.column(0), second, pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words" if last else "text", "hit", "items"])
                yield out.filter(pa.array([not i for i in items], pa.bool_())) if last and drop else out

        second = T.StructField("n_words", T.LongType()) if last else T.StructField("text", T.StringType())
        schema = T.StructType([kept, second, T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
        step, first = step.mapInArrow(lean(apply), schema), False
        if not last:
            step = cut(step, "decontaminate")
        block = following
    return step


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    marked = mark_contaminated(docs, benchmark, carry=["doc_id"])
    bits = F.regexp_replace(F.hex("hit"), "0", "")
    hits = sum((F.length(bits) - F.length(F.regexp_replace(bits, f"[{digits}]", ""))) * n for n, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")))
    return marked.select(
        "row.doc_id",
        "n_words",
        hits.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark window."""
    return mark_contaminated(docs, benchmark, drop=True).select("row.*")
