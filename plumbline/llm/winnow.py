"""Document fingerprints by winnowing.

The fingerprint of a text is the set of the smallest rolling hashes of its k-grams in every window
of w k-grams, the rightmost where hashes tie, with their positions. Any common substring of at
least ``w + k - 1`` code points gives two texts a common fingerprint hash. A text shorter than a
k-gram has one hash, of the whole; one with fewer than w k-grams has one window.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dealing_keys, mix, partitions

K, W = 12, 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-grams: a polynomial, built up in log2(k) doublings."""
    x = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    x ^= x >> np.uint64(32)
    total, width = None, 0
    block, size = x, 1
    while True:
        if k & size:
            if total is None:
                total, width = block, size
            else:
                n = len(points) - (width + size) + 1
                shift = np.uint64(pow(int(_MULTIPLIER), size, 2**64))
                total = total[:n] * shift + block[width : width + n]
                width += size
        if size * 2 > k:
            break
        n = len(points) - 2 * size + 1
        block = block[:n] * np.uint64(pow(int(_MULTIPLIER), size, 2**64)) + block[size : size + n]
        size *= 2
    return (mix(total) >> np.uint64(32)).astype(np.uint32)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) selected from the text; both empty for an empty text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if len(points) < k:
        whole = int.from_bytes(hashlib.blake2b(points.tobytes(), digest_size=4).digest(), "little")
        return np.array([whole], np.uint32), np.zeros(1, np.int64)
    h = _grams(points, k)
    # the smallest value, the rightmost among equals: one comparison decides both
    keyed = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w = min(w, len(h))
    least, size = keyed, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        n = len(h) - w + 1
        least = np.minimum(least[:n], least[w - size : w - size + n])
    at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # the chosen place never moves left
    return h[at], at


def encode(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Base64 of the hashes (4 bytes each), a dot, base64 of the steps between positions (2 bytes each)."""
    steps = np.diff(positions, prepend=0).astype("<u2")
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode() + "." + base64.b64encode(steps.tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    a, b = fingerprint.split(".")
    return np.frombuffer(base64.b64decode(a), "<u4"), np.cumsum(np.frombuffer(base64.b64decode(b), "<u2"), dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / union if (union := len(a) + len(b) - common) else 1.0


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``_OUT`` for columns.

    The edited text takes its last half from the next document in ascending ``doc_id`` (null ids
    first; equal ids by text, null as empty; the first follows the last). Texts travel once,
    compressed, to range partitions of ``doc_id``; the first rows of each partition go to the one
    before it as well, so that every document meets its next without a global window.
    """
    spark = docs.sparkSession
    low = -(2**63)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    # exact bounds are not needed, only even ones that all tasks share
    bounds = sorted(set(base.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []))
    bounds = [int(b) for b in bounds]
    limits = np.array(bounds, np.int64)

    def bucket_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            b = np.searchsorted(limits, ids, "right")
            for k in np.unique(b):
                least[int(k)] = min(least.get(int(k), 2**63 - 1), int(ids[b == k].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], names=["b", "id"])

    keys = dealing_keys(spark, n)
    heads = {r.b: r.id for r in base.select("id").mapInArrow(bucket_heads, "b long, id long").groupBy("b").agg(F.min("id").alias("id")).collect()}  # one for each partition
    filled = sorted(heads)
    before = {heads[b]: filled[k - 1] for k, b in enumerate(filled)}  # the partition that needs this head, the last one for the first head

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, none, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                packed = z.compress(text.as_py().encode("utf-8", "surrogatepass"))
                to = [(keys[int(np.searchsorted(limits, i, "right"))], False)]
                if i in before:
                    to.append((keys[before[i]], True))
                for b, halo in to:
                    for column, v in zip(rows, (b, halo, i, none, packed), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["b", "halo", "id", "none", "z"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        out: list[list] = [[] for _ in range(7)]

        def flush():
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            got = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])
            for v in out:
                v.clear()
            return got

        def report(doc, following):
            (i, text, (h, at)), (_, other, (g, _)) = doc, following
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            eh, eat = winnow(edited)
            values = (i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(h, at), encode(eh, eat), likeness(h, eh), likeness(h, g))
            for column, v in zip(out, values, strict=True):
                column.append(v)

        def documents():
            """The rows in order, those of equal ids by text; (bucket, halo, doc)."""
            held, key = [], None
            for batch in batches:
                for b, halo, i, none, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (b, halo, i) != key and held:
                        yield from sorted(held, key=lambda x: x[2][1])
                        held = []
                    key = (b, halo, i)
                    text = unzip.decompress(z).decode("utf-8", "surrogatepass")
                    held.append((b, halo, (None if none else i, text, None)))
            yield from sorted(held, key=lambda x: x[2][1])

        last, last_bucket, met = None, None, False
        for b, halo, (i, text, _) in documents():
            if b != last_bucket:
                last, last_bucket, met = None, b, False
            if halo and met:
                continue  # only the first of the next partition's head rows follows
            met = halo
            doc = (i, text, winnow(text))
            if last:
                report(last, doc)
                if len(out[0]) >= 500:
                    yield flush()
            last = doc
        if out[0]:
            yield flush()

    dealt = base.mapInArrow(deal, "b int, halo boolean, id long, none boolean, z binary")
    return dealt.repartition(n, "b").sortWithinPartitions("b", "halo", "id").mapInArrow(prints, _OUT)
