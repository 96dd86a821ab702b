"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at a word that ends in . ! or ? and at line breaks; a sentence of more
than ``LONG`` words is taken in pieces of so many). A run is the fewest consecutive sentences, ``RUN``
at least, that have ``LEAST`` words; the runs that begin at each sentence and those that end at each
are hashed, so that both ends of a repeated passage are covered. Of all places with one hash the first, in the order of
(doc_id, text hash, place), stays; the sentences that any other covers are removed.

The borders of a passage that begins or ends within a sentence differ from text to text, so runs of
``WORDS`` words are hashed too, wherever they lie in sentences. They begin at the words whose hash is
the smallest of any ``WINDOW`` words in a row, the rightmost where hashes tie: a choice that rests on
those words alone. Every passage of ``WORDS + WINDOW - 1`` (51) words holds such a window, and after
its smallest word a whole run, so it shares a run with its other places whatever is around them. Of
these runs the words are removed, not the sentences; fewer than ``WINDOW`` words may stay at each end.
Places of a run that overlap its first one in the same text are not removed.

In each task the smallest place of a hash is found before anything is shuffled: the others are known
not to be first, and only the smallest is sent on. So a passage that a third of all documents share
is one row for each task, not for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import _LOWER, _ROLL, _SPACE, cut, dealing_keys, lean, mix, partitions, span_hashes, spans

RUN, LEAST, LONG = 3, 12, 16  # RUN and LEAST below 16
WINDOW, WORDS = 16, 36

_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?")]] = True


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first word of each sentence, starts of words, ends of words)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end = spans(raw, ~_SPACE[raw])
    if not len(start):
        return raw, start, start, end
    lines = np.cumsum(raw == 0x0A)[start]
    last = _STOP[raw[end - 1]]
    opens = np.ones(len(start), bool)
    opens[1:] = last[:-1] | (lines[1:] != lines[:-1])
    first = np.flatnonzero(opens)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    return raw, np.flatnonzero(place % LONG == 0), start, end


def word_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``WORDS`` words that begins at the smallest word of a window."""
    if len(words) < WORDS:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # the smallest value, the rightmost among equals: one comparison decides both
    least = (words & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(words), dtype=np.uint64))
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # the chosen place never moves left
    at = at[at + WORDS <= len(words)]
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        total = mix(total * _ROLL[k % 5] + words[at + k])
    return total + np.uint64(WORDS * 16), at


def span_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each run; a place is 16 times its first sentence plus its number of sentences,
    or 16 times its first word for a run of words.

    A sentence has a word at least, so a run has at most ``max(RUN, LEAST)`` sentences, below 16.
    """
    raw, first, start, end = sentences(text)
    m = len(first)
    if m < RUN:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = span_hashes(raw, start, end)
    bound = np.append(first, len(start))
    inside = np.arange(len(words)) - np.repeat(first, np.diff(bound))
    # a sentence's hash depends on its words and their places in it
    own = np.add.reduceat(mix(words + mix(inside.astype(np.uint64) + np.uint64(1))), first)
    own = mix(own + np.diff(bound).astype(np.uint64))
    at = np.arange(m)
    until = np.maximum(at + RUN, np.searchsorted(bound, bound[:-1] + LEAST))
    since = np.minimum(at + 1 - RUN, np.searchsorted(bound, bound[1:] - LEAST, "right") - 1)
    x, y = at[until <= m], until[until <= m]
    p, q = since[since >= 0], at[since >= 0] + 1
    places = np.union1d(x * 16 + (y - x), p * 16 + (q - p))
    x, n = places >> 4, places & 15
    total = np.zeros(len(places), np.uint64)
    for k in range(int(n.max(initial=0))):
        on = n > k
        total[on] = mix(total[on] * _ROLL[k % 5] + own[x[on] + k])
    key, word = word_runs(words)
    return np.concatenate([total + n.astype(np.uint64), key]), np.concatenate([places, word * 16])


def covered(places: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which of the ``n`` words of a text the places cover."""
    bound = np.append(first, n)
    x, k = places >> 4, places & 15
    of_words = k == 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.where(of_words, x, bound[np.where(of_words, 0, x)]), 1)
    np.add.at(edges, np.where(of_words, x + WORDS, bound[np.where(of_words, 0, x + k)]), -1)
    return np.cumsum(edges[:-1]) > 0


def without(text: str, removed: np.ndarray) -> str:
    """The text without the words marked, each with the white space after it."""
    raw, _, start, _ = sentences(text)
    keep = np.ones(len(raw), bool)
    keep[start[0] :] = np.repeat(~removed, np.diff(np.append(start, len(raw))))
    out = raw[keep].tobytes().decode("utf-8", "surrogatepass")
    return out.rstrip() if removed[-1] else out


def _again(key: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its hash, to be removed) for places sorted by hash, document, text and place."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    # the same place twice (a repeated row) is one place
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (at[1:] == at[:-1])])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    overlaps = (at & 15 == 0) & (doc == doc[lead]) & (h == h[lead]) & (at >> 4 < (at[lead] >> 4) + WORDS)
    return first, ~first & ~same & ~overlaps


_ROW = "bucket int, known binary, blob binary"


def _pack(doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> bytes:
    """Places sorted by document and text: number of texts, documents, text hashes, places of each, places."""
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    counts = np.diff(np.append(new, len(doc))).astype(np.uint32)
    return np.uint32(len(new)).tobytes() + doc[new].tobytes() + h[new].tobytes() + counts.tobytes() + at.astype(np.uint32).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, text hash, place) of each place, and where the places end."""
    m = int(np.frombuffer(raw, np.uint32, 1)[0])
    counts = np.frombuffer(raw, np.uint32, m, 4 + 16 * m)
    total = int(counts.sum())
    doc, h = (np.repeat(np.frombuffer(raw, np.int64, m, 4 + k * m), counts) for k in (0, 8))
    return doc, h, np.frombuffer(raw, np.uint32, total, 4 + 20 * m), 4 + 20 * m + 4 * total


def _emitter(keys: list[int]):
    """(doc, text hash, text) to packed removals known in this task, by bucket of the document, and packed first places, by bucket of the hash."""
    n = len(keys)

    def batch_of(bucket, known, blob):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known, pa.binary()), pa.array(blob, pa.binary())], names=["bucket", "known", "blob"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], []]
        held = 0

        def flush():
            key, doc, h, at = (np.concatenate(x) for x in rows)
            order = np.lexsort((at, h, doc, key))
            key, doc, h, at = key[order], doc[order], h[order], at[order]
            first, again = _again(key, doc, h, at)
            yield from removals(doc[again], h[again], at[again])
            key, doc, h, at = key[first], doc[first], h[first], at[first]
            part = (key % np.uint64(n)).astype(np.int64)
            order = np.lexsort((h, doc, part))
            key, doc, h, at, part = key[order], doc[order], h[order], at[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [_pack(doc[lo:hi], h[lo:hi], at[lo:hi]) + key[lo:hi].tobytes() for lo, hi in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]
            yield batch_of([keys[int(part[lo])] for lo in cuts], [None] * len(blobs), blobs)

        for batch in batches:
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                key, at = span_keys(text.as_py())
                if len(at):
                    for column, v in zip(rows, (key, np.full(len(at), doc), np.full(len(at), h), at), strict=True):
                        column.append(v)
                    held += len(at)
                if held > 1_000_000:
                    yield from flush()
                    rows, held = [[], [], [], []], 0
        if held:
            yield from flush()

    def removals(doc, h, at):
        """One row for each bucket of documents, however many documents and places."""
        if not len(doc):
            return
        part = doc % n
        order = np.lexsort((at, h, doc, part))
        doc, h, at, part = doc[order], h[order], at[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [_pack(doc[lo:hi], h[lo:hi], at[lo:hi]) for lo, hi in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]
        yield batch_of([keys[int(part[lo])] for lo in cuts], blobs, [None] * len(blobs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First places by hash: all but the smallest are removals; removals already known pass."""
        parts: list[list] = [[], [], [], []]
        for batch in batches:
            known = batch.filter(batch.column("known").is_valid())
            if known.num_rows:
                yield known
            for blob in batch.column("blob").filter(batch.column("blob").is_valid()):
                raw = blob.as_buffer().to_pybytes()
                *places, end = _unpack(raw)
                for column, v in zip(parts, (np.frombuffer(raw, np.uint64, len(places[0]), end), *places), strict=True):
                    column.append(v)
        if not parts[0]:
            return
        key, doc, h, at = (np.concatenate(x) for x in parts)
        order = np.lexsort((at, h, doc, key))
        key, doc, h, at = key[order], doc[order], h[order], at[order]
        _, later = _again(key, doc, h, at)
        yield from removals(doc[later], h[later], at[later])

    return emit, find


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removals of a bucket of documents, one row for each text."""
    parts: list[list] = [[], [], []]
    for batch in batches:
        for blob in batch.column("known"):
            for column, v in zip(parts, _unpack(blob.as_buffer().to_pybytes())[:3], strict=True):
                column.append(v)
    if not parts[0]:
        return
    doc, h, at = (np.concatenate(x) for x in parts)
    order = np.lexsort((at, h, doc))
    doc, h, at = doc[order], h[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    ends = np.append(new[1:], len(doc))
    for lo in range(0, len(new), 50_000):
        s, e = new[lo : lo + 50_000], ends[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(h[s]), pa.array([at[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary())], names=["doc", "h", "at"])


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut from the text. See ``span_report``."""
    return span_report(docs, id_col, text_col, chars_col).select("row.*")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``row``, a struct of the columns of ``docs`` with the repeated passages cut from the text, and
    ``n_sentences`` and ``n_removed``, the number of sentences and of those that lost words.

    A column ``n_chars`` of the input is set to the new length. Null texts stay null; texts of which
    nothing is left become empty. Rows with a null id are kept as they are and count for nothing;
    rows equal in id and text are one document; rows of one id with different texts are told apart.
    Texts of any length are read whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    emit, find = _emitter(dealing_keys(spark, n))
    h = F.xxhash64(F.col(f"`{text_col}`"))
    usable = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), h.alias("h"), F.col(f"`{text_col}`").alias("text")).where("doc is not null and text is not null")
    found = cut(usable.mapInArrow(lean(emit), _ROW).repartition(n, "bucket").mapInArrow(lean(find), _ROW), "removals")
    removals = found.select("bucket", "known").repartition(n, "bucket").mapInArrow(lean(_merge), "doc long, h long, at binary")
    # the row travels as one column, so that no name of its columns can clash with those used here
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), h.alias("h"), text.alias("text"))
    joined = rows.join(removals, ["doc", "h"], "left").select("row", "text", "at")
    kept = joined.schema["row"]
    names = [x.lower() for x in docs.columns]
    text_at = names.index(text_col.lower())
    chars_at = names.index(chars_col.lower()) if chars_col.lower() in names else None
    schema = T.StructType([kept, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars, totals, gone = [], [], [], []
            for text, places in zip(*batch.columns[1:], strict=True):
                t = text.as_py()
                _, first, start, _ = sentences(t or "")
                lost = 0
                if blob := places.as_py():
                    removed = covered(np.frombuffer(blob, np.uint32).astype(np.int64), first, len(start))
                    lost = int(np.logical_or.reduceat(removed, first).sum())
                    t = without(t, removed)
                texts.append(t)
                chars.append(None if t is None else len(t))
                totals.append(len(first))
                gone.append(lost)
            fields = list(batch.schema.field(0).type)
            columns = batch.column(0).flatten()
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array(chars, pa.int64()).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=["row", "n_sentences", "n_removed"])

    return joined.mapInArrow(lean(remove), schema)
