"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document (keep, reject or no vote).  Their accuracies
are unknown; expectation maximisation estimates them, and the share of bad documents, from how often
each pattern of votes occurs in the whole corpus.  The posterior of each pattern then labels a
bounded sample of documents, on which a linear scorer over hashed words, hashed word beginnings,
shape measures and votes is trained.  The scorer decides on every document.

Two labellers are learned from a bounded sample of labelled rows: a greedy cover of the toxic
documents by words and word beginnings that clean ones lack, dealt to two labellers by turns, so
that their votes overlap with others but not in what they look for.  The reviewers' labels
themselves are a labeller too, silent on most documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import _LOWER, _SPACE, lean, mix, span_hasher, spans

#: Bounds of what is fitted on: labelled rows for the lexicon, documents for the scorer. Both samples
#: are the rows of smallest hash, so they do not depend on partitions or the order of rows.
LABELLED_ROWS, TRAIN_ROWS = 4000, 6000
DIMENSIONS = 1 << 18
BEGINNINGS = (4, 5, 6)
#: Beginnings of words that go on for at most ``REST`` bytes.
STEMS, REST = (4, 5, 6, 7, 8), 6
THRESHOLD = 0.5
ROUNDS = 200
L1, RATE, RIDGE = 1e-3, 0.1, 0.1
#: Rows whose tokens the fit handles at a time.
TRAIN_BLOCK = 200

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[0x80:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~=+<>\\/_|"]] = True
_PLAIN_END = _WORD.copy()
_PLAIN_END[[ord(c) for c in "0123456789.,;:?)'\"]"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SHAPES = ("symbols", "shouts", "bars", "repeats", "pairs", "capitals", "letters", "decorated")


def bytes_of(text: str):
    """(bytes, hasher of spans of the lower-cased bytes)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return raw, span_hasher(_LOWER[raw])


def tokens(text: str, read=None) -> np.ndarray:
    """Sorted distinct hashes of lower-cased words, of their beginnings, and of the stems of words with a short rest."""
    raw, hashes = read or bytes_of(text)
    start, end = spans(raw, _WORD[raw])
    if not len(start):
        return np.empty(0, np.uint64)
    words, first = np.unique(hashes(start, end), return_index=True)
    start, end = start[first], end[first]  # each word once
    size = end - start
    parts = [words]
    for k in BEGINNINGS:
        at = start[size >= k]
        parts.append(mix(hashes(at, at + k) + np.uint64(k)))
    for k in STEMS:
        at = start[(size > k) & (size <= k + REST)]
        parts.append(mix(hashes(at, at + k) + np.uint64(1000 + k)))
    found = np.concatenate(parts)
    found.sort()
    return found[np.append(True, found[1:] != found[:-1])]


def buckets(tok: np.ndarray) -> np.ndarray:
    """The scorer's dimensions of tokens."""
    return (tok & np.uint64(DIMENSIONS - 1)).astype(np.uint32)


def shape(text: str, read=None) -> np.ndarray:
    """Shares that tell junk from prose; see ``_SHAPES``. Those of a text without words are a prose text's."""
    raw, span_hash = read or bytes_of(text)
    start, end = spans(raw, ~_SPACE[raw])
    n = len(start)
    if not n:
        return np.array([0, 0, 0, 0, 1, 0, 1, 0], float)
    hashes = span_hash(start, end)
    last = raw[end - 1]
    tripled = (end - start >= 4) & _SYMBOL[last] & (raw[np.maximum(end - 2, 0)] == last) & (raw[np.maximum(end - 3, 0)] == last)
    shouts = (end - start >= 3) & (last == 33) & (raw[np.maximum(end - 2, 0)] == 33)
    bars = (end - start == 1) & _SYMBOL[last]
    repeats = (hashes[1:] == hashes[:-1]).sum() / n
    both = np.sort(hashes[1:] + hashes[:-1] * np.uint64(3))
    pairs = (1 + np.count_nonzero(both[1:] != both[:-1])) / (n - 1) if n > 1 else 1.0
    letters = _WORD[raw].sum()
    return np.array([tripled.mean(), shouts.mean(), bars.mean(), repeats, pairs, _UPPER[raw].sum() / max(1, letters), letters / max(1, (~_SPACE[raw]).sum()), (~_PLAIN_END[last]).mean()])


def _shape_votes(s: np.ndarray) -> np.ndarray:
    """Votes of the shape labellers: 1 reject, 0 keep, 2 no vote."""
    high = np.array([0.2, 0.2, 0.2, 0.3, 0.0, 0.6, 0.0, 0.25])
    low = np.array([0.02, 0.02, 0.02, 0.06, 2.0, 0.25, 2.0, 0.08])
    votes = np.where(s > high, 1, np.where(s < low, 0, 2))
    votes[4] = 1 if s[4] < 0.3 else 0 if s[4] > 0.5 else 2
    votes[6] = 1 if s[6] < 0.5 else 0 if s[6] > 0.85 else 2
    return votes


@dataclass
class Lexicon:
    """Sorted token hashes of the two learned labellers."""

    parts: tuple[np.ndarray, np.ndarray]

    def votes(self, tok: np.ndarray) -> list[int]:
        out = []
        for part in self.parts:
            if not len(part):
                out.append(2)
                continue
            at = np.searchsorted(tok, part)
            out.append(int(bool((tok[np.minimum(at, len(tok) - 1)] == part).any())) if len(tok) else 0)
        return out


def votes_of(text: str | None, lexicon: Lexicon, label: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = text or ""
    read = bytes_of(text)
    tok, s = tokens(text, read), shape(text, read)
    return np.array([*_shape_votes(s), *lexicon.votes(tok), 2 if label is None else label]), tok, s


def _label(quality, toxic):
    """The reviewers' vote: reject what is of low quality or toxic; null labels are none."""
    return F.when(F.col(quality).isNull() & F.col(toxic).isNull(), None).otherwise(((F.coalesce(quality, F.lit(1)) == 0) | (F.coalesce(toxic, F.lit(0)) == 1)).cast("int"))


def _clean_labels(labels: DataFrame) -> DataFrame:
    both = labels.select(F.col("doc_id").cast("string").alias("_doc"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("_doc is not null")
    return both.groupBy("_doc").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))  # of several labels the stricter counts


class _Tally:
    """Sorted distinct tokens and in how many rows they are; of the rows only a few are held at a time."""

    def __init__(self):
        self.known, self.count, self.rows, self.held = np.empty(0, np.uint64), np.empty(0, np.int64), 0, []

    def add(self, tok: np.ndarray) -> None:
        self.rows += 1
        self.held.append(tok)
        if len(self.held) >= 128:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        new, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held = []
        at = np.searchsorted(self.known, new)
        old = np.zeros(len(new), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == new[inside]
        self.count[at[old]] += n[old]
        self.known, self.count = np.insert(self.known, at[~old], new[~old]), np.insert(self.count, at[~old], n[~old])


def _among(tok: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places in the sorted ``known`` of the tokens that are there."""
    if not len(known):
        return np.empty(0, np.int64)
    at = np.searchsorted(known, tok).clip(0, len(known) - 1)
    return at[known[at] == tok]


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A greedy cover of the toxic documents of a bounded labelled sample; see the module's text."""
    chosen = _clean_labels(labels).withColumn("_o", F.xxhash64("_doc"))
    third = LABELLED_ROWS // 3
    chosen = chosen.where("toxic = 1").orderBy("_o").limit(third).unionByName(chosen.where("coalesce(toxic, 0) = 0").orderBy("_o").limit(LABELLED_ROWS - third))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(t.as_py() or "").tobytes() for t in batch.column(1)], pa.binary())], names=["toxic", "tokens"])

    # at most LABELLED_ROWS rows are broadcast
    rows = docs.select(F.col("doc_id").cast("string").alias("_doc"), "text").join(F.broadcast(chosen.select("_doc", F.coalesce("toxic", F.lit(0)).alias("toxic"))), "_doc")
    # rows that repeat a document are one
    rows = rows.groupBy("_doc", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    got = rows.mapInArrow(lean(read), "toxic int, tokens binary").toLocalIterator()
    toxic, clean, bad = [], _Tally(), _Tally()
    for r in got:
        tok = np.frombuffer(r.tokens, np.uint64)
        if r.toxic:
            toxic.append(tok)
            bad.add(tok)
        else:
            clean.add(tok)
    clean.merge()
    bad.merge()
    empty = np.empty(0, np.uint64)
    if not toxic or not clean.rows:
        return Lexicon((empty, empty))
    in_clean = np.zeros(len(bad.known), np.int64)
    place = np.searchsorted(clean.known, bad.known).clip(0, max(0, len(clean.known) - 1))
    if len(clean.known):
        in_clean = np.where(clean.known[place] == bad.known, clean.count[place], 0)
    least = max(3, int(np.ceil(0.002 * len(toxic))))
    # a token is taken only if clean documents nearly lack it; rarer ones than ``least`` never are
    fit = (in_clean <= 0.001 * bad.count * clean.rows / len(toxic)) & (bad.count >= least)
    known, count = bad.known[fit], bad.count[fit]
    del clean, bad
    found = [_among(t, known) for t in toxic]
    at, doc = np.concatenate(found), np.repeat(np.arange(len(toxic)), [len(x) for x in found])
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(known) + 1))
    allowed, covers = np.ones(len(known), bool), []
    for _ in range(2):  # the second cover does without what the first has taken
        open_docs, picked, gain = np.ones(len(toxic), bool), [], np.where(allowed, count, 0)
        while len(picked) < 200 and len(known):
            best = int(gain.argmax())
            if gain[best] < least:
                break
            members = doc[order[begin[best] : begin[best + 1]]]
            now = int(open_docs[members].sum())
            if now < gain[best]:
                gain[best] = now  # some are covered already; others may have more that aren't
                continue
            picked.append(best)
            open_docs[members] = False
            gain[best] = 0
        allowed[picked] = False
        covers.append(np.sort(known[picked]) if picked else empty)
    return Lexicon((covers[0], covers[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation maximisation over distinct vote patterns.

    Returns the share of bad documents, ``accuracy[labeller, class, vote]`` and the posterior of
    being bad for each pattern. Votes are taken to be independent given the class; no vote tells
    nothing.
    """
    if not len(patterns):
        return 0.5, np.full((patterns.shape[1], 2, 2), 0.5), np.empty(0)
    onehot = patterns[:, :, None] == np.arange(2)
    rejects, keeps = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    posterior = np.where(rejects > 0, 0.9, np.where(keeps > 0, 0.02, 0.3))
    share, accuracy = 0.5, np.empty(0)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        accuracy = np.einsum("cp,plv->lcv", weight, onehot) + 0.1
        accuracy /= accuracy.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,lcv->pc", onehot, np.log(accuracy)) + np.log([1 - share, share])
        updated = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        done = np.abs(updated - posterior).max() < 1e-9
        posterior = updated
        if done:
            break
    return float(share), accuracy, posterior


@dataclass
class Scorer:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, tok: np.ndarray, votes: np.ndarray, s: np.ndarray) -> float:
        z = self.weights[buckets(tok)].sum() + features(votes, s) @ self.dense + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def features(votes: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Shape measures, and the votes of the shape and lexicon labellers (not the reviewers', which most documents lack)."""
    v = votes[:-1]
    return np.concatenate([s, v == 1, v == 0]).astype(float)


def newton(x: np.ndarray, y: np.ndarray, offset: np.ndarray, d: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights ``d`` of the few dense features beside a fixed offset: Newton's method on the ridge-penalised loss.

    A full step can overshoot where nearly all rows are told apart, so a step is halved until the loss falls.
    """

    def loss(v: np.ndarray) -> float:
        z = offset + x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + RIDGE / 2 * v @ v)

    now = loss(d)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ d, -500, 500)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + RIDGE * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (p - y) + RIDGE * d)
        size = 1.0
        while (after := loss(d - size * step)) > now and size > 1e-9:
            size /= 2
        if size <= 1e-9 or np.abs(size * step).max() < 1e-8:
            break
        d, now = d - size * step, after
    return d


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> Scorer:
    """Logistic regression on soft labels; hashed weights are shrunk towards zero, so that only tokens with wide support keep one."""
    if not rows:
        return Scorer(np.zeros(DIMENSIONS), np.zeros(2 * (len(_SHAPES) + 2) + len(_SHAPES)), -1.0)
    dense = np.stack([d for _, d, _ in rows])
    y = np.array([p for _, _, p in rows])
    spread = np.zeros(DIMENSIONS, np.int32)
    for t, _, _ in rows:
        spread[t] += 1  # of how many rows, not how often
    wide = spread >= max(5, len(rows) // 400)
    used = np.flatnonzero(wide)
    place = np.cumsum(wide, dtype=np.int32) - np.int32(1)
    # the others keep no weight; blocks of rows keep what is computed for each token of them small
    rows = [place[t[wide[t]]] for t, _, _ in rows]
    blocks = [(lo, np.concatenate(rows[lo : lo + TRAIN_BLOCK]), [len(t) for t in rows[lo : lo + TRAIN_BLOCK]]) for lo in range(0, len(rows), TRAIN_BLOCK)]
    n = len(rows)
    del rows
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-8)
    x = np.column_stack([dense, np.ones(n)])
    d = np.zeros(x.shape[1])

    def odds(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def sums() -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[column], len(sizes)) for _, column, sizes in blocks])

    def gradient(error: np.ndarray) -> np.ndarray:
        g = np.zeros(len(used))
        for lo, column, sizes in blocks:
            np.add.at(g, column.astype(np.intp), np.repeat(error[lo : lo + len(sizes)], sizes))
        return g

    for turn in range(2):
        fixed = x @ d if turn else np.full(n, np.log(y.mean().clip(1e-3, 0.999) / (1 - y.mean().clip(1e-3, 0.999))))
        for _ in range(80):  # shrunken steps for the hashed weights
            error = (odds(fixed + sums()) - y) / n
            g = gradient(error)
            gw += g * g
            rate = RATE / np.sqrt(gw)
            w = w - rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        offset = sums()
        d = newton(x, y, offset, d)
    b = d[-1]
    d = d[:-1]
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return Scorer(weights, d, float(b))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``p_reject`` (the scorer's probability), ``p_weak``
    (the posterior of the votes) and ``keep`` for every row of ``docs (doc_id, text, ...)``.

    Null texts are empty; empty texts cast the votes of empty shapes; texts of any length are read
    whole. Ids may be of any type, labels join on their string form; of several labels of a document
    the stricter counts, labels without a document or an id count for nothing, and without labels the
    heuristic labellers stand alone. Rows that repeat a document are decided alike; a row with a null
    id is decided by its text. Of documents whose sampling hashes tie, which are equal in id and text,
    one is drawn. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(learn_lexicon(docs, labels))
    marks = _clean_labels(labels).select("_doc", _label("quality", "toxic").alias("_label"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                v, _, _ = votes_of(text.as_py(), lexicon.value, None)
                out.append(int(v[:-1] @ 3 ** np.arange(len(v) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["_doc", "v"])

    ids = docs.select(F.col("doc_id").cast("string").alias("_doc"), "text")
    patterns = ids.mapInArrow(lean(vote), "_doc string, v long").join(marks, "_doc", "left").groupBy("v", "_label").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers
    m = len(_SHAPES) + 2
    table = np.array([[r.v // 3**k % 3 for k in range(m)] + [2 if r._label is None else r._label] for r in patterns], np.int64).reshape(-1, m + 1)
    share, accuracy, _ = estimate(table, np.array([r.n for r in patterns], float))
    logs = np.log(accuracy)

    def posterior(v: np.ndarray) -> float:
        z = np.log(share / (1 - share)) + sum(logs[k, 1, x] - logs[k, 0, x] for k, x in enumerate(v) if x < 2)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [votes_of(t.as_py(), lexicon.value, x) for t, x in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([buckets(r[1]).tobytes() for r in rows], pa.binary()), pa.array([features(r[0], r[2]).tobytes() for r in rows], pa.binary()), pa.array([posterior(r[0]) for r in rows], pa.float64())], names=["tokens", "dense", "p"])

    order = F.xxhash64("_doc", "text", F.lit(7))
    chosen = F.broadcast(ids.select(order.alias("_o")).distinct().orderBy("_o").limit(TRAIN_ROWS))
    drawn = ids.withColumn("_o", order).join(chosen, "_o").join(marks, "_doc", "left").groupBy("_o").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    got = drawn.select("text", "_label").mapInArrow(lean(sample), "tokens binary, dense binary, p double").toLocalIterator()  # at most TRAIN_ROWS rows of 4 bytes a token
    scorer = spark.sparkContext.broadcast(train([(np.frombuffer(r.tokens, np.uint32), np.frombuffer(r.dense, float), r.p) for r in got]))
    # the row travels as one column, so that no name of its columns can clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("p_reject", T.DoubleType()), T.StructField("p_weak", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, weak = [], []
            for text in batch.column(1):
                v, tok, s = votes_of(text.as_py(), lexicon.value, None)
                p.append(scorer.value.score(tok, v, s))
                weak.append(posterior(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(weak, pa.float64()), pa.array([x < THRESHOLD for x in p], pa.bool_())], names=schema.names)

    return rows.mapInArrow(lean(decide), schema)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    return judged(docs, labels).where("keep").select("row.*")
