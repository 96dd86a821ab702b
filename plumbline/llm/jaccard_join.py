"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity of at least t differ in at most ``k = (1-t)/(1+t) * (|A|+|B|)``
elements.  Per band of set sizes the hash domain is dealt into ``n1`` groups of three equal ranges.
Among any ``k // 2 + 1`` groups one holds at most one of the differences, so one of the three
*subsets of two ranges* of that group is equal in both sets: its hash is a signature that both share.
A set therefore emits the signatures of its first groups, until ``k // 2 + 1`` of them were *solid*
(at least two ranges not empty); where a set has too few solid groups it also emits under a second
geometry, and at last every element by itself.  Whichever set of a similar pair stops first, the
other emits that far too, so no similar pair is without a shared signature, and an empty subset,
which every other set would share, is never a signature.

Shingles that many documents have (``COMMON`` or more, counted over all of them) are left out of the
domain first: leaving elements out can only lower the number of differences, so
the bound still holds, and boilerplate makes no candidates.  A set with too few other shingles falls
through to its whole domain.

Signatures are used in two rounds, so that the work on candidates stays linear and no link is lost.

1. Exact copies are merged by the hash of their set. Of every other set the signatures of its first
   few groups are sent, and the sets of one signature are compared with that of smallest id (a
   star). Most similar sets are connected by that.
2. All signatures of one document of each set are sent, with the component that round 1 gave it.
   Only a signature that different components share makes candidates: a few sets as pairs, more of
   them by hub and in blocks of bounded size. Pairs inside a component need no comparison.

Signatures are dealt to as many buckets as the number of shingles asks for, whatever the number of
shuffle partitions is, so a task's memory has a bound. Where many sets of one component have one
signature, a task sends it for the smallest of them only and marks it. The texts of lists that are not passed on as
pairs, and of marked components, are read again.

The rounds tell what is connected. All links lie inside components, so those of each document are
counted there: the sets of a component are compared with one another, in blocks of bounded size, by
products of 0-1 matrices. Copies are counted, not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, dealing_keys, join_hot, lean, mix, partitions, shingle_hashes
from plumbline.llm.components import connected_components

SIZE = 5
#: Similarity as a fraction of integers: 75 / 100.
NUM, DEN = 75, 100
#: Elements for each group at the top of a band: enough groups stay solid, and subsets stay selective.
PER_GROUP = 4.8
#: Rows about documents (copies, components, texts wanted) are broadcast only when they have been counted to be no more.
BROADCAST_ROWS = 2_000_000
#: Sets of a list are compared in blocks of so many bytes of compressed text, some four times that in hashes.
BLOCK = 4 << 20
#: Links are counted in blocks of about so many shingles, and in them for so many sets and shingles of a matrix at a time.
COUNTED, TILE, COLUMNS = 1 << 20, 256, 8192
#: Groups whose signatures the first round takes.
FIRST = 2
#: Signatures of a bucket, about; and bits of a signature that are sent beside the bucket's number.
BUCKET, BITS = 2_000_000, 39
#: Lists of at most so many sets are passed on as pairs; so many sets of a component send a signature by themselves.
PAIRS, ALONE = 6, 8
#: Lists that are read again in one pass over the texts.
LISTS = 1_000_000
_S32, _GROUP, _TAG = np.uint64(32), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_LEAVE = np.array([0x632BE59BD9B4E019, 0x71D67FFFEDA60000, 0x8538ECB5BD456EA3], np.uint64)
#: (common shingles too, every element by itself) in the order in which they are tried.
_LADDER = ((False, False), (False, True), (True, True))
#: A shingle that at least so many documents have is common. Where more than ``COMMON_ROWS`` shingles
#: (16 MB) were, the number is raised, as they are sent to the executors.
COMMON, COMMON_ROWS = 16, 2_000_000


def _bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, most differences) for each band of larger sizes that a set of ``n`` elements meets."""
    band, most = n.bit_length(), n * den // num
    out = []
    while True:
        top = min((1 << band) - 1, most)
        out.append((band, (den - num) * (n + top) // (den + num)))
        if most < 1 << band:
            return out
        band += 1


def _enumerate(h: np.ndarray, band: int, k: int, single: bool) -> tuple[np.ndarray, bool]:
    """Signatures of the sorted set ``h``, and whether enough groups were solid."""
    tag = np.array([band * 4 + 1], np.uint64)  # an array: its products wrap without a warning
    if not len(h):
        return np.empty(0, np.uint64), False
    if single:
        return mix(np.sort(mix(h + np.uint64(77)))[: k + 1] + tag * _TAG), len(h) > k
    if k == 0 and len(h) <= 2:  # no difference is allowed: the set itself
        return mix(h.sum(dtype=np.uint64, keepdims=True) * np.uint64(3) + tag), True
    groups = max(1, int(((1 << band) - 1) / PER_GROUP))
    piece = ((h >> _S32) * np.uint64(3 * groups)) >> _S32
    change = np.empty(len(h), bool)
    change[0] = True
    np.not_equal(piece[1:], piece[:-1], out=change[1:])
    first = change.nonzero()[0]
    totals = np.add.reduceat(h, first)
    piece = piece[first].astype(np.int64)
    group = piece // 3
    change = np.empty(len(group), bool)
    change[0] = True
    np.not_equal(group[1:], group[:-1], out=change[1:])
    begins = change.nonzero()[0]
    need = k // 2 + 1
    solid = np.cumsum(np.append(begins[1:], len(group)) - begins >= 2)
    covered = bool(solid[-1] >= need)
    if covered:
        begins = begins[: np.searchsorted(solid, need) + 1]
    last = group[begins[-1]]
    row = np.cumsum(change) - 1
    keep = np.searchsorted(group, last, "right")
    held = np.zeros((len(begins), 3), np.uint64)
    held[row[:keep], piece[:keep] - 3 * group[:keep]] = totals[:keep]
    rest = held.sum(axis=1, dtype=np.uint64)[:, None] - held
    # what remains without one of the three ranges; nothing remains of a group with that range only
    out = mix(rest + group[begins].astype(np.uint64)[:, None] * _GROUP + _LEAVE + tag * _TAG)
    return out[rest != 0], covered


def signatures(h: np.ndarray, num: int = NUM, den: int = DEN, common: np.ndarray | None = None) -> np.ndarray:
    """All PartEnum signatures of a sorted set of 64-bit hashes; ``common`` is sorted too."""
    if not len(h):
        return np.empty(0, np.uint64)
    rare = h
    if common is not None and len(common):
        rare = h[common[np.searchsorted(common, h).clip(0, len(common) - 1)] != h]
    out = []
    for band, k in _bands(len(h), num, den):
        for step, (whole, single) in enumerate(_LADDER):
            if k == 0 and not whole and len(rare) < len(h):
                continue  # the whole set is the signature
            got, covered = _enumerate(h if whole else rare, band, k, single)
            out.append(got + np.uint64(step))
            if covered:
                break
    return np.concatenate(out) if len(out) > 1 else out[0]


def first_signatures(h: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The signatures of the first ``FIRST`` groups of each band, common shingles included."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.concatenate([_enumerate(h[: 24 * FIRST], band, k, False)[0][: 3 * FIRST] for band, k in _bands(len(h), num, den)])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


_SURVEY = "kind int, a long, n long, h1 long, h2 long"


def _surveyor(size: int, num: int, den: int):
    """Texts to rows by kind: 0 document, set size and set hashes; 1 shingle ``h1`` and how many texts
    have it (two at least); 2 signature ``h1`` of document ``a`` with a set of ``n``.

    Shingles are counted among the texts that are held at a time, so sums of them are lower bounds:
    the choice of common shingles decides how much work candidates are, never the result.
    """

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, a, n, h1, h2):
            count = len(next(x for x in (a, n, h1) if x is not None))
            columns = [pa.array(np.full(count, kind, np.int32)), *(pa.nulls(count, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, n, h1, h2))]
            for lo in range(0, count, 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 100_000) for c in columns], names=["kind", "a", "n", "h1", "h2"])

        def flush():
            h1 = np.array([mix(h ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64) for h in sets], np.uint64)
            h2 = np.array([mix(h + np.uint64(0x12345)).sum(dtype=np.uint64) for h in sets], np.uint64)
            yield from rows(0, docs, [len(h) for h in sets], h1.astype(np.int64), h2.astype(np.int64))
            values = np.concatenate(sets)
            values.sort()
            first = np.flatnonzero(_runs(values))
            counts = np.diff(np.append(first, len(values)))
            keep = counts >= 2
            yield from rows(1, None, counts[keep].astype(np.int64), values[first[keep]].astype(np.int64), None)
            # copies among the texts at hand send signatures once
            alone: dict[tuple, int] = {}
            for k, doc in enumerate(docs):
                if doc is not None and len(sets[k]):
                    key = (len(sets[k]), h1[k], h2[k])
                    if key not in alone or doc < docs[alone[key]]:
                        alone[key] = k
            if not alone:
                return
            chosen = list(alone.values())
            found = [first_signatures(sets[k], num, den) for k in chosen]
            sig, who = np.concatenate(found), np.repeat(np.array([docs[k] for k in chosen], np.int64), [len(x) for x in found])
            n = np.repeat(np.array([len(sets[k]) for k in chosen], np.int64), [len(x) for x in found])
            yield from rows(2, who, n, sig.astype(np.int64), None)

        docs, sets, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                sets.append(shingle_hashes(text.as_py(), size))
                held += len(sets[-1])
                if held > 2_000_000 or len(docs) >= 50_000:
                    yield from flush()
                    docs, sets, held = [], [], 0
        if docs:
            yield from flush()

    return survey


def common_shingles(counts: DataFrame) -> np.ndarray:
    """``h, n`` to the sorted shingles that ``COMMON`` documents or more have, at most ``COMMON_ROWS`` of them."""
    found = cut(counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "common")
    by_count = sorted(found.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect(), reverse=True)  # a row for each count
    least, total = COMMON, 0
    for r in by_count:
        total += r["count"]
        if total > COMMON_ROWS:
            least = r.n + 1
            break

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["h"])

    packed = found.where(F.col("n") >= least).select("h").limit(COMMON_ROWS).mapInArrow(lean(pack), "h binary")
    return np.sort(np.frombuffer(b"".join(bytes(r.h) for r in packed.toLocalIterator()), np.int64).astype(np.uint64))


def _codes(sigs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, the bits sent) of signatures. Two that agree by chance make a candidate, which is verified."""
    n = np.uint64(buckets)
    return (sigs % n).astype(np.int64), (sigs // n) & np.uint64((1 << BITS) - 1)


_MARK = np.uint64(1 << BITS)


def _emitter(keys: list[int], size: int, num: int, den: int, common):
    """(document, text, component) to packed signatures by bucket, with the sizes of the sets."""
    buckets = len(keys)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)

        def flush():
            who, comp, count = np.array(docs, np.int64), np.array(comps, np.int64), np.array(counts, np.uint32)
            row = np.repeat(np.arange(len(who), dtype=np.int32), [len(x) for x in sigs])
            part, rest = _codes(np.concatenate(sigs), buckets)
            # the sets of a component that is met often here send a signature together
            members = np.unique(comp, return_inverse=True, return_counts=True)[1:]
            often = np.flatnonzero((members[1] > ALONE)[members[0]][row])
            if len(often):
                often = often[np.lexsort((who[row[often]], rest[often], part[often], comp[row[often]]))]
                new = _runs(comp[row[often]], part[often], rest[often])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(often))) > ALONE
                rest[often[first[many]]] |= _MARK
                keep = np.ones(len(row), bool)
                keep[often[np.repeat(many, np.diff(np.append(first, len(often)))) & ~new]] = False
                row, part, rest = row[keep], part[keep], rest[keep]
            order = np.argsort(part.astype(np.uint16) if buckets <= 1 << 16 else part, kind="stable")  # a document's signatures stay together
            row, part, rest = row[order], part[order], rest[order]
            cuts = np.flatnonzero(_runs(part))
            out = [[], []]
            for lo, hi in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
                first = np.flatnonzero(_runs(row[lo:hi]))
                at = row[lo:hi][first]
                places = np.diff(np.append(first, hi - lo)).astype(np.uint32)
                short = np.ascontiguousarray(rest[lo:hi].view(np.uint8).reshape(-1, 8)[:, :5])
                ids = who[at]
                raw = np.uint32(len(at)).tobytes() + np.diff(ids, prepend=0).tobytes() + (comp[at] - ids).tobytes() + count[at].tobytes() + places.tobytes() + short.tobytes()
                out[0].append(keys[int(part[lo])])
                out[1].append(zip_.compress(raw))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "blob"])

        docs, comps, counts, sigs, held = [], [], [], [], 0
        for batch in batches:
            for doc, text, comp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                h = shingle_hashes(text.as_py(), size)
                found = signatures(h, num, den, common.value)
                if len(found):
                    docs.append(doc)
                    comps.append(comp)
                    counts.append(len(h))
                    sigs.append(found)
                    held += len(found)
                if held > 1_000_000:
                    yield from flush()
                    docs, comps, counts, sigs, held = [], [], [], [], 0
        if docs:
            yield from flush()

    return emit


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, component, size of the set, number of signatures) of each document, and the bits and mark of each signature."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    ids = np.cumsum(np.frombuffer(blob, np.int64, n, 4))
    comps = np.frombuffer(blob, np.int64, n, 4 + 8 * n) + ids
    sizes = np.frombuffer(blob, np.uint32, n, 4 + 16 * n).astype(np.int64)
    counts = np.frombuffer(blob, np.uint32, n, 4 + 20 * n)
    short = np.frombuffer(blob, np.uint8, offset=4 + 24 * n).reshape(-1, 5)
    rest = np.zeros((len(short), 8), np.uint8)
    rest[:, :5] = short
    return ids, comps, sizes, counts, rest.view(np.uint64)[:, 0]


_CROSSING = "a long, b long, code long, docs binary, comps binary"


def _reducer(keys: list[int], num: int, den: int):
    """Packed signatures to what different components share: pairs (``a, b``), open lists (``a`` the
    smallest document, ``code``), and for each bucket the documents and marked components in its lists."""
    number = {k: i for i, k in enumerate(keys)}

    def rows(a=None, b=None, code=None, docs=None, comps=None):
        n = 1 if a is None else len(a)
        for lo in range(0, n, 100_000):
            m = min(n - lo, 100_000)
            columns = [pa.nulls(m, pa.int64()) if x is None else pa.array(x[lo : lo + m].copy()) for x in (a, b, code)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(m, pa.binary()) if x is None else pa.array([x], pa.binary()) for x in (docs, comps))], names=["a", "b", "code", "docs", "comps"])

    def crossing(held, bucket):
        # a signature is held with the number of its document only; those of one document go at once
        who, comp, n, counts = (np.concatenate([h[k] for h in held]) for k in range(4))
        sig = np.concatenate([h[4] for h in held])
        held.clear()
        row = np.repeat(np.arange(len(who), dtype=np.int32), counts)
        bits = sig & (_MARK - np.uint64(1))
        order = np.argsort(bits)
        bits = bits[order]
        same = bits[1:] == bits[:-1]
        shared = np.append(same, False) | np.append(False, same)
        order, bits = order[shared], bits[shared]
        row, mark = row[order], (sig[order] & _MARK) != 0
        del sig, order
        order = np.lexsort((who[row], comp[row], bits))
        row, sig, mark = row[order], bits[order], mark[order]
        who, comp, n = who[row], comp[row], n[row]
        first = np.flatnonzero(_runs(sig))
        if not len(first):
            return
        last = np.append(first[1:], len(sig)) - 1
        mixed = comp[first] != comp[last]
        small = mixed & (last - first < PAIRS) & ~np.logical_or.reduceat(mark, first)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in range(2, PAIRS + 1):
            at = first[small & (last - first == m - 1)]
            for i in range(m):
                for j in range(i + 1, m):
                    x, y = at + i, at + j
                    ok = (comp[x] != comp[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
                    a.append(np.minimum(who[x], who[y])[ok])
                    b.append(np.maximum(who[x], who[y])[ok])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        yield from rows(a=pairs[:, 0], b=pairs[:, 1])
        large = np.flatnonzero(mixed & ~small)
        if len(large):
            yield from rows(a=np.minimum.reduceat(who, first)[large], code=(np.int64(bucket) << BITS) | sig[first[large]].astype(np.int64))
            inside = np.repeat(mixed & ~small, last - first + 1)
            yield from rows(docs=np.unique(who[inside]).tobytes(), comps=np.unique(comp[inside & mark]).tobytes())

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, held, at = zstandard.ZstdDecompressor(), [], None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at and held:
                    yield from crossing(held, number[at])
                at = bucket
                held.append(_unpack(unzip.decompress(blob.as_buffer())))
        if held:
            yield from crossing(held, number[at])

    return reduce


def _of(docs: DataFrame, wanted: DataFrame, form, name: str) -> DataFrame:
    """``doc, z``: the form of the text of each document in ``wanted (doc)``, a table that was cut."""
    # where there are too many to broadcast, the texts are shuffled
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_.compress(form(t.as_py())) for t in batch.column(1)], pa.binary())], names=["doc", "z"])

    packed = docs.join(side, "doc", "left_semi").mapInArrow(lean(pack), "doc long, z binary")
    return cut(packed.groupBy("doc").agg(F.max("z").alias("z")), name)  # rows that repeat an id are one


def _both_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs that were cut with ``za`` and ``zb``; one document may be the first of very many."""
    rows = join_hot(pairs, table.toDF("a", "za"), ["a"]).join(table.toDF("b", "zb"), "b")
    return rows.select("a", "b", "za", "zb").sortWithinPartitions("a")


def _sketch(h: np.ndarray) -> bytes:
    """The size of a set and how many of its elements fall in each of some ``2 * size`` ranges."""
    m = 1 << max(6, len(h).bit_length())
    counts = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.uint32(len(h)).tobytes() + counts.clip(max=255).astype(np.uint8).tobytes()


def _may_be_similar(x: bytes, y: bytes, num: int, den: int) -> bool:
    """Whether sets with these sketches can be similar: they differ in as many elements as the counts do, at least."""
    total = int(np.frombuffer(x, np.uint32, 1)[0]) + int(np.frombuffer(y, np.uint32, 1)[0])
    x, y = (np.frombuffer(z, np.uint8, offset=4).astype(np.int64) for z in (x, y))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    return int(np.abs(x - y).sum()) * (den + num) <= (den - num) * total


def _reader(size: int):
    unzip = zstandard.ZstdDecompressor()
    return lambda z: shingle_hashes(unzip.decompress(z).decode("utf-8", "surrogatepass"), size)


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return common > 0 and den * common >= num * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: by a bound from small sketches first, which loses none, then by their texts."""

    def chosen(rows: DataFrame, read, similar) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, kept = None, None
            unzip = zstandard.ZstdDecompressor()
            for batch in batches:
                a, b = [], []
                for x, y, za, zb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if x != last:
                        last, kept = x, read(unzip.decompress(za.as_py()))
                    if similar(kept, read(unzip.decompress(zb.as_py())), num, den):
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return rows.mapInArrow(lean(compare), "a long, b long")

    def ends(rows: DataFrame) -> DataFrame:
        return cut(rows.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")

    left = cut(pairs.select("a", "b"), "pairs")
    sketches = _of(docs, ends(left), lambda t: _sketch(shingle_hashes(t, size)), "sketches")
    close = cut(chosen(_both_ends(left, sketches), lambda z: z, _may_be_similar), "close")
    texts = _of(docs, ends(close), lambda t: (t or "").encode("utf-8", "surrogatepass"), "texts")
    return chosen(_both_ends(close, texts), lambda z: shingle_hashes(z.decode("utf-8", "surrogatepass"), size), _similar)


def _ids(blobs: DataFrame) -> DataFrame:
    """Packed ids to distinct rows ``doc``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob.as_buffer(), np.int64))], names=["doc"])

    return blobs.mapInArrow(lean(explode), "doc long").distinct()


def _open_links(found: DataFrame, placed: DataFrame, comps: DataFrame, buckets: int, common, size: int, num: int, den: int) -> DataFrame:
    """Links between members of one open list that lie in different components.

    The texts of the members, and of the marked components, are read again, for at most ``LISTS``
    lists at a time. The lists of one hub are compared together, so that a pair that several lists
    have is compared once. A hub of many members is dealt out in pairs of blocks.
    """
    spark = found.sparkSession
    lists = found.where("code is not null").select("a", "code")
    marked = _ids(found.where("comps is not null").select("comps"))
    wanted = _ids(found.where("docs is not null").select("docs")).unionByName(marked).unionByName(comps.join(marked.toDF("comp"), "comp", "left_semi").select("doc")).distinct()
    wanted = cut(wanted, "members")
    placed = placed.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in batch.columns]).tobytes()], pa.binary())], names=["b"])

    total = lists.count()
    passes = -(-total // LISTS)
    opened = None
    for turn in range(passes):
        # the lists of a hub go in one pass: a document has one row for each hub
        mine = lists.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == turn).select("code", "a")
        known = [np.frombuffer(r.b, np.int64).reshape(2, -1) for r in mine.mapInArrow(lean(pack), "b binary").toLocalIterator()]  # about LISTS rows of 16 bytes
        if not known:
            continue
        known = np.concatenate(known, axis=1)
        known = spark.sparkContext.broadcast(known[:, np.argsort(known[0])])

        def members(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            zip_ = zstandard.ZstdCompressor(level=3)
            codes, hubs = known.value
            for batch in batches:
                out = [[], [], [], [], []]
                for doc, text, comp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    part, rest = _codes(signatures(shingle_hashes(text.as_py(), size), num, den, common.value), buckets)
                    mine = np.unique((part << BITS) | rest.astype(np.int64))
                    at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                    mine, hub = mine[codes[at] == mine], hubs[at[codes[at] == mine]]
                    z = zip_.compress((text.as_py() or "").encode("utf-8", "surrogatepass")) if len(mine) else None
                    for x in np.unique(hub):
                        for column, v in zip(out, (int(x), doc, comp, mine[hub == x].tobytes(), z), strict=True):
                            column.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["hub", "doc", "comp", "lists", "z"])

        got = placed.select("doc", "text", "comp").mapInArrow(lean(members), "hub long, doc long, comp long, lists binary, z binary")
        opened = got if opened is None else opened.unionByName(got)
    if opened is None:
        return found.select("a", "b").limit(0)
    opened = cut(opened, "open")
    # members of a hub's largest component need no comparison with each other: they meet the rest only
    largest = F.max(F.struct("bytes", "comp"))
    sizes = opened.groupBy("hub", "comp").agg(F.count("*").alias("count"), F.sum(F.length("z")).alias("bytes"))
    sizes = sizes.groupBy("hub").agg(largest.alias("most"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    large = F.col("bytes") > 2 * BLOCK
    sizes = sizes.select("hub", F.col("most.comp").alias("main"), F.when(large, blocks(F.col("most.bytes"))).otherwise(1).alias("x"), F.when(large, blocks(F.col("bytes") - F.col("most.bytes"))).otherwise(0).alias("y"))
    main = (F.col("comp") == F.col("main")) | (F.col("y") == 0)
    at = F.xxhash64("doc")
    dealt = (
        join_hot(opened, sizes, ["hub"])
        .withColumn("mine", F.when(main, F.pmod(at, F.col("x"))).otherwise(F.col("x") + F.pmod(at, F.greatest("y", F.lit(1)))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(main & (F.col("y") > 0), F.col("x")).otherwise(0), F.col("x") + F.col("y") - 1)))
        .select("hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc", "comp", "lists", "z")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(size)

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (_, i, j), group in groupby(rows(), key=lambda r: r[:3]):
            group = {r[4]: r for r in group}  # a repeated id is one document
            group = [group[k] for k in sorted(group)]
            doc, comp, mine = (np.array([r[k] for r in group], np.int64) for k in (4, 5, 3))
            sets = [read(r[7]) for r in group]
            length = np.array([len(x) for x in sets])
            own = np.repeat(np.arange(len(group)), [len(r[6]) // 8 for r in group])
            lists = np.frombuffer(b"".join(r[6] for r in group), np.int64)
            order = np.argsort(lists, kind="stable")
            own, lists = own[order], lists[order]
            cuts = np.flatnonzero(_runs(lists))
            members = [own[lo:hi] for lo, hi in zip(cuts, np.append(cuts[1:], len(own)), strict=True)]
            within: list[list[int]] = [[] for _ in group]
            for k, at in enumerate(members):
                if (comp[at] != comp[at[0]]).any():
                    for p in at:
                        within[p].append(k)
            found = []
            for p, mine_lists in enumerate(within):  # the partners of one set at a time, whatever a list's length is
                if not mine_lists:
                    continue
                q = np.unique(np.concatenate([members[k] for k in mine_lists]))
                q = q[(q > p) & (comp[q] != comp[p])]
                q = q[den * np.minimum(length[p], length[q]) >= num * np.maximum(length[p], length[q])]
                if i != j:
                    q = q[mine[q] != mine[p]]
                found += [(doc[p], doc[x]) for x in q if _similar(sets[p], sets[x], num, den)]
            if found:
                both = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return dealt.repartition(partitions(spark), "hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(lean(compare), "a long, b long").distinct()


def _common(x: list[np.ndarray], y: list[np.ndarray], columns: int) -> np.ndarray:
    """How many elements each set of ``x`` and each of ``y`` have in common."""
    out = np.zeros((len(x), len(y)), np.int64)
    flat = [np.concatenate(sets) for sets in (x, y)]
    own = [np.repeat(np.arange(len(sets)), [len(h) for h in sets]) for sets in (x, y)]
    both = np.intersect1d(*flat)
    for lo in range(0, len(both), columns):
        part, held = both[lo : lo + columns], []
        for h, o, n in zip(flat, own, out.shape, strict=True):
            at = np.searchsorted(part, h).clip(0, len(part) - 1)
            there = part[at] == h
            m = np.zeros((n, len(part)), np.float32)  # its sums stay whole: they are no more than columns
            m[o[there], at[there]] = 1
            held.append(m)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def _partners(docs: DataFrame, members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``doc, partners``: with how many documents of other sets each of ``members (doc, comp, n, w)`` links.

    There is a member for each set of a component, ``n`` the size of the set and ``w`` the number of
    documents that have it; the table was cut.
    """
    spark = docs.sparkSession
    whole = members.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    members = cut(join_hot(members, whole, ["comp"]), "partners")
    two = members.where("sets = 2").select("doc", (F.col("all_w") - F.col("w")).alias("partners"))  # a component of two is one link
    blocks = F.ceil(F.col("all_n") / F.lit(COUNTED)).cast("int")
    more = cut(members.where("sets > 2").select("doc", "comp", "w", blocks.alias("blocks"), F.pmod(F.xxhash64("doc"), F.greatest(blocks, F.lit(1))).cast("int").alias("mine")), "counted")
    texts = docs.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, "doc")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([zip_.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], z], names=["doc", "comp", "w", "blocks", "mine", "z"])

    packed = texts.select("doc", "text", "comp", "w", "blocks", "mine").mapInArrow(lean(pack), "doc long, comp long, w long, blocks int, mine int, z binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = packed.withColumn("other", other).select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc", "w", "z")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(size)

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (_, i, j), group in groupby(rows(), key=lambda r: r[:3]):
            group = {r[4]: (r[3], r[4], r[5], read(r[6])) for r in group}.values()  # a repeated id is one document
            group = sorted((r for r in group if len(r[3])), key=lambda r: (len(r[3]), r[1]))
            sides = [[r for r in group if r[0] == side] for side in (i, j)[: 1 + (i != j)]]
            docs_, weights, lengths = ([np.array([f(r) for r in side], np.int64) for side in sides] for f in (lambda r: r[1], lambda r: r[2], lambda r: len(r[3])))
            found = [np.zeros(len(side), np.int64) for side in sides]
            x, y = 0, len(sides) - 1
            for p in range(0, len(sides[x]), TILE):
                for q in range(0 if x != y else p, len(sides[y]), TILE):
                    a, b = slice(p, p + TILE), slice(q, q + TILE)
                    la, lb = lengths[x][a], lengths[y][b]
                    if den * la[-1] < num * lb[0] or den * lb[-1] < num * la[0]:
                        continue  # sets are in the order of their sizes
                    common = _common([r[3] for r in sides[x][a]], [r[3] for r in sides[y][b]], COLUMNS)
                    linked = (common > 0) & (den * common >= num * (la[:, None] + lb[None, :] - common))
                    if x == y and p == q:
                        np.fill_diagonal(linked, False)
                    found[x][a] += linked @ weights[y][b]
                    if x != y or p != q:
                        found[y][b] += linked.T @ weights[x][a]
            for d, n in zip(docs_, found, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n)], names=["doc", "partners"])

    counted = dealt.repartition(partitions(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(lean(compare), "doc long, partners long")
    return cut(counted.unionByName(two).groupBy("doc").agg(F.sum("partners").alias("partners")), "partners")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN, links: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_connecting, n_links``.

    Texts link when ``den * |A & B| >= num * |A | B|`` over their distinct word shingles;
    ``component_id`` is the smallest id reachable by links.  ``n_connecting`` counts the verified
    links that were used to connect the document (a copy has one, to the first of its kind), and
    ``n_links`` all documents that link with it, copies included. Without ``links`` that column, and
    the comparisons inside components that it asks for, are left out.
    Null and blank texts have no shingles and link with nothing; a row with a null id keeps its
    ``n_shingles`` and has a null ``component_id``; rows that repeat an id count as one document.
    Further columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    survey = cut(docs.mapInArrow(lean(_surveyor(size, num, den)), _SURVEY), "survey")
    stats = survey.where("kind = 0").select(F.col("a").alias("doc"), "n", "h1", "h2")
    common = spark.sparkContext.broadcast(common_shingles(survey.where("kind = 1").select(F.col("h1").alias("h"), "n")))

    # copies: every document but the smallest of its set
    known = stats.where("doc is not null and n > 0")
    copies = known.groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep < last").drop("last")
    same = join_hot(known, copies, ["n", "h1", "h2"]).where("doc > rep")
    same = cut(same.groupBy("doc").agg(F.min("rep").alias("rep")), "copies")

    # round 1: stars
    sent = survey.where("kind = 2").select(F.col("h1").alias("sig"), F.col("a").alias("doc"), "n").join(same, "doc", "left")
    sent = cut(sent.select("sig", F.coalesce("rep", "doc").alias("b"), F.col("n").alias("nb")), "first")
    least = sent.groupBy("sig").agg(F.min(F.struct("b", "nb")).alias("hub"), F.max("b").alias("last")).where("hub.b < last").select("sig", F.col("hub.b").alias("a"), F.col("hub.nb").alias("na"))
    stars = join_hot(sent, least, ["sig"]).where(f"a < b and least(na, nb) * {den} >= greatest(na, nb) * {num}").select("a", "b").distinct()
    used = cut(_verified(stars, docs, size, num, den), "links")
    comps = connected_components(used)

    # round 2: signatures that different components share
    buckets = max(partitions(spark), -(-(known.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    keys = dealing_keys(spark, buckets)
    place = cut(comps.select("doc", "comp", F.lit(False).alias("copy")).unionByName(same.select("doc", F.lit(None).cast("long").alias("comp"), F.lit(True).alias("copy"))), "place")
    few = place.count() <= BROADCAST_ROWS
    placed = docs.where("doc is not null").join(F.broadcast(place) if few else place, "doc", "left").where("copy is null or not copy").select("doc", "text", F.coalesce("comp", "doc").alias("comp"))
    emitted = placed.mapInArrow(lean(_emitter(keys, size, num, den, common)), "bucket int, blob binary")
    found = cut(emitted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_reducer(keys, num, den)), _CROSSING), "crossing")
    more = _verified(found.where("b is not null").select("a", "b").distinct(), docs, size, num, den)
    more = cut(more.unionByName(_open_links(found, placed, comps, buckets, common, size, num, den)).distinct(), "more")
    if not more.isEmpty():
        used = used.unionByName(more)
        comps = connected_components(comps.select(F.col("comp").alias("a"), F.col("doc").alias("b")).unionByName(more))

    # a copy belongs where the first of its kind does
    kinds = same.groupBy("rep").agg(F.count("*").alias("copies")).join(comps.toDF("rep", "comp"), "rep", "left").select("rep", "copies", F.coalesce("comp", "rep").alias("comp"))
    kinds = cut(kinds, "kinds")
    none = F.lit(0).cast("long")
    kinds, by_partners = kinds.withColumn("partners", none), None
    if links:
        members = comps.select("doc", "comp").unionByName(comps.select(F.col("comp").alias("doc"), "comp").distinct())
        members = members.join(known.groupBy("doc").agg(F.max("n").alias("n")), "doc").join(kinds.select(F.col("rep").alias("doc"), "copies"), "doc", "left")
        partners = _partners(docs, cut(members.select("doc", "comp", "n", (F.coalesce("copies", none) + 1).alias("w")), "members"), size, num, den)
        kinds = cut(kinds.drop("partners").join(partners.toDF("rep", "partners"), "rep", "left").fillna(0, ["partners"]), "kinds")
        by_partners = partners.select("doc", F.lit(None).cast("long").alias("comp"), none.alias("links"), F.col("partners").alias("all"))
    ends = used.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("links"))
    by_doc = comps.select("doc", "comp", none.alias("links"), none.alias("all")).unionByName(join_hot(same, kinds, ["rep"]).select("doc", "comp", F.lit(1).alias("links"), (F.col("copies") + F.col("partners")).alias("all")))
    by_doc = by_doc.unionByName(kinds.select(F.col("rep").alias("doc"), "comp", F.col("copies").alias("links"), F.col("copies").alias("all"))).unionByName(ends.select("doc", F.lit(None).cast("long").alias("comp"), "links", none.alias("all")))
    if by_partners is not None:
        by_doc = by_doc.unionByName(by_partners)
    by_doc = by_doc.groupBy("doc").agg(F.max("comp").alias("comp"), F.sum("links").alias("links"), F.sum("all").alias("all"))
    counts = [F.coalesce("links", none).alias("n_connecting"), *([F.coalesce("all", none).alias("n_links")] if links else [])]
    return stats.select("doc", "n").join(by_doc, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"), *counts)
