"""Corpus operators on documents against brute force, with the awkward cases: nulls, empties, ties, repeats, extra columns."""

import hashlib
import re
from collections import defaultdict

import pytest

from plumbline.llm.decontaminate import decontaminate, decontamination_report
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.mixing import mixed
from plumbline.llm.span_dedup import span_dedup, span_report
from plumbline.llm.winnow import K, W, decode, fingerprint_report, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 997}{'.' if k % 7 == 6 else ''}" for k in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [words(s, 40 + 13 * s) for s in range(6)]
    near = [t + " extra tail" for t in base] + [t.upper() for t in base] + ["lead word " + t[: len(t) * 9 // 10] for t in base]
    texts = [*base, *near, None, "", " \n\t ", "one", "one two", "one two three four", "ONE TWO three four", "a b c d e", words(99, 20_000), "é à ü x"]
    # a chain: neighbours are similar, the ends are not
    chain = [f"c{k}" for k in range(60)]
    texts += [" ".join(chain[s : s + 30]) for s in range(0, 24, 2)]
    out = [(k, t, "en", ["s1", "s2", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    return out + [out[3], (None, base[0], "en", "s1", 1), (None, None, None, None, None)]


def brute_components(rows):
    sets = {}
    for k, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = [k for k in sets if k is not None]
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {k: find(k) for k in ids}


def test_jaccard_components(spark, rows):
    sets, comp = brute_components(rows)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "a")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == comp.get(r.doc_id)
        if r.doc_id is not None:
            assert r.n_shingles == len(sets[r.doc_id])


def test_jaccard_many_near_threshold(spark):
    import random

    rng = random.Random(5)
    base = [f"t{k}" for k in range(90)]
    rows = []
    for k in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(t[: rng.randint(70, 90)]), "en", "s", 1))
    _, comp = brute_components(rows)
    assert {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()} == comp


def test_jaccard_hot_lists(spark, monkeypatch):
    """Marked components, open lists and blocks, which small tables meet only with small limits."""
    import random

    import plumbline.llm.jaccard_join as j

    for name, value in (("PAIRS", 2), ("ALONE", 1), ("BLOCK", 4000), ("LISTS", 5), ("BUCKET", 500)):
        monkeypatch.setattr(j, name, value)
    rng = random.Random(9)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(rng.choice((0, 2, 8, 9, 10, 30))):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(t), "en", "s", 1))
    _, comp = brute_components(rows)
    assert 3 < len(set(comp.values())) < 150
    assert {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()} == comp


def brute_links(rows):
    """Of each document, how many others its set links with."""
    sets, _ = brute_components(rows)
    sets = {k: s for k, s in sets.items() if k is not None}
    return {a: sum(a != b and bool(x & y) and 100 * len(x & y) >= 75 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}


def test_jaccard_links(spark, rows):
    """All links of a document are counted, also those inside a component and of copies."""
    want = brute_links(rows)
    for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.n_links == want.get(r.doc_id, 0)


def test_jaccard_links_in_blocks(spark, monkeypatch):
    import random

    import plumbline.llm.jaccard_join as j

    for name, value in (("COUNTED", 2000), ("TILE", 7), ("COLUMNS", 50)):
        monkeypatch.setattr(j, name, value)
    rng = random.Random(4)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(120):
        t = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 5, 6))):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(t[: rng.choice((100, 120))]), "en", "s", 1))
    want = brute_links(rows)
    assert len(set(want.values())) > 9
    assert {r.doc_id: r.n_links for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()} == want


def test_jaccard_open_lists_in_passes(spark, monkeypatch):
    """A hub's lists are compared whole, in however many passes lists are read again."""
    import plumbline.llm.jaccard_join as j

    for name, value in (("first_signatures", lambda h, num, den: h[:0]), ("PAIRS", 1), ("LISTS", 8)):  # round 1 connects nothing
        monkeypatch.setattr(j, name, value)
    rows = []
    for g in range(2):
        base = [f"g{g}t{k}" for k in range(104)]
        variants = [base] + [[*base[:at], f"g{g}x{at}", f"g{g}y{at}", *base[at + 2 :]] for at in (10, 25, 40, 55, 70)]
        variants[1:] = [[*v[: at + 8], f"g{g}z{at}", *v[at + 9 :]] for v, at in zip(variants[1:], (10, 25, 40, 55, 70), strict=True)]
        rows += [(10 * g + k, " ".join(v), "en", "s", 1) for k, v in enumerate(variants)]
    _, comp = brute_components(rows)
    assert set(comp.values()) == {0, 10} and brute_links(rows)[1] == 1
    assert {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()} == comp


def test_jaccard_sketches_lose_no_pair():
    import numpy as np

    from plumbline.llm.jaccard_join import _may_be_similar, _similar, _sketch

    rng, seen = np.random.default_rng(3), set()
    for _ in range(400):
        n = int(rng.integers(1, 600))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: int(n * rng.uniform(0.5, 1))], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 3)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        same, may = _similar(x, y, 75, 100), _may_be_similar(_sketch(x), _sketch(y), 75, 100)
        assert may or not same
        seen.add((bool(same), may))
    assert seen >= {(True, True), (False, False)}


def test_jaccard_empty(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decontamination(spark, rows):
    items = [(1, words(2, 30)), (10, words(3, 10)), (2, "one two"), (3, None), (4, ""), (5, "à ü x"), (6, "W1!!w2"), (7, words(99, 300))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    expected = {}
    for k, t, *_ in rows:
        w, hit, found = tokens(t), set(), set()
        for i, it in items:
            x = tokens(it)
            n = min(10, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
        expected[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = decontamination_report(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == expected[r.doc_id]
    kept = decontaminate(docs, bench)
    assert kept.schema.names == docs.schema.names
    assert kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontamination_report(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, rows, monkeypatch):
    import plumbline.llm.decontaminate as d

    bench = spark.createDataFrame([(1, words(2, 30)), (10, words(3, 40))], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, decontamination_report(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK", 8)
    assert sorted(map(str, decontamination_report(docs, bench).collect())) == whole


def brute_winnow(text):
    """The guarantee and the choice by the definition, on the module's own gram hashes."""
    from plumbline.llm.winnow import _grams
    import numpy as np

    if len(text) < K:
        return None
    h = _grams(np.frombuffer(text.encode("utf-32-le"), np.uint32), K).tolist()
    w, chosen = min(W, len(h)), set()
    for lo in range(len(h) - w + 1):
        window = h[lo : lo + w]
        chosen.add(lo + max(i for i, v in enumerate(window) if v == min(window)))
    return sorted(chosen)


def test_winnow_choice(rows):
    for t in [words(1, 50), "ab" * 40, "x" * 300, "short", "exactly12chr"]:
        h, at = winnow(t)
        if (expected := brute_winnow(t)) is not None:
            assert at.tolist() == expected
    a, b = "qwertyuiopasdfghjklzxcvbnm0123456789", "ZZZZ" + "qwertyuiopasdfghjklzxcvbnm0123456789"[4 : 4 + W + K - 1] + "YYYY"
    assert set(winnow(a)[0]) & set(winnow(b)[0])
    assert len(winnow("")[0]) == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_fingerprints(spark, rows, parts):
    unique = [r for r in rows if r[0] is not None][: -1]
    order = sorted(unique, key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprint_report(spark.createDataFrame(unique, SCHEMA).repartition(parts)).collect()}
    assert len(got) == len(unique)
    for k, (i, t, *_) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        h, at = decode(got[i].fingerprint)
        assert h.tolist() == winnow(t)[0].tolist() and at.tolist() == winnow(t)[1].tolist()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert fingerprint_report(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert fingerprint_report(spark.createDataFrame([], SCHEMA)).count() == 0


def sentences(text):
    out = []
    for line in text.split("\n"):
        current = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            current.append(w)
            if w[-1] in ".!?":
                out.append(current)
                current = []
        if current:
            out.append(current)
    return [s[k : k + 16] for s in out for k in range(0, len(s), 16)]


def test_span_dedup(spark):
    passage = ". ".join(words(s, 9).replace(".", "") for s in range(8)) + "."
    rows = [(k, f"Start {k} a b c. {words(k, 30)}\n{passage} End {k}.", "en", "s", 0) for k in range(1, 7)]
    rows += [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "Be. To. Of.", "en", "s", 0), (53, "Be. To. Of.", "en", "s", 0), (54, passage, "en", "s", 0), (56, f"Once. {'Is it. ' * 40}", "en", "s", 0), (57, f"Other words here. {'Is it. ' * 40}", "en", "s", 0), (55, passage + "\n" + passage, "en", "s", 0), rows[2], (None, passage, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen, removed = {}, defaultdict(set)
    for k, t, *_ in sorted({r for r in rows if r[0] is not None and r[1]}, key=lambda r: r[0]):
        s = sentences(t)
        enough = lambda a, b: b - a >= 3 and sum(map(len, s[a:b])) >= 12
        ahead = {(a, min(b for b in range(len(s) + 1) if enough(a, b))) for a in range(len(s)) if enough(a, len(s))}
        back = {(max(a for a in range(len(s)) if enough(a, b)), b) for b in range(len(s) + 1) if enough(0, b)}
        for a, b in sorted(ahead | back):
            key = tuple(map(tuple, s[a:b]))
            if key in seen:
                removed[k] |= set(range(a, b))
            else:
                seen[key] = k
    got = span_report(docs).select("row.*", "n_sentences", "n_removed").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.text == passage
        elif r.text is not None and r.doc_id < 60:
            source = next(x[1] for x in rows if x[0] == r.doc_id)
            s = sentences(source)
            assert r.n_removed == len(removed[r.doc_id]) and r.n_sentences == len(s)
            assert r.text.split() == [w for i, x in enumerate(s) if i not in removed[r.doc_id] for w in x]
            assert r.n_chars == len(r.text)
    assert span_dedup(docs.limit(0)).count() == 0


def test_span_dedup_within_sentences(spark):
    def plain(seed, n):
        return [f"x{(seed * 7919 + k * k * 31 + k * seed) % 9973}" for k in range(n)]

    rows, passages = [], {}
    for k in range(24):
        p = plain(1000 + k, 51 + k)
        for at in {0: (), 1: (18,), 2: (31, 37)}[k % 3]:
            p[at] += "."
        passages[k] = p
        for copy in range(2):
            before, after = plain(100 + 2 * k + copy, 1 + (k * 5 + copy * 9) % 23), plain(300 + 2 * k + copy, 1 + k % 19)
            rows.append((2 * k + copy, " ".join([*before, *p, *after]), "en", "s", 0))
    alone = " ".join(f"y{k}" for k in range(300))
    rows += [(90, alone, "en", "s", 0), (91, "again " + " ".join(["one two three"] * 20), "en", "s", 0)]
    got = {r.doc_id: r for r in span_report(spark.createDataFrame(rows, SCHEMA)).select("row.*", "n_removed").collect()}
    for k, p in passages.items():
        first, later = rows[2 * k][1], rows[2 * k + 1][1]
        assert got[2 * k].text == first and got[2 * k].n_removed == 0
        left = got[2 * k + 1].text.split()
        own = [w for w in later.split() if w not in p]
        assert [w for w in left if w not in p] == own and got[2 * k + 1].n_removed > 0
        assert len(left) - len(own) <= 30 and not any(p[a : a + 51] == left[b : b + 51] for a in range(len(p) - 50) for b in range(len(left) - 50))
    assert got[90].text == alone
    assert got[91].text == rows[-1][1]  # no place beside the first that does not overlap it


def test_mixing(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "target")
    got = mixed(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
    names, weights = ["s1", "s2", None], {"s1": 5.0, "s2": 2.0, None: 1.0}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        level = left / sum(weights[n] for n in open_)
        if not (full := {n for n in open_ if weights[n] * level > 2 * size[n]}):
            target |= {n: weights[n] * level for n in open_}
            break
        for n in full:
            target[n] = 2.0 * size[n]
            left -= target[n]
        open_ -= full
    for n in names:
        own = [r for r in got if r.source == n]
        assert all(abs(r.target - target[n]) < 1e-6 and r.source_size == size[n] for r in own)
        assert abs(sum(r.taken for r in own) - target[n]) <= 3
    assert sorted(map(str, mixed(docs).collect())) == sorted(map(str, got))
    assert mixed(docs.limit(0)).count() == 0


def test_idle_workers_hold_no_freed_memory(spark, monkeypatch):
    import time

    import numpy as np
    import pyarrow as pa

    monkeypatch.setitem(spark.sparkContext.environment, "PLUMBLINE_FRESH", "1")  # workers of its own
    rng = np.random.default_rng(5)
    texts = [(k, " ".join(f"w{x}" + "." * int(x % 9 == 0) for x in rng.integers(0, 40_000, 500))) for k in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)

    def held(batches):
        time.sleep(0.3)  # so that each worker takes a part
        rss = next(line for line in open("/proc/self/status") if line.startswith("RssAnon"))
        yield pa.RecordBatch.from_arrays([pa.array([int(rss.split()[1]) / 1024])], names=["mb"])

    def most():
        return max(r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(held, "mb double").collect())

    span_report(docs.limit(1)).collect()  # what is imported stays
    before = most()
    assert span_report(docs).count() == len(texts)
    span_report(docs).selectExpr("sum(n_removed)").collect()
    assert most() < before + 30
