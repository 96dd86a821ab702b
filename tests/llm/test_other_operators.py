"""HTML extraction, licence scans, the quality classifier, archives, chat formatting and the pipeline."""

import base64
import hashlib
import random

import pytest

from plumbline.llm import chat_format, html_extract, license_scan, quality, warc


# --- HTML extraction

def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 8])
def test_lcs(cells):
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        kept = [x for x, k in zip(a, html_extract._lcs(a, b, cells), strict=True) if k]
        rest = iter(b)
        assert len(kept) == lcs_length(a, b) and all(x in rest for x in kept)


def test_blocks():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><header>Site</header>'
        '<div class="ad">buy</div><article><h1>A &amp; B&nbsp;C</h1><p>one<br>two <b>three</b>\n four<div class="newsletter-signup">join</div>'
        '<form>f</form><ul><li>x<li>y</ul><script>if (a<b) "</p>"</script></article><section id="comments"><article class="comment">hi</article></section>'
        "<footer>&copy;</footer><p>tail &lt;"
    )
    expected = [("A & B C", "+"), ("one two three four", "+"), ("x", "+"), ("y", "+"), ("tail <", "-")]
    assert [x for x in html_extract.blocks(page) if x[1] != "~"] == expected
    assert [x for x, kind in html_extract.blocks(page) if kind == "~"] == ["Menu", "Site", "buy", "join", "f", "hi", "\u00a9"]
    assert html_extract.blocks('<p>a <span class=ad>buy</span> b</p><div class="social-history">s</div><div class="social-links">t') == [("a b", "-"), ("buy", "~"), ("s", "-"), ("t", "~")]
    assert html_extract.blocks(None) == html_extract.blocks("") == []


def brute_main_text(rows):
    """Pairing and output by the definition, for pages of one plain block a line, none of which a page has twice."""
    def parts(url):
        host, _, path = url.split("//")[1].partition("/")
        return host, "/" + path

    def near(x, y):
        # whole parts of the path count, and one more where the next parts begin alike
        done = 0
        for p, q in zip(x.split("/"), y.split("/")):
            if p != q:
                return done + next((k for k, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
            done += len(p) + 1
        return done

    out = {}
    for host in {parts(u)[0] for _, u, _ in rows}:
        runs = []
        for page, url, lines in sorted(((k, parts(u)[1], t) for k, u, t in rows if parts(u)[0] == host), key=lambda r: (r[1], r[0])):
            if runs and runs[-1][0] == lines:
                runs[-1][1].append((page, url))
            else:
                runs.append((lines, [(page, url)]))
        for i, (lines, pages) in enumerate(runs):
            for page, path in pages:
                others = [(-near(runs[j][1][-1 if j < i else 0][1], path), abs(i - j), j > i, runs[j][0]) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(runs)]
                others = [o[3] for o in sorted(others)[:2]]
                kept = lines
                if others:
                    def common(o):
                        best = []
                        for mask in range(1 << len(lines)):
                            some = [x for k, x in enumerate(lines) if mask >> k & 1]
                            rest = iter(o)
                            if len(some) > len(best) and all(x in rest for x in some):
                                best = some
                        return set(best)

                    shared = common(others[0])
                    sure = shared & common(others[1]) if len(others) > 1 else set()
                    size = lambda xs: sum(map(len, xs))
                    copy = 2 * size(shared - sure) > size(x for x in lines if x not in sure)
                    kept = [x for x in lines if x not in (sure if copy else shared)]
                out[page] = "\n".join(kept)
    return out


def test_main_text_against_brute_force(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for host in "abc":
        template = [f"Site line {host} {x}" for x in range(3)]
        for section in ("n", "s/x", "s/y"):
            for _ in range(6):
                own = [f"Own story {k} line {x} " + "w" * rng.randrange(0, 60) for x in range(rng.randrange(0, 4))]
                lines = [template[0], *([f"Section {section} of {host}"] if rng.random() < 0.7 else []), *own, *sorted(rng.sample(template[1:], rng.randrange(0, 3)))]
                if rng.random() < 0.25 and rows:
                    lines = [*rows[-1][2]] if rng.random() < 0.5 else [*rows[-1][2], f"Print {k}"]
                rows.append((k, f"http://{host}.org/{section}/{rng.randrange(300)}", lines))
                k += 1
    pages = spark.createDataFrame([(k, u, "".join(f"<p>{x}</p>" for x in t)) for k, u, t in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    expected = brute_main_text(rows)
    assert {k: (got[k], expected[k]) for k in expected if got[k] != expected[k]} == {}
    assert any("Site line" not in t for t in got.values())


def test_main_text_short_stories(spark):
    """Template lines longer than the stories go; copies and pages that repeat do not hide them."""
    lines = ["Welcome to the long welcome line of this site of many words", "Call us on any day of the week at any hour that you like", "All the news that we found fit for you to read today"]
    rows = [(k, f"http://h.org/{k}", "".join(f"<p>{x}</p>" for x in [lines[0], f"Tale {k} {'x' * k}", *lines[1:]])) for k in range(1, 6)]
    rows += [rows[2], rows[2]]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and {r.page_id: r.text for r in got} == {k: f"Tale {k} {'x' * k}" for k in range(1, 6)}


def test_main_text(spark):
    def page(k, body):
        return (k, f"http://www.h.org/a/{k}?q=1", f"<body><p>Welcome to the site of plain pages<p>{body} is here and long enough to be read<p>Call us on any day</body>")

    rows = [page(k, f"Story number {k} about thing {k * 17}") for k in range(9)]
    rows += [(20, "http://other.org/x", "<p>Alone</p>"), (21, None, None), (22, "http://h.org/a/22", "<article><p>Welcome to the site of plain pages</p></article>"), (None, "http://z.org", "<p>n</p>"), rows[3]]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in (0, 1, 5, 8):
        assert by[k].text == f"Story number {k} about thing {k * 17} is here and long enough to be read"
    assert by[20].text == "Alone" and by[21].text == "" and by[21].n_chars == 0 and by[None].text == "n"
    assert by[22].text == "Welcome to the site of plain pages"
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_beside_articles(spark):
    def page(k, body):
        return (k, f"http://www.h.org/a/{k}", body)

    def story(k):
        return f"Story number {k} about thing {k * 17} is here and long enough to be read by all"

    rows = [page(k, f"<body><p>Welcome to the plain site<div><p>{story(k)}<p>More of {story(k + 50)}</div><article><p>Teaser card {k}</article></body>") for k in range(1, 6)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1, 6):
        assert got[k] == [story(k), f"More of {story(k + 50)}", f"Teaser card {k}"]


# --- licence scans

def test_scan(spark):
    files = [
        ("a/LICENSE", "Permission\nReleased under the MIT License.\n"), ("a/b/c/x.txt", "plain words"), ("a/b/y.txt", None), ("a/b/d/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/b/d/e/z.txt", ""), ("q/w.txt", "word " * 500 + "\nLicensed under CC BY-NC 4.0."), ("q/v.txt", "nothing"), (None, "All rights reserved."), ("top.txt", "t"), ("a/b/c/x.txt", "plain words"),
    ]
    got = license_scan.scan(spark.createDataFrame(files, "path string, text string").selectExpr("*", "'x' as license")).collect()
    assert len(got) == len(files)
    by = {r.path: r for r in got}
    assert by["a/LICENSE"].license == "MIT" and by["a/LICENSE"].source == "header" and by["a/LICENSE"].own_cosine == 1
    assert (by["a/b/c/x.txt"].license, by["a/b/c/x.txt"].source, by["a/b/c/x.txt"].from_dir) == ("MIT", "directory", "a")
    assert by["a/b/y.txt"].license == "MIT"
    assert (by["a/b/d/e/z.txt"].license, by["a/b/d/e/z.txt"].from_dir) == ("Apache-2.0", "a/b/d")
    assert by["q/w.txt"].license == "CC-BY-NC-4.0" and by["q/v.txt"].source == "none" and by["top.txt"].license is None
    assert by[None].license == "Proprietary"
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_scan_whole_texts_and_sentences(spark):
    texts = license_scan.full_texts()
    files = [(f"{name}/LICENSE", "Copyright (c) 2020 Some One.\nAll rights reserved.\n\n" + t) for name, (t,) in texts.items()]
    mit = texts["MIT"][0]
    files += [
        ("untitled/COPYING", mit[mit.index("Permission") :]), ("BSD-3-Clause/a/b.c", "int x;"), ("untitled/x.py", "pass"), ("own/LICENSE", "All rights reserved."),
        ("prose.txt", "The tool was written on long winter evenings by three friends from the north who liked birds. Released under the MIT License. They still maintain it when there is time."),
    ]
    by = {r.path: r for r in license_scan.scan(spark.createDataFrame(files, "path string, text string"), sentences=True).collect()}
    assert {n: by[f"{n}/LICENSE"].license for n in texts} == {n: n for n in texts}
    assert by["untitled/COPYING"].license == "MIT" and by["untitled/x.py"].license == "MIT"
    assert by["BSD-3-Clause/a/b.c"].license == "BSD-3-Clause" and by["BSD-3-Clause/a/b.c"].source == "directory"
    assert by["own/LICENSE"].license == "Proprietary" and by["prose.txt"].license == "MIT"
    docs = spark.createDataFrame([(1, files[-1][1], "en", "s")], "doc_id long, text string, lang string, source string")
    assert license_scan.document_licenses(docs).first().own_license == "MIT"


def test_scan_headers(spark):
    """SPDX lines, wrapped headers in comments, and licences that differ by a version only."""
    gpl = lambda v: f"This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version {v} of the License, or\n# (at your option) any later version."
    mit = license_scan.full_texts()["MIT"][0]
    prose = "The house stood by the river and it was in the care of the people of the town. " * 40
    files = {
        "spdx.c": ("// SPDX-License-Identifier: MIT\nint main() {}\n", "MIT"), "two.py": (f"# {gpl(2)}\nimport os\n" + "x = 1\n" * 300, "GPL-2.0"), "three.py": (f"# {gpl(3)}\nimport os\n" + "x = 1\n" * 300, "GPL-3.0"),
        "only2.h": ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"), "para.txt": (prose + "\n\n" + mit[mit.index("Permission") :], "MIT"), "prose.txt": (prose, None), "zlib.c": ("// SPDX-License-Identifier: Zlib", None),
        "head.txt": ("GNU GENERAL PUBLIC LICENSE", None), "lesser.c": ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    }
    got = {r.path: r.own_license for r in license_scan.scan(spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string"), sentences=True).collect()}
    assert got == {p: x for p, (_, x) in files.items()}


def test_scan_inheritance_against_brute_force(spark):
    """The nearest ancestor with a licence file, whatever its size and name."""
    rng = random.Random(2)
    headers = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "plain words of a file"}
    paths = {"/".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(60)}
    files = []
    for d in sorted(paths):
        for k in range(rng.randrange(1, 4)):
            kind = rng.choice([None, None, "MIT", "Apache-2.0"])
            whole = rng.random() < 0.5
            files.append((f"{d}/f{k}.txt" if d else f"f{k}.txt", headers[kind] if whole else headers[kind] + "\n" + "other things are told here at length " * 90, kind, whole and kind))
    own = {}
    for p, _, kind, whole in files:
        if whole:
            d = p.rpartition("/")[0]
            own[d] = min(own.get(d, "~"), kind)
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    for p, _, kind, _ in files:
        d, at = p.rpartition("/")[0], None
        while at is None:
            if d in own:
                at = d
            elif not d:
                break
            d = d.rpartition("/")[0]
        expected = (kind, "header", None) if kind else (own[at], "directory", at) if at is not None else (None, "none", None)
        assert (got[p].license, got[p].source, got[p].from_dir) == expected, p


def test_scan_cosine_against_brute_force(spark):
    import math
    import re
    from collections import Counter

    texts = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    names = [n for n, ts in license_scan.TEMPLATES.items() for _ in ts]
    counted = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    docs = [counted(t) for t in texts]
    df = Counter(t for c in docs for t in c)

    def vector(c):
        v = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    rng, lines = random.Random(1), []
    for t in texts:
        w = t.split()
        for _ in range(4):
            lines.append(" ".join(x for x in w if rng.random() > 0.25) + " extra" * rng.randrange(3))
    expected = []
    for line in lines:
        v = vector(counted(line)) if counted(line) else {}
        scores = [(round(sum(v.get(t, 0) * x for t, x in vector(c).items()), 6), n) for c, n in zip(docs, names, strict=True)]
        top = max(s for s, _ in scores)
        expected.append(min(n for s, n in scores if s == top) if top >= license_scan.THRESHOLD else None)
    rows = [(f"f{k}/x", line) for k, line in enumerate(lines)]
    got = {r.path: r.own_license for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[p] for p, _ in rows] == expected


# --- quality

@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    syllables = ["th", "er", "on", "ing", "and", "es", "ti", "ou", "re"]
    docs, labels = [], []
    for k in range(600):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        kind = "toxic" if k % 8 == 0 else "junk" if k % 8 == 1 else "clean"
        if kind == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blargh", "snorfus", "gruntix"]))
        if kind == "junk":
            words = [w + "%%%" for w in words] if k % 16 == 1 else [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words), "s", kind))
        if k % 3:
            labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    docs += [(1000, None, "s", "x"), (1001, "", "s", "x"), (None, docs[2][1], "s", "clean"), docs[3]]
    labels += [(None, 1, 0), (5, None, None), (2000, 0, 0), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, _p string, kind string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, judged):
    docs, labels = judged
    judge = lambda d, x: quality.judged(d, x).select("row.*", "p_reject", "p_weak", "keep")
    got = judge(docs, labels).collect()
    assert len(got) == docs.count()
    held_out = [r for r in got if r.doc_id is None or r.doc_id % 3 == 0]
    wrong = [(r.doc_id, r.kind, round(r.p_reject, 3), round(r.p_weak, 3)) for r in held_out if r.kind != "x" and r.keep != (r.kind == "clean")]
    assert len(wrong) <= 0.03 * len(held_out), wrong
    assert {str(r) for r in judge(docs, labels).collect()} == {str(r) for r in got}
    alone = judge(docs, labels.limit(0)).collect()
    assert sum(r.keep == (r.kind != "junk") for r in alone if r.kind != "x") > 0.95 * len(alone)
    assert judge(docs.limit(0), labels).count() == 0


def test_newton_finds_the_minimum():
    """Also where a full step overshoots: rows that are told apart at once, beside a far offset."""
    import numpy as np

    rng = np.random.default_rng(6)
    for scale in (0, 5, 25):
        x = np.column_stack([rng.random((500, 4)) > 0.8, np.ones(500)]).astype(float)
        y = np.clip((x[:, :4].sum(axis=1) > 0).astype(float), 1e-9, 1 - 1e-9)
        offset = scale * (2 * y - 1) * rng.random(500)
        d = quality.newton(x, y, offset, np.full(5, 40.0))
        p = 1 / (1 + np.exp(-(offset + x @ d)))
        assert np.abs(x.T @ (p - y) + quality.RIDGE * d).max() < 1e-4 and np.abs(d).max() < 50


def test_estimate_against_brute_force():
    """The same estimates document by document, without patterns and arrays."""
    import math

    import numpy as np

    rng = random.Random(8)
    truth = [rng.random() < 0.3 for _ in range(400)]
    votes = [[2 if rng.random() < 0.2 else int(t if rng.random() < r else not t) for r in (0.95, 0.8, 0.7)] for t in truth]
    bad = [0.9 if 1 in v else 0.02 if 0 in v else 0.3 for v in votes]
    for _ in range(50):
        share = (sum(bad) + 1) / (len(votes) + 2)
        table = []
        for k in range(3):
            weights = [[0.1 + sum((b if c else 1 - b) for v, b in zip(votes, bad, strict=True) if v[k] == x) for x in (0, 1)] for c in (0, 1)]
            table.append([[w / sum(ws) for w in ws] for ws in weights])
        new = []
        for v in votes:
            odds = [math.log(p) + sum(math.log(table[k][c][v[k]]) for k in range(3) if v[k] < 2) for c, p in ((0, 1 - share), (1, share))]
            new.append(1 / (1 + math.exp(odds[0] - odds[1])))
        bad = new
    patterns, at, counts = np.unique(np.array(votes), axis=0, return_inverse=True, return_counts=True)
    got_share, got_table, got = quality.estimate(patterns, counts.astype(float), rounds=50)
    assert abs(got_share - share) < 1e-6 and np.abs(got_table - np.array(table)).max() < 1e-6
    assert np.abs(got[at.ravel()] - np.array(bad)).max() < 1e-6


def test_estimate_recovers_accuracies():
    import numpy as np

    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.85, 0.7])
    votes = np.where(rng.random((20_000, 3)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, accuracy, _ = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.03
    assert np.abs((accuracy[:, 0, 0] + accuracy[:, 1, 1]) / 2 - right).max() < 0.04


# --- archives

def test_arc_to_warc():
    body = warc.http_head(b"<p>x</p>") + b"<p>x</p>"
    for version in (1, 2):
        data = warc.version_block(version) + b"".join(
            warc.arc_record({"url": u, "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "status": "200"}, c, version) for u, c in [("http://a/", body), ("dns:a", b"ip\nURL 1 2"), ("http://b/", b"")]
        )
        records = [warc.convert(f, c) for f, c in warc.parse_arc(data)]
        assert [r.kind for r in records] == ["warcinfo", "response", "resource", "resource"]
        assert records[1].headers["WARC-Date"] == "2001-02-03T04:05:06Z"
        assert records[1].headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
        back = list(warc.parse_warc(b"".join(r.serialised() + b"\r\n\r\n" for r in records)))
        assert [(r.kind, r.headers, r.block) for r in back] == [(r.kind, r.headers, r.block) for r in records]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-3]))
    assert warc.timestamp("1997") == "1997-01-01T00:00:00Z"


def test_archived(spark):
    rows = [(5, "http://a/ b", "same"), (3, "http://b", "same"), (9, None, None), (10, "u", ""), (11, "http://c", "x\r\n\r\nWARC/1.1\r\n\r\né\n\n"), (3, "http://b", "same"), (12, "http://d", "y" * 300_000), (None, "http://e", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n")
    got = warc.archived(pages).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    for page, _, html in rows:
        data = (html or "").encode()
        r = next(r for r in got if r.page_id == page)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[3] == ("response", None) and kinds[5] == ("revisit", 3) and kinds[9] == ("response", None) and kinds[10] == ("revisit", 9) and kinds[11] == ("response", None)
    assert all(r.record_type == "response" for r in warc.archived(pages, least_bytes=100).collect())
    assert warc.archived(pages.limit(0)).count() == 0


# --- chat formatting

def test_chat(spark):
    hard = "\\a <s> </s> [INST] \\b[\\c] <\\ [END]\n"
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", hard), (1, 0, "system", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, None, None), (None, 0, "user", "[INST]"), (4, 0, "user", "a" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(turns)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("system", ""), ("user", "hi"), ("assistant", hard)]
    assert back[1].loss_text == hard and back[1].valid
    assert len(back[2].turns) == 2 and back[2].loss_text == "xx" and not back[2].valid
    assert [(t.role, t.text) for t in back[3].turns] == [("", "")] and back[None].turns[0].text == "[INST]"
    r = chat_format.digests(chat_format.formatted(turns)).where("conv_id = 1").first()
    assert r.turns_sha256 == hashlib.sha256(f"system\n\nuser\nhi\nassistant\n{hard}\n".encode()).hexdigest()
    assert r.loss_chars == len(hard) and r.loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    assert chat_format.formatted(turns.limit(0)).count() == 0


# --- the pipeline

def test_pipeline(spark, tmp_path, judged):
    import corpus_pipeline

    docs, labels = judged
    rows = [(r.doc_id, r.text, "en", f"s{(r.doc_id or 0) % 4}", len(r.text or "")) for r in docs.where("doc_id is not null").distinct().collect()]
    clean = [r for r in rows if r[0] % 8 > 1 and r[0] < 1000]
    rows += [(5000, clean[0][1], "en", "s1", 1), (5001, clean[1][1] + " tail", "en", "s2", 1)]
    bench = " ".join(clean[5][1].split()[:15])
    docs_schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, docs_schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id for r in out.collect()}
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not got & {5000, 5001, clean[5][0]}
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.kept(source, labels).collect()}
    assert got <= kept and sum(k % 8 <= 1 for k in kept if k < 1000) <= 3
    # what the mix leaves out apart, clean documents stay
    at = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).select(at.columns)
    assert ({r[0] for r in clean} & kept) - {clean[5][0]} <= {r.doc_id for r in at.select("doc_id").collect()}


def test_quality_fit_holds_few_bytes_a_token():
    """The driver fits on a bounded sample; what it holds beside the sample is a few bytes for each of its tokens."""
    import tracemalloc

    import numpy as np

    from plumbline.llm.quality import DIMENSIONS, train

    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.zipf(1.2, 1500) % DIMENSIONS).astype(np.uint32), rng.random(28), float(k % 5 == 0)) for k in range(2000)]
    tracemalloc.start()
    train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * DIMENSIONS * 3 + 12 * sum(len(t) for t, _, _ in rows)


def test_quality_tally():
    import numpy as np

    from plumbline.llm.quality import _Tally

    rng, tally = np.random.default_rng(3), _Tally()
    rows = [np.unique(rng.integers(0, 3000, 40)).astype(np.uint64) for _ in range(300)]
    for r in [*rows, np.empty(0, np.uint64)]:
        tally.add(r)
    tally.merge()
    known, count = np.unique(np.concatenate(rows), return_counts=True)
    assert tally.rows == 301 and np.array_equal(tally.known, known) and np.array_equal(tally.count, count)
