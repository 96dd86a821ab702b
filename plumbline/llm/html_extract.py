"""Main-text extraction by nearest-URL page differencing.

A page is read into blocks of text, one line each, with those of menus, headers, footers, asides,
forms, adverts, notices and comments. The pages of one host are ordered by URL path; each is paired
with the page of other text whose path has most in common with its own, the text lines of the two are
aligned by their longest common subsequence, and shared lines are deleted as part of the site's
template. Where the nearest page is nearly a copy (more than half of the text is shared), which says
little about the template, only those lines go that the second nearest page shares too.

What differencing can't see, as an advert that differs by page, is then told by structure: by
elements, roles and class names. Lines inside a declared article are never deleted by differencing,
as an article may well repeat a passage of another page's article.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dealing_keys, partitions

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_GONE = frozenset("head button select option object video audio canvas".split())
_CUT = frozenset("nav header footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: Words of class names and ids that tell what isn't article text, and words that say nothing beside them.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notification popup newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist reply replies disqus respond login pagination toolbar".split()
)
_NEUTRAL = frozenset("area bar block body box bottom btn button buttons card cards col column container content form global header icon icons inner item items left link links list main media message messages outer page panel post posts right row section site slot small text thread title top unit widget wrap wrapper".split())
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_SAME = frozenset("ul ol dl table menu dir select tbody thead tfoot".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _named_clutter(attributes: dict[str, str]) -> bool:
    """A name tells clutter if it has such a word and nothing else of meaning: ``social-links``, not ``social-history``."""
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        parts = [p for p in re.split(r"[-_:]+|(?<=[a-z])\d+$", name) if p and not p.isdigit()]
        if not _PARTS.isdisjoint(parts) and all(p in _PARTS or p in _NEUTRAL for p in parts):
            return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


#: Kinds of blocks: of a declared article, of clutter by structure, any other.
ARTICLE, CLUTTER, PLAIN = "+", "~", "-"


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(text, kind) of every block of text, in page order."""
    if not page:
        return []
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, int, int, int]] = []  # element, holds no text, is clutter, declares an article
    gone, clutter, article, raw = 0, 0, 0, None
    text, side = [], []  # of the block at hand, and of clutter inside or after it
    at = 0

    def close() -> None:
        for parts, kind in ((text, ARTICLE if article else PLAIN), (side, CLUTTER)):
            if parts:
                if line := " ".join("".join(parts).split()):
                    found.append((line, kind))
                parts.clear()

    def add(piece: str) -> None:
        if not gone:
            (side if clutter else text).append(piece)

    def pop() -> None:
        nonlocal gone, clutter, article
        name, was_gone, was_clutter, was_article = stack.pop()
        if name in _BLOCK:
            close()
        gone -= was_gone
        clutter -= was_clutter
        article -= was_article

    def pop_to(k: int) -> None:
        while len(stack) > k:
            pop()

    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), None
            continue
        token = None
        opening = page.find("<", at)
        while opening >= 0:
            if token := _TOKEN.match(page, opening):
                break
            opening = page.find("<", opening + 1)
        stop = opening if opening >= 0 else len(page)
        if not gone and stop > at:
            add(html_lib.unescape(page[at:stop]))
        if not token:
            break
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if token[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                pop_to(k)
            elif name in _BLOCK and not gone:
                close()
            continue
        if name == "br":
            add(" ")
            continue
        if name in _P_CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in ("td", "th", "button", "table", "caption"):
                    break
        if name in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[name]:
                    pop_to(k)
                    break
                if stack[k][0] in _ENDS_SAME:
                    break
        if name in _BLOCK:
            close()
        if name in _VOID:
            continue
        attributes = _attributes(token[3]) if token[3] and len(token[3]) > 3 else {}
        if name in _RAW:
            if not token[3].rstrip().endswith("/") or name not in ("svg", "math"):
                raw = name
            stack.append((name, 1, 0, 0))
            gone += 1
            continue
        if token[3].endswith("/") and name in ("svg", "math"):
            continue
        empty = name in _GONE or _hidden(attributes)
        cut = name in _CUT or attributes.get("role", "").lower() in _ROLES
        if name == "header" and article and not clutter:
            cut = False
        if name not in ("html", "body", "main"):
            cut = cut or _named_clutter(attributes)
        declares = not (empty or cut or gone or clutter) and (name in ("article", "main") or attributes.get("role") in ("main", "article") or "articleBody" in attributes.get("itemprop", ""))
        stack.append((name, int(empty), int(cut), int(declares)))
        gone += empty
        clutter += cut
        article += declares
    pop_to(0)
    close()
    return found


def path_key(url: str | None) -> tuple[str, str]:
    """(host, path): without scheme, www, query, fragment and closing slash."""
    m = re.match(r"(?:[a-zA-Z][-+.\w]*:)?//([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", re.split(r"[?#]", url or "")[0].rstrip("/")
    return m[1].lower().removeprefix("www."), m[2].rstrip("/")


def _lcs(a: list[int], b: list[int], most_cells: int = 1 << 28) -> np.ndarray:
    """Marks the items of ``a`` on a longest common subsequence with ``b``; bit-parallel rows, halved where they'd be large."""
    mark = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        mark[lo] = True
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        mark[len(a) - 1 - hi] = True
        hi += 1
    common = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x = [k for k in range(lo, len(a) - hi) if a[k] in common]
    y = [v for v in b[lo : len(b) - hi] if v in common]
    if not x:
        return mark
    if len(x) * len(y) > most_cells:  # split as Hirschberg does
        half = len(x) // 2
        left = _row([a[k] for k in x[:half]], y)
        right = _row([a[k] for k in reversed(x[half:])], y[::-1])[::-1]
        split = int(np.argmax(left + right))
        mark[x[:half]] = _lcs([a[k] for k in x[:half]], y[:split], most_cells)
        mark[x[half:]] = _lcs([a[k] for k in x[half:]], y[split:], most_cells)
        return mark
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [], full
    for k in x:
        rows.append(v)
        match = where[a[k]]
        v = ((v + (v & match)) | (v & ~match)) & full
    j = len(y)
    for i in range(len(x) - 1, -1, -1):
        # the length up to row i and column j is the number of zeros among the first j bits
        before = rows[i]
        after = rows[i + 1] if i + 1 < len(x) else v
        while j and not after >> (j - 1) & 1 == 0:
            j -= 1
        if not j:
            break
        if before >> (j - 1) & 1:  # the zero is new in this row: the row's item is matched here
            mark[x[i]] = True
            j -= 1
        # otherwise the same length was reached without this row's item
    return mark


def _row(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of x with every prefix of y."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for k in x:
        match = where.get(k, 0)
        v = ((v + (v & match)) | (v & ~match)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def template_lines(mine: list[str], nearest: list[str], second: list[str] | None = None) -> np.ndarray:
    """Marks the lines of ``mine`` that are shared with the nearest page; if that is nearly a copy, those shared with the second nearest too."""
    codes = [hash(x) for x in mine]
    shared = _lcs(codes, [hash(x) for x in nearest])
    size = np.array([len(x) for x in mine], np.int64)
    sure = shared & _lcs(codes, [hash(x) for x in second]) if second is not None else np.zeros(len(mine), bool)
    copy = 2 * size[shared & ~sure].sum() > size[~sure].sum()
    return sure if copy else shared


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            for p, q in zip(x, y, strict=False):
                if p != q:
                    break
                n += 1
            break
        n += len(x) + 1
    return n


def _page_keys(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield (*path_key(url), -(2**63) if page is None else page)


def _run_results(run: tuple, before: list[tuple], after: list[tuple]) -> Iterator[tuple]:
    """(page_id, url, text, lines deleted by differencing, lines deleted by structure) of a run of pages of equal text.

    A run is (host, lines, pages); ``before`` and ``after`` are the next runs of its host, nearest first.
    """
    _, lines, pages = run
    mine = [x for x, _ in lines]
    done: dict[tuple, tuple] = {}
    for halo, path, page, url in pages:
        if halo:
            continue
        # path, then distance, then the page before
        near = [(-_common(r[2][-1][1], path), d, 0) for d, r in enumerate(before)] + [(-_common(r[2][0][1], path), d, 1) for d, r in enumerate(after)]
        chosen = tuple((side, d) for _, d, side in sorted(near)[:2])
        if chosen not in done:
            others = [[x for x, _ in (before, after)[side][d][1]] for side, d in chosen]
            shared = template_lines(mine, *others) if others and any(kind != ARTICLE for _, kind in lines) else np.zeros(len(lines), bool)
            left = [(x, kind) for (x, kind), s in zip(lines, shared, strict=True) if kind == ARTICLE or not s]
            text = [x for x, kind in left if kind != CLUTTER]
            done[chosen] = ("\n".join(text), len(lines) - len(left), len(left) - len(text))
        yield page, url, *done[chosen]


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_clutter`` for every row of ``pages (page_id, url, html)``.

    ``text`` is the blocks that stay, joined by one line feed; empty if none. ``n_shared`` and
    ``n_clutter`` count the blocks that differencing and then structure deleted. A null html is an
    empty page; null urls form a host of their own. Neighbouring pages of equal text, as rows that
    repeat a page, count as one neighbour; of pages equally near the one before counts first. Pages of
    any length are read whole. They travel once, as compressed blocks, to range partitions of
    (host, path, page_id); the two outermost pages at each end of a partition are sent to its
    neighbours as well, so only there a run of more than two pages of equal text hides what is
    behind it.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    total = base.count()
    wanted = 24 * n  # a bounded sample of keys only sets the bounds of the partitions
    rate = min(1.0, wanted / max(1, total))
    drawn = base.select("page_id", "url").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).limit(4 * wanted).collect()
    sample = sorted({(*path_key(r.url), -(2**63) if r.page_id is None else r.page_id) for r in drawn})
    bounds = [sample[k * len(sample) // n] for k in range(1, n)] if len(sample) >= n else sample
    bounds = sorted(set(bounds))

    def place(key) -> int:
        lo, hi = 0, len(bounds)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if bounds[mid] <= key else (lo, mid)
        return lo

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bool], list[tuple]] = {}
        for key in _page_keys(batches):
            b = place(key)
            for last in (False, True):
                held = found.setdefault((b, last), [])
                if key not in held:
                    held.append(key)
                    held.sort(reverse=last)
                    del held[2:]
        rows = [(b, last, *key) for (b, last), held in found.items() for key in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64()))], names=["b", "last", "host", "path", "id"])

    outer = base.select("page_id", "url").mapInArrow(ends, "b long, last boolean, host string, path string, id long").groupBy("b", "last")
    edge = {(r.b, r.last): sorted(map(tuple, r.keys)) for r in outer.agg(F.collect_set(F.struct("host", "path", "id")).alias("keys")).collect()}  # four keys of each partition and task at most
    filled = sorted({b for b, _ in edge})
    also: dict[tuple, set[int]] = {}
    for last, order in ((True, filled), (False, filled[::-1])):
        carried: list[tuple] = []
        for b in order:
            for key in carried:
                also.setdefault(key, set()).add(b)
            ends_of = edge[b, last][-2:] if last else edge[b, last][:2][::-1]
            carried = (carried + ends_of)[-2:]
    keys = dealing_keys(spark, n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for page, url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                host, path = path_key(url)
                k = (host, path, -(2**63) if page is None else page)
                found = blocks(source.as_py())
                packed = z.compress("\n".join(kind + line for line, kind in found).encode("utf-8", "surrogatepass"))
                own = place(k)
                for b in (own, *sorted(also.get(k, ()))):
                    for column, v in zip(rows, (keys[b], b != own, host, path, page, url, packed), strict=True):
                        column.append(v)
            types = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names=["b", "halo", "host", "path", "page_id", "url", "z"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()

        def runs() -> Iterator[tuple]:
            """(bucket and host, lines, pages) of neighbouring pages of equal text."""
            run, packed = None, None
            for batch in batches:
                for b, halo, host, path, page, url, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if run and run[0] == (b, host) and packed == z:
                        run[2].append((halo, path, page, url))
                        continue
                    if run:
                        yield run
                    lines = unzip.decompress(z).decode("utf-8", "surrogatepass")
                    run, packed = ((b, host), [(x[1:], x[0]) for x in lines.split("\n")] if lines else [], [(halo, path, page, url)]), z
            if run:
                yield run

        def results() -> Iterator[tuple]:
            window: list[tuple] = []  # up to two runs before the current one, which is at ``place``, and two after it
            place = 0

            def current() -> Iterator[tuple]:
                run = window[place]
                near = lambda part: [r for r in part if r[0] == run[0]]
                return _run_results(run, near(window[:place][::-1]), near(window[place + 1 :]))

            for run in runs():
                window.append(run)
                if len(window) > place + 2:
                    yield from current()
                    if place < 2:
                        place += 1
                    else:
                        window.pop(0)
            while place < len(window):
                yield from current()
                if place < 2:
                    place += 1
                else:
                    window.pop(0)

        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["page_id", "url", "text", "n_chars", "n_shared", "n_clutter"]
        out: list[list] = [[] for _ in names]
        for page, url, text, shared, cut in results():
            for column, v in zip(out, (page, url, text, len(text), shared, cut), strict=True):
                column.append(v)
            if len(out[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    dealt = base.mapInArrow(deal, "b int, halo boolean, host string, path string, page_id long, url string, z binary")
    result = "page_id long, url string, text string, n_chars long, n_shared long, n_clutter long"
    return dealt.repartition(n, "b").sortWithinPartitions("b", "host", "path", "page_id", "z").mapInArrow(differ, result)
