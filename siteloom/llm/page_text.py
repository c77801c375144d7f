"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one per block element, each with a zone that the markup tells:

* ``article``: in an ``article`` (or ``articleBody``) element, ``main``: in a ``main`` element,
* ``chrome``: in navigation, headers, footers, asides, forms, scripts, adverts, notices or
  reader comments, by element, role or class name,
* ``open``: none of these.

Pages of a host are sorted by URL path. The nearest page is the neighbour that shares the
longer beginning of the path. The lines of a page and its nearest page are aligned by their
longest common subsequence, and lines that both share are deleted as boilerplate.

So the text is the page's lines less what it shares with its nearest page, and the markup has the last
word where differencing alone is wrong:

* menus, adverts and footers that differ on every page: lines of the ``chrome`` zone always go,
* passages and whole articles that two pages of a host carry: lines of an article always stay,
* copies of a page: where nothing else is left, lines of the other zones stay although they are shared.

Sorting is by range partitions; the first and last rows of each partition meet their
neighbours in a second, small pass, so that no host is brought into one task.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import common

OPEN, MAIN, ARTICLE, CHROME = 0, 1, 2, 3

# No pattern below looks further than a tag's end or the next tag's beginning, but for quoted values.
OPENING = re.compile(r"<([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: A tag with an odd quote or a bare ``<`` ends at the first ``>``.
BROKEN = re.compile(r"<([a-zA-Z][^\s/<>\"']*+)([^>]*+)>")
CLOSING = re.compile(r"</([a-zA-Z][^\s/<>]*+)[^>]*+>")
COMMENT_END = re.compile(r"--!?>")
LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element and class names, by what they tell.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section "
    "summary table caption thead tbody tfoot tr td th title ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
CHROME_TAGS = RAW | frozenset(
    "head nav footer aside form fieldset button select datalist dialog menu search object canvas audio video".split()
)
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip".split()
)
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar menu nav navbar navigation navi breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments disqus respond reply replies share sharing social related recommended recommendations widget widgets "
    "pagination pager paywall".split()
)
#: Elements whose class tells about the whole page or article, not about themselves.
WHOLE = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLES = frozenset("comment comments reply related recommended sidebar ad ads advert sponsored promo".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}


def _told(tag: str, attributes: str) -> int:
    """The zone that an element opens; OPEN if it tells nothing."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html_lib.unescape(a or b or c))
    words = {x.lower() for x in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hidden = hidden or re.search(r"display\s*:\s*none", found.get("style", "").lower()) is not None
    if tag in CHROME_TAGS or role in CHROME_ROLES or hidden:
        return CHROME
    if words & (NOT_ARTICLES if tag in WHOLE - {"html", "body"} else CHROME_WORDS) and tag not in ("html", "body"):
        return CHROME
    if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower():
        return ARTICLE
    return MAIN if tag == "main" or role == "main" else OPEN


_known = lru_cache(maxsize=20_000)(_told)


def _zone(tag: str, attributes: str) -> int:
    return _known(tag, attributes) if len(attributes) < 1000 else _told(tag, attributes)


def _plain(text: str) -> str:
    """The text with its character references decoded."""
    if "&" not in text:
        return text
    # Numbers beyond all characters, which may be too long to be numbers.
    return html_lib.unescape(LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


class _Lines:
    """The lines of a page while it is read: held text, open elements and the zone inside them."""

    def __init__(self) -> None:
        self.lines: list[tuple[int, str]] = []
        self.held: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        self.zone = OPEN

    def flush(self) -> None:
        if self.held:
            if text := " ".join("".join(self.held).split()):
                self.lines.append((self.zone, text))
            self.held.clear()

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        outer = self.stack[-1][1] if self.stack else OPEN
        if outer != self.zone:
            self.flush()
            self.zone = outer
        return tag

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.open[tag]:  # else it ends nothing
            while self.pop() != tag:
                pass

    def begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            while self.stack and tag in CLOSED_BY.get(self.stack[-1][0], ()):
                self.pop()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID or attributes.endswith("/"):
            return
        own = _zone(tag, attributes)
        if tag == "header" and self.zone not in (ARTICLE, MAIN):
            own = CHROME
        inner = CHROME if CHROME in (self.zone, own) else max(self.zone, own)
        if inner != self.zone:
            self.flush()
        self.stack.append((tag, inner))
        self.open[tag] += 1
        self.zone = inner


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block that has text, in page order, in one pass over the page.

    A tag that the page ends in is no text.
    """
    html = html or ""
    page = _Lines()
    at, end, last = 0, len(html), html.rfind(">")
    text_from = 0
    while (at := html.find("<", at)) >= 0:
        after = html[at + 1 : at + 2]
        name = html[at + 2 : at + 3] if after == "/" else after
        is_tag = name.isascii() and name.isalpha()
        if not is_tag and after not in ("!", "?"):
            at += 1
            continue
        if at > text_from:
            page.held.append(_plain(html[text_from:at]))
        if after in ("!", "?"):
            if html.startswith("<!--", at):
                short = re.compile(r"-?>").match(html, at + 4)
                found = short or COMMENT_END.search(html, at + 4)
                at = found.end() if found else end
            else:
                at = html.find(">", at) + 1 or end
        elif at > last:
            at = end
        elif after == "/":
            found = CLOSING.match(html, at)
            if found:
                page.end(found[1].lower())
                at = found.end()
            else:
                at = html.find(">", at) + 1
        else:
            found = OPENING.match(html, at) or BROKEN.match(html, at)
            at = found.end() if found else at + 1
            if found:
                tag = found[1].lower()
                page.begin(tag, found[2])
                if tag in RAW and page.stack and page.stack[-1][0] == tag:
                    after_raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                    at = after_raw.end() if after_raw else end
                    page.pop()
        text_from = at
    if text_from < end:
        page.held.append(_plain(html[text_from:]))
    page.flush()
    return page.lines


# Longest common subsequences


def _lcs_table(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit vectors (one per element of b)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for x in b:
        m = row & where.get(x, 0)
        row = (row + m | row - m) & full
        rows.append(row)
    pairs, i = [], len(a)
    for j in range(len(b), 0, -1):
        # The zeros below i count what the first i elements of a have in common with b so far.
        mask = (1 << i) - 1
        if (rows[j] & mask).bit_count() == (rows[j - 1] & mask).bit_count():
            continue
        while a[i - 1] != b[j - 1]:
            i -= 1
        i -= 1
        pairs.append((i, j - 1))
    return pairs[::-1]


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of each prefix of a with the whole of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = row & where.get(x, 0)
        row = (row + m | row - m) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return [0, *np.cumsum(bits == 0).tolist()]


def common_lines(a: list[int], b: list[int], table_bits: int = 1 << 26) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of two sequences.

    Equal ends are matched first, then elements that only one side has are left out. What
    is left is solved by a table of bits, or split in halves where that would be too large.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    both = set(a[low : len(a) - high]) & set(b[low : len(b) - high])
    ia = [i for i in range(low, len(a) - high) if a[i] in both]
    ib = [j for j in range(low, len(b) - high) if b[j] in both]
    middle = _halved([a[i] for i in ia], [b[j] for j in ib], table_bits)
    return (
        [(i, i) for i in range(low)]
        + [(ia[i], ib[j]) for i, j in middle]
        + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    )


def _halved(a: list[int], b: list[int], table_bits: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) <= table_bits or len(b) == 1:
        return _lcs_table(a, b)
    half = len(b) // 2
    front = _lengths(a, b[:half])
    back = _lengths(a[::-1], b[half:][::-1])[::-1]
    cut = max(range(len(a) + 1), key=lambda i: front[i] + back[i])
    right = _halved(a[cut:], b[half:], table_bits)
    return _halved(a[:cut], b[:half], table_bits) + [(i + cut, j + half) for i, j in right]


# Pairing

KEY_SCHEMA = "key string, page_id long, host string, path string, url string, lines array<long>"
PAIR_SCHEMA = f"{KEY_SCHEMA}, wanted boolean, pair_id long, shared array<int>"


def url_place(url: str | None) -> tuple[str, str]:
    """Host (lower case, without port) and path; empty where the URL has none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [url_place(x) for x in batch["url"].to_pylist()]
        lines = []
        for html in batch["html"]:
            found = [xxhash.xxh64_intdigest(f"{z}{x}".encode("utf-8", "surrogatepass")) for z, x in page_lines(html.as_py())]
            lines.append(np.array(found, np.uint64).view(np.int64))
        yield pa.record_batch(
            {
                "key": batch["key"],
                "page_id": batch["page_id"],
                "host": pa.array([x for x, _ in places], pa.string()),
                "path": pa.array([x for _, x in places], pa.string()),
                "url": pa.array([x or "" for x in batch["url"].to_pylist()], pa.string()),
                "lines": pa.array(lines, pa.list_(pa.int64())),
            }
        )


def _same_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _nearest(row: dict, before: dict | None, after: dict | None) -> dict | None:
    near = [x for x in (before, after) if x and x["host"] == row["host"]]
    return max(near, key=lambda x: _same_start(x["path"], row["path"]), default=None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows in order, repeated ones once."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != last:
                last = row["key"]
                yield row


def _batches(rows: Iterable[dict], size: int = 1000) -> Iterator[pa.RecordBatch]:
    kinds = [
        *((x, pa.string()) for x in ("key",)),
        ("page_id", pa.int64()),
        *((x, pa.string()) for x in ("host", "path", "url")),
        ("lines", pa.list_(pa.int64())),
        ("wanted", pa.bool_()),
        ("pair_id", pa.int64()),
        ("shared", pa.list_(pa.int32())),
    ]
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch({k: pa.array([x.get(k) for x in held], t) for k, t in kinds})

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _paired(row: dict, before: dict | None, after: dict | None) -> dict:
    near = _nearest(row, before, after)
    pairs = common_lines(row["lines"], near["lines"]) if near else []
    return {
        "key": row["key"],
        "lines": [],
        "pair_id": near["page_id"] if near else None,
        "shared": [i for i, _ in pairs],
    }


def _pair_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs the inner rows of a partition; hands on its first two and last two as they are."""

    def run() -> Iterator[dict]:
        before = row = None
        n = 0
        for after in _rows(batches):
            n += 1
            if n <= 2:
                yield after | {"wanted": n == 1}
            if n > 2:
                yield _paired(row, before, after)
            before, row = row, after
        if n == 2:
            yield row | {"wanted": True}
        elif n > 2:
            yield before | {"wanted": False}
            yield row | {"wanted": True}

    return _batches(run())


def _pair_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs the rows that partitions began and ended with, now in order over all of them."""

    def merged() -> Iterator[dict]:
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if last and row["key"] == last["key"]:
                    last["wanted"] |= row["wanted"]
                    continue
                if last:
                    yield last
                last = row
        if last:
            yield last

    def run() -> Iterator[dict]:
        before = row = None
        for after in merged():
            if row and row["wanted"]:
                yield _paired(row, before, after)
            before, row = row, after
        if row and row["wanted"]:
            yield _paired(row, before, None)

    return _batches(run())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, shares, counts = [], [], []
        for html, shared in zip(batch["html"], batch["shared"].to_pylist(), strict=True):
            lines = page_lines(html.as_py())
            texts.append("\n".join(main_lines(lines, set(shared or ()))))
            counts.append(len(lines))
            shares.append(len(shared or ()))
        yield pa.record_batch(
            {x: batch[x] for x in ("page_id", "url", "pair_id")}
            | {
                "text": pa.array(texts, pa.string()),
                "n_lines": pa.array(counts, pa.int32()),
                "n_shared": pa.array(shares, pa.int32()),
            }
        )


def main_lines(lines: list[tuple[int, str]], shared: set[int]) -> list[str]:
    """The lines that are no boilerplate: neither chrome nor shared with the nearest page.

    Lines of an article stay although they are shared, and so do all lines outside of the chrome where else
    nothing would stay.
    """
    body = [i for i, (z, _) in enumerate(lines) if z != CHROME]
    own = [i for i in body if lines[i][0] == ARTICLE or i not in shared]
    return [lines[i][1] for i in own or body]


def extract_texts(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_lines, n_shared, pair_id.

    ``n_shared`` of the page's ``n_lines`` lines are also on the nearest page, ``pair_id``. The
    page's text is its remaining lines joined by ``\\n``, empty if there are none. A null html
    is empty; pages without a URL are one host; a page that is alone on its host has no pair.
    Repeated rows count once in the pairing and come back as often as they are given. The id
    has to be a whole number or null.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("key", F.md5(F.to_json(F.struct("page_id", "url", F.md5("html").alias("html")))))
    order = ["host", "path", "url", "key"]
    keys = common.materialize(rows.mapInArrow(_line_hashes, KEY_SCHEMA), "page-lines")
    pairs = common.materialize(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pair_within, PAIR_SCHEMA), "page-pairs"
    )
    # Four rows a partition at most; they are found where the table lies and then brought together.
    edges = pairs.filter("wanted is not null").repartition(1).sortWithinPartitions(*order).mapInArrow(_pair_edges, PAIR_SCHEMA)
    found = pairs.filter("wanted is null").unionByName(edges).select("key", "pair_id", "shared")
    schema = "page_id long, url string, pair_id long, text string, n_lines int, n_shared int"
    return rows.join(found, "key", "left").select("page_id", "url", "html", "pair_id", "shared").mapInArrow(_texts, schema)
