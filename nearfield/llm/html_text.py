"""Main text of web pages by nearest-URL page differencing.

Each page is cut into text lines, one for each block, menus and the like included. Pages are sorted by host and URL path, a
page is paired with its neighbour there (the one before, or the one after at the start), and their lines are aligned by
a longest common subsequence. Shared lines are what a site repeats: they are deleted, unless they lie in the marked
article. That decides first and on every page. Markup is the second signal, for lines that no neighbour repeats: what is
left in elements that it names as menu, header, footer, sidebar, notice, advert, form or comment section goes too, and a
marked page without a neighbour keeps its article alone. Lines inside a marked article (article, main or role=main)
count in the alignment but are not deleted by it, as articles of a site do share sentences. Scripts, styles and other
content that is no text never make lines.

Pages of a host with equal lines are one class, which stands at its first page; the neighbour is the nearest class, so
copies do not hide the site's lines from each other and all get the same lines deleted. Classes carry a hash for each
line and are dealt by range of (host, path, page_id), which also spreads a host that has a third of all pages. The classes
at the borders of ranges (three a range at most) are stored and paired on the driver, so results do not depend on the
ranges. The result is joined back to all pages. A host with a single class keeps what the markup leaves.

The alignment runs on bits, 30 lines a step, and keeps SPLIT bits at most, beyond which it halves the lines (Hirschberg);
tags are cut in one pass that never looks back. So a page of many equal lines or unclosed tags costs no more than others.

Edge cases: null html is the empty page; null URLs are of one empty host; unclosed elements end at the end of the
page and an unclosed menu or the like does not swallow what follows; very long pages are handled whole; equal pages
keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of

#: Comments, raw sections, declarations, whole tags, tags that the next one or the end cuts off, text.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^"'<>])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>?|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PART = re.compile(r"[^a-z0-9]+")

#: Fixed values of HTML: elements whose content is no text, elements without content, and elements that are blocks.
RAW = frozenset("script style template noscript textarea title iframe object svg math canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements, roles and parts of class names and ids that mark what is not the article.
OUTSIDE = frozenset("head nav header footer aside form menu dialog button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription popup modal login signup search widget pagination pager skip".split()
)
#: Those that also mark a block inside a marked article, where the others name parts of its text.
INNER_NAMES = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo cookie cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar comment comments commentlist disqus newsletter".split())
INNER_OUTSIDE = OUTSIDE - {"label", "button"}
ARTICLE = frozenset(("article", "main"))
#: Bits that an alignment keeps at once: 16 MB.
SPLIT = 1 << 27


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


def _is_outside(tag: str, attributes: dict[str, str], inside: bool = False) -> bool:
    if tag in (INNER_OUTSIDE if inside else OUTSIDE):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("role", "").lower() in ROLES:
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    return any(p in (INNER_NAMES if inside else NAMES) for p in _PART.split(names))


#: Where a line lies: in what markup excludes, in plain content, in the marked article.
OUT, PLAIN, INSIDE = 0, 1, 2


def lines_of(page: str) -> tuple[list[str], bool]:
    """Lines of the page outside of what markup excludes, and if markup named the article (then they are its lines)."""
    lines, kinds, named = marked_lines(page)
    least = INSIDE if named else PLAIN
    return [x for x, k in zip(lines, kinds, strict=True) if k >= least], named


def marked_lines(page: str) -> tuple[list[str], list[int], bool]:
    """All lines of the page, where each of them lies, and if markup named the article."""
    low = page.lower() if "<" in page else page
    lower = low if len(low) == len(page) else page
    every: list[str] = []
    kinds: list[int] = []
    words: list[str] = []
    skip, depth, named, raw_end = "", 0, False, 0
    articles: list[list] = []  # open articles: the tag, and how many of this tag are open since
    closes: dict[str, int] = {}

    def last_close(tag: str) -> int:
        if tag not in closes:
            closes[tag] = lower.rfind(f"</{tag}")
        return closes[tag]

    def end_block() -> None:
        if words:
            line = " ".join("".join(words).split())
            words.clear()
            if line:
                every.append(line)
                kinds.append(OUT if skip else INSIDE if articles else PLAIN)

    for m in _TOKEN.finditer(page):
        if m.start() < raw_end:
            continue
        tag = m[2] or m[5]
        if not tag:
            piece = m[0]
            if piece == "<" or not piece.startswith("<"):
                words.append(html.unescape(piece))
            elif piece.startswith("<![CDATA["):
                words.append(piece[9:].removesuffix("]]>"))
            continue
        tag, closing, raw = tag.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        empty = tag in VOID or (raw.endswith("/") and tag not in BLOCKS)
        if tag in RAW and not closing and not empty:
            close = lower.find(f"</{tag}", m.end()) if last_close(tag) >= m.end() else -1
            raw_end = len(page) if close < 0 and tag in ("script", "style") else max(close, m.end())
            continue
        if tag == "br":
            words.append(" ")
        if tag in BLOCKS:
            end_block()
        if skip:
            if tag == skip and not empty:
                depth += -1 if closing else 1
                if not depth:
                    end_block()
                    skip = ""
            continue
        if closing:
            at = next((n for n in range(len(articles) - 1, -1, -1) if articles[n][0] == tag), -1)
            if at >= 0:
                articles[at][1] -= 1
                if not articles[at][1]:
                    end_block()
                    del articles[at:]
            continue
        if empty:
            continue
        attributes = _attributes(raw)
        mark = tag in ARTICLE or attributes.get("role", "").lower() == "main"
        if _is_outside(tag, attributes, bool(articles)) and tag not in ("html", "body") and not (mark and tag not in ARTICLE):
            if last_close(tag) >= m.end():
                end_block()
                skip, depth = tag, 1
        elif mark:
            end_block()
            named = True
            articles.append([tag, 1])
        elif articles and articles[-1][0] == tag:
            articles[-1][1] += 1
    end_block()
    return every, kinds, named


class _Places:
    """For a line, the bits of its places in b; those of frequent lines are kept."""

    def __init__(self, b: list) -> None:
        self.size = len(b)
        self.at: dict = {}
        self.kept: dict = {}
        for j, line in enumerate(b):
            self.at.setdefault(line, []).append(j)

    def bits(self, line) -> int:
        places = self.at.get(line, ())
        if len(places) <= 64:
            return sum(1 << j for j in places)
        if line not in self.kept:
            bits = np.zeros(self.size, np.uint8)
            bits[places] = 1
            self.kept[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return self.kept[line]


def _bit_rows(a: list, b: list) -> Iterator[int]:
    """After each line of a: bit j is 0 if line j of b lengthens the common subsequence (Hyyro, 2004). First, all ones."""
    places = _Places(b)
    mask = row = (1 << len(b)) - 1
    yield row
    for line in a:
        hit = row & places.bits(line)
        row = ((row + hit) | (row - hit)) & mask
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a and each beginning of b."""
    row = 0
    for row in _bit_rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    low, high, end = 0, len(a), len(b)
    while low < min(high, end) and a[low] == b[low]:
        low += 1
    out = set(range(low))
    while min(high, end) > low and a[high - 1] == b[end - 1]:
        high, end = high - 1, end - 1
        out.add(high)
    a, b = a[low:high], b[low:end]
    if not a or not b:
        return out
    if len(a) > 1 and len(a) * len(b) > SPLIT:
        half = len(a) // 2
        ahead, behind = _lengths(a[:half], b), _lengths(a[: half - 1 : -1], b[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        return out | {low + i for i in common_lines(a[:half], b[:cut])} | {low + half + i for i in common_lines(a[half:], b[cut:])}
    rows = list(_bit_rows(a, b))
    i, j = len(a), len(b)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif i > 1 and not rows[i - 1] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.add(low + i)
    return out


def _shared(lines: list, neighbour: list | None) -> list[bool] | None:
    """For each line, if the neighbour shares it."""
    if neighbour is None:
        return None
    at = common_lines(lines, neighbour)
    return [i in at for i in range(len(lines))]


def _key(lines: list[str], size: int) -> bytes:
    return blake2b("\n".join(lines).encode(), digest_size=size).digest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [marked_lines(x) for x in batch.column("html").to_pylist()]
        lines, kinds, named = (pa.array([x[n] for x in found], t) for n, t in enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_())))
        keys = pa.array([_key(x[0], 16) for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), keys, lines, kinds, named], names=["page_id", "url", "host", "key", "lines", "kinds", "named"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with 64-bit hashes of their lines; a page without lines tells nothing about the site."""
    for batch in batches:
        found = [(n, lines) for n, x in enumerate(batch.column("html").to_pylist()) if (lines := marked_lines(x)[0])]
        own = batch.take(pa.array([n for n, _ in found], pa.int64()))
        keys = pa.array([_key(lines, 16) for _, lines in found], pa.binary())
        hashes = pa.array([[int.from_bytes(_key([x], 8), "little", signed=True) for x in lines] for _, lines in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("host", "path", "page_id")), keys, hashes], names=["host", "path", "page_id", "key", "hashes"])


def _paired(classes: Iterable[tuple]) -> Iterator[tuple]:
    """(class, shared) of sorted classes (host, key, hashes, ...): with the one before, or the one after at the start of a host."""
    last = waiting = None
    for c in classes:
        same = last is not None and last[0] == c[0]
        if waiting:
            yield waiting, _shared(waiting[2], c[2] if same else None)
            waiting = None
        if same:
            yield c, _shared(c[2], last[2])
        else:
            waiting = c
        last = c
    if waiting:
        yield waiting, None


_FOUND = "host string, key binary, shared array<boolean>, hashes array<bigint>, part int, place int, open boolean"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a range's classes (place 0), and its first, second and last class with hashes; other ranges decide on an open one."""
    part, rows = TaskContext.get().partitionId(), (c for b in batches for c in zip(*(b.column(x).to_pylist() for x in ("host", "key", "hashes")), strict=True))
    out: list[tuple] = []
    ends: list[tuple] = []
    held: tuple | None = None  # the last class so far and its result
    for n, (c, shared) in enumerate(_paired(rows)):
        if held:
            out.append((*held[0][:2], held[1], None, part, 0, False))
        if len(out) >= 1000:
            yield _rows(out)
            out = []
        if n < 2:
            ends.append((*c[:2], None, c[2], part, n + 1, not n))
        held = (c, shared) if n else None
    if held:
        c, shared = held
        last = (*c[:2], None, c[2], part, 3, shared is None)  # the next range may begin with its host
        ends = ends[: 1 if ends[1][:2] == c[:2] else 2] + [last]
        if shared is not None:
            out.append((*c[:2], shared, None, part, 0, False))
    yield _rows(out + ends)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"host": pa.string(), "key": pa.binary(), "shared": pa.list_(pa.bool_()), "hashes": pa.list_(pa.int64()), "part": pa.int32(), "place": pa.int32(), "open": pa.bool_()}
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared for each row of pages.

    n_lines: lines of the whole page. n_shared: those that the alignment deleted.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), text_of(html_col).alias("html"),
    )
    parsed = rows.mapInArrow(_parse, "page_id bigint, url string, host string, key binary, lines array<string>, kinds array<int>, named boolean")
    hashed = rows.mapInArrow(_hash, "host string, path string, page_id bigint, key binary, hashes array<bigint>")
    classes = hashed.groupBy("host", "key").agg(F.min(F.struct("path", "page_id")).alias("at"), F.first("hashes").alias("hashes")).select("host", "at.path", "at.page_id", "key", "hashes")
    dealt = classes.repartitionByRange("host", "path", "page_id", "key").sortWithinPartitions("host", "path", "page_id", "key")
    found = stored(dealt.mapInArrow(_pair, _FOUND), "page-classes")
    borders = sorted(found.where("place > 0").select("host", "key", "hashes", "part", "place", "open").collect(), key=lambda r: (r["part"], r["place"]))  # three a range
    paired = [(c["host"], c["key"], shared) for c, shared in _paired(borders) if c["open"]]
    ends = pages.sparkSession.createDataFrame(paired, "host string, key binary, shared array<boolean>")
    shared = found.where("place = 0").select("host", "key", "shared").unionByName(ends)
    # First the alignment: what the neighbour shares goes, but for lines of the marked article. Then the markup.
    is_shared = lambda i: F.coalesce(F.get("shared", i), F.lit(False)) & (F.get("kinds", i) != INSIDE)
    least = F.when(F.col("shared").isNull() & F.col("named"), INSIDE).otherwise(PLAIN)
    at = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    out = parsed.join(shared, ["host", "key"], "left").withColumn("left", F.filter(at, lambda i: ~is_shared(i)))
    kept = F.filter("left", lambda i: F.get("kinds", i) >= least)
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    n = F.size("lines").cast("long")
    return out.select("page_id", "url", text.alias("text"), n.alias("n_lines"), (n - F.size("left")).alias("n_shared")).withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_lines", "n_shared")
