"""Main text of web pages: repeated runs of a host's pages, confirmed by the markup.

A host's pages are read as token streams. Every position starts a suffix; the
suffixes of a host are grouped by their first words, which is a suffix array
cut at that depth, kept as a distributed table. A stretch that starts such a
suffix on two distinct pages is a long repeated substring, and what those
stretches cover is boilerplate; the runs between them are unique.

Repetition alone takes mirrored articles for boilerplate and leaves menus and
adverts of small hosts in. Where the markup says what a block is, it decides:
blocks inside ``article`` or ``main`` are text unless they lie in a nested
menu, form, notice or the like, and pages that have such an element have no
other text. On all other pages blocks that the markup does not rule out are
judged by repetition, against whole pages and ruled-out blocks of their host.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.semantics import BROADCAST_BYTES, persisted, row_bytes

#: Words that make a repeated stretch long.
DEPTH = 6

TEXT, OPEN, RULED_OUT = 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[^a-z0-9]+")

#: Fixed values of HTML: elements that break a line of text, that hold no text for readers, and that have no end tag.
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template title textarea svg iframe object select button canvas audio video math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and parts of class names or ids that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup share sharing social sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar toolbar footer bottombar related recommended widget login comment comments disqus "
    "reply replies respond pagination pager skip".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())


def _kind(name: str, attributes: str, zone: int, in_comments: bool) -> tuple[int, bool]:
    """Zone inside an element, and whether it lies among reader comments."""
    role, names = "", set()
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == "role":
                role = value.strip()
            else:
                names.update(_PIECES.split(value))
    in_comments = in_comments or bool(names & COMMENTS)
    if in_comments:
        return RULED_OUT, True
    if name in ("article", "main") or role == "main":
        return TEXT, False
    if name in ("html", "body"):
        return zone, False
    if name in ASIDE_TAGS or role in ASIDE_ROLES or names & ASIDE_NAMES or (name == "header" and zone != TEXT):
        return RULED_OUT, False
    return zone, False


def blocks(source: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order: references decoded, white space single, no empty ones."""
    out: list[tuple[int, str]] = []
    if not source:
        return out
    stack: list[tuple[str, int, bool]] = []
    zone, in_comments, held, at = OPEN, False, [], 0

    def close() -> None:
        text = " ".join(_html.unescape("".join(held)).split())
        if text:
            out.append((zone, text))
        held.clear()

    while True:
        m = _TAG.search(source, at)
        if m is None:
            held.append(source[at:])
            close()
            return out
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        ending, attributes = m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if name in SILENT and not ending:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                if end is None:
                    close()
                    return out
                at = end.start()
            if name == "title":
                close()
            continue
        if name in BREAKS:
            close()
        if name in VOID or name in SILENT:
            continue
        if ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if stack[depth][1:] != (zone, in_comments):
                    close()
                zone, in_comments = stack[depth][1:]
                del stack[depth:]
            continue
        if stack and (stack[-1][0] == name in ("p", "li", "option") or stack[-1][0] == "p" and name in BREAKS):
            zone, in_comments = stack.pop()[1:]
        inner = _kind(name, attributes, zone, in_comments)
        if inner[0] != zone:
            close()
        stack.append((name, zone, in_comments))
        zone, in_comments = inner


def _joined(parts: list[tuple[int, str]]) -> str:
    """Text of a page that has an article or main element; without one, all blocks that are not ruled out."""
    named = [t for z, t in parts if z == TEXT]
    return " ".join(named if named else [t for z, t in parts if z == OPEN])


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _tokens(parts: list[tuple[int, str]], structure: bool) -> list[str]:
    """Words of the stream, each block followed by a mark; with ``structure`` without the blocks that are text."""
    out: list[str] = []
    for zone, text in parts:
        if structure and zone == TEXT:
            if out and out[-1] != "\n":
                out.append("\n")
            continue
        out += text.split(" ")
        out.append("\n")
    return out


def _named(parts: list[tuple[int, str]]) -> bool:
    """Whether the page has text in an article or main element, by its parsed markup."""
    return any(zone == TEXT for zone, _ in parts)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))


def repeated_places(pages: DataFrame, structure: bool = True, depth: int = DEPTH) -> DataFrame:
    """(key, place): stream positions where a suffix of ``depth`` words starts that another page of the host has too.

    ``key`` is the digest of a page's source; equal sources are one page. Only
    a host, a digest and two pages stand for a suffix, and they are combined
    before they travel, so a run on every page of a host costs little.
    """

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for where, key, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts = blocks(source)
                words, judge = _tokens(parts, structure), not (structure and _named(parts))
                out += [(where, key, i, "\n".join(words[i : i + depth]), judge) for i in range(max(0, len(words) - depth + 1))]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "key", "place", "suffix", "judge"])

    sources = pages.where("html is not null").select(host(F.col("url")).alias("host"), F.md5("html").alias("key"), "html")
    found = sources.mapInArrow(suffixes, "host string, key string, place int, suffix string, judge boolean")
    found = found.select("key", "place", "judge", F.xxhash64("host", "suffix").alias("h1"), F.xxhash64("suffix", "host", F.lit(1)).alias("h2"))
    shared = found.groupBy("h1", "h2").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h1", "h2")
    return found.where("judge").join(shared, ["h1", "h2"]).select("key", "place").distinct()


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structure: bool = True, depth: int = DEPTH
) -> DataFrame:
    """(page_id, url, text): one row per input row.

    Blocks are joined in page order by one space. Null and empty sources, and
    pages without text, give an empty text; repeated rows repeat their result;
    a null url is a host of its own. With ``structure`` off, repetition alone
    decides, over all blocks of all pages.
    """
    own = _pages(pages, id_col, url_col, html_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                parts = blocks(source)
                if structure and _named(parts):
                    texts.append(_joined(parts))
                    continue
                words = _tokens(parts, structure)
                covered = bytearray(len(words))
                for p in places or ():
                    covered[p : p + depth] = b"\1" * depth
                keep, at = [], 0
                for zone, text in parts:
                    n = text.count(" ") + 1
                    if not (structure and zone == RULED_OUT):
                        keep += [w for w, c in zip(words[at : at + n], covered[at : at + n]) if not c]
                    at += n + 1
                texts.append(" ".join(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = own.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    places = persisted(repeated_places(own, structure, depth), "places")
    by_page = places.groupBy("key").agg(F.collect_list("place").alias("places"))
    if places.count() * row_bytes(places.schema) <= BROADCAST_BYTES:
        by_page = F.broadcast(by_page)
    own = own.withColumn("key", F.coalesce(F.md5("html"), F.md5(F.coalesce("url", F.lit("")))))
    out = own.join(by_page, "key", "left").select("page_id", "url", "html", "places").mapInArrow(judged, schema)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")
