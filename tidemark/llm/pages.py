"""Main text of web pages, with the templates of their sites removed.

Every element's subtree is hashed (its tag, its class and its text, with those of the elements inside). Spark counts in
how many different pages of a host each hash occurs, and subtrees that recur across many are deleted from its pages. What
remains is read as the page's main text: the article (or main) element if there is one, without elements that tell by tag,
role or class that they are no part of it.

Inside an article (or main) element, paragraphs, headings and the like and whatever holds one are its text however often
they recur (quotations, or a body that is published again), and so is the larger part of it: of other subtrees that recur,
the smallest go first, while more text stays than goes. An element that holds an article is never taken for a template.

Pages whose main text is the same (they differ in advertisements, comments, notices or markup alone) count as one page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_below, emit, stash

# A subtree is a template if it is in so many pages of a hundred of a host's, but in so many at least.
MANY_PAGES = 3
MANY_PERCENT = 30

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_UNQUOTED = re.compile(r"[^>\"']*+")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,}+;?")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")

#: Kinds of elements by tag, role and words of their class or id.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table thead tbody tfoot tr td th caption figure figcaption hr".split())
_INLINE_SPACE = frozenset(["br", "img", "wbr"])
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "summary", "legend"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table body html article main section div nav aside form select".split())
_OUT = frozenset("head nav footer aside form button select option textarea script style noscript template iframe object svg canvas audio video dialog menu label input title".split())
_OUT_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion share sharing social newsletter subscribe signup popup modal overlay "
    "login search pagination related recommended widget toolbar".split())
_OUT_HEADER = frozenset("header masthead banner topbar".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond discussion".split())


class _Element:
    __slots__ = ("tag", "name", "at", "out", "holds", "plain", "text", "parts")

    def __init__(self, tag: str, name: str, at: int, out: int, plain: bool):
        self.tag, self.name, self.at, self.out, self.plain = tag, name, at, out, plain
        self.holds = False  # an article or main element
        self.text = False  # a paragraph or the like of an article
        self.parts: list[str] = []  # text, and hashes of elements inside


def _decode(text: str) -> str:
    """Character references decoded; numbers too long to be one are beyond all characters, whatever their length."""
    if "&" not in text:
        return text
    return unescape(_LONG_NUMBER.sub(lambda m: f"&#{min(0x110000, int(m[0][2:].rstrip(';').lstrip('0')[:8] or 0))};", text))


class _Tokens:
    """Markup of a page, found from left to right in time that grows with the page alone: what is known not to come any
    more isn't looked for again."""

    def __init__(self, html: str):
        self.html = html
        self.ahead: dict[str, int] = {}  # the next place of a mark, as of the last look
        self.dead: set[int] = set()  # opening quotes behind which no tag ends

    def _next(self, mark: str, at: int) -> int:
        found = self.ahead.get(mark, 0)
        if found < at:
            found = self.html.find(mark, at)
            self.ahead[mark] = found = len(self.html) if found < 0 else found
        return found

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: its ``>`` outside quotes; -1 if there is none."""
        html, size = self.html, len(self.html)
        openers = []
        while at <= size:
            end = _UNQUOTED.match(html, at).end()
            if end < size and html[end] == ">":
                return end
            openers.append(end)
            if end >= size or end in self.dead:
                break
            at = self._next(html[end], end + 1) + 1
        self.dead.update(openers)
        return -1

    def first(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The first piece of markup from ``at`` on: its start and end, the tag (empty for comments and the like), whether it
        is an end tag, and its attributes."""
        html, size = self.html, len(self.html)
        while (start := html.find("<", at)) >= 0 and (close := self._next(">", start + 1)) < size:
            at = start + 1
            if name := (_NAME if self.dead else _TAG).match(html, start):
                if self.dead:
                    end = self._tag_end(name.end())
                    attributes = html[name.end() : max(end, 0)]
                else:
                    end, attributes = name.end(), name[3]
                    if end >= size or html[end] != ">":
                        self.dead.update(m.start() for m in _QUOTED.finditer(html, name.end(2), end))
                        self.dead.add(end)
                        end = -1
                if end < 0:  # a quote is never closed: the tag ends at any ``>``
                    end, attributes = close, ""
                return start, end + 1, name[2].lower(), name[1] != "", attributes
            if html[at] in "!?":
                end = close + 1
                for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                    if html.startswith(opening, start) and (found := self._next(ending, start + len(opening))) < size:
                        end = found + len(ending)
                return start, end, "", False, ""
        return None


class _Open:
    """The open elements, with the places of each tag among them, so that none is looked for element by element."""

    def __init__(self) -> None:
        self.stack = [_Element("html", "", 0, 0, False)]
        self.places: dict[str, list[int]] = {"p": []}
        self.stops = [0]

    def push(self, e: _Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in _STOPS:
            self.stops.append(len(self.stack))
        self.stack.append(e)

    def pop(self) -> _Element:
        e = self.stack.pop()
        self.places[e.tag].pop()
        if e.tag in _STOPS:
            self.stops.pop()
        return e

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): _decode(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def _way_out(tag: str, words: set[str], role: str, in_article: bool) -> int:
    """0: the element may be main text; 1: it is not, unless it holds an article; 2: it is not."""
    if tag in ("html", "body", "main"):
        return 0
    if tag in _OUT or words & _COMMENTS:
        return 2
    if tag == "article":
        return 0
    if role in _OUT_ROLES or words & _OUT_WORDS or not in_article and (tag == "header" or role == "banner" or words & _OUT_HEADER):
        return 1
    return 0


def read_page(html: str, is_template: Callable[[int], bool] | None, seen: Callable[[int], None] | None = None) -> str:
    """The main text of a page, without the subtrees whose hash ``is_template`` tells (None: no subtree is hashed).
    ``seen`` gets the hashes of all subtrees that may be templates.

    The time grows with the page's length alone, whatever is left open, unclosed or nested."""
    out: list[str | None] = []  # text, and None between blocks
    opened = _Open()
    stack, places = opened.stack, opened.places
    mains: list[tuple[int, int]] = []  # where article and main elements that are in no other lie in ``out``
    inside = 0  # of how many article and main elements
    recurring: list[tuple[int, int]] = []  # where templates inside them lie in ``out``, inner ones first

    def without_templates(start: int) -> None:
        """Delete what recurs from an article's text: the smallest first, while more stays than goes."""
        before = [0]  # characters before each place
        for x in out[start:]:
            before.append(before[-1] + len(x or ""))
        ranked, nested = [], []  # nested: (start, size) of those that may lie in the next one
        for s, e in recurring:
            size, own = before[e - start] - before[s - start], 0
            while nested and nested[-1][0] >= s:
                own += nested.pop()[1]
            nested.append((s, size))
            ranked.append((size, bisect_left(before, before[s - start] + 1), e - s, size - own, s, e))
        left, spans = before[-1], []
        gone = 0
        for _, _, _, own, s, e in sorted(ranked):  # inner ones, which are no larger, are gone before the outer one comes
            if gone + own >= left - own:
                break
            left, gone = left - own, gone + own
            spans.append((s, e))
        done = start
        for s, e in sorted(spans):
            s = max(s, done)
            if s < e:
                out[s:e] = [None] * (e - s)
                done = e
        recurring.clear()

    def close() -> None:
        nonlocal inside
        e = opened.pop()
        parent = stack[-1]
        if e.tag in ("article", "main"):
            inside -= 1
            e.holds = True
            if e.at == 2:
                del out[e.out :]
            elif not inside:
                without_templates(e.out)
                while mains and mains[-1][0] >= e.out:
                    mains.pop()
                mains.append((e.out, len(out)))
        else:
            value = None
            if e.parts and is_template:  # an element's hash is made of its own text and the hashes of those inside
                digest = xxhash.xxh64_intdigest("\x00".join([e.tag, e.name, *e.parts]).encode("utf-8", "surrogatepass"))
                parent.parts.append(f"\x01{digest:x}")
            elif e.parts:
                parent.parts = e.parts  # only whether there is text
            if inside and not e.at and e.parts and e.tag in _PLAIN:
                e.text = True
            if e.tag in _BLOCK and not e.plain and not e.holds and not e.text and e.parts and is_template:
                value = digest - (1 << 63)
                if seen:
                    seen(value)
            gone = e.at == 2 or not e.holds and e.at == 1
            if not gone and value is not None and is_template(value):
                if inside:
                    recurring.append((e.out, len(out)))
                else:
                    gone = True
            if gone:
                del out[e.out :]
                while mains and mains[-1][0] >= e.out:
                    mains.pop()
                while recurring and recurring[-1][0] >= e.out:
                    recurring.pop()
            else:
                parent.text |= e.text
        parent.holds |= e.holds
        if e.tag in _BLOCK:
            out.append(None)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            close()

    at, size, low = 0, len(html), html.lower() if "<" in html else html
    if len(low) != size:  # lower-casing changed a length: only ASCII matters for the search of end tags
        low = html
    tokens = _Tokens(html)
    while at < size:
        token = tokens.first(at)
        text = html[at : token[0] if token else size]
        if text and (clean := _SPACE.sub(" ", _decode(text))):
            out.append(clean)
            if clean != " ":
                stack[-1].parts.append(clean.strip())
        if not token:
            break
        _, at, tag, ends, source = token
        if not tag:
            continue
        if ends:
            depth = places[tag][-1] if places.get(tag) else 0
            if tag == "p" and not depth:
                out.append(None)
            if depth and (tag in ("body", "html", "article", "main") or depth > opened.last(("article", "main"))):
                close_to(depth)
            continue
        if tag in _ENDS_P and places["p"] and places["p"][-1] > opened.stops[-1]:
            close_to(places["p"][-1])
        if tag in _CLOSES and (depth := opened.last(_CLOSES[tag])) > opened.stops[-1]:
            close_to(depth)
        if tag in _BLOCK:
            out.append(None)
        elif tag in _INLINE_SPACE:
            out.append(" ")
        if tag in _VOID:
            continue
        attributes = _attributes(source)
        name = attributes.get("class", "") + " " + attributes.get("id", "")
        words = {w for w in _SPLIT.split(name.lower()) if w}
        way = _way_out(tag, words, attributes.get("role", "").lower(), inside > 0)
        if tag in _RAW:
            end = low.find(f"</{tag}", at)
            at = size if end < 0 else end
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if source.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        plain = inside > 0 and tag in _PLAIN and not words and "role" not in attributes
        opened.push(_Element(tag, " ".join(sorted(words)), way, len(out), plain))
        inside += tag in ("article", "main")
    while len(stack) > 1:
        close()

    pieces = [x for s, e in mains for x in [None, *out[s:e]]] if mains else out
    blocks, block = [], []
    for x in [*pieces, None]:
        if x is None:
            if block and (line := _SPACE.sub(" ", "".join(block)).strip()):
                blocks.append(line)
            block = []
        else:
            block.append(x)
    return "\n".join(blocks)


def _subtrees(keyed: DataFrame) -> DataFrame:
    """``host, th, own, h``: the hashes of the subtrees in each different page of a host; ``own`` is that of its main text."""
    schema = pa.schema([("host", pa.string()), ("th", pa.int64()), ("own", pa.int64()), ("h", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, ths, owns, hashes = [], [], [], []
            for host, th, html in zip(*(batch.column(c).to_pylist() for c in ("host", "th", "html"))):
                found: set[int] = set()
                text = read_page(html, lambda h: False, found.add)
                owns += [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)] * len(found)
                hosts += [host] * len(found)
                ths += [th] * len(found)
                hashes += found
            yield emit({"host": hosts, "th": ths, "own": owns, "h": hashes}, schema)

    rows = keyed.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "th", "html")
    return rows.mapInArrow(of, "host string, th long, own long, h long").distinct()


def templates(subtrees: DataFrame, many: int = MANY_PAGES, percent: int = MANY_PERCENT) -> DataFrame:
    """``host, h``: subtrees that recur across many pages of their host with different main texts."""
    pages = subtrees.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(many), F.ceil(F.col("pages") * percent / 100))
    return subtrees.select("host", "own", "h").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= many).join(pages, "host").filter(F.col("n") >= least).select("host", "h")


def main_text(pages: DataFrame, many: int = MANY_PAGES, percent: int = MANY_PERCENT) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``: its main text, blocks joined by line ends.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are not looked at. A null or empty html gives an empty
    text. A page whose url is null or names no host is read, but no templates are known for it. Pages of a host with
    the same main text count as one; every row comes back, as often as it comes. An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.when(host != "", host).alias("host"), F.xxhash64(F.col("html").cast("string")).alias("th"))
    subtrees = stash(_subtrees(keyed))
    known = stash(templates(subtrees, many, percent))
    found = subtrees.join(broadcast_if_below(known, known.count(), 64), ["host", "h"])
    found = stash(found.groupBy("host", "th").agg(F.collect_set("h").alias("drop")))
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("drop")).alias("m")).first()
    joined = keyed.join(broadcast_if_below(found, 64 * size["n"] + 8 * (size["m"] or 0), 1), ["host", "th"], "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist()):
                texts.append(read_page(html, set(drop).__contains__ if drop else None) if html else "")
            yield emit({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    return joined.select("page_id", "url", "html", "drop").mapInArrow(of, "page_id long, url string, text string, n_chars long")
