"""HTML to node arrays: the one step that needs Python.

Each page becomes an array of nodes in document order. ``last`` is the position
of a node's last descendant, so "inside this element" is a slice of the array
and everything else about a page is a native expression over it. Arrow batches
go in and out; no rows are shuffled and pages do not depend on each other.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
from collections import defaultdict
from collections.abc import Collection, Iterator
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate, chain
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Ship this module with the tasks, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements dropped with all they hold.
BOILERPLATE = frozenset(("script", "style", "nav", "footer", "aside", "advertisement"))
# Elements that take no children.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Elements whose text is not page text.
HIDDEN_TEXT = frozenset(("script", "style", "template", "rt", "rp"))
# Elements that keep runs of white space.
PREFORMATTED = frozenset(("pre", "textarea"))
# Elements that may hold the caption of an image before them.
CAPTION_TAGS = frozenset(("p", "div", "span"))
# The code points that count as white space.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
# Attributes read by the extraction expressions; others are left behind.
KEPT_ATTRIBUTES = frozenset(
    "id class href src alt title name property content rel data-filename aria-label lang".split()
)

# A page whose element texts add up to more characters is not put together as one document: its elements hold
# one another, as unclosed paragraphs do, and each would repeat all that follows it.
MAX_ELEMENT_CHARS = 64_000_000
# Elements whose text a page document keeps.
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p code pre a th td li span caption figcaption".split())

# Tags of these are counted while they are open, and captions only looked for at these.
COUNTED = BOILERPLATE | HIDDEN_TEXT | PREFORMATTED
CAPTIONED = CAPTION_TAGS | {"img", "figure", "figcaption"}
# Tags with more to note than where they begin and end.
NOTED_START = COUNTED | VOID | {"a", "figure", "figcaption", "html", *HTMLParser.CDATA_CONTENT_ELEMENTS}
NOTED_END = COUNTED | VOID | {"figure"}
# What most of a page is made of: end tags, start tags whose attributes hold no references, elements of nothing but
# text, each with the text after it; and text alone.
PLAIN = re.compile(
    r'<(?:/([a-zA-Z][a-zA-Z0-9]*)>|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9:-]*="[^"&]*")*)>(?:([^<&]*+)</\2>)?)'
    r'([^<&]*)|[^<&]+'
)
PLAIN_ATTRIBUTE = re.compile(r' ([^=]+)="([^"]*)"')
# A path from the root without dot segments, parameters or query, on a page whose address begins plainly.
PLAIN_PATH = re.compile(r"/(?:[A-Za-z0-9_-][A-Za-z0-9_.-]*/)*(?:[A-Za-z0-9_-][A-Za-z0-9_.-]*)?")
PLAIN_HOST = re.compile(r"https?://[A-Za-z0-9.-]+(?=[/?#]|$)")
PLAIN_REFERENCE = re.compile(r"&(?:#([0-9]+|[xX][0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")

TEXT, HIDDEN, OTHER = "#text", "#hidden", "#other"

NODE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("figcaption", T.IntegerType()),
        T.StructField("beside", T.IntegerType()),
        T.StructField("chars", T.IntegerType()),
    ]
)
HREF = T.StructType([T.StructField("raw", T.StringType()), T.StructField("url", T.StringType())])
PARSED = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("hrefs", T.ArrayType(HREF)),
        T.StructField("html_lang", T.StringType()),
        T.StructField("parse_error", T.StringType()),
        T.StructField("element_chars", T.LongType()),
    ]
)

_ATTRS = pa.map_(pa.string(), pa.string())
_HREF = pa.list_(pa.struct([("raw", pa.string()), ("url", pa.string())]))
_OUTPUT_ROWS = 200


def resolve(base: str, href: str) -> str | None:
    if PLAIN_PATH.fullmatch(href) and (host := PLAIN_HOST.match(base)):
        return host[0] + href
    try:
        return urljoin(base, href)
    except ValueError:
        return None


class NodeCollector(HTMLParser):
    """Appends nodes while the tokenizer runs: ``nodes`` holds the fields known at the
    start of a node, ``last`` the position of its last descendant.

    There are no implied end tags: an end tag closes everything up to the nearest
    open element of its name, and is ignored when none is open.
    """

    def __init__(self, page_url: str):
        super().__init__(convert_charrefs=False)
        self.page_url = page_url
        self.last: list[int] = []
        self.nodes: list[tuple] = []  # (parent, depth, tag, attrs, url, text)
        self.hrefs: list[dict] = []
        self.html_lang: str | None = None
        self.open: list[tuple[str, int]] = []  # (name, position or -1 when dropped)
        self.open_names: defaultdict = defaultdict(int)
        self.dropping = self.hiding = self.preformatted = 0
        self.ended_void: defaultdict = defaultdict(int)
        self.pending: list[str] = []
        self.figures: list[int] = []  # open figures, outermost first
        self.figure_caption: dict[int, int] = {}
        self.figure_of: dict[int, int] = {}  # images inside a figure
        self.beside: dict[int, int] = {}
        self.waiting: dict[int, list[int]] = {}  # images by parent, until a caption tag follows
        self.chars: list[int] = []  # length of the stripped text inside each node
        self.read = 0  # length of the stripped text so far

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def goahead(self, end):
        """Plain tokens are taken by one expression; the tokenizer does all others, and what is left at the end."""
        rawdata, i = self.rawdata, 0
        while i < len(rawdata):
            if self.cdata_elem is not None:
                match = self.interesting.search(rawdata, i)
                if match is None:
                    break
                if i < match.start():
                    self.handle_data(rawdata[i : match.start()])
                i = match.start()
                k = self.parse_endtag(i)
            elif (k := self._plain(rawdata, i)) > i:
                pass
            elif match := PLAIN_REFERENCE.match(rawdata, i):
                number, name = match.groups()
                k = match.end()
                if number is not None:
                    self.handle_charref(number)
                else:
                    self.handle_entityref(name)
            else:
                k = self._other(rawdata, i)
            if k < 0:
                break
            i = k
        self.rawdata = rawdata[i:]
        super().goahead(end)

    def _plain(self, rawdata: str, i: int) -> int:
        """Read plain tokens from ``i`` on, to the first that is not, and return its place.

        Tags that need no notes are taken here, as most are; a call for each would cost more than the work.
        """
        pending, nodes, last, chars = self.pending, self.nodes, self.last, self.chars
        opened, names = self.open, self.open_names
        for match in PLAIN.finditer(rawdata, i):
            if match.start() != i:
                break
            i = match.end()
            ended, started, attrs, inner, text = match.groups()
            if ended is not None:
                tag = ended.lower()
                if tag in NOTED_END:
                    self.handle_endtag(tag)
                else:
                    if pending:
                        self._end_text()
                    if opened and opened[-1][0] == tag:
                        pos = opened.pop()[1]
                        names[tag] -= 1
                        if pos >= 0:
                            last[pos] = len(last) - 1
                            chars[pos] = self.read - chars[pos]
                    else:
                        self._end(tag)
            elif started is not None:
                tag = started.lower()
                values = {n.lower(): v for n, v in PLAIN_ATTRIBUTE.findall(attrs)} if attrs else {}
                if tag in NOTED_START:
                    self.handle_starttag(tag, values.items())
                    if tag in self.CDATA_CONTENT_ELEMENTS:
                        self.set_cdata_mode(tag)
                        return match.end(3) + 1
                    if inner is not None:
                        if inner:
                            pending.append(inner)
                        self.handle_endtag(tag)
                else:
                    if pending:
                        self._end_text()
                    pos = -1
                    if not self.dropping:
                        pos = len(last)
                        kept = [pair for pair in values.items() if pair[0] in KEPT_ATTRIBUTES] if values else ()
                        nodes.append((opened[-1][1] if opened else -1, len(opened), tag, kept, None, None))
                        last.append(pos)
                        chars.append(self.read)
                        if self.waiting and tag in CAPTION_TAGS:
                            self._note_captions(tag, pos)
                    if inner is None:
                        opened.append((tag, pos))
                        names[tag] += 1
                    elif pos >= 0:
                        shown = len(inner.strip())
                        if shown and not self.hiding:
                            nodes.append((pos, len(opened) + 1, TEXT, (), None, inner))
                            last[pos] = pos + 1
                            last.append(pos + 1)
                            chars[pos] = shown
                            chars.append(shown)
                            self.read += shown
                        else:
                            opened.append((tag, pos))
                            names[tag] += 1
                            if inner:
                                pending.append(inner)
                            self._end(tag)
            else:
                text = match[0]
            if text:
                pending.append(text)
        return i

    def _other(self, rawdata: str, i: int) -> int:
        """End of the markup that begins at ``i``, or -1 where the tokenizer must see what comes after."""
        second = rawdata[i + 1 : i + 2] if rawdata[i] == "<" else ""
        if second.isascii() and second.isalpha():
            return self.parse_starttag(i)
        if second == "/":
            return self.parse_endtag(i)
        if rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if second == "?":
            return self.parse_pi(i)
        return self.parse_html_declaration(i) if second == "!" else -1

    def _add(self, tag: str, attrs=(), url=None, text=None, shown: int = 0) -> int:
        pos = len(self.last)
        parent = self.open[-1][1] if self.open else -1
        self.last.append(pos)
        # Until an element ends this is where its text begins.
        if tag == TEXT:
            self.chars.append(shown)
            self.read += shown
        else:
            self.chars.append(self.read)
        self.nodes.append((parent, len(self.open), tag, attrs, url, text))
        return pos

    def _end_text(self, tag: str = TEXT) -> None:
        pending = self.pending
        if not pending:
            return
        text = pending[0] if len(pending) == 1 else "".join(pending)
        pending.clear()
        if self.dropping:
            return
        shown = len(text.strip())  # what Python strips is ``WHITESPACE``
        if not shown and not self.preformatted and not text.strip(" \t\n\r\x0b\x0c"):
            text = "\n" if "\n" in text else " "
        self._add(HIDDEN if tag == TEXT and self.hiding else tag, text=text, shown=shown)

    def _count_open(self, tag: str, by: int) -> None:
        self.open_names[tag] += by
        if tag not in COUNTED:
            return
        if tag in BOILERPLATE:
            self.dropping += by
        if tag in HIDDEN_TEXT:
            self.hiding += by
        if tag in PREFORMATTED:
            self.preformatted += by

    def _pop(self) -> str:
        name, pos = self.open.pop()
        self._count_open(name, -1)
        if pos >= 0:
            self.last[pos] = len(self.last) - 1
            self.chars[pos] = self.read - self.chars[pos]
            if name == "figure":
                self.figures.pop()
        return name

    def _note_captions(self, tag: str, pos: int) -> None:
        """What an image needs to find its caption, noted while the page is read once."""
        parent = self.nodes[pos][0]
        if tag == "img":
            if self.figures:
                self.figure_of[pos] = self.figures[-1]
            self.waiting.setdefault(parent, []).append(pos)
        elif tag == "figure":
            self.figures.append(pos)
        elif tag == "figcaption":
            # A caption counts for every figure around it, so those outside of one that has one have one too.
            for figure in reversed(self.figures):
                if figure in self.figure_caption:
                    break
                self.figure_caption[figure] = pos
        elif tag in CAPTION_TAGS:
            for image in self.waiting.pop(parent, ()):
                self.beside[image] = pos

    def caption_positions(self) -> tuple[list[int | None], list[int | None]]:
        """Per node, for images only: the caption of its figure, and the caption tag that follows it."""
        figcaption: list[int | None] = [None] * len(self.last)
        beside: list[int | None] = [None] * len(self.last)
        for image, figure in self.figure_of.items():
            figcaption[image] = self.figure_caption.get(figure)
        for image, pos in self.beside.items():
            beside[image] = pos
        return figcaption, beside

    def _start(self, tag: str, attrs: list) -> None:
        self._end_text()
        values = {k: v or "" for k, v in attrs} if attrs else {}
        url = None
        if tag == "a" and "href" in values:
            url = resolve(self.page_url, values["href"])
            self.hrefs.append({"raw": values["href"], "url": url})
        elif tag == "img" and values.get("src", "").startswith("/"):
            url = resolve(self.page_url, values["src"])
        elif tag == "html" and self.html_lang is None:
            self.html_lang = values.get("lang")
        pos = -1
        if not self.dropping and tag not in BOILERPLATE:
            kept = [(k, v) for k, v in values.items() if k in KEPT_ATTRIBUTES]
            pos = self._add(tag, kept, url)
            if tag in CAPTIONED:
                self._note_captions(tag, pos)
        self.open.append((tag, pos))
        self._count_open(tag, 1)

    def _end(self, tag: str) -> None:
        self._end_text()
        while self.open_names[tag]:
            if self._pop() == tag:
                break

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID:
            self._end(tag)
            self.ended_void[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # The end tag of a void element was given with its start tag.
        if self.ended_void[tag]:
            self.ended_void[tag] -= 1
        else:
            self._end(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(html_lib.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        known = html5.get(name + ";") or html5.get(name)
        self.pending.append(known or "&" + name)

    def _markup(self, data: str) -> None:
        self._end_text()
        self.pending.append(data)
        self._end_text(OTHER)

    def handle_comment(self, data):
        self._markup(data)

    def handle_decl(self, decl):
        self._markup(decl)

    def handle_pi(self, data):
        self._markup(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._end_text()
            self.pending.append(data[len("CDATA[") :])
            self._end_text()
        else:
            self._markup(data)

    def element_chars(self) -> int:
        """Characters of all element texts that a page document keeps."""
        return sum(n for n, node in zip(self.chars, self.nodes, strict=True) if node[2] in TEXT_ELEMENTS)

    def finish(self) -> None:
        self.close()
        self._end_text()
        while self.open:
            self._pop()


def collect_nodes(url: str | None, html: str | None) -> tuple[NodeCollector, str | None]:
    """Nodes of one page, or an empty collector and why the page was rejected."""
    collector = NodeCollector(url or "")
    try:
        collector.feed(html or "")
        collector.finish()
    except (AssertionError, ValueError) as error:  # one bad page must not end the job
        return NodeCollector(""), f"{type(error).__name__}: {error}"
    return collector, None


def _node_array(pages: list[NodeCollector]) -> pa.Array:
    """The nodes of several pages as one Arrow list column, built field by field."""
    sizes = [len(page.last) for page in pages]
    nodes = list(chain.from_iterable(page.nodes for page in pages))
    parent, depth, tag, attrs, url, text = zip(*nodes, strict=True) if nodes else [()] * 6
    captions = [page.caption_positions() for page in pages]
    fields = [
        pa.array(chain.from_iterable(range(n) for n in sizes), pa.int32()),
        pa.array(chain.from_iterable(page.last for page in pages), pa.int32()),
        pa.array(parent, pa.int32()),
        pa.array(depth, pa.int32()),
        pa.array(tag, pa.string()),
        pa.array(attrs, _ATTRS),
        pa.array(url, pa.string()),
        pa.array(text, pa.string()),
        pa.array(chain.from_iterable(figcaption for figcaption, _ in captions), pa.int32()),
        pa.array(chain.from_iterable(beside for _, beside in captions), pa.int32()),
        pa.array(chain.from_iterable(page.chars for page in pages), pa.int32()),
    ]
    offsets = pa.array(accumulate(sizes, initial=0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=NODE.names))


def _parsed_column(name: str, pages: list[NodeCollector], errors: list[str | None]) -> pa.Array:
    if name == "nodes":
        return _node_array(pages)
    if name == "hrefs":
        return pa.array([page.hrefs for page in pages], _HREF)
    if name == "html_lang":
        return pa.array([page.html_lang for page in pages], pa.string())
    if name == "element_chars":
        return pa.array([page.element_chars() for page in pages], pa.int64())
    return pa.array(errors, pa.string())


def _parse_batches(
    batches: Iterator[pa.RecordBatch], keep: list[str], found: list[str]
) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, _OUTPUT_ROWS):
            batch = whole.slice(start, _OUTPUT_ROWS)
            inputs = zip(
                batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True
            )
            pages, errors = zip(*[collect_nodes(url, html) for url, html in inputs], strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in keep],
                    *[_parsed_column(name, pages, errors) for name in found],
                ],
                names=[*keep, *found],
            )


def parse_pages(raw: DataFrame, keep_html: bool = True, found: Collection[str] = PARSED.names) -> DataFrame:
    """Add ``nodes``, ``hrefs``, ``html_lang``, ``parse_error`` and ``element_chars`` to fetched pages.

    Filters and column pruning do not pass through a Python step, so callers filter
    rows and pick columns before this call, and say when the html is not needed back
    or which of the added columns they read.
    """
    fields = [f for f in raw.schema.fields if keep_html or f.name != "html"]
    keep = [f.name for f in fields]
    added = [f for f in PARSED.fields if f.name in found]
    names = [f.name for f in added]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parse_batches(batches, keep, names)

    return raw.mapInArrow(parse, T.StructType(fields + added))
