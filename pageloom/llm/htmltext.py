"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored: text in blocks, less what is inside links. A page votes with its score for
the generalised path (tags, and classes without digits) of its best container; Spark sums the votes by host,
and the path with the most wins. Pages are then read again: the text is that of the containers on their
host's winning path, or of the page's own best container where that path does not occur.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# HTML's elements by how they are treated.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "label", "head", "object", "canvas", "audio", "video"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
# An open p ends where one of these begins.
ENDS_P = BLOCKS - {"caption", "dd", "dt", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"} | SKIP
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|notice|cookie|cookies|"
    r"consent|banner|ad|ads|advert|adverts|advertisement|advertising|promo|sponsor|sponsored|comment|comments|"
    r"disqus|reply|replies|respond|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|newsletter|"
    r"subscribe|popup|modal|widget|login|signup|search|pagination|pager|toolbar|skip|copyright|legal|alert)"
    r"(?=$|[\s_-])",
    re.I,
)
# Inside an article only these whole classes or ids mean that a part is not of it.
NOISE_WITHIN = {
    "ad", "ads", "advert", "advertisement", "comment-list", "comments", "cookie-banner", "disqus_thread", "newsletter",
    "popup", "respond", "share", "share-buttons", "sharing", "sponsored", "subscribe",
}
# A class on an element of text says what the text is about as often as what it is, so it counts for the others only.
OF_TEXT = {"a", "b", "blockquote", "code", "dd", "dt", "em", "h1", "h2", "h3", "h4", "h5", "h6", "i", "li", "p", "pre", "span", "strong", "td", "th", "u"}
# A longer path goes on from its own hash.
PATH_CHARS = 400
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}


class Page:
    """One pass over a page's tags: blocks with the containers they are in."""

    def __init__(self, source: str) -> None:
        # Of each container: path, the one around it, characters outside and inside links. The first is the page.
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.plain: list[int] = [0]
        self.linked: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, str]] = []  # tag, container, skipped, path
        open_tags: Counter = Counter()
        container, skipped, path, links = 0, False, "", 0
        pieces: list[str] = []
        linked, at, raw_end = 0, 0, ""
        low = ""

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text and not skipped:
                    self.blocks.append((container, text))
                    self.plain[container] += max(0, len(text) - linked)
                    self.linked[container] += min(linked, len(text))
                pieces, linked = [], 0

        def leave(depth: int) -> None:
            nonlocal container, skipped, path, links
            while len(stack) > depth:
                tag, container, skipped, path = stack.pop()
                open_tags[tag] -= 1
                if tag == "a":
                    links = max(0, links - 1)

        while True:
            match = _TAG.search(source, at)
            begin = match.start() if match else len(source)
            if begin > at and not skipped:
                piece = source[at:begin]
                pieces.append(piece)
                if links:
                    linked += len(piece)
            if not match:
                break
            at = match.end()
            tag = (match.group(2) or "").lower()
            if not tag:
                continue
            if match.group(1):
                if not open_tags[tag]:
                    if tag == "p":
                        flush()
                    continue
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        if tag in BLOCKS or tag in SKIP or any(x[0] in BLOCKS for x in stack[depth:]):
                            flush()
                        leave(depth)
                        break
                    if stack[depth][0] in CONTAINERS and tag not in BLOCKS and tag not in SKIP:
                        break  # an inline end does not close a container
                continue
            if tag in RAW:
                if not match.group(3).endswith("/"):
                    low = low or source.lower()
                    end = low.find(f"</{tag}", at)
                    at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
                continue
            if tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in BLOCKS or tag in SKIP:
                flush()
                if tag in ENDS_P:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == "p":
                            leave(depth)
                            break
                        if stack[depth][0] in CONTAINERS:
                            break
                if tag in CLOSES:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in CLOSES[tag]:
                            leave(depth)
                            break
                        if stack[depth][0] in ("ul", "ol", "dl", "table"):
                            break
            within = open_tags["article"] + open_tags["main"] > 0
            stack.append((tag, container, skipped, path))
            open_tags[tag] += 1
            if skipped:
                continue
            names = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(match.group(3))} if match.group(3) else {}
            noise = f"{names.get('class', '')} {names.get('id', '')}"
            marked = tag not in OF_TEXT and tag not in ("html", "body", "article", "main")
            if marked:
                marked = not NOISE_WITHIN.isdisjoint(noise.lower().split()) if within else NOISE.search(noise)
            if (
                tag in SKIP
                or (tag == "header" and not within)
                or names.get("role", "").lower() in NOISE_ROLES
                or marked
                or "hidden" in match.group(3).lower().split()
            ):
                skipped = True
                continue
            if tag == "a":
                links += 1
            if tag in CONTAINERS:
                kind = ".".join([tag, *sorted(re.sub(r"\d+", "", c) for c in names.get("class", "").split())])
                if len(path) > PATH_CHARS:
                    path = f"#{xxhash.xxh3_64_hexdigest(path)}"
                path = f"{path}/{kind}"
                self.paths.append(path)
                self.parents.append(container)
                self.plain.append(0)
                self.linked.append(0)
                container = len(self.paths) - 1
        flush()

    def best(self) -> tuple[str | None, float]:
        """Path and score of the best container: most plain text with little besides.

        A container is worth its own blocks and four fifths of what its children are worth, so the smallest
        one that holds the article beats those around it.
        """
        worth = [p - 0.5 * q for p, q in zip(self.plain, self.linked, strict=True)]
        bonus = {"article": 1.5, "main": 1.3}
        for k in range(len(worth) - 1, -1, -1):
            if self.parents[k] >= 0:
                worth[self.parents[k]] += 0.8 * worth[k]
        if not self.blocks:
            return None, 0.0
        scored = [w * bonus.get(p.rsplit("/", 1)[-1].split(".")[0], 1.0) for w, p in zip(worth, self.paths, strict=True)]
        top = max(range(len(scored)), key=lambda k: (scored[k], -k))
        return self.paths[top], max(0.0, scored[top])

    def text(self, path: str | None) -> str:
        """Blocks below the containers on ``path``, in page order; the empty path is the whole page."""
        if path is None:
            return ""
        inside: list[bool] = []
        for k, own in enumerate(self.paths):
            inside.append(own == path or (self.parents[k] >= 0 and inside[self.parents[k]]))
        return "\n".join(text for container, text in self.blocks if inside[container])


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """The vote of each page: host, path and score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for name, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                path, score = Page(source.as_py() or "").best()
                if path is not None and score > 0:
                    sums[name, path] = sums.get((name, path), 0.0) + score
            yield pa.record_batch(
                {
                    "host": pa.array([k[0] for k in sums], pa.string()),
                    "path": pa.array([k[1] for k in sums], pa.string()),
                    "score": pa.array(list(sums.values()), pa.float64()),
                }
            )

    found = pages.select(host("url").alias("host"), "html").mapInArrow(work, "host string, path string, score double")
    return found.groupBy("host", "path").agg(F.sum("score").alias("score"))


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without a text block, have an empty text. A null url, or one without host,
    belongs to the host ''. Equal votes go to the path that sorts first. Repeated rows are repeated; other
    columns are not looked at; an empty table gives an empty one.
    """
    best = Window.partitionBy("host").orderBy(F.desc("score"), "path")
    won = votes(pages).withColumn("place", F.row_number().over(best)).where("place = 1").select("host", "path")
    # One row per host. Its file size decides whether Spark sends it to every task or shuffles.
    won = scratch.save(won.coalesce(8), "paths")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True):
                page = Page(source.as_py() or "")
                if path not in page.paths:
                    path = page.best()[0]
                texts.append(page.text(path))
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(list(map(len, texts)), pa.int64()),
                }
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host("url").alias("host"))
    rows = rows.join(won, "host", "left").select("page_id", "url", "html", "path")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
