"""Main text of web pages by removal of a site's templates.

Every element's subtree is hashed (tag, class, text, children); Spark counts on how many pages of a
host each hash stands, and containers that recur on RECUR of the host's pages (LEAST pages at least)
are the host's template and go. What a page marks by tag, role, class or id as menu, header,
footer, sidebar, notice, advert, form or reader comments goes as well. If the page marks its
article, only that is read, and paragraphs within it stay even where they recur. The text of each
block is decoded, its white space becomes one space, and blocks are joined by a newline.

A null or empty page, and one without text, give an empty text. A null url is a host of its own.
Repeated rows give repeated rows and count as pages of their own; extra columns are ignored; an
empty table gives an empty result. Broken markup (unclosed elements, stray end tags, a bare <) is
read as a browser would, near enough.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import stage

RECUR = 0.3
LEAST = 5
#: Template hashes that are sent to all tasks at the most (8 bytes each); beyond, they are joined by host.
BROADCAST_HASHES = 500_000
_SALTS = 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|noembed|xmp)\b(?P<rattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<body>.*?)(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_WALL = frozenset("article section div main td th table body html aside nav footer header form ul ol li blockquote figure".split())
_DROP = frozenset("head nav aside footer form button select dialog menu svg object audio video canvas map script style noscript template iframe textarea title".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
_MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense banner promo promotion "
    "sponsor sponsored cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus discussion replies respond popup modal overlay toolbar pagination pager masthead copyright skip".split()
)
_OUTSIDE = frozenset("header topbar".split())
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dd dt figcaption b i em strong span a br article main body html".split())


class Page:
    """The elements of a page, in the order of their tags, and its texts between them."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.marks: list[frozenset[str]] = []
        self.roles: list[str] = []
        self.hidden: list[bool] = []
        self.parents: list[int] = []
        self.hashes: list[int] = []
        #: texts, or element + 1 for a start and its negative for an end
        self.events: list[str | int] = []
        stack: list[int] = []
        parts: list[list[str]] = []

        def text(value: str) -> None:
            self.events.append(value)
            if parts:
                parts[-1].append(" ".join(value.split()))

        def open_(tag: str, attrs: str) -> int:
            found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            self.tags.append(tag)
            self.marks.append(frozenset(x.lower() for x in _PIECES.findall(names)) if names != " " else frozenset())
            self.roles.append(found.get("role", "").lower())
            self.hidden.append("hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower())
            self.parents.append(stack[-1] if stack else -1)
            self.hashes.append(0)
            self.events.append(len(self.tags))
            parts.append([tag, names.strip()])
            stack.append(len(self.tags) - 1)
            return stack[-1]

        def close() -> None:
            node = stack.pop()
            own = parts.pop()
            self.hashes[node] = xxhash.xxh64_intdigest("\0".join(own)) - (1 << 63)
            if parts:
                parts[-1].append(str(self.hashes[node]))
            self.events.append(-1 - node)

        def close_to(names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
            for k in range(len(stack) - 1, -1, -1):
                tag = self.tags[stack[k]]
                if tag in names:
                    while len(stack) > k:
                        close()
                    return
                if tag in walls:
                    return

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            raw = m["raw"]
            if raw:
                open_(raw.lower(), m["rattrs"])
                if raw.lower() not in ("script", "style"):
                    text(m["body"])
                close()
                continue
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "br":
                    text(" ")
                elif tag not in _VOID:
                    close_to({tag}, _WALL - {tag} if tag == "p" or tag not in _BLOCK else frozenset())
                continue
            if tag in _CLOSES_P:
                close_to({"p"}, _WALL)
            if tag in _SIBLINGS:
                walls = _LISTS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if self.tags[stack[k]] in walls:
                        break
                    if self.tags[stack[k]] in _SIBLINGS[tag]:
                        while len(stack) > k:
                            close()
            if tag in _VOID:
                if tag == "br":
                    text(" ")
                elif tag == "hr":
                    open_(tag, "")
                    close()
                continue
            open_(tag, m["attrs"])
            if m["attrs"].endswith("/") and tag not in _BLOCK and tag not in ("a", "b", "i", "span", "em", "strong"):
                close()
        if at < len(source):
            text(source[at:])
        while stack:
            close()

    def boilerplate(self, node: int, inside: bool) -> bool:
        """Whether the element is marked as no part of an article."""
        tag = self.tags[node]
        if tag in _DROP or self.hidden[node] or self.roles[node] in _ROLES:
            return True
        if tag in ("html", "body", "main", "article"):
            return tag == "article" and bool(self.marks[node] & {"comment", "comments", "reply"})
        if tag == "header" and not inside:
            return True
        marks = self.marks[node]
        return bool(marks) and bool(marks & _MARKS or (not inside and marks & _OUTSIDE))

    def dropped(self, inside: bool, template: frozenset[int] | set[int], within: int = -1) -> list[bool]:
        """For each element whether it or one around it goes."""
        out: list[bool] = []
        for node, parent in enumerate(self.parents):
            gone = parent >= 0 and out[parent]
            if not gone and node != within:
                gone = self.boilerplate(node, inside)
                if not gone and template and self.hashes[node] in template:
                    gone = self.tags[node] not in _TEXT_ELEMENTS if inside else self.tags[node] not in ("html", "body", "main", "article")
            out.append(gone)
        return out

    def article(self, gone: list[bool]) -> int:
        """The element that the page marks as its article, or -1."""
        sizes = [0] * len(self.tags)
        node = -1
        for e in self.events:
            if isinstance(e, str):
                if node >= 0:
                    sizes[node] += len(e)
            elif e > 0:
                node = e - 1
            else:
                node = self.parents[-1 - e]
                if node >= 0:
                    sizes[node] += sizes[-1 - e]
        free = [k for k in range(len(self.tags)) if not gone[k]]
        articles = [k for k in free if self.tags[k] == "article" and not self._under(k, "article")]
        mains = [k for k in free if self.tags[k] == "main" or self.roles[k] == "main"]
        if articles:
            best = max(articles, key=lambda k: (sizes[k], -k))
            if len(articles) == 1 or not mains or sizes[best] >= 0.6 * sum(sizes[k] for k in articles):
                return best
        return mains[0] if mains else -1

    def _under(self, node: int, tag: str) -> bool:
        node = self.parents[node]
        while node >= 0:
            if self.tags[node] == tag:
                return True
            node = self.parents[node]
        return False

    def text(self, template: frozenset[int] | set[int]) -> str:
        marked = self.article(self.dropped(False, frozenset()))
        gone = self.dropped(marked >= 0, template, marked)
        if marked >= 0:
            # around the article nothing counts; the elements around it may be dropped ones no more
            keep = [False] * len(self.tags)
            for node, parent in enumerate(self.parents):
                keep[node] = node == marked or (parent >= 0 and keep[parent] and not gone[node])
            # an element dropped only for one around the article is judged again
            for node, parent in enumerate(self.parents):
                if parent >= 0 and keep[parent] and not keep[node]:
                    own = self.boilerplate(node, True) or (self.hashes[node] in template and self.tags[node] not in _TEXT_ELEMENTS)
                    keep[node] = not own
        else:
            keep = [not g for g in gone]
        blocks: list[str] = []
        line: list[str] = []
        node = -1

        def flush() -> None:
            if line:
                done = " ".join(entities.unescape("".join(line)).split())
                if done:
                    blocks.append(done)
                line.clear()

        for e in self.events:
            if isinstance(e, str):
                if (keep[node] if node >= 0 else marked < 0):
                    line.append(e)
                continue
            at = e - 1 if e > 0 else -1 - e
            if self.tags[at] in _BLOCK:
                flush()
            node = at if e > 0 else self.parents[at]
        flush()
        return "\n".join(blocks)


def subtrees(source: str) -> set[int]:
    """Hashes of the page's elements that may be template: containers and what they hold."""
    page = Page(source)
    return {h for h, t in zip(page.hashes, page.tags) if t not in ("html", "body", "head", "title", "article", "main")}


def host_of(url: str) -> object:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, recur: float = RECUR, least: int = LEAST) -> DataFrame:
    """(host, hash): subtrees that stand on a share recur of the host's pages, and on least at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of a batch are summed here, so that a hot host sends one row for a hash and batch
        for batch in batches:
            counts: dict[tuple[str, int | None], int] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                counts[host, None] = counts.get((host, None), 0) + 1
                for h in subtrees(source):
                    counts[host, h] = counts.get((host, h), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["host", "hash", "n"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, hash long, n long")
    counts = stage(rows.groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least)), "subtrees")
    totals = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    return counts.where("hash is not null").join(totals, "host").where(F.col("n") >= F.lit(recur) * F.col("pages")).select("host", "hash")


def extract(pages: DataFrame, recur: float = RECUR, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    found = stage(templates(pages, recur, least), "templates")

    schema = "page_id long, url string, text string, n_chars long"

    def out(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if found.count() <= BROADCAST_HASHES:
        by_host: dict[str, set[int]] = {}
        for r in found.collect():
            by_host.setdefault(r.host, set()).add(r.hash)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                yield out(batch, [Page(s).text(known.get(h, frozenset())) for h, s in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())])

        return pages.mapInArrow(run, schema)

    # a host's templates are few: each is on RECUR of its pages, so they are at most a page's elements / RECUR
    sets = found.groupBy("host").agg(F.collect_set("hash").alias("hashes")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")).join(sets, ["host", "salt"], "left")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out(batch, [Page(s).text(set(t or ())) for t, s in zip(batch.column("hashes").to_pylist(), batch.column("html").to_pylist())])

    return joined.select("page_id", "url", "html", "hashes").mapInArrow(run_joined, schema)
