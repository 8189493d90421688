"""Main text of web pages by consensus of a host's pages.

Every page is read into blocks of text under a tree of containers. A page scores its containers by the text in them, less link text,
climbs from the best one as long as an ancestor adds headings or prose, and votes for its path: tags with their classes, digits and
long random names generalised. Votes are counted per host in Spark; then every page is extracted again from the containers on the
host's winning path, or from its own best container if it has none there.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are told by tag or by a whole class, id or role
(`left-sidebar`, `ad-slot`; not `has-sidebar`, `comments-open`). Such a mark lowers what its text counts in the vote, and once a
container is chosen everything under a mark below it is left out; a mark on the container itself or above it drops nothing. What
isn't displayed (scripts, styles, hidden elements) is never read.

White space inside a block becomes one blank, blocks are trimmed and joined in page order by two line feeds. Character
references are decoded. A page that breaks off is read as far as it goes; an unfinished tag at its end is markup.

Defined cases: null or empty html gives the empty text; a null or unreadable url is a host of its own kind (''); ties between paths
go to the longer path, then to the first in order; repeated rows are extracted each; other columns are ignored; an empty table
gives an empty result. Pages are read whole, in time proportional to their length, however deep their tags nest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.llm.common import Scratch, bounded_broadcast, series_udf, trimmed

#: Elements whose content is no displayed text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_HIDDEN = _RAW | {"head", "template", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "select", "datalist", "button"}
#: Elements around the main text.
_AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "table", "tbody", "tr", "center"}
_BLOCKS = _CONTAINERS | _AROUND | {"header", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "th", "thead", "tfoot", "caption", "address", "hr", "details", "summary", "hgroup"}
_LINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "font", "code", "sub", "sup", "mark", "abbr", "cite", "q", "label"}
#: What the words of one class, id or role say of an element: a noun at its end, or at its start before a word of place or grouping.
_NOUNS = set(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar aside widget widgets footer masthead topbar toolbar share sharing social related recommended recommendations teaser teasers "
    "comment comments commentlist discussion disqus respond replies reply reviews login search searchbox complementary contentinfo form".split())
_GROUPS = set("left right main top bottom first last list lists section sections area wrap wrapper container box block bar button buttons link links item items inner outer slot unit space holder panel column col row group form field posts articles stories text body header title message thread tree".split())
_NOT = {"has", "no", "not", "with", "without", "is", "hide", "show", "hidden", "js"}
_SITE = {"site", "page", "global", "top", "main", "header", "masthead", "blog", "web"}
_TOKEN = re.compile(r"<!--(?:>|->)?.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_FENCES = _CONTAINERS - {"tr", "td", "tbody"}
_MARKED = 0.2  # what text under a mark counts in the vote
_LEVEL = 0.9  # what text one container deeper counts
_PROSE = 60  # characters of a block that is text rather than a caption


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """The tag with its classes in order, digits as #, without names that look generated."""
    names = sorted({re.sub(r"\d+", "#", c.lower()).replace("/", "|") for c in attributes.get("class", "").split()})
    return ".".join([tag, *[c for c in names if len(c) <= 40 and c.count("#") <= 2]])


def names_boilerplate(name: str) -> bool:
    """Whether one class, id or role, taken as a whole, names something around the main text."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or words[0] in _NOT:
        return False
    if words[-1] in ("header", "head"):
        return all(w in _SITE for w in words)
    return words[-1] in _NOUNS or words[0] in _NOUNS and words[-1] in _GROUPS


def _mark(tag: str, attributes: dict[str, str]) -> str:
    """'around' or 'header' for an element that isn't main text unless the main container lies in it, else ''."""
    if tag in _AROUND:
        return "around"
    if tag == "header":
        return "header"
    if tag in ("html", "body", "article", "main", "h1"):
        return ""
    names = [*attributes.get("class", "").split(), attributes.get("id", ""), attributes.get("role", "")]
    if any(names_boilerplate(n) for n in names if n):
        return "header" if any(n.lower().endswith("header") for n in names) else "around"
    return ""


class Node:
    """A container or a marked element; `last` numbers the last node in it."""

    __slots__ = ("tag", "label", "parent", "number", "last", "mark", "titled", "weight", "path", "depth")

    def __init__(self, tag: str, label: str, parent: Node | None, number: int, mark: str, path: int):
        self.tag, self.label, self.parent, self.number, self.last, self.mark, self.path = tag, label, parent, number, number, mark, path
        self.titled = False
        self.weight = (parent.weight if parent else 1.0) * (_MARKED if mark else 1.0)
        self.depth = parent.depth + 1 if parent else 0

    def is_container(self) -> bool:
        return self.tag in _CONTAINERS or self.parent is None

    def path_string(self) -> str:
        labels, node = [], self
        while node.parent is not None:
            if node.label:
                labels.append(node.label)
            node = node.parent
        return "".join("/" + x for x in reversed(labels))


class Page:
    """blocks: (text, characters of link text, node, whether a main heading) in page order; nodes in the order they open."""

    def __init__(self, html: str):
        self.root = Node("", "", None, 0, "", 0)
        self.nodes, self.blocks = [self.root], []
        self.paths: dict[tuple[int, str], int] = {}
        self._read(html)
        for n in reversed(self.nodes):
            if n.parent is not None:
                n.parent.last = max(n.parent.last, n.last)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, Node, bool]] = [("", self.root, False)]  # tag, nearest node, whether it isn't text
        where: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
        containers, fences = [0], [0]  # places of containers, and of those that stop an implied end
        text: list[str] = []
        links = 0
        h1 = False

        def flush() -> None:
            nonlocal links, h1
            if text:
                words = " ".join("".join(text).split())
                if words and not stack[-1][2]:
                    self.blocks.append((words, links, stack[-1][1], h1))
                text.clear()
            links, h1 = 0, False

        def say(raw: str) -> None:
            nonlocal links
            if raw and not stack[-1][2]:
                raw = unescape(raw)
                text.append(raw)
                if where["a"]:
                    links += len(" ".join(raw.split()))

        def close(at: int) -> None:
            while len(stack) > at:
                tag, _, off = stack[-1]
                if tag in _BLOCKS or off and not stack[-2][2]:
                    flush()
                stack.pop()
                where[tag].pop()
                if tag in _CONTAINERS:
                    containers.pop()
                    if tag in _FENCES:
                        fences.pop()

        at = 0
        for_end: dict[str, re.Pattern] = {}
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if html.startswith("<![CDATA[", m.start()):
                    say(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if not m[4]:  # an unfinished tag ends the page
                break
            if tag == "br":
                text.append(" ")
                continue
            if m[1]:
                places = where[tag]
                if places and not (tag in _LINE and containers[-1] > places[-1]):
                    close(places[-1])
                elif tag == "p":
                    flush()
                continue
            if tag in _BLOCKS:
                flush()
            if tag in _VOID:
                continue
            if tag in _IMPLIED or tag in _BLOCKS:
                ends = _IMPLIED.get(tag, ())
                open_ = [where[e][-1] for e in ends if where[e]]
                if tag in _BLOCKS and "p" not in ends and where["p"]:
                    open_.append(where["p"][-1])
                if open_:
                    fence = max([fences[-1], *[where[f][-1] for f in _FENCE.get(tag, ()) if where[f]]])
                    outer = [i for i in open_ if i > fence]
                    if outer:
                        close(max(outer))
            attributes = _attributes(m[3])
            _, node, off = stack[-1]
            hidden = tag in _HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "style" in attributes and _INVISIBLE.search(attributes["style"])
            mark = "" if off or hidden else _mark(tag, attributes)
            if not off and (hidden or mark and tag in _LINE):
                off = True
                if tag not in _LINE:
                    flush()
            if tag == "h1" and not off:
                h1 = True
                header = next((n for n in self._marks(node) if n.mark == "header"), None)
                if header is not None:
                    header.titled = True
            elif tag == "h2" and not off:
                h1 = True
            if tag in _RAW:
                end = for_end.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>", re.I)).search(html, at)
                at = end.end() if end else len(html)
                continue
            if m[3].rstrip().endswith("/") and tag in ("svg", "path", "object", "canvas"):
                continue
            if not off and (tag in _CONTAINERS or mark):
                flush()
                label = generalised(tag, attributes) if tag in _CONTAINERS else ""
                path = self.paths.setdefault((node.path, label), len(self.paths) + 1) if label else node.path
                node = Node(tag, label, node, len(self.nodes), mark, path)
                self.nodes.append(node)
                h1 = False
            where[tag].append(len(stack))
            if tag in _CONTAINERS:
                containers.append(len(stack))
                if tag in _FENCES:
                    fences.append(len(stack))
            stack.append((tag, node, off))
        else:
            say(html[at:])
        close(1)
        flush()

    @staticmethod
    def _marks(node: Node) -> Iterator[Node]:
        """The nearest few nodes around a heading."""
        for _ in range(8):
            yield node
            if node.parent is None:
                return
            node = node.parent

    def marks_above(self, container: Node) -> list[int]:
        """For each node the number of marks on the way down to it. A header with a title is none, unless the container is the whole page."""
        whole = container.tag in ("", "html", "body")
        out = [0] * len(self.nodes)
        for n in self.nodes[1:]:
            out[n.number] = out[n.parent.number] + (n.mark == "around" or n.mark == "header" and (whole or not n.titled))
        return out

    def best(self) -> tuple[Node, float] | None:
        """The main container and its score."""
        if not self.blocks:
            return None
        scores = [0.0] * len(self.nodes)
        for words, links, node, _ in self.blocks:
            scores[node.number] += (len(words) - 2.0 * links) * node.weight
        for n in reversed(self.nodes[1:]):
            scores[n.parent.number] += scores[n.number] * (_LEVEL if n.is_container() else 1.0)
        worth = lambda n: scores[n.number] * (1.5 if n.tag in ("article", "main") else 1.0)
        first = max((n for n in self.nodes if n.is_container()), key=lambda n: (worth(n), n.depth, -n.number))
        return self._climbed(first), worth(first)

    def _climbed(self, start: Node) -> Node:
        """The outermost ancestor whose further blocks are headings or prose, not links; the whole page only if it holds most of the text."""
        chosen, above = start, start.parent
        inside = [start.number <= b[2].number <= start.last for b in self.blocks]
        if not any(inside):
            return start
        low = inside.index(True)
        high = len(inside) - inside[::-1].index(True)
        marks = self.marks_above(start)
        free = lambda b, a: marks[b[2].number] == marks[a.number]
        held = sum(len(b[0]) for b in self.blocks[low:high] if free(b, start))
        while above is not None and chosen.tag not in ("article", "main"):
            added = []
            while low > 0 and above.number <= self.blocks[low - 1][2].number <= above.last:
                low -= 1
                added.append(self.blocks[low])
            while high < len(self.blocks) and above.number <= self.blocks[high][2].number <= above.last:
                added.append(self.blocks[high])
                high += 1
            added = [b for b in added if free(b, above)]
            size = sum(len(b[0]) for b in added)
            if above.tag in ("", "html", "body"):
                if size > held:
                    chosen = above
            elif added:
                if 3 * sum(b[1] for b in added) > size or not any(b[3] or len(b[0]) >= _PROSE for b in added):
                    break
                held, chosen = held + size, above
            above = above.parent if above.tag != "body" else None
        return chosen

    def under(self, path: str) -> list[Node]:
        """The outermost containers on the path."""
        at: int | None = 0
        for label in path.split("/")[1:]:
            at = self.paths.get((at, label))
            if at is None:
                return []
        out: list[Node] = []
        for n in self.nodes:
            if n.path == at and n.is_container() and n.label == path.rsplit("/", 1)[-1] and not (out and n.number <= out[-1].last):
                out.append(n)
        return out

    def text(self, containers: list[Node]) -> str:
        """The blocks of the containers, without those under a mark below them."""
        if not containers:
            return ""
        marks = self.marks_above(containers[0])  # on one path, so all or none are the whole page
        within: list[Node | None] = [None] * len(self.nodes)
        for c in containers:
            within[c.number : c.last + 1] = [c] * (c.last + 1 - c.number)
        inside = ((words, node, within[node.number]) for words, _, node, _ in self.blocks)
        return "\n\n".join(words for words, node, c in inside if c is not None and marks[node.number] == marks[c.number])


def vote(html: str) -> tuple[str, float]:
    """Path of the page's main container and its score; '' if it has no text."""
    best = Page(html).best()
    return (best[0].path_string(), best[1]) if best else ("", 0.0)


def extract(html: str, path: str | None) -> str:
    """The text under the containers on the path, else under the page's main container."""
    page = Page(html)
    if path:
        text = page.text(page.under(path))
        if text:
            return text
    best = page.best()
    return page.text([best[0]]) if best else ""


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path): of each host the path with most pages, then with the higher total score."""

    def ballots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes = [vote(h) for h in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "path": [v[0] for v in votes], "score": [v[1] for v in votes]})

    cast = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInPandas(trimmed(ballots), "host string, path string, score double")
    counted = cast.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))
    first = F.max(F.struct("pages", "score", F.length("path"), F.col("path")))
    return counted.groupBy("host").agg(first.alias("best")).select("host", "best.path")


def main_texts(pages: DataFrame, html_col: str = "html", url_col: str = "url", max_broadcast_hosts: int = 100_000) -> DataFrame:
    """The pages' columns as `row`, and text."""
    scratch = Scratch(pages.sparkSession)
    paths = scratch.table(winning_paths(pages, html_col, url_col), "paths")
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(F.col(url_col)).alias("host"))

    def text(html: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p) for h, p in zip(html, path, strict=True)], dtype=object)

    return held.join(bounded_broadcast(paths, max_broadcast_hosts), "host", "left").select("row", series_udf(text, "string")(F.coalesce(F.col(f"row.`{html_col}`"), F.lit("")), F.col("path")).alias("text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
