"""Main text of HTML pages by tag-path ratios.

A page's text nodes are gathered by the path of tags from the root to the node. A path's ratios are
its characters and its punctuation marks for each of its nodes; articles have long, punctuated text
under few paths, menus and lists have short, bare text. The two ratios are fused, smoothed over
paths that share a beginning, and held against a threshold relative to the page's best path; the
containers in which chosen paths hold most of the text are the content, with all their blocks.

Elements whose tag or role says that they are menus, forms and so on never count. A class or an id
that says so strikes an element unless that holds the page's article, or, where the page marks none
and the class only says so in a part of a longer name, most of its text. Within the article an id, or a part of a
longer name, is no more than a hint: such an element goes only if its own ratios are low or its text is mostly links. Ids of headings and
paragraphs are anchors and say nothing.

Blocks that lie beside the article, or, where the page marks none, beside the container that holds most of the
chosen text, must reach the threshold by themselves, and most of their text must be no links: menus and footers in plain
containers share the paths of what stands beside them.

Each page is read alone, in the task that holds it, in time and memory that grow with its length:
paths are nodes of one tree, and smoothing goes along it. Nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*>", re.S)
#: Elements without markup inside, up to their end tag: where that lacks, those of the first kind go to the page's end, the others are a tag alone.
RAW, SKIPPED = frozenset("script style textarea title".split()), frozenset("noscript template iframe svg select button".split())
CLOSED = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW | SKIPPED}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers whose share of chosen text decides over their blocks.
CONTAINER = frozenset("article main section div body td blockquote".split())
STRIPPED = frozenset("nav header footer aside form menu dialog head annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
#: Readers' comments, and other names of what is no content, as parts of a class or id between - and _.
REMARKS = re.compile(r"comments?|commentlist|disqus|replies|responses")
NAMED = re.compile(
    REMARKS.pattern + r"|ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|rail|footer|header|masthead|cookies?|consent|"
    r"gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|form|search|share|sharing|social|related|recommended|toolbar|pagination|skip"
)
#: First parts of names that tell of a page's layout, not of an element.
LAYOUT = frozenset("has with no without not is hide show".split())
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A new element of the first kind closes an open one of the second, if none of the third is nearer.
#: Elements whose ids are places to jump to; what an id says of others within an article is a hint.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p dt dd li span a code pre table figure img".split())
CLOSES = [("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("tr", "tr", "table"), ("td th", "td th", "tr table"), (" ".join(BLOCK), "p", "td th object")]
CLOSES = [tuple(frozenset(x.split()) for x in row) for row in CLOSES]
MARKS = re.compile(r"[.,;:!?…。、，]")
#: Paths further apart than this in the tree have no weight for each other.
FAR = 5
#: An element that is named by a hint stays if its ratio is this part of the page's; a container holds a page's text with this part of what is chosen.
HINTED, MOST = 0.25, 0.6
WEIGHTS = [math.exp(-d * d / 2.0) for d in range(FAR + 1)]


def _said(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """(whether an element is no content by its tag, role or state; what its class and id name).

    A name is "" for nothing, "part" if by a part of a longer name alone, "hint" within an article if by that or by an id, and "whole"
    otherwise and for comments.
    """
    if tag in STRIPPED:
        return True, ""
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, ""
    named = ""
    rank = ("", "hint", "part", "whole")
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, ""
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split("[-_]+", word)
                if word == "widget" or parts[0] not in LAYOUT and any(map(NAMED.fullmatch, parts)):
                    remarks = any(map(REMARKS.fullmatch, parts)) and (len(parts) == 1 or name == "class" or not inside)
                    if name == "id" and tag in ANCHORED and (inside or not remarks):
                        continue
                    found = "whole" if len(parts) == 1 or remarks else "part"
                    if inside and not remarks and (name == "id" or found == "part"):
                        found = "hint"
                    named = max(named, found, key=rank.index)
    return False, named


def _is_article(tag: str, attrs: str) -> bool:
    if tag in ("article", "main"):
        return True
    low = attrs.lower() if attrs else ""
    return ("role" in low or "itemprop" in low) and any(n.lower() == "role" and "".join(v).lower() == "main" or n.lower() == "itemprop" and "".join(v).lower() == "articlebody" for n, *v in ATTR.findall(attrs))


class _Page:
    """A page's blocks as lists of text nodes (path, container, name, text); paths, containers and named elements are numbered from their parents on."""

    def __init__(self, page: str):
        self.blocks: list[list[tuple[int, int, int, str]]] = [[]]
        self.parent, self.child = [-1], {}
        # Of each path, whether it is within a link; of each container, the one around it and whether it is within the page's article.
        self.linked, self.box_around, self.box_inside = [False], [-1], [False]
        # Of each named element: the named one around it, what it is, whether it holds an article.
        self.around, self.name, self.holds = [-1], [""], [False]
        #: Of each open element: tag, whether it is off, container, named element, path, the nearest open element of each row of CLOSES, and whether it is within an article.
        self.stack: list[tuple] = [("", False, 0, 0, 0, (-1,) * len(CLOSES), False)]
        self.open: dict[str, list[int]] = defaultdict(list)
        self._read(page)
        self.blocks = [b for b in self.blocks if b]

    def _text(self, raw: str) -> None:
        _, off, box, name, path, _, _ = self.stack[-1]
        if raw and not off:
            self.blocks[-1].append((path, box, name, html.unescape(raw) if "&" in raw else raw))

    def _part(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _close(self, i: int) -> None:
        for _ in range(len(self.stack) - i):
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in BLOCK:
                self._part()

    def _read(self, page: str) -> None:
        containers, at, endless = 0, 0, set()
        # No tag ends after the last >, but a comment without an end goes on to the page's.
        stop = page.rfind(">") + 1
        if (rest := page.find("<!--", stop)) >= 0:
            page = page[:rest]
        while m := TOKEN.search(page, at, stop):
            self._text(page[at : m.start()])
            at = m.end()
            if m["tag"] is None:
                continue
            tag, attrs = m["tag"].lower(), m["attrs"]
            if m["end"]:
                if tag in BLOCK:
                    self._part()
                if self.open[tag]:
                    self._close(self.open[tag][-1])
                continue
            if tag in CLOSED:
                if not attrs.endswith("/") and tag not in endless:
                    if end := CLOSED[tag].search(page, at):
                        at = end.end()
                    elif tag in RAW:
                        at = len(page)
                    else:
                        endless.add(tag)
                continue
            if tag == "br":
                self._text(" ")
            if tag in BLOCK:
                self._part()
            for k, (opens, _, _) in enumerate(CLOSES):
                if tag in opens and self.stack[-1][5][k] >= 0:
                    self._close(self.stack[-1][5][k])
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                continue
            self._open(tag, attrs, containers + 1)
            containers += tag in CONTAINER
        self._text(page[at:])

    def _open(self, tag: str, attrs: str, container: int) -> None:
        _, off, box, name, path, near, inside = self.stack[-1]
        here = len(self.stack)
        article = _is_article(tag, attrs)
        if not off:
            off, named = _said(tag, attrs, inside)
            if named:
                self.around.append(name)
                self.name.append(named)
                self.holds.append(False)
                name = len(self.name) - 1
            self.holds[name] |= article
        if (path, tag) not in self.child:
            self.child[path, tag] = len(self.parent)
            self.parent.append(path)
            self.linked.append(tag == "a" or self.linked[path])
        inside |= article
        if tag in CONTAINER:
            self.box_around.append(box)
            self.box_inside.append(inside)
        near = tuple(here if tag in ends else -1 if tag in stops else x for x, (_, ends, stops) in zip(near, CLOSES))
        self.stack.append((tag, off, container if tag in CONTAINER else box, name, self.child[path, tag], near, inside))
        self.open[tag].append(here)

    def struck(self) -> list[bool]:
        """Of each named element, whether its text doesn't count."""
        own = [[0, 0, 0, 0] for _ in self.name]
        for block in self.blocks:
            for path, _, name, raw in block:
                _add(own[name], raw, self.linked[path])
        every = [sum(x) for x in zip(*own)]
        for i in range(len(own) - 1, 0, -1):
            own[self.around[i]] = [x + y for x, y in zip(own[self.around[i]], own[i])]
            self.holds[self.around[i]] |= self.holds[i]
        out = [False]
        for i in range(1, len(own)):
            most = self.name[i] == "part" and 2 * own[i][0] >= every[0] and not self.holds[0]
            # A hint holds where the element's text is unlike the page's.
            prose = self.name[i] == "hint" and 2 * own[i][3] < own[i][0] and _ratio(own[i]) >= HINTED * _ratio(every)
            out.append(out[self.around[i]] or not (self.holds[i] or most or prose))
        return out

    def beside(self, chosen: dict[int, int]) -> list[bool]:
        """Of each container, whether it lies beside the page's article, or beside the container with most of the ``chosen`` characters (by container)."""
        inside = list(self.box_inside)
        if not any(inside[b] for b, n in chosen.items() if n):
            total = [chosen.get(b, 0) for b in range(len(inside))]
            for b in range(len(total) - 1, 0, -1):
                total[self.box_around[b]] += total[b]
            root = 0
            for b in range(1, len(total)):  # parents come first
                if self.box_around[b] == root and total[b] >= MOST * total[0]:
                    root = b
            inside = [b == root for b in range(len(inside))]
            for b in range(root + 1, len(inside)):
                inside[b] = inside[self.box_around[b]]
        return [not x for x in inside]


def _add(sums: list[int], raw: str, linked: bool) -> None:
    """Counts a text node: characters, punctuation marks, nodes, characters in links."""
    if (n := len(raw.strip())) > 0:
        sums[0] += n
        sums[1] += len(MARKS.findall(raw))
        sums[2] += 1
        sums[3] += n * linked


def _ratio(sums: list[int]) -> float:
    chars, marks, n, *_ = sums
    return chars / n * (1 + marks / n) if n else 0.0


def smoothed(parent: list[int], values: dict[int, float]) -> dict[int, float]:
    """Means of ``values`` (by path) with Gaussian weights of the steps between paths in the tree, up to ``FAR`` steps.

    Sums over what lies d steps below each node give those over what lies d steps away.
    """
    below: dict[int, list[list[float]]] = {}
    for p, v in values.items():
        for d in range(FAR + 1):
            s = below.setdefault(p, [[0.0, 0] for _ in range(FAR + 1)])[d]
            s[0] += v
            s[1] += 1
            if (p := parent[p]) < 0:
                break
    out = {}
    for start in values:
        total = weight = 0.0
        came, p = -1, start
        for up in range(FAR + 1):
            for d in range(FAR + 1 - up):
                v, n = below[p][d]
                if came >= 0 and d:
                    v, n = v - below[came][d - 1][0], n - below[came][d - 1][1]
                total += WEIGHTS[up + d] * v
                weight += WEIGHTS[up + d] * n
            came, p = p, parent[p]
            if p < 0:
                break
        out[start] = total / weight
    return out


def main_text(page: str | None, share: float = 0.1) -> str:
    """The content blocks of a page in page order, joined by newlines; empty for a null page or one without text."""
    read = _Page(page or "")
    off = read.struck()
    blocks = [[(path, box, raw) for path, box, name, raw in block if not off[name]] for block in read.blocks]
    stats: dict[int, list[int]] = {}
    boxes: dict[int, list[int]] = {}
    for block in blocks:
        for path, box, raw in block:
            if raw.strip():
                _add(stats.setdefault(path, [0, 0, 0, 0]), raw, read.linked[path])
                _add(boxes.setdefault(box, [0, 0, 0, 0]), raw, read.linked[path])
    if not stats:
        return ""
    smooth = smoothed(read.parent, {p: _ratio(s) for p, s in stats.items()})
    least = share * max(smooth.values())
    chosen = {p for p, v in smooth.items() if v >= least}
    held: dict[int, list[int]] = {}
    for block in blocks:
        for path, box, raw in block:
            h = held.setdefault(box, [0, 0])
            n = len(raw.strip())
            h[1] += n
            h[0] += n * (path in chosen)
    beside = read.beside({box: h[0] for box, h in held.items()})
    low = {box for box, s in boxes.items() if beside[box] and (_ratio(s) < least or 2 * s[3] > s[0])}
    out = (" ".join("".join(raw for _, box, raw in block if box not in low and 2 * held[box][0] >= held[box][1]).split()) for block in blocks)
    return "\n".join(x for x in out if x)


def extract_text(pages: DataFrame, html_col: str = "html", share: float = 0.1) -> DataFrame:
    """All rows and columns of ``pages`` except the html, with ``text`` and ``n_chars`` (its code points).

    ``share`` is the least smoothed ratio of a chosen path, relative to the page's best. A null or
    empty page, and one without content, has an empty text. Rows repeat as they come; an empty table
    gives no rows; columns named text or n_chars are replaced, others may have any name. Texts are
    taken whole, whatever their length.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*kept, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py(), share) for x in batch.column(len(kept))], pa.string())
            yield pa.record_batch([*batch.columns[: len(kept)], found], names=[*kept, "text"])

    schema = type(source.schema)(source.schema.fields[: len(kept)]).add("text", "string")
    return source.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
