"""Main text of web pages by tag-path ratios.

A page's text lies in blocks: runs of text between the starts and ends of block elements. Each
block has its path of elements from the root; a step is an element's tag and its first name (class
or id). For each path, text length and punctuation marks are summed over its blocks and divided by
their number (a block that is mostly links counts less); both ratios are smoothed over paths that
lie near each other in the tree of containers, fused as a product with the root of the share of the
text that lies there, weighed by what the path's elements are, and held against a threshold. The text is all blocks of the paths above it.

The weight makes a path count less for each element on it whose class, id or name is one that
pages give to what isn't the article, or that is a form, and for lying outside article and main
where these hold a good part of the prose; it counts nothing by itself: where all prose is in such
elements, the threshold is theirs. Elements that are never part of an article (menus, headers and
footers of the page, sidebars, dialogs, controls, scripts, styles, what is hidden; by tag, role or
attribute) have no text. Elements of any kind are looked at, also those within lines.

Defined results: a null page is empty; a page without text, or with text only in elements that are
out, gives the empty string; broken markup is read as browsers do in the main (unclosed elements,
stray ends, unclosed comments and scripts run to the end; beyond DEEPEST open elements, what would
lie deeper lies beside the innermost, with all its text); a page without markup is its own text;
rows that repeat give equal results. Nothing is cut by length.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hgroup center "
    "nav header footer aside form fieldset legend dialog menu search template noscript head hr select option optgroup textarea button".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CONTAINER = frozenset("html body main article section div td center".split())
OUT = frozenset("nav footer aside form fieldset dialog menu search template noscript head title select option optgroup textarea button script style iframe object svg math canvas audio video".split())
OUT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
SIBLINGS_END = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SIBLINGS_END |= {x: ("thead tbody tfoot tr td th caption", ("table",)) for x in ("thead", "tbody", "tfoot")}

#: Whole names in a class or id, bare or with a place or kind after them, that mark what is not article text.
OUT_NAME = re.compile(
    r"(?<!\S)(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|notification\w*|alert\w*|popup|pop-up|modal|overlay|lightbox|"
    r"side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|masthead|site-?header|page-?header|topbar|site-?footer|page-?footer|footer|foot|header|"
    r"comments?|comment-?\w*|disqus\w*|respond|replies|reply|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscri\w*|signup|sign-up|login|"
    r"widget\w*|toolbar|pagination|pager|copyright|skip-?link\w*|tags?-?list|outbrain|taboola)(?:[_-](?:notice|bar|box|area|section|list|wrap|wrapper|container|block|widget|slot|unit|banner|left|right|top|bottom|main|primary|secondary|nav|menu|links?|form|\d+))*(?!\S)",
    re.IGNORECASE,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")


#: Elements open at once; as in browsers, what would lie deeper lies beside the innermost.
DEEPEST = 512


@dataclass
class Path:
    """A tag path: the steps from the root."""

    container: int  # the path of its nearest container, itself included
    up: int  # the path of the nearest container of the element above
    doubts: int  # elements on it that a name or being a form speaks against
    marked: bool  # runs through article or main
    heading: bool


@dataclass
class Element:
    tag: str
    path: int
    out: bool
    inline: bool


@dataclass
class Block:
    path: int
    out: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


# Raw text elements hold no markup: they end at their own end tag only.
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.IGNORECASE) for x in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
MARKUP = re.compile(r"<!--|<[!?]|</(?![a-zA-Z])|<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")


class BlockParser:
    """Reads a page into blocks, in one pass from start to end whatever its markup."""

    def __init__(self) -> None:
        self.tree = [Path(0, -1, 0, False, False)]
        self.paths: dict[tuple[int, str], int] = {}
        self.open, self.blocks, self.links = [Element("html", 0, False, False)], [], 0
        self.opened: dict[str, int] = {}  # open elements by tag
        self.skip: list[str] = []  # open elements without text of their own: scripts and the like
        self.line: dict[int, Block] = {}  # blocks that text may still join, by the depth of their element

    def read(self, html: str) -> None:
        at = 0
        while m := MARKUP.search(html, at):
            if m.start() > at:
                self.text(unescape(html[at : m.start()]))
            if not m[2]:  # comments, declarations and what is read as a comment
                mark = "-->" if m[0] == "<!--" else ">"
                end = html.find(mark, m.start() + 2)
                if end < 0:
                    return
                at = end + len(mark)
                continue
            tag, at, attrs = m[2].lower(), m.end(), {}
            while not (end := TAG_END.match(html, at)):
                found = ATTRIBUTE.match(html, at)
                if not found:
                    return  # the page ends within a tag
                attrs.setdefault(found[1].lower(), unescape(found[2] or found[3] or found[4] or ""))
                at = found.end()
            at = end.end()
            if m[1]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, attrs)
            if tag in RAW_END:
                end = RAW_END[tag].search(html, at)
                if not end:
                    return
                at = end.start()
        if at < len(html):
            self.text(unescape(html[at:]))

    def start_tag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in VOID:
            if tag == "hr":
                self.close_p()
                self.line = {}
            elif tag == "br":
                self.text(" ")
            return
        if self.skip or tag in OUT and tag not in BLOCK or tag in RAW_END:
            self.skip.append(tag)
            return
        if tag == "a":
            self.links = 1
        if tag not in BLOCK:
            # Of elements within lines only those matter that are put out or in doubt, and those inside of one such of their name, for their ends.
            out, doubt = self.judged(tag, attrs)
            if out or doubt or self.opened.get(tag):
                self.push(tag, attrs, out, doubt)
            return
        if self.open[-1].tag == "head" and tag != "noscript" and tag != "template":
            self.pop_to(len(self.open) - 1)
        if tag in ("html", "body"):
            if len(self.open) == 1 and tag == "body":
                self.push(tag, attrs, *self.judged(tag, attrs))
            return
        if tag in ENDS_P:
            self.close_p()
        if tag in SIBLINGS_END:
            names, within = SIBLINGS_END[tag]
            self.close_siblings(names.split(), within)
        self.push(tag, attrs, *self.judged(tag, attrs))

    def judged(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
        """Whether an element is out, and whether its name or being a form speaks against it."""
        out = tag in OUT and tag != "form" or tag == "header" and not (self.opened.get("article") or self.opened.get("main"))
        doubt = tag == "form" or "-" in tag and bool(OUT_NAME.search(tag))
        if attrs:
            out = out or attrs.get("role", "").lower() in OUT_ROLE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "style" in attrs and bool(HIDDEN.search(attrs["style"]))
            named = tag not in ("html", "body", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6") and ("class" in attrs or "id" in attrs)
            doubt = doubt or named and bool(OUT_NAME.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
        return out, doubt

    def push(self, tag: str, attrs: dict[str, str], out: bool, doubt: bool) -> None:
        if len(self.open) > DEEPEST:
            self.pop_to(len(self.open) - 1)
        up, inline = self.open[-1], tag not in BLOCK
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        step = f"{tag}.{names[0]}" if names and tag != "p" else tag
        key = (up.path, step + "?" * doubt)
        if key not in self.paths:
            own, above = len(self.tree), self.tree[up.path]
            self.paths[key] = own
            self.tree.append(Path(own if tag in CONTAINER else above.container, above.container if tag in CONTAINER else above.up, above.doubts + doubt, above.marked or tag in ("article", "main"), tag[0] == "h" and tag[1:].isdigit()))
        self.open.append(Element(tag, self.paths[key], up.out or out, inline))
        self.opened[tag] = self.opened.get(tag, 0) + 1
        if not inline:
            self.line, self.links = {}, 0

    def pop_to(self, k: int) -> None:
        for depth in range(k, len(self.open)):
            e = self.open[depth]
            self.opened[e.tag] -= 1
            self.line.pop(depth, None)
            if not e.inline:
                self.line, self.links = {}, 0
        del self.open[k:]

    def close_p(self) -> None:
        if not self.opened.get("p"):
            return None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == "p":
                return self.pop_to(k)
            if self.open[k].tag in ("td", "th", "button", "caption", "table", "template"):
                return None
        return None

    def close_siblings(self, names: list[str], within: tuple[str, ...]) -> None:
        if not any(map(self.opened.get, names)):
            return
        last = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in within:
                break
            if self.open[k].tag in names:
                last = k
        if last is not None:
            self.pop_to(last)

    def end_tag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag == "a":
            self.links = 0
        if tag in ("html", "body") or not self.opened.get(tag):
            return
        for k in range(len(self.open) - 1, 0, -1):
            e = self.open[k]
            if e.tag == tag:
                return self.pop_to(k)
            if tag == "p" and e.tag in ("td", "th") or tag == "li" and e.tag in ("ul", "ol") or tag not in BLOCK and not e.inline:
                return None
        return None

    def text(self, data: str) -> None:
        if self.skip:
            return
        depth = len(self.open) - 1
        block = self.line.get(depth)
        if block is None:
            if not data.strip():
                return
            e = self.open[depth]
            self.line[depth] = block = Block(e.path, e.out)
            self.blocks.append(block)
        block.parts.append(data)
        if self.links:
            block.linked += len(data.strip())


#: How much paths one and two containers away count when ratios are smoothed, and headings' paths one away.
NEAR, FAR, HEADING = 0.1, 0.01, 0.6
#: The threshold's share of the mean score; weights of a doubt, and of lying outside and inside of article and main.
LEAST, DOUBT, OUTSIDE, INSIDE = 0.15, 0.002, 0.1, 10.0
#: Prose that a page has at least for what is in doubt to be its text.
SOME = 20


def ratios(blocks: list[Block], tree: list[Path]) -> dict[int, float]:
    """Length and punctuation ratios by path, smoothed over the tree of containers and fused, with the root of the share of the text that lies there."""
    length, marks, nodes = Counter(), Counter(), Counter()
    for b in blocks:
        weight = 1 - min(1.0, b.linked / max(1, len(b.text)))
        length[b.path] += weight * len(b.text)
        marks[b.path] += weight * len(PUNCTUATION.findall(b.text))
        nodes[b.path] += 1
    # Sums of (length ratio, mark ratio, 1, length) over the paths of each container, its children and their children.
    none = [0.0, 0.0, 0.0, 0.0]
    own, below, further = (defaultdict(none.copy) for _ in range(3))
    above = lambda c: tree[c].up if c >= 0 else -1
    for p, k in nodes.items():
        value, c = (length[p] / k, marks[p] / k, 1.0, length[p]), tree[p].container
        for sums, at in ((own, c), (below, above(c)), (further, above(above(c)))):
            if at >= 0:
                sums[at] = [x + y for x, y in zip(sums[at], value)]
    out, sizes = {}, {}
    for p in nodes:
        c = tree[p].container
        up = above(c)
        near = HEADING if tree[p].heading else NEAR
        around = zip(own[c], own.get(up, none), below.get(c, none), own.get(above(up), none), below.get(up, none), further.get(c, none))
        text, mark, weight, size = (o + near * (u + b) + FAR * (uu + max(0.0, s - o if up >= 0 else 0.0) + f) for o, u, b, uu, s, f in around)
        out[p], sizes[p] = text / weight * (1 + mark / weight), size
    marked = sum(length[p] for p in nodes if tree[p].marked)  # an article's parts aren't weighed against each other
    sizes = {p: marked if tree[p].marked else x for p, x in sizes.items()}
    most = max(sizes.values()) or 1.0
    return {p: x * math.sqrt(sizes[p] / most) for p, x in out.items()}


def prose(b: Block) -> float:
    """Characters of a block that aren't linked; a quarter of them, if it has no mark."""
    return max(0, len(b.text) - b.linked) * (1.0 if PUNCTUATION.search(b.text) else 0.25)


def weights(blocks: list[Block], tree: list[Path]) -> tuple[int, dict[int, float]]:
    """The doubts that the page's prose has at least, and each path's weight."""
    total = sum(map(prose, blocks))
    held, article = Counter(), Counter()
    for b in blocks:
        held[tree[b.path].doubts] += prose(b)
        article[tree[b.path].doubts] += prose(b) * tree[b.path].marked
    least, so_far, inside = 0, 0, 0
    for d in sorted(held):
        so_far, inside, least = so_far + held[d], inside + article[d], d
        if inside or 10 * so_far >= total > 0:
            break
    if total < SOME:
        least = 0
    trusted = 4 * inside >= so_far > 0
    out = {}
    for p in {b.path for b in blocks}:
        where = (INSIDE if tree[p].marked else OUTSIDE) if trusted else 1.0
        out[p] = where * DOUBT ** max(0, tree[p].doubts - least)
    return least, out


def path_scores(blocks: list[Block], tree: list[Path]) -> tuple[dict[int, float], float]:
    """Each path's ratios times its weight, and the threshold: a share of the mean ratios of the text that is least in doubt."""
    score = ratios(blocks, tree)
    doubts, weight = weights(blocks, tree)
    basis = [b for b in blocks if tree[b.path].doubts <= doubts]
    if not basis:
        return {}, 1.0
    mean = sum(score[b.path] * len(b.text) for b in basis) / sum(len(b.text) for b in basis)
    return {p: x * weight[p] for p, x in score.items()}, LEAST * mean


def article_text(html: str | None) -> str:
    """The main text: blocks joined by two line ends."""
    parser = BlockParser()
    parser.read(html or "")
    blocks = []
    for b in parser.blocks:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
        if b.text and not b.out:
            blocks.append(b)
    if not blocks:
        return ""
    score, least = path_scores(blocks, parser.tree)
    return "\n\n".join(b.text for b in blocks if score.get(b.path, 0.0) >= least)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; ids and urls as they are."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [article_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = own.dtypes
    return own.mapInArrow(run, f"page_id {kinds[0][1]}, url {kinds[1][1]}, text string, n_chars long")
