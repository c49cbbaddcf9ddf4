"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf tag path (elements with their classes; elements within a line don't count). For each
path the page's text is summed: characters, punctuation marks and blocks. The text ratio of a path is its characters
for each block, the punctuation ratio its marks for each block; the two are fused as their product, spread back to the blocks
in page order and smoothed with a small Gaussian window. Paths whose mean smoothed value reaches a share of the
spread (standard deviation) are content.

Content paths elect a region: every <article> or <main> with content, or else the lowest common ancestor of all content. The result is the blocks of content
paths and, in the region, the headings, lists and short blocks among them. Before the first and after the last content block, blocks of another path that are links
only are left out, and without an article or main those whose container holds no content, an h1 excepted. Of several articles, those with less than a quarter of the
largest one's text are teasers and go.

Elements that never hold article text are left out before any ratio is taken. So are forms, and elements marked by class, id or role as menus, adverts,
notices, comments and the like, unless they hold over half of the page's fused text (then a form or a mark belongs to the layout), which doesn't hold for readers' comments.
A class that has such a word beside words of its own (search-term) is weighed: the element goes only if its text is not on content paths.
Words after has, no, with and the like mark nothing, nor do ids with words of their own (as of a heading) unless they begin or end with a word for comments, nor
marks of main, html and body. Of a header within an article or main the headings stay.

Inside a block white space becomes one space, and a line break is white space. Blocks are joined in page order by one newline.

Defined cases: a null, empty or textless page gives an empty text; unclosed and crossing tags are closed as
browsers do, roughly; a page cut off in a tag ends there. Time and memory are in proportion to a page's length, however deep its tags are nested.
Repeated rows and null ids get a row each. An empty table gives no rows. Other columns are not read, whatever their names; those in `keep` must not be named
page_id, text or n_chars.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i img ins kbd label mark q s samp select small span strike strong sub sup svg time tt u var video wbr".split())
SKIPPED = frozenset("head nav header footer aside button label legend select option svg dialog menu audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("body main article section div".split())
# Words of class, id or role that mark what is not article text, beginnings of such words, and those of readers' comments.
MARKS = frozenset("ad ads adv banner consent footer gdpr header masthead menu modal nav navbar notice popup promo promoted related social share sharing toolbar widget complementary contentinfo search".split())
STEMS = ("adsby", "advert", "breadcrumb", "cookie", "navig", "newsletter", "sidebar", "sponsor", "subscri")
COMMENTS = frozenset("comment comments commentlist comentarios commentaires kommentare disqus replies reply respond".split())
#: After these a word tells what a layout has, not what the element is; words that say nothing about content
ABOUT = frozenset("has no with without is not show hide".split())
STRUCTURE = frozenset("area article articles bar block blog body bottom box btn button buttons card cards close col column container content desktop entry fixed form global google group horizontal icon icons image inline inner input item items label large left link links list main media mobile module network outer overlay page panel post posts primary right row secondary section signup single site slot small sticky stories story text thread title toggle top unit vertical view wrap wrapper".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？¡¿]")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
MARKED = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
#: Smoothing weights, the share of the standard deviation that a content path reaches, and the share of links in a block of links.
WINDOW, SHARE, LINKED = (0.05, 0.25, 0.4, 0.25, 0.05), 0.25, 0.8
#: Articles under this share of the largest one's text are teasers
TEASER = 0.25
#: What an element's mark says
PLAIN, WEIGHED, LAYOUT, READERS = 0, 1, 2, 3


def _said(word: str) -> int:
    return READERS if word in COMMENTS else LAYOUT if word in MARKS or word.startswith(STEMS) else PLAIN


def _token(kind: str, name: str, token: str) -> int:
    """What one class, id or role says."""
    words = WORDS.findall(token)
    if not words or words[0] in ABOUT:
        return PLAIN
    most = max(map(_said, words))
    own = [w for w in words if not _said(w) and w not in STRUCTURE and len(w) > 2]
    if not own or not most:
        return most
    if kind == "id":
        ends = name not in HEADINGS and len(words) == 2 and COMMENTS.intersection(words)
        return READERS if ends else PLAIN
    return most if kind == "role" else WEIGHED


def _marked(name: str, attrs: str) -> tuple[int, str]:
    """What an element's name and attributes mark it as, and its classes, id and role."""
    found = [(kind.lower(), value.strip("\"'").lower()) for kind, value in MARKED.findall(attrs)] if "=" in attrs else []
    most = LAYOUT if name == "form" else PLAIN
    for kind, value in found:
        if kind != "id" or name not in HEADINGS:
            most = max([most, *(_token(kind, name, t) for t in value.split())])
    if name in ("html", "body", "main") or name == "article" and most == LAYOUT:
        most = PLAIN
    return most, ".".join(value for _, value in found)


class Page:
    """The text nodes of a page, outside of what never holds article text.

    Paths are numbered: names[p] is the last element of path p, above[p] is the path it is in. Boxes are the containers themselves, of which
    several may have one path.
    """

    def __init__(self, html: str):
        self.names, self.above = [""], [-1]
        self.boxes: list[tuple[str, int]] = [("", -1)]  # name, and the box around it
        self.marks: list[tuple[int, int]] = [(PLAIN, -1)]  # what a marked element is, and the marked one around it
        self.nodes: list[tuple[int, int, int, int, bool, str]] = []  # block, path, box, mark, within a link, text
        self.held = [False]  # the marked element holds an h1, article or main
        self._numbers: dict[tuple[int, str], int] = {}
        self._read(html)

    def _path(self, above: int, name: str, label: str) -> int:
        key = (above, f"{name}.{label}")
        if key not in self._numbers:
            self._numbers[key] = len(self.names)
            self.names.append(name)
            self.above.append(above)
        return self._numbers[key]

    def _read(self, html: str) -> None:
        # stack: name, path, box, mark, left out, inside an article or main, links around
        stack: list[tuple] = [("", 0, 0, 0, False, False, 0)]
        opened: Counter[str] = Counter()
        block, at, end = 0, 0, len(html)

        def close(k: int) -> None:
            for x in stack[k:]:
                opened[x[0]] -= 1
            del stack[k:]

        def add(text: str) -> None:
            _, path, box, mark, out, _, links = stack[-1]
            if not out:
                self.nodes.append((block, path, box, mark, links > 0, text))

        while at < end:
            m = TOKEN.search(html, at)
            text = html[at : m.start() if m else end]
            if text:
                add(unescape(text))
            if not m:
                break
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if name not in INLINE:
                block += 1
            if m[1]:
                if opened[name]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                continue
            if name == "br":
                add("\n")
                continue
            if name in VOID:
                continue
            if name in RAW:
                found = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = found.end() if found else end
                continue
            closing = "p" if name in CLOSES_P else name if name in ("li", "tr", "td", "th", "dt", "dd", "option") else None
            if closing and opened[closing]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == closing:
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            _, path, box, mark, out, inside, links = stack[-1]
            kind, label = _marked(name, m[3])
            if kind:
                self.marks.append((kind, mark))
                self.held.append(False)
                mark = len(self.marks) - 1
            elif name in ("h1", "article", "main"):
                around = mark
                while around > 0 and not self.held[around]:
                    self.held[around] = True
                    around = self.marks[around][1]
            if name in HEADINGS and out == "header" and inside:
                out = False
            elif name in SKIPPED and not out:
                out = "header" if name == "header" else True
            if name not in INLINE:
                path = self._path(path, name, label)
            if name in CONTAINERS:
                self.boxes.append((name, box))
                box = len(self.boxes) - 1
            opened[name] += 1
            stack.append((name, path, box, mark, out, inside or name in ("article", "main"), links + (name == "a")))


@dataclass
class Block:
    path: int
    box: int
    mark: int
    linked: float  # share of its text within links
    text: str


def _blocks(page: Page) -> list[Block]:
    """The blocks with text."""
    out = []
    for _, own in groupby(page.nodes, key=lambda n: n[0]):
        own = list(own)
        text = " ".join("".join(n[5] for n in own).split())
        if text:
            _, path, box, mark, _, _ = max(own, key=lambda n: len(n[5].strip()))
            size = [(len(n[5].strip()), n[4]) for n in own]
            out.append(Block(path, box, mark, sum(n for n, link in size if link) / max(1, sum(n for n, _ in size)), text))
    return out


def _unmarked(page: Page, blocks: list[Block]) -> list[Block]:
    """Blocks outside of elements that their marks leave out."""
    fused = [0.0] * len(page.marks)
    for b in blocks:
        fused[b.mark] += len(b.text) * (1 + len(PUNCTUATION.findall(b.text)))
    total = sum(fused)
    for mark in range(len(fused) - 1, 0, -1):  # the inner ones come later
        fused[max(0, page.marks[mark][1])] += fused[mark]
    gone = [False] * len(page.marks)
    for mark in range(1, len(gone)):
        kind, around = page.marks[mark]
        most = kind == WEIGHED or fused[mark] > total / 2 and (kind == LAYOUT or page.held[mark])
        gone[mark] = not most or gone[max(0, around)]
    blocks = [b for b in blocks if not gone[b.mark]]
    if any(kind == WEIGHED for kind, _ in page.marks) and blocks:
        picked, size, good = content_paths(blocks), [0] * len(gone), [0] * len(gone)
        for b in blocks:
            size[b.mark] += len(b.text)
            good[b.mark] += len(b.text) * (b.path in picked)
        for mark in range(len(gone) - 1, 0, -1):
            around = max(0, page.marks[mark][1])
            size[around] += size[mark]
            good[around] += good[mark]
        for mark in range(1, len(gone)):
            kind, around = page.marks[mark]
            gone[mark] = gone[mark] or gone[max(0, around)] or kind == WEIGHED and 2 * good[mark] < size[mark]
        blocks = [b for b in blocks if not gone[b.mark]]
    return blocks


def content_paths(blocks: list[Block]) -> set[int]:
    """The paths of blocks that hold the main text."""
    sums: dict[int, list[int]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
    fused = [chars / n * (1 + marks / n) for chars, marks, n in (sums[b.path] for b in blocks)]
    half = len(WINDOW) // 2
    smooth = [sum(w * fused[min(max(i + k - half, 0), len(fused) - 1)] for k, w in enumerate(WINDOW)) for i in range(len(fused))]
    mean = sum(smooth) / len(smooth)
    least = SHARE * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    total: dict[int, float] = {}
    for b, x in zip(blocks, smooth):
        total[b.path] = total.get(b.path, 0) + x
    return {p for p, x in total.items() if x / sums[p][2] >= least and sums[p][1]} or {max(sums, key=lambda p: sums[p][0])}


def _without_teasers(page: Page, blocks: list[Block]) -> list[Block]:
    """Blocks outside of articles that are small beside the largest one and neither in it nor around it."""
    size = [0] * len(page.boxes)
    for b in blocks:
        size[b.box] += len(b.text)
    for k in range(len(size) - 1, 0, -1):
        size[page.boxes[k][1]] += size[k]
    articles = [k for k, (name, _) in enumerate(page.boxes) if name == "article" and size[k]]
    if len(articles) < 2:
        return blocks
    largest = max(articles, key=lambda k: (size[k], -k))
    around, k = set(), largest
    while k >= 0:
        around.add(k)
        k = page.boxes[k][1]
    teaser, inside = [False], [False]
    for k, (name, up) in enumerate(page.boxes[1:], 1):
        inside.append(inside[up] or k == largest)
        teaser.append(teaser[up] or name == "article" and k not in around and not inside[k] and size[k] < TEASER * size[largest])
    return [b for b in blocks if not teaser[b.box]]


def _article(page: Page, blocks: list[Block]) -> list[str]:
    blocks = _without_teasers(page, blocks)
    picked = content_paths(blocks)
    content = [b.path in picked for b in blocks]
    # of each box: the outermost article or main it is in, and how many content blocks are in it (boxes come after those around them)
    explicit, below = [-1], [0] * len(page.boxes)
    for k, (name, around) in enumerate(page.boxes[1:], 1):
        explicit.append(explicit[around] if explicit[around] >= 0 else k if name in ("article", "main") else -1)
    for b, is_content in zip(blocks, content):
        below[b.box] += is_content
    for k in range(len(below) - 1, 0, -1):
        below[page.boxes[k][1]] += below[k]
    tops = {explicit[b.box] for b, is_content in zip(blocks, content) if is_content and explicit[b.box] >= 0}
    top = blocks[content.index(True)].box
    while below[top] < sum(content):
        top = page.boxes[top][1]
    inside, title = [top == 0], [False]
    for k, (_, around) in enumerate(page.boxes[1:], 1):
        inside.append(inside[around] or k == top)
    for p in range(1, len(page.names)):
        title.append(title[page.above[p]] or page.names[p] == "h1")
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    if tops:
        among = lambda k, b: content[k] or title[b.path] or b.linked < LINKED or first < k < last
        return [b.text for k, b in enumerate(blocks) if explicit[b.box] in tops and among(k, b)]
    among = lambda k, b: inside[b.box] and b.linked < LINKED and (first < k < last or below[b.box] > 0)
    return [b.text for k, b in enumerate(blocks) if content[k] or title[b.path] or among(k, b)]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    blocks = _unmarked(page, _blocks(page))
    return "\n".join(_article(page, blocks)) if blocks else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, the columns in keep, text and n_chars."""
    rows = pages.select(F.col(html_col).cast("string").alias("_html"), F.col(id_col).alias("page_id"), *keep)

    def run(batches):
        for b in batches:
            out = [main_text(h.as_py()) for h in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*b.schema.names[1:], "text", "n_chars"])

    return rows.mapInArrow(run, rows.drop("_html").schema.add("text", "string").add("n_chars", "long"))
