"""Main text of web pages by tag-path ratios.

A tolerant reader turns a page into blocks, each with the path of tags from the root to
it. Text length and punctuation are summed per path and divided by the blocks of that
path; both ratios are smoothed over neighbouring blocks in page order and fused, and
paths above the threshold are content. Elements whose class or id names what they are
(an advert, comments, ...) weigh less in the fusion; what HTML itself sets apart (nav,
footer, form, ...) is no block at all.

The page's only article with a heading and prose is the content's container, whatever
stands beside it; else the chosen blocks give it: the <article> or <main> that holds most of
them, or the element that holds all. What the article has besides them, such as headings and
one-word paragraphs, is added from the container. Units that repeat without headings after
other prose (replies) weigh as little as labelled ones, and a form that holds most of the
page is no form.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by the way they are laid out and used.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i img ins kbd label map mark math q rp rt ruby s samp small
    span strike strong sub sup time tt u var video wbr""".split()
)
RAW = frozenset("script style noscript template svg iframe object textarea select title xmp noframes".split())
NEVER = frozenset("nav footer aside button dialog menu head fieldset datalist audio video canvas map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be one of many alike, such as replies.
UNITS = frozenset("div section li article dd tr".split())
#: An open element that a start tag of the same group ends, up to the given container.
ENDS = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HOLDERS = frozenset("article main section div td body html center".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words by which pages call what isn't the article, and words that go with them.
LABELS = frozenset(
    """ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments commentlist
    disqus respond reply replies nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices
    notification popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended
    recommendations trending widget widgets pagination pager toolbar copyright disclaimer alert skip outbrain taboola""".split()
)
LAYOUT = frozenset(
    """area bar block bottom box btn button buttons container content custom footer form global group header icons inner item items left link links list main page
    panel posts primary right row secondary section site slot thread top unit wrap wrapper""".split()
)

#: Words for the head of a page that an article's head may have too.
HEADS = frozenset("header masthead banner".split())

ATTRIBUTES = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CLASS = re.compile(r"(?<![-\w])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Weights of the Gaussian that smooths a block's ratios with its neighbours', and what
#: a neighbour of another path has of its weight.
SMOOTHING = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)
OTHER_PATH = 0.25
#: Characters and punctuation marks of a block that count; beyond, it is simply long.
LONG_TEXT, LONG_MARKS = 400, 20
#: Share of the mean fused ratio, by characters, that content has at least.
THRESHOLD = 0.3
#: Weight of a labelled path in the fusion.
LABELLED = 0.05
#: Share of the content's characters in an article that makes it the container.
HELD = 0.8
#: Share of the page's characters from which a form is the page itself.
WIDE_FORM = 0.5
#: Siblings alike, without headings, from which they are replies to what stands before them.
ALIKE = 3
#: Blocks, such as a byline, that may stand between a title and the text.
BYLINES = 3
#: Characters from which a block with punctuation is prose.
PROSE = 60
#: Share of its characters in links from which a block is a list of links.
LINKED = 0.9


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int  # number of the path of block elements down to it
    block: int  # the innermost block element: itself or one above
    labelled: bool
    never: bool
    in_article: bool
    form: int = 0  # the outermost form it lies in
    like: str = ""  # tag and class


@dataclass(slots=True)
class Block:
    element: int
    path: int
    labelled: bool
    in_article: bool
    form: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def is_links(self) -> bool:
        return self.linked >= LINKED * len(self.text)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page in one pass: kind is `text`, `start` or `end`; rest is
    the text or the attributes. Comments, declarations and raw elements are left out."""
    at, size = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}  # nothing is looked for where it can't be
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "text", "", page[at:lt]
        if lt >= size:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1 if last[">"] > lt else size
            continue
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if name is None or last[">"] < name.end():
            yield "text", "", "<"
            at = lt + 1
            continue
        end = tag_end(page, name.end(), last)
        tag, rest = name[0].lower(), page[name.end() : end]
        at = end + 1
        if tag in RAW and not closing:
            if not rest.endswith("/") or tag not in ("svg", "math"):
                found = END_OF[tag].search(page, at)
                at = found.end() if found else size
            continue
        yield "end" if closing else "start", tag, rest


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the `>` that ends a tag; one in quotes doesn't, unless no other follows."""
    first = end = page.find(">", at)
    while True:
        quotes = [q for c in "\"'" if 0 <= (q := page.find(c, at, end)) < last[c]]
        if not quotes:
            return end
        quote = min(quotes)
        at = page.find(page[quote], quote + 1) + 1
        if at > end:
            if last[">"] < at:
                return first
            end = page.find(">", at)


def names_boilerplate(value: str, without: frozenset[str] = frozenset()) -> bool:
    """Whether a class or id consists of words for what isn't the article, and layout words."""
    for name in value.split():
        found = {w.lower() for w in WORDS.findall(name)}
        if (found & LABELS) - without and all(w in LABELS or w in LAYOUT or w.isdigit() for w in found):
            return True
    return False


def judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(never, labelled): whether HTML sets an element apart, and whether its name does."""
    labelled = False
    for m in ATTRIBUTES.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)) or (name == "role" and value.lower() in ROLES):
            return tag not in ("html", "body"), False
        # inside an article a class doesn't make a heading or paragraph something else, and a header holds its title
        plain = tag in INLINE or tag in ("html", "body", "main") or (in_article and (tag in HEADINGS or tag == "p"))
        if name in ("class", "id") and not plain:
            labelled = labelled or names_boilerplate(value, HEADS if in_article else frozenset())
    return tag in NEVER or (tag == "header" and not in_article), labelled


def read_blocks(page: str) -> tuple[list[Block], list[Element], list[str]]:
    """Blocks of a page in order, its elements (parents first), and its paths by number."""
    elements = [Element("#", -1, 0, 0, False, False, False)]
    stack, open_ = [0], Counter()
    paths, texts = {(-1, "#", False): 0}, ["#"]
    found: list[Block] = []
    block: Block | None = None

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            open_[elements[stack.pop()].tag] -= 1

    for kind, tag, rest in tokens(page):
        top = elements[stack[-1]]
        if kind == "text":
            if top.never or (block is None and rest.isspace()):
                continue
            if block is None:
                block = Block(top.block, top.path, elements[top.block].labelled, top.in_article, top.form)
                found.append(block)
            rest = html.unescape(rest) if "&" in rest else rest
            block.parts.append(rest)
            block.linked += len(rest.strip()) if open_["a"] else 0
            continue
        if tag == "br" and block is not None:
            block.parts.append(" ")
        inline = tag in INLINE or open_["math"] > 0
        if not inline:
            block = None
        if tag in VOID:
            continue
        if kind == "end":
            if open_[tag]:
                while elements[stack[-1]].tag != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            continue
        if not inline and open_["p"] and tag not in ENDS:
            _end(stack, elements, "p", close)
        if tag in ENDS and open_[tag]:
            _end(stack, elements, tag, close)
        if rest.endswith("/") and (tag not in INLINE or tag == "math") and tag not in HOLDERS:
            continue
        parent = elements[stack[-1]]
        number = len(elements)
        never, labelled = (True, False) if parent.never else judged(tag, rest, parent.in_article)
        path, inner = parent.path, parent.block
        if not inline:
            labelled = labelled or elements[inner].labelled
            key, inner = (path, tag, labelled), number
            path = paths.setdefault(key, len(paths))
            if path == len(texts):
                texts.append(tag)
        elements.append(Element(tag, stack[-1], path, inner, labelled, never, parent.in_article or tag in ("article", "main"), parent.form or number * (tag == "form"), f"{tag} {m[1] or m[2] or m[3]}" if (m := CLASS.search(rest)) else tag))
        stack.append(number)
        open_[tag] += 1
    for b in found:
        b.text = " ".join("".join(b.parts).split())
        b.parts = []
    return without_forms([b for b in found if b.text]), elements, texts


def without_forms(blocks: list[Block]) -> list[Block]:
    """Blocks outside forms; a form that holds most of the page is the page."""
    sizes = Counter()
    for b in blocks:
        sizes[b.form] += len(b.text)
    return [b for b in blocks if not b.form or sizes[b.form] >= WIDE_FORM * sizes.total()]


def is_prose(b: Block) -> bool:
    return len(b.text) - b.linked >= PROSE and PUNCTUATION.search(b.text) is not None


def mark_replies(blocks: list[Block], elements: list[Element], paths: list[str]) -> None:
    """Label units that repeat: siblings of one tag and class, none with a heading, after prose of another place.

    A list of sections has headings, and the paragraphs of a story aren't units.
    """
    headed, filled = [False] * len(elements), [False] * len(elements)
    for b in blocks:
        filled[b.element] = True
        headed[b.element] |= paths[b.path] in HEADINGS
    for e in range(len(elements) - 1, 0, -1):
        filled[elements[e].parent] |= filled[e]
        headed[elements[e].parent] |= headed[e]
    groups: dict[tuple[int, str], list[int]] = {}
    for e, x in enumerate(elements):
        if e and filled[e] and x.tag in UNITS:
            groups.setdefault((x.parent, x.like), []).append(e)
    of = [0] * len(elements)  # the outermost group of units an element lies in
    for (parent, _), members in groups.items():
        if len(members) >= ALIKE and not any(headed[e] for e in members):
            for e in members:
                of[e] = parent or -1
    for e in range(1, len(elements)):
        of[e] = of[elements[e].parent] or of[e]
    before = False
    for b in blocks:
        if of[b.element]:
            b.labelled = b.labelled or before
        else:
            before = before or (is_prose(b) and not b.labelled)


def _end(stack: list[int], elements: list[Element], tag: str, close) -> None:
    for at in range(len(stack) - 1, 0, -1):
        name = elements[stack[at]].tag
        if name == tag:
            return close(at)
        if name in ENDS[tag] or (not ENDS[tag] and (name in HOLDERS or name in ("li", "blockquote"))):
            return None


def fused_ratios(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed text and punctuation ratios of the blocks' tag paths, fused; and the path of each block."""
    _, of = np.unique([2 * b.path + b.labelled for b in blocks], return_inverse=True)
    nodes, places = np.bincount(of), np.arange(len(of))
    ratios = []
    for values in ([min(LONG_TEXT, max(0, len(b.text) - b.linked)) for b in blocks], [min(LONG_MARKS, len(PUNCTUATION.findall(b.text))) for b in blocks]):
        ratio = (np.bincount(of, values) / nodes)[of]
        weights = sums = np.zeros(len(of))
        for k, weight in enumerate(SMOOTHING):
            near = np.clip(places + k - len(SMOOTHING) // 2, 0, len(of) - 1)
            w = np.where(of[near] == of, weight, weight * OTHER_PATH)
            weights, sums = weights + w, sums + w * ratio[near]
        ratios.append(sums / weights)
    return np.sqrt(ratios[0] * ratios[1]) * label_weights(blocks), of


def label_weights(blocks: list[Block]) -> np.ndarray:
    return np.where([b.labelled for b in blocks], LABELLED, 1.0)


def chosen_blocks(blocks: list[Block]) -> np.ndarray:
    """Whether each block is content: those of the paths whose mean fused ratio is high enough.

    The threshold is a share of the mean over unlabelled text, so that much labelled text
    doesn't lower it.
    """
    fused, of = fused_ratios(blocks)
    mean = np.bincount(of, fused) / np.bincount(of)
    sizes = np.array([len(b.text) * (not b.labelled) for b in blocks])
    if not sizes.any():
        sizes = np.array([len(b.text) for b in blocks])
    return (mean >= min(mean.max(), THRESHOLD * np.average(fused, weights=sizes)))[of]


def headed_article(blocks: list[Block], elements: list[Element], paths: list[str]) -> int | None:
    """The page's only unlabelled <article> with a heading and prose in it, if there is just one; articles inside it are its parts."""
    top = [0] * len(elements)  # the outermost such article, parents come first
    for e, x in enumerate(elements):
        if e:
            top[e] = top[x.parent] or e * (x.tag == "article" and not x.labelled)
    headed, prose = set(), set()
    for b in blocks:
        at = top[b.element]
        if at:
            (headed if paths[b.path] in HEADINGS else prose if is_prose(b) and not b.labelled else set()).add(at)
    return prose.pop() if len(prose) == 1 and prose <= headed else None


def container_of(picked: list[Block], elements: list[Element]) -> int:
    """The article that holds most of the picked characters, else the holder of all of them."""
    inside = np.zeros(len(elements), np.int64)
    for b in picked:
        inside[b.element] += len(b.text)
    for e in range(len(elements) - 1, 0, -1):  # parents come first
        inside[elements[e].parent] += inside[e]
    total = inside[0]
    articles = [e for e, x in enumerate(elements) if x.tag in ("article", "main") and inside[e] >= HELD * total]
    if articles:
        return max(articles)
    at = int(np.flatnonzero(inside == total)[-1])
    while at and elements[at].tag not in HOLDERS:
        at = elements[at].parent
    return at


def inside_of(container: int, elements: list[Element]) -> np.ndarray:
    """Whether each element is the container or lies in it."""
    within = np.zeros(len(elements), bool)
    within[container] = True
    for e in range(container + 1, len(elements)):
        within[e] = within[elements[e].parent]
    return within


def main_blocks(page: str) -> list[str]:
    """Texts of the article's blocks, in page order."""
    blocks, elements, paths = read_blocks(page)
    # lists of links outside an article aren't looked at by the ratios
    blocks = [b for b in blocks if b.in_article or not b.is_links() or paths[b.path] in ("p", "h1", "h2", "h3")]
    if not blocks:
        return []
    mark_replies(blocks, elements, paths)
    chosen = chosen_blocks(blocks)
    container = headed_article(blocks, elements, paths)
    if container is None:
        container = container_of([b for b, x in zip(blocks, chosen, strict=True) if x], elements)
        within = inside_of(container, elements)
    else:  # longer texts beside it don't replace it
        within = inside_of(container, elements)
        inner = within[[b.element for b in blocks]]
        chosen = chosen & inner if (chosen & inner).any() else inner & np.array([not b.labelled for b in blocks])
    is_article = elements[container].tag in ("article", "main")
    first, last = np.flatnonzero(chosen)[[0, -1]]
    title = max((i for i in range(max(0, first - BYLINES - 1), first) if paths[blocks[i].path] == "h1" or (paths[blocks[i].path] == "h2" and within[blocks[i].element])), default=first)
    out = []
    for i, b in enumerate(blocks):
        # an article is whole; elsewhere what stands between its parts belongs to it, and the headings before
        beside = first <= i <= last or (i < first and all(paths[x.path][0] == "h" for x in blocks[i:first]))
        added = within[b.element] and not b.labelled and (is_article or (paths[b.path] in TEXTUAL and beside))
        # a title with its byline
        added = added or (title <= i < first and not b.labelled and not b.is_links())
        if chosen[i] or added:
            out.append(b.text)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars; blocks are joined by two line feeds.

    Null or empty html and pages without text give an empty text. Character references
    are decoded and white space inside a block becomes one blank; nothing is cut. Rows
    are independent: no shuffle, repeated rows and null ids give a row each, an empty
    table none, extra columns are ignored. Memory: one page's blocks at a time.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(v)) if (v := x.as_py()) else "" for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(extract, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
