"""Main text of web pages by tag-path ratios.

A page is cut into runs of text, one for each block, each with its path of block elements (tags and classes) from the root.
Elements that by the meaning of their tag hold no article text (scripts, forms, nav, aside, footer, a page's header) or are
hidden are left out. For each path the text length and the punctuation of its runs are set against their number; text in
links and short runs lower the length. Both ratios are smoothed along the runs of one container and fused by
multiplication, and so are the text and the punctuation of the container as a whole. A run counts by the mean of its path's
and its container's value, and is content if that reaches a share of the page's mean: a short run among content passes by
its container, an advert, notice or comment in a container of its own does not. A heading counts as what it heads. Paths through an article
or main element weigh a little more. No list of class or id names is used, and an article outputs nothing that its ratios
reject. Content of an article inside an article is a reader's comment if the outer one has content of its own.

Defined results: a null or empty page, or one without text, gives an empty text; unclosed and misnested tags are
tolerated; a page whose text stands in forms alone is read as if they were plain containers; pages are read whole and
independently, in time and memory in proportion to their length, so repeated rows give repeated results; an empty table
gives an empty one; all other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>|.*\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp".split())
#: Elements whose tag says that they hold no article text, and those that end a block.
OUT = frozenset("head script style title noscript template iframe object svg canvas nav aside footer button select textarea dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body br center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is judged as a whole beside its paths.
CONTAINER = frozenset("article main section div body form blockquote details fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weight of the text length of paths through an article or main element, and of short runs (under SHORT characters).
IN_ARTICLE, IN_SHORT, SHORT = 2.0, 0.5, 15
#: Power of the ratios, which keeps one very long paragraph from outweighing the others.
POWER = 0.7
#: Weights of a run's path and of its container; what a container with text of its own counts for the ones inside it.
OWN, INSIDE = (0.5, 0.5), 0.8
#: Share of the mean of the page's text that a content run reaches.
SHARE = 0.55
#: Gaussian weights of a run itself, the next and the second next ones.
KERNEL = np.exp(-0.5 * np.arange(3) ** 2)
CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'>]*)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Which open elements a start tag closes: the innermost of the first names, unless one of the second stands inside it.
CLOSED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSED_BY = {name: (tuple(a.split()), tuple(b.split())) for name, (a, b) in CLOSED_BY.items()}


def hidden(rest: str) -> bool:
    """Whether an element with these attributes is not shown."""
    if "hidden" not in rest and "none" not in rest:
        return False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Element(NamedTuple):
    """An open element: its path, whether its text is left out, the container it is in, the outermost article, whether it is in
    a link or in an article inside an article."""

    name: str = ""
    path: int = 0
    out: bool = False
    container: int = 0
    article: int = 0
    link: bool = False
    comment: bool = False


class Node(NamedTuple):
    """A text node, its block and the element it stands in."""

    text: str
    block: int
    of: Element


class Page:
    """Text nodes of a page in order. Paths and containers are numbered."""

    def __init__(self, page: str, forms: bool = False):
        self.nodes: list[Node] = []
        self.paths: dict[tuple[int, str, str], int] = {}
        self.path_articles = [False]  # whether the path goes through an article or main element
        self.container_in = [0]  # the container around each
        self.bodies, self.articles = {0}, set()  # those that are the page itself, and that are said to be its content
        self.forms = forms
        self.stack, self.open = [Element()], defaultdict(list)  # open: places in the stack by name
        self.blocks: list[int] = []  # places of block elements
        self._read(page)

    def inside(self, container: int, other: int) -> bool:
        while container > other:
            container = self.container_in[container]
        return container == other

    def _read(self, page: str) -> None:
        at, end, block = 0, len(page), 0
        while at < end:
            tag = TAG.search(page, at)
            stop = tag.start() if tag else end
            if stop > at and not self.stack[-1].out:
                self.nodes.append(Node(html.unescape(page[at:stop]), block, self.stack[-1]))
            if not tag:
                break
            at, name = tag.end(), (tag[2] or "").lower()
            if not name:
                continue
            block += name in BLOCK
            if tag[1]:
                if self.open[name]:
                    self._close(self.open[name][-1])
            elif name in RAW:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            elif name not in VOID:
                self._open(name, tag[3] or "")

    def _close(self, place: int) -> None:
        while len(self.stack) > place:
            name = self.stack.pop().name
            self.open[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def _open(self, name: str, rest: str) -> None:
        if name in BLOCK and self.blocks and self.stack[self.blocks[-1]].name == "p":  # a paragraph ends where a block begins
            self._close(self.blocks[-1])
        if name in CLOSED_BY:
            ends, limits = CLOSED_BY[name]
            place, limit = (max((self.open[n][-1] for n in names if self.open[n]), default=-1) for names in (ends, limits))
            if place > limit:
                self._close(place)
        _, path, out, container, article, link, comment = self.stack[-1]
        if name in BLOCK:
            around, kind = path, CLASS.search(rest)
            path = self.paths.setdefault((around, name, kind[1] if kind else ""), len(self.path_articles))
            if path == len(self.path_articles):
                self.path_articles.append(self.path_articles[around] or name in ("article", "main"))
        out = out or name in OUT or name == "form" and not self.forms or name == "header" and not article or hidden(rest)
        if name in CONTAINER:
            self.container_in.append(container)
            container = len(self.container_in) - 1
            if name == "body":
                self.bodies.add(container)
            elif name in ("article", "main"):
                self.articles.add(container)
        comment = comment or name == "article" and bool(self.open["article"])
        if name in ("article", "main") and not article:
            article = container
        self.open[name].append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(Element(name, path, out, container, article, link or name == "a", comment))


def _fused(n: np.ndarray, length: np.ndarray, marks: np.ndarray, links: np.ndarray, short: np.ndarray, per_run: bool) -> np.ndarray:
    """(text length, punctuation) of groups of ``n`` runs, to the power POWER: punctuation for each run, and the length ``per_run``
    or as a whole."""
    n = np.maximum(n, 1)
    plain = 1 - links / np.maximum(length, 1)
    size = (length / n if per_run else length) * plain * plain * (1 - (1 - IN_SHORT) * short / n)
    return np.stack((size, 1 + marks / n)) ** POWER


def content_values(paths: np.ndarray, containers: np.ndarray, lengths: np.ndarray, marks: np.ndarray, links: np.ndarray, weights: np.ndarray, around: list[int], pages: set[int]) -> np.ndarray:
    """The value of each run: the mean of its path's fused ratios, smoothed along the runs of its container and of those inside, and
    those of the container, both relative to the mean of the page's text (by length, so that many short runs do not lower it).

    ``weights``: of each run's path; ``around``: the container around each; ``pages``: containers that are the page itself or wrap
    parts of it, and so say nothing of those inside.
    """
    of = np.unique(paths, return_inverse=True)[1]
    ratios = _fused(*[np.bincount(of, x) for x in (np.ones(len(of)), lengths, marks, links, lengths < SHORT)], per_run=True)[:, of]
    ratios[0] *= weights**POWER
    total, weight = KERNEL[0] * ratios, np.full(len(of), KERNEL[0])
    last = np.arange(len(around))  # the last container inside each; one is numbered after the one around it
    for c in range(len(around) - 1, 0, -1):
        last[around[c]] = max(last[around[c]], last[c])
    for step in (1, 2):
        for here, there in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            inside = (containers[there] >= containers[here]) & (containers[there] <= last[containers[here]])
            total[:, here] += KERNEL[step] * inside * ratios[:, there]
            weight[here] += KERNEL[step] * inside
    own = np.prod(total / weight, axis=0)

    sums = np.stack([np.bincount(containers, x, len(around)) for x in (np.ones(len(of)), lengths, marks, links, lengths < SHORT)])
    for c in range(len(around) - 1, 0, -1):
        sums[:, around[c]] += sums[:, c]
    whole = np.prod(_fused(*sums, per_run=False), axis=0)
    for c in range(1, len(around)):
        if around[c] not in pages:
            whole[c] = max(whole[c], INSIDE * whole[around[c]])
    whole = whole[containers] * weights**POWER
    return sum(OWN[i] * x / max(np.average(x, weights=lengths), 1e-9) for i, x in enumerate((own, whole)))


def main_text(source: str | None, share: float = SHARE) -> str:
    page = Page(source or "")
    if not any(x.text and not x.text.isspace() for x in page.nodes):
        page = Page(source or "", forms=True)
    runs: dict[int, list[Node]] = {}
    for x in page.nodes:
        runs.setdefault(x.block, []).append(x)
    texts = {b: " ".join("".join([x.text for x in some]).split()) for b, some in runs.items()}
    blocks = [b for b in runs if texts[b]]
    if not blocks:
        return ""
    first = [next(x for x in runs[b] if x.text and not x.text.isspace()).of for b in blocks]
    lengths = np.array([len(texts[b]) for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(texts[b])) for b in blocks], float)
    links = np.array([min(len(texts[b]), sum(len(x.text.strip()) for x in runs[b] if x.of.link)) for b in blocks], float)
    weights = np.where([page.path_articles[e.path] for e in first], IN_ARTICLE, 1)
    wrappers = page.bodies | (set(range(len(page.container_in))) - {e.container for e in first} - page.articles)  # without text of their own
    values = content_values(np.array([e.path for e in first]), np.array([e.container for e in first]), lengths, marks, links, weights, page.container_in, wrappers)
    own_text = {e.article for e, v in zip(first, values) if v >= share and not e.comment}
    values[[e.comment and e.article in own_text for e in first]] = 0
    for i in range(len(first) - 2, -1, -1):  # a heading counts as what it heads
        if first[i].name in HEADING and page.inside(first[i + 1].container, first[i].container):
            values[i] = values[i + 1]
    return " ".join(texts[b] for b, v in zip(blocks, values) if v >= min(share, values.max()))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col``."""
    kept = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html_col, 8 << 20):
                texts = [main_text(p) for p in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text_col])

    return pages.select(*kept, html_col).mapInArrow(run, pages.select(*kept, F.lit("").alias(text_col)).schema)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
