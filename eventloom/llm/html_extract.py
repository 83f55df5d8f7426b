"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at its block-level tags.  A classifier gives each
block a probability of being content; its costs are the capacities between the block
and the two terminals.  Neighbouring blocks, and next blocks under one parent, are
joined by smoothness edges, weaker the further apart they are in the tree.  The
minimum cut, found by maximum flow, separates content from boilerplate.  The
classifier is a logistic regression trained on weakly labelled blocks of a sample of
pages: those that the page's own sectioning tags or class names tell apart.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages in the training sample, and different blocks of each label learned from.
SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 50_000
#: Capacities of the smoothness edges: neighbours in the page, and next blocks under one parent.
NEAR, SIBLING = 0.6, 0.4
#: Log odds are cut here, so that no block outweighs every neighbour.
MOST = 8.0

# Tags of HTML.
_TAG = re.compile(r"</?([a-z][^\s/>]*)", re.I)
#: What a tag has up to its end or to a quotation mark that opens a value.
_PLAIN = re.compile(r"""[^>"']*""")
_RAW = frozenset("script style template noscript iframe object svg math textarea select title".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption".split())
_DROPPED = frozenset("script style template noscript iframe object svg math textarea select title head button".split())
_BAD_TAG = frozenset("nav header footer aside form dialog menu".split())
_GOOD_TAG = frozenset("article main".split())
_BAD_WORD = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus foot footer form hidden login "
    "masthead menu modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup privacy promo promoted promotion related recommended register reply "
    "replies respond rss share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar top topbar widget widgets header complementary contentinfo".split()
)
_GOOD_WORD = frozenset("article content entry main post story text body".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

FEATURES = ("one", "bad_tag", "good_tag", "bad_word", "good_word", "links", "length", "words", "ends", "heading", "item", "depth", "early", "late", "long")


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """``(tag, token)`` of each start and end tag, and ``("", text)`` of what stands between.

    Comments, declarations and elements without readable text are passed over.  A ``>``
    inside quotation marks does not end a tag.  Where a mark is never closed, tags end at
    the next ``>`` from there on, so a page is read in time proportional to its length.
    """
    at, size, last_end = 0, len(page), page.rfind(">")
    quoted = True

    def end_of(i: int) -> int:
        """Where the tag that goes on at ``i`` ends, exclusive; -1 if nowhere."""
        nonlocal quoted
        j = i
        while quoted:
            j = _PLAIN.match(page, j).end()
            if j >= size:
                quoted = False
            elif page[j] == ">":
                return j + 1
            else:
                j = page.find(page[j], j + 1) + 1
                quoted = j > 0
        return page.find(">", i) + 1 or -1

    while at < size:
        begin = page.find("<", at)
        if begin != at:
            yield "", page[at : begin if begin >= 0 else size]
            if begin < 0:
                return
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            if at < 3:
                return
            continue
        found = _TAG.match(page, begin)
        if begin > last_end or (not found and page[begin + 1 : begin + 2] not in ("!", "?")):
            yield "", "<"
            at = begin + 1
            continue
        if not found:
            at = page.find(">", begin) + 1
            continue
        end = end_of(found.end())
        tag, token = found[1].lower(), page[begin:end]
        if tag in _RAW and token[1] != "/" and not (tag in ("svg", "math") and token.endswith("/>")):
            closed = _RAW_END[tag].search(page, end)
            at = closed.end() if closed else size
            continue
        yield tag, token
        at = end


class _Open:
    """The open elements: (tag, number, bad tags, good tags, bad words, good words), counted with all above."""

    def __init__(self):
        self.stack: list[tuple] = [("", 0, 0, 0, 0, 0)]
        #: Where each tag and where block elements stand in the stack.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places.setdefault(element[0], []).append(at)
        if element[0] in _BLOCK:
            self.blocks.append(at)

    def cut(self, at: int) -> int:
        """Close everything from ``at`` on; returns how many of it hide their text."""
        hidden = 0
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
            hidden += tag in _DROPPED
        return hidden

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def holder(self) -> int:
        """The innermost block element, 0 if there is none."""
        return self.blocks[-1] if self.blocks else 0


# Elements that end where one of these begins.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def blocks(page: str) -> list[tuple]:
    """Blocks as (text, parent, depth, in bad tag, in good tag, bad words, good words, link characters, tag)."""
    out: list[tuple] = []
    opened = _Open()
    stack = opened.stack
    texts: list[str] = []
    linked, in_link, number, dropped = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = _SPACE.sub(" ", html.unescape("".join(texts))).strip()
            if text:
                at = opened.holder()
                top = stack[-1]
                out.append((text, stack[at - 1][1] if at else 0, at, top[2], top[3], top[4], top[5], linked, stack[at][0]))
            texts.clear()
        linked = 0

    for tag, token in tokens(page):
        if not tag:
            if not dropped:
                texts.append(token)
                if in_link:
                    linked += len(token.strip())
            continue
        if token[1] == "/":
            if tag == "a":
                in_link = 0
            if tag in _BLOCK:
                flush()
            at = opened.last(tag)
            # An inline tag does not close the blocks inside it.
            if at and (tag in _BLOCK or opened.holder() < at):
                dropped -= opened.cut(at)
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            in_link = 0
            if tag == "body":
                dropped = 0
                opened.cut(max(1, opened.last("html") + 1))
            # End tags that may be left out.
            if tag in _CLOSES_P and (at := opened.last("p")) and opened.holder() == at:
                opened.cut(at)
            ends = _ENDS.get(tag)
            while ends and stack[-1][0] in ends:
                opened.cut(len(stack) - 1)
        if tag in _VOID or token.endswith("/>"):
            continue
        number += 1
        _, _, bad, good, bad_word, good_word = stack[-1]
        bad += tag in _BAD_TAG
        good += tag in _GOOD_TAG
        if len(token) > len(tag) + 2:
            for a in _ATTRIBUTE.finditer(token, len(tag) + 1):
                name, value = a[1].lower(), (a[2] or "").lower()
                if name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and "none" in value and "display" in value):
                    bad_word += 1
                elif name in ("class", "id", "role"):
                    said = set(_WORD.findall(value))
                    bad_word += bool(said & _BAD_WORD) and tag not in ("html", "body")
                    good_word += bool(said & _GOOD_WORD) and tag not in ("html", "body")
        opened.push((tag, number, bad, good, bad_word, good_word))
        if tag in _DROPPED:
            dropped += 1
        if tag == "a":
            in_link = 1
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    n = len(found)
    out = np.empty((n, len(FEATURES)))
    for i, (text, _, depth, bad, good, bad_word, good_word, linked, tag) in enumerate(found):
        size = len(text)
        out[i] = (1, bad > 0, good > 0, bad_word > 0, good_word > 0, min(1.0, linked / size), log(1 + size) / 5, log(1 + text.count(" ")) / 4, text[-1] in ".!?…。\"”", tag in ("h1", "h2", "h3", "h4"), tag == "li" and 2 * linked > size, min(depth, 12) / 12, n > 4 and i < 2, n > 4 and i >= n - 2, size > 120)
    return out


def weak_labels(found: list[tuple]) -> np.ndarray:
    """1 content, 0 boilerplate, -1 unknown."""
    return np.array([0 if bad or bad_word else 1 if good or good_word else -1 for _, _, _, bad, good, bad_word, good_word, *_ in found])


def regression(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; row i counts ``times[i]`` times, and classes weigh the same."""
    w = np.zeros(x.shape[1])
    if len(y) == 0:
        return w
    weight = times * np.where(y == 1, 0.5 / max(1, times[y == 1].sum()), 0.5 / max(1, times[y == 0].sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w / 10
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge / 10 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def weights_of(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Trained weights, halfway to the prior.

    Each block is learned from a second time without its section's tags and names,
    so that its text counts on pages that have none.
    """
    bare = x.copy()
    bare[:, 1:5] = 0
    bare[:, FEATURES.index("early") : FEATURES.index("late") + 1] = 0
    learned = regression(np.concatenate((x, bare)), np.concatenate((y, y)), np.concatenate((times, times)))
    return 0.5 * np.array([PRIOR[k] for k in FEATURES]) + 0.5 * learned


#: What the sample cannot teach when none of its pages has sectioning tags: long, unlinked, punctuated blocks are content.
PRIOR = dict(zip(FEATURES, (-0.6, -5.0, 3.0, -5.0, 1.0, -3.0, 0.8, 0.3, 0.6, 0.5, -0.4, 0.0, 0.0, 0.0, 0.5), strict=True))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of the cut; ``odds`` are net capacities to the content terminal."""
    n = len(odds)
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]
    source, sink = n, n + 1

    def edge(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        at[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(odds):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in at[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        use = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:  # augmenting paths of this level graph, without recursion
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            moved = False
            while use[v] < len(at[v]):
                e = at[v][use[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    moved = True
                    break
                use[v] += 1
            if not moved:
                if not path:
                    break
                e = path.pop()
                v = to[e ^ 1]
                use[v] += 1


def main_blocks(found: list[tuple], weights: np.ndarray, near: float = NEAR, sibling: float = SIBLING) -> list[str]:
    if not found:
        return []
    odds = np.clip(features(found) @ weights, -MOST, MOST).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            apart = abs(b[2] - found[i - 1][2]) + (b[1] != found[i - 1][1])
            edges.append((i - 1, i, near / (1 + apart)))
        if b[1] in last and last[b[1]] != i - 1:
            edges.append((last[b[1]], i, sibling))
        last[b[1]] = i
    return [b[0] for b, content in zip(found, minimum_cut(odds, edges), strict=True) if content]


def fit(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Classifier weights from a bounded sample: ``sample_pages`` pages, those with the least hash of page_id.

    Equal blocks are learned from once, weighted by how often they occur; of different ones
    ``SAMPLE_BLOCKS`` with each label, in the order of their hash.
    """
    ids = [r.page_id for r in pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()]
    prior = np.array([PRIOR[k] for k in FEATURES])
    if not ids:
        return prior

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch["html"].to_pylist():
                found = blocks(page or "")
                if found:
                    y = weak_labels(found)
                    yield pa.RecordBatch.from_arrays([pa.array(y[y >= 0], pa.int64()), pa.array(list(features(found)[y >= 0]), pa.list_(pa.float64()))], names=["y", "x"])

    seen = pages.where(F.col("page_id").isin(ids)).select("html").mapInArrow(label, "y long, x array<double>").groupBy("y", "x").count()
    some = [r for y in (0, 1) for r in seen.where(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(SAMPLE_BLOCKS).collect()]
    y = np.array([r.y for r in some])
    if len(set(y.tolist())) < 2:
        return prior
    return weights_of(np.array([r.x for r in some]), y, np.array([float(r["count"]) for r in some]))


def extract(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES, near: float = NEAR, sibling: float = SIBLING) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    The whole html is read; character references are decoded, white space inside a
    block becomes one space, blocks are trimmed and joined in page order by two line feeds.
    Null, empty and textless pages give an empty text; repeated rows and null ids stay; an empty table
    gives an empty result.  Pages of any length and depth are read in time proportional to
    their length.
    """
    weights = fit(pages, sample_pages=sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = ["\n\n".join(main_blocks(blocks(page or ""), weights, near, sibling)) for page in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
