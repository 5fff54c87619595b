"""Main-text extraction by minimum-cut labelling of page blocks.

A page is split into text blocks, each with the path of open elements above
it.  A logistic classifier turns what is known of a block (elements and names
above it, length, links, its own words and those of the heading of its section,
where these are short) into a probability of being content; the logarithms of
the two probabilities are the costs of its labels and the capacities of its
edges to the two terminals.  Neighbouring blocks, and blocks under the same
parent, are joined by smoothness edges that cost something if their labels
differ.  The minimum cut, found as a maximum flow, is the cheapest labelling of
the whole page.

The classifier's weights and the smoothness are learnt from ``train_pages``
made-up pages (``planted``), whose main text is known; no name or element
decides alone.  This bound is a parameter, the fit takes seconds and the same
weights come out each time.

Elements that never hold visible text (script, style, head, template, ...) and
hidden ones are skipped while splitting.  Blocks keep page order, character
references are decoded, white space inside a block becomes one space.  Time is
in proportion to the page: a block whose terminal edge outweighs all its others
has its label at once, which leaves the flow few blocks to decide.

Defined results: null or empty html and pages without content give the empty
text; broken or cut-off markup is read as far as it goes, an unclosed element
ends with the page; rows are kept one for one, null ids and urls as they are,
repeated rows as often as they occur; an empty table gives an empty one; other
columns are ignored, whatever their names.  Pages of any length are read whole.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm import planted

# Element names of the HTML standard.
SKIPPED = set("script style head noscript template svg math iframe object canvas select textarea button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
TELLING = set("nav footer aside form menu dialog fieldset header article main section figure table details".split())
CLOSES_OWN = set("li dt dd tr td th option".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SHORT = re.compile(r"[^\W\d_]+|\u00a9")
_TELLING_WORDS = planted.telling_words()
_LAYOUT = set("has with no is without not".split())


class Node:
    """An open element, with the names and elements above and including it that tell something."""

    __slots__ = ("tag", "up", "skip", "signs", "inner", "owner", "base", "lead", "size")

    def __init__(self, tag: str, attrs: str, up: Node | None, known: frozenset[str] | None):
        self.tag, self.up = tag, up
        self.skip = tag in SKIPPED or bool(up and up.skip)
        self.lead: frozenset[str] | None = None  # the words of its first block, if that is short
        self.size = 0  # blocks so far
        own = {f"<{tag}"} if tag in TELLING else set()
        if attrs and "=" in attrs:
            if tag not in ("html", "body"):
                for a, b, c in _NAMES.findall(attrs):
                    for name in (a or b or c).split():
                        parts = _NAME.findall(_CAMEL.sub(" ", name).lower())
                        own.update(f".{p}" for p in (parts[:1] if parts and parts[0] in _LAYOUT else parts))  # "has-sidebar" tells of a layout
            if _HIDDEN.search(attrs):
                self.skip = True
        elif attrs and _HIDDEN.search(attrs):
            self.skip = True
        if tag == "header" and up and ("<article" in up.signs or "<main" in up.signs):
            own = {"<header in article"}
        if known is not None:
            own &= known
        above = up.signs if up else frozenset()
        self.signs = above | own if own - above else above
        self.inner = frozenset(own) if own else up.inner if up else above  # of the nearest element that has any
        # the nearest element that is no inline one; the same without paragraphs
        self.owner = up.owner if up and tag in INLINE else self
        self.base = up.base if up and (tag in INLINE or tag == "p") else self


class Block:
    __slots__ = ("text", "node", "linked", "lead", "order")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked
        words = text.split(None, 7)
        short = _TELLING_WORDS.intersection(_SHORT.findall(text.lower())) if len(words) <= 6 else frozenset()
        self.lead, n = frozenset(), node
        self.order = node.up.size if node.up else 0
        for _ in range(3):  # headings of the section and of those around it
            if n is None or n.tag in ("body", "html"):
                break
            if n.lead is None:
                n.lead = short
            else:
                self.lead = self.lead | n.lead
            n = n.up
        if node.up:
            node.up.size += 1


def blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The visible text blocks of a page in order; of elements and names only the ``known`` are kept."""
    out: list[Block] = []
    node = Node("", "", None, known)
    opened: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    linked = anchors = 0
    at, size = 0, len(html)

    def flush(owner: Node) -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, owner, linked))
            parts = []
        linked = 0

    def close(to: Node) -> None:
        """Closes all elements below ``to``."""
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.up

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        m = _TAG.match(html, lt) if lt < size else None
        stop = lt if m or lt == size else lt + 1  # a "<" that starts no tag is text
        if stop > at and not node.skip:
            parts.append(html[at:stop])
            if anchors:
                linked += stop - at
        if lt == size:
            break
        if not m:
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                n = node
                while n.tag != tag:
                    n = n.up
                if tag not in INLINE:
                    flush(node.owner)
                if tag == "a":
                    anchors = max(0, anchors - 1)
                close(n.up)
            elif tag == "p":
                flush(node.owner)
            continue
        if tag == "br":
            if not node.skip:
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush(node.owner)
            if tag in CLOSES_P and node.owner.tag == "p":
                close(node.owner.up)
            elif tag in CLOSES_OWN and node.base.tag == tag:
                close(node.base.up)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "a":
            anchors += 1
        node = Node(tag, m[3], node, known)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else size
    flush(node.owner)
    return out


def signs(found: list[Block]) -> list[set[str]]:
    """What the classifier knows of each block of a page."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        words, density = b.text.count(" ") + 1, b.linked / len(b.text)
        own = set(b.node.signs)
        own.update(f"in {s}" for s in b.node.inner)
        own.add("tag " + (b.node.tag if b.node.tag in ("p", "li", "td", "blockquote", "pre") else "h" if b.node.tag[:1] == "h" and b.node.tag[1:].isdigit() else "other"))
        own.add(f"words {min(5, words.bit_length())}")
        own.add("linked " + ("none" if density == 0 else "some" if density < 0.5 else "most" if density < 0.9 else "all"))
        own.add("sentence" if b.text[-1] in ".!?\u3002\u2026\"\u00bb\u201d" and words > 3 else "no sentence")
        own.add("first" if i == 0 else "last" if i == n - 1 else "second" if i == 1 else "middle")
        own.add(f"in its parent {min(3, b.order)}")
        if words <= 8:
            own.update(f"word {w}" for w in _TELLING_WORDS.intersection(_SHORT.findall(b.text.lower())))
        own.update(f"under {w}" for w in b.lead)
        out.append(own)
    return out


@dataclass
class Costs:
    """Weights of signs and of smoothness edges."""

    weights: dict[str, float]
    bias: float
    near: float = 0.5
    same_parent: float = 0.5
    known: frozenset[str] = field(default_factory=frozenset)

    def logits(self, found: list[Block]) -> list[float]:
        w = self.weights
        return [self.bias + sum(w.get(s, 0.0) for s in own) for own in signs(found)]


def _terminals(logit: float) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    return float(np.logaddexp(0, logit)), float(np.logaddexp(0, -logit))


def _logistic(rows: list[set[str]], y: np.ndarray, least: int = 3, l2: float = 1.0, steps: int = 25) -> tuple[dict[str, float], float]:
    """Weights of signs by Newton's method."""
    count: dict[str, int] = {}
    for r in rows:
        for s in r:
            count[s] = count.get(s, 0) + 1
    names = sorted(s for s, c in count.items() if c >= least)
    at = {s: i for i, s in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [at[s] for s in r if s in at]] = 1
    w, keep = np.zeros(x.shape[1]), np.append(np.full(len(names), l2), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def marks(found: list[Block], kept: list[str]) -> list[bool]:
    """Which blocks of a made-up page are its main text, in order."""
    out, at = [], 0
    for b in found:
        out.append(at < len(kept) and b.text == kept[at])
        at += out[-1]
    return out


@cache
def learnt_costs(train_pages: int = 800, seed: int = 4) -> Costs:
    """Weights from made-up pages, smoothness from a fifth of them held back."""
    made = [(blocks(h), kept) for h, kept in planted.pages(train_pages, seed)]
    made = [(found, marks(found, kept)) for found, kept in made]
    cut = len(made) * 4 // 5
    rows = [s for found, _ in made[:cut] for s in signs(found)]
    weights, bias = _logistic(rows, np.array([k for _, keep in made[:cut] for k in keep], float))
    known = frozenset(s.removeprefix("in ") for s in weights if s.removeprefix("in ")[0] in "<.")
    best = None
    for near in (0.0, 0.25, 0.5, 1.0):
        for same in (0.0, 0.25, 0.5, 1.0):
            costs = Costs(weights, bias, near, same, known)
            wrong = sum(a != b for found, keep in made[cut:] for a, b in zip(label(found, costs), keep, strict=True))
            if best is None or wrong < best[0]:
                best = wrong, costs
    return best[1]


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels by maximum flow: True where a node stays on the source side."""
    n = len(source)
    rest = [a - b for a, b in zip(source, sink, strict=True)]  # flow straight through a node is sent first
    to: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        if c > 0 and u != v:
            to[u][v] = to[u].get(v, 0.0) + c
            to[v][u] = to[v].get(u, 0.0) + c
    # a terminal edge that outweighs all others of its node is never cut: the node joins that terminal
    label: list[bool | None] = [None] * n
    around = [sum(t.values()) for t in to]
    ready = deque(range(n))
    while ready:
        u = ready.popleft()
        if label[u] is None and abs(rest[u]) > around[u] + 1e-12 or label[u] is None and not to[u]:
            label[u] = rest[u] > 0
            for v, c in to[u].items():
                del to[v][u]
                around[v] = sum(to[v].values()) if len(to[v]) < 8 else around[v] - c
                rest[v] += c if label[u] else -c
                ready.append(v)
            to[u] = {}
    free = [u for u in range(n) if label[u] is None]
    _saturate(free, rest, to)
    seen, queue = set(), deque(u for u in free if rest[u] > 1e-9)
    seen.update(queue)
    while queue:
        for v, c in to[queue.popleft()].items():
            if c > 1e-9 and v not in seen:
                seen.add(v)
                queue.append(v)
    return [u in seen if x is None else x for u, x in enumerate(label)]


def _saturate(free: list[int], rest: list[float], to: list[dict[int, float]]) -> None:
    """Sends all the flow there is from nodes with rest > 0 to those with rest < 0, in phases of equal distance."""
    eps = 1e-9
    while True:
        level = {u: 0 for u in free if rest[u] > eps}
        queue, reached = deque(level), False
        while queue:
            u = queue.popleft()
            if rest[u] < -eps:
                reached = True
                continue
            for v, c in to[u].items():
                if c > eps and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not reached:
            return
        left = {u: iter(list(to[u])) for u in level}
        for start in [u for u, d in level.items() if d == 0]:
            path = [start]
            while path and rest[start] > eps:
                u = path[-1]
                if rest[u] < -eps:
                    flow = min(rest[start], -rest[u], *(to[a][b] for a, b in zip(path, path[1:], strict=False)))
                    rest[start] -= flow
                    rest[u] += flow
                    full = len(path) - 1
                    for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        to[a][b] -= flow
                        to[b][a] = to[b].get(a, 0.0) + flow
                        if to[a][b] <= eps:
                            full = min(full, i)
                    del path[full + 1 :]
                    continue
                for v in left[u]:
                    if to[u].get(v, 0.0) > eps and level.get(v) == level[u] + 1:
                        path.append(v)
                        break
                else:
                    path.pop()


def label(found: list[Block], costs: Costs) -> list[bool]:
    """Which blocks of a page are content."""
    terminals = [_terminals(x) for x in costs.logits(found)]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, costs.near))
        up = id(b.node.up)
        if up in last:
            edges.append((last[up], i, costs.same_parent))
        last[up] = i
    return min_cut([c for c, _ in terminals], [b for _, b in terminals], edges)


def extract(html: str, costs: Costs | None = None) -> str:
    """The main text of one page."""
    costs = costs or learnt_costs()
    found = blocks(html, costs.known)
    return "\n".join(b.text for b, k in zip(found, label(found, costs), strict=True) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = 800) -> DataFrame:
    """(page_id, url, text) for each row of ``pages``."""
    costs = learnt_costs(train_pages)  # some hundred weights, whatever the table

    def run(batches):
        for b in batches:
            texts = [extract(h, costs) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string")
