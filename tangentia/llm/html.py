"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Nodes are the block-level elements of the page and the runs of text inside
them.  Every node is content or not; a node's features give its potential, and
an element and each of its children share a potential of their four joint
states.  As the graph is a tree, one sum-product pass upward and one downward
give exact marginals, and the runs of text whose marginal is above one half are
the main text.  All potentials are trained together by the gradient of the
conditional likelihood, which needs nothing but the same marginals, on labelled
pages that :mod:`tangentia.llm.html_pages` lays out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold text of the page.
DROPPED = frozenset(
    "script style noscript template head title svg math iframe object embed canvas audio video select option "
    "optgroup datalist button textarea input map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
#: Elements that can stand in a head; any other start tag, and text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: Elements within a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q "
    "ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr picture".split()
)
#: Start tags that end an open element of the given names.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Elements that a search for an open element doesn't leave.
SCOPES = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?:(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<odd>[^<>]*)>)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Attributes of a self-closed tag: the slash isn't the end of a value without quotes.
_CLOSED = re.compile(r"""(?:^|[\s"'])[^\s"'=]*/\s*$""")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Someone's words and when they were said, as readers' comments begin.
_SAID = re.compile(r"^\S+(?: \S+){0,2} (?:wrote|writes|said|says|replied|commented|schrieb|schreibt|escribió|dijo|dice|a écrit|a dit)\b|^\S+(?: \S+){0,3}:$", re.I)
_WHEN = re.compile(r"\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|\b\d{1,2}:\d{2}\b|\b(?:19|20)\d\d-\d\d-\d\d\b|^vor \d+ |^hace \d+ |^il y a \d+ ", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    tag: str  # "#" for a run of text
    parent: int
    words: tuple[str, ...] = ()  # of class, id, role and the like
    text: str = ""
    linked: int = 0  # characters of the text within links
    size: int = 0  # characters of all text below
    all_linked: int = 0
    runs: int = 0  # runs of text below
    twins: int = 1  # elements of the same tag and names under the same parent
    label: bool | None = None


@dataclass(slots=True)
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _attributes(attrs: str) -> tuple[tuple[str, ...], bool, bool | None]:
    """Words of the naming attributes, whether the element is hidden, and a training label."""
    words: list[str] = []
    hidden, label = False, None
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            words += _TOKEN.findall(_CAMEL.sub(r"\1 \2", value).lower())
        elif name == "hidden" or (name == "style" and _HIDDEN.search(value)) or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "data-content":
            label = value == "1"
    return tuple(dict.fromkeys(words)), hidden, label


def parse(page: str) -> list[Node]:
    """The tree of block-level elements and runs of text, parents before children, in page order."""
    nodes = [Node("body", -1)]
    # open elements: (name, node or None if inline, dropped, in a link)
    stack: list[tuple[str, int | None, bool, bool]] = []
    opened: Counter[str] = Counter()
    run = _Run()
    at, n = 0, len(page)

    def block() -> int:
        for _, node, _, _ in reversed(stack):
            if node is not None:
                return node
        return 0

    def dropped() -> bool:
        return bool(stack) and stack[-1][2]

    def linked() -> bool:
        return bool(stack) and stack[-1][3]

    def flush() -> None:
        nonlocal run
        if run.parts:
            text = " ".join(html.unescape("".join(run.parts)).split())
            if text:
                nodes.append(Node("#", block(), text=text, linked=run.linked))
            run = _Run()

    def add(text: str) -> None:
        if stack and stack[-1][0] == "head" and text and not text.isspace():
            close(len(stack) - 1)
        if text and not dropped():
            run.parts.append(text)
            if linked():
                run.linked += len(text.strip())

    def close(depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        if any(node is not None for _, node, _, _ in stack[depth:]):
            flush()
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    def open_at(names: tuple[str, ...], barriers: tuple[str, ...]) -> int:
        if not any(opened[x] for x in names):
            return -1
        for d in range(len(stack) - 1, -1, -1):
            if stack[d][0] in names:
                return d
            if stack[d][0] in barriers:
                return -1
        return -1

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                add(m["cdata"])
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                add(" ")
                continue
            d = open_at((name,), () if name not in INLINE else ("td", "th", "table"))
            if d >= 0 and (name not in INLINE or all(x[1] is None for x in stack[d:])):
                close(d)
            continue
        if name not in IN_HEAD and name != "html" and opened["head"]:
            close(open_at(("head",), ()))
        attrs = m["attrs"] or m["odd"] or ""
        if name in ("html", "body"):
            nodes[0].label = _attributes(attrs)[2] if attrs and nodes[0].label is None else nodes[0].label
            continue
        words, hidden, label = _attributes(attrs) if attrs else ((), False, None)
        shut = name in DROPPED and attrs.endswith("/") and _CLOSED.search(attrs[-200:]) is not None
        if shut and name in RAW:  # a slash doesn't count where the element's own end tag comes next
            after = re.compile(rf"<(/?){name}\b", re.I).search(page, at)
            shut = after is None or not after[1]
        if shut:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in ENDS_P:
            d = open_at(("p",), ("table", "td", "th"))
            if d >= 0:
                close(d)
        if name in CLOSES:
            d = open_at(CLOSES[name], SCOPES.get(name, ("table",)))
            while d >= 0:
                close(d)
                d = open_at(CLOSES[name], SCOPES.get(name, ("table",)))
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                flush()
            continue
        gone = dropped() or hidden or name in DROPPED
        if name in INLINE:
            stack.append((name, None, gone, linked() or name == "a"))
            opened[name] += 1
            continue
        flush()
        parent = block()
        node = None
        if not gone:
            nodes.append(Node(name, parent, words, label=label))
            node = len(nodes) - 1
        stack.append((name, node, gone, linked()))
        opened[name] += 1
    if at < n:
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!]", rest)
        add(rest[: cut.start()] if cut else rest)
    flush()
    for node in reversed(nodes):
        if node.tag == "#":
            node.size, node.all_linked, node.runs = len(node.text), min(node.linked, len(node.text)), 1
        if node.parent >= 0:
            up = nodes[node.parent]
            up.size += node.size
            up.all_linked += node.all_linked
            up.runs += node.runs
    alike = Counter((node.parent, node.tag, node.words) for node in nodes)
    for node in nodes:
        node.twins = alike[node.parent, node.tag, node.words]
    return nodes


def _level(x: float, *cuts: float) -> int:
    return sum(x >= c for c in cuts)


def features(nodes: list[Node], i: int) -> list[str]:
    """Names of the features that are on for a node: its own, its siblings', and its share of the page's text outside links."""
    node = nodes[i]
    plain = max(1, nodes[0].size - nodes[0].all_linked)
    share = _level((node.size - node.all_linked) / plain, 0.02, 0.1, 0.3, 0.6, 0.9)
    page = _level(plain, 150, 600, 2500)
    if node.tag == "#":
        owner = nodes[node.parent]
        words = node.text.count(" ") + 1
        link = node.linked / max(1, len(node.text))
        out = [
            f"own:{owner.tag}",
            f"words:{_level(words, 3, 6, 12, 25, 60)}",
            f"link:{_level(link, 0.05, 0.4, 0.8)}",
            f"stop:{node.text[-1] in '.!?…:;\"'}",
            f"comma:{_level(node.text.count(',') / words, 0.02, 0.2)}",
            f"share:{share}",
            f"of:{page},{share}",
            f"linked:{_level(link, 0.05, 0.4, 0.8)},{_level(words, 3, 5, 8)}",
        ]
        if _SAID.search(node.text[:80]):
            out.append(f"said:{_level(owner.twins, 2, 4)}")
        if _WHEN.search(node.text[:80]):
            out.append(f"when:{_level(words, 6, 25)}")
        if "©" in node.text:
            out.append("copyright")
        return out
    out = [
        f"tag:{node.tag}",
        f"path:{nodes[node.parent].tag if node.parent >= 0 else ''}>{node.tag}",
        f"size:{_level(node.size, 1, 40, 150, 600, 2000)}",
        f"links:{_level(node.all_linked / max(1, node.size), 0.05, 0.3, 0.7)}",
        f"long:{_level(node.size / max(1, node.runs), 20, 60, 150)}",
        f"part:{share}",
        f"whole:{page},{share}",
        f"parts:{_level(node.all_linked / max(1, node.size), 0.05, 0.3, 0.7)},{_level(node.size / max(1, node.runs), 12, 20, 30, 60)}",
        f"all:{_level(node.size / max(1, nodes[0].size), 0.1, 0.3, 0.6, 0.9)}",
    ]
    if node.tag in ("div", "section", "article", "li"):
        out.append(f"twins:{'named' if node.words else node.tag},{_level(node.twins, 2, 3, 6)}")
    out += [f"word:{w}" for w in node.words]
    return out


def _edge(nodes: list[Node], i: int) -> str:
    """Kind of the potential between a node and its parent."""
    tag = nodes[i].tag
    return "text" if tag == "#" else "block" if tag in ("p", "li", "td", "h1", "h2", "h3", "h4", "pre", "blockquote") else "part"


@dataclass
class Model:
    weights: dict[str, float]
    edges: dict[str, list[float]]  # log potentials of (parent, child) = 00, 01, 10, 11


def _ratio(x: float, a: float, b: float, c: float, d: float) -> float:
    """log((e^c + e^(d + x)) / (e^a + e^(b + x)))."""
    x = max(-40.0, min(40.0, x))
    return math.log((math.exp(c) + math.exp(d + x)) / (math.exp(a) + math.exp(b + x)))


def sum_product(unary: list[float], parents: list[int], edges: list[list[float]]) -> tuple[list[float], list[float], list[float]]:
    """Log odds of every node's marginal, its odds from below and its parent's odds without it.

    Messages run upward from the leaves and downward from the root; both are
    log odds, as nodes have two states.
    """
    n = len(unary)
    below, message = list(unary), [0.0] * n
    for i in range(n - 1, 0, -1):
        w = edges[i]
        message[i] = _ratio(below[i], w[0], w[1], w[2], w[3])
        below[parents[i]] += message[i]
    odds, cavity = list(below), [0.0] * n
    for i in range(1, n):
        w = edges[i]
        cavity[i] = odds[parents[i]] - message[i]
        odds[i] = below[i] + _ratio(cavity[i], w[0], w[2], w[1], w[3])
    return odds, below, cavity


def _chance(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Probability of being content, for every node."""
    w = model.weights
    unary = [sum(w.get(f, 0.0) for f in features(nodes, i)) for i in range(len(nodes))]
    edges = [model.edges[_edge(nodes, i)] for i in range(len(nodes))]
    return [_chance(x) for x in sum_product(unary, [n.parent for n in nodes], edges)[0]]


def train(pages: list[list[Node]], rounds: int = 16, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximise the conditional likelihood of labelled trees by stochastic gradient ascent.

    The gradient of a page is its features and joint states as labelled, less
    their expectations under the model, which the marginals give.
    """
    model = Model({}, {k: [0.0, 0.0, 0.0, 0.0] for k in ("text", "block", "part")})
    w = model.weights
    ready = [([features(p, i) for i in range(len(p))], [_edge(p, i) for i in range(len(p))], [n.parent for n in p], [bool(n.label) for n in p]) for p in pages]
    for r in range(rounds):
        step = rate / (1 + r)
        for names, kinds, parents, labels in ready:
            edges = [model.edges[k] for k in kinds]
            unary = [sum(w.get(f, 0.0) for f in fs) for fs in names]
            odds, below, cavity = sum_product(unary, parents, edges)
            for i, fs in enumerate(names):
                g = step * (labels[i] - _chance(odds[i]))
                for f in fs:
                    w[f] = w.get(f, 0.0) * (1 - step * decay) + g
            moves = {k: [0.0] * 4 for k in model.edges}
            for i in range(1, len(names)):
                e = edges[i]
                joint = [e[0], e[1] + below[i], e[2] + cavity[i], e[3] + below[i] + cavity[i]]
                top = max(joint)
                joint = [math.exp(x - top) for x in joint]
                total = sum(joint)
                for k in range(4):
                    moves[kinds[i]][k] -= joint[k] / total
                moves[kinds[i]][2 * labels[parents[i]] + labels[i]] += 1
            for k, move in moves.items():
                model.edges[k] = [x + step * 0.3 * m for x, m in zip(model.edges[k], move, strict=True)]
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model trained on the library's labelled pages; the same in every process."""
    from tangentia.llm import html_pages

    return train([html_pages.labelled(parse(p)) for p in html_pages.pages()])


def main_text(page: str | None, model: Model) -> str:
    """Runs of text that are content, joined by newlines in page order; a null page has none."""
    if not page:
        return ""
    nodes = parse(page)
    if len(nodes) == 1:
        return ""
    chances = marginals(nodes, model)
    return "\n".join(n.text for n, p in zip(nodes, chances, strict=True) if n.tag == "#" and p > 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each row of ``pages``; ``text`` is empty, never null.

    Null ids and urls stay null; rows that repeat are extracted each on its own.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, shared.value) for p in batch], dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), run(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
