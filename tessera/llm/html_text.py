"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut to blocks (stretches of text between block-level tags) with the elements that hold them. A
logistic classifier gives each block the log-odds of being content; they are the capacity of its arc
from the source, or to the sink where negative. Neighbouring blocks, and blocks of the same parent, are tied by arcs that
are the stronger the closer they stand in the document tree. The minimum cut parts content from boilerplate.

The classifier sees the elements and the class, id and role names above a block, its length, links and last mark. It
is fitted to at most SAMPLE_PAGES of the pages (those of least hash, up to SAMPLE_BYTES long): on pages with one article
element (or none and one main), blocks within it are content and blocks outside aren't; what stands within under
a name or element of known boilerplate has no label. Every labelled block is taken twice, once without article and main among
its features, so that the others learn to tell. Weights start from, and are held to, fixed prior ones, which stand for
names that the sample doesn't show. The strength of the ties is that of TIES which labels the sample best where article
and main are withheld.

Blocks whose score outweighs all their ties are settled first, which leaves the cut as it is; the rest is
cut by maximum flow (blocking flows in layers).

Defined cases: a null or empty page has an empty text; broken markup is read as far as it goes: after the first tag whose quotes
don't pair, tags end at the next `>`, and from the first that has none on, all is text; an element ends
with its parent; elements more than DEEPEST deep count as their parent's siblings; script, style, textarea, title and their like without an end
reach to the page's end, other elements without text of their own (svg, select, ...) only to theirs. Repeated rows, null ids and
other columns are kept (a column text or n_chars as text_in, n_chars_in); pages of any length are read whole, in time
that grows with their length; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, column, mapped, plain, schema_of

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Kinds of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe textarea title".split())
_SILENT = frozenset("template svg select canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_BARRIER = frozenset("article aside body div dl footer form header html main nav ol section table ul td th".split())

# Prior weights of elements and names, in log-odds.
_ELEMENTS = {"article": 3, "main": 2, "nav": -6, "footer": -6, "aside": -6, "form": -6, "header": -4, "menu": -6, "dialog": -6, "button": -6, "head": -10, "fieldset": -6, "address": -1, "figcaption": -0.5, "table": -0.25, "li": -0.25, "section": 0, "ul": 0, "ol": 0, "pre": 0, "blockquote": 0}
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar "
    "comment comments respond disqus discussion reply replies cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login "
    "register search share sharing social related recommended trending popular widget pagination pager copyright legal disclaimer form skip".split()
)
_CONTENT = frozenset("article content post entry story main body text prose".split())
_OTHERS = {"hidden": -10, "<header> within": -1, "bias": -1, "words": 1, "mark": 0.5, "links": -3, "paragraph": 1}
PRIOR = {f"<{t}>": w for t, w in _ELEMENTS.items()} | {f".{n}": -6 for n in _BOILERPLATE} | {f".{n}": 1 for n in _CONTENT} | _OTHERS
#: What the labels come from.
_WITHHELD = frozenset(("<article>", "<main>", ".article", ".main"))

SAMPLE_PAGES, SAMPLE_BYTES = 300, 1 << 17
TIES = (0.25, 0.5, 1.0, 2.0)
#: A block's log-odds count up to this, so that ties may outweigh them.
MOST = 6.0
DEEPEST = 512


class Model:
    """Weights of features, and the strength of ties."""

    def __init__(self, weights: dict[str, float] | None = None, tie: float = 1.0) -> None:
        self.weights, self.tie = dict(PRIOR if weights is None else weights), tie


class _Element:
    __slots__ = ("tag", "features", "score", "up", "depth", "links")

    def __init__(self, tag: str, attributes: str, up: _Element | None, weights: dict[str, float]) -> None:
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        self.features: frozenset[str] = up.features if up else frozenset()
        self.score = up.score if up else 0.0
        own = []
        if tag in _ELEMENTS:
            own.append("<header> within" if tag == "header" and self.features & _WITHHELD else f"<{tag}>")
        if attributes and "=" in attributes and tag not in ("body", "html"):
            for found in _NAMES.findall(attributes):
                own += ["." + n for n in _PARTS.findall(_CAMEL.sub(" ", "".join(found)).lower())]
        if attributes and _HIDDEN.search(attributes):
            own.append("hidden")
        if own:
            new = set(own) - self.features
            self.features |= new
            self.score += sum(weights.get(f, 0.0) for f in new)
        self.links = tag == "a" or bool(up and up.links)


def _cut(page: str, weights: dict[str, float]) -> list[tuple[str, dict[str, float], _Element]]:
    """Text, features of its own and holder of each block in page order."""
    root = _Element("#root", "", None, weights)
    stack, out, text, linked = [root], [], [], 0
    is_open: dict[str, int] = {}
    holder = root
    unended: set[str] = set()
    quotes, size = True, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            block = _SPACE.sub(" ", "".join(text)).strip()
            if block:
                share = min(1.0, linked / len(block))
                own = {"bias": 1.0, "words": min(block.count(" ") + 1, 30) / 10}
                if block[-1] in ".!?:;…。":
                    own["mark"] = 1.0
                if share > 0.4:
                    own["links"] = share
                if holder.tag in ("p", "h1", "h2", "h3", "h4"):
                    own["paragraph"] = 1.0
                out.append((block, own, holder))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal holder, linked
        if piece:
            plain = html.unescape(piece) if "&" in piece else piece
            if not text:
                if plain.isspace():
                    return
                top = stack[-1]
                while top.up is not None and top.tag in _INLINE:
                    top = top.up
                holder = top
            text.append(plain)
            if stack[-1].links:
                linked += len(plain)

    def close(down_to: int) -> None:
        for e in stack[down_to:]:
            is_open[e.tag] -= 1
        del stack[down_to:]

    at = 0
    while found := _OPEN.search(page, at):
        begin, after = found.span()
        add(page[at:begin])
        at, tag = begin, found[2]
        if tag is None and found[0] == "<!--":
            end = page.find("-->", after - 2)
            at = end + 3 if end >= 0 else size
            continue
        ended = _QUOTED.match(page, after) if quotes and tag is not None else None
        if ended:
            end = ended.end()
        else:
            quotes = quotes and tag is None
            end = page.find(">", after) + 1
            if not end:  # no tag ends from here on
                break
        at = end
        if tag is None:
            continue
        attributes, tag = page[after : end - 1], tag.lower()
        if found[1]:  # an end tag
            if tag not in _INLINE:
                flush()
            if is_open.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if (tag in _INLINE or tag == "p") and stack[i].tag in _BARRIER:
                        break
            continue
        if tag in _RAW or tag in _SILENT:
            flush()
            if not attributes.endswith("/") and tag not in unended:
                ending = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                over = page.find(">", ending.start()) + 1 if ending else 0
                if over:
                    at = over
                elif tag in _RAW:
                    at = size
                else:
                    unended.add(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            flush()
            closes = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes or stack[i].tag == "p":
                    close(i)
                    if not closes:
                        break
                elif stack[i].tag in _BARRIER:
                    break
        if (tag not in _VOID and not attributes.endswith("/") or tag in ("a", "p", "div")) and len(stack) < DEEPEST:
            stack.append(_Element(tag, attributes, stack[-1], weights))
            is_open[tag] = is_open.get(tag, 0) + 1
    add(page[at:])
    flush()
    return out


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def minimum_cut(scores: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source: that labelling of least cost, where a node on the side it scores against costs its score, and a cut tie its strength."""
    n = len(scores)
    score = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in ties.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(score[i]) >= sum(near[i].values()):
            label[i] = score[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                score[j] += w if label[i] else -w
                queue.append(j)
            near[i].clear()
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        kept = _source_side({i: near[i] for i in rest}, score)
        for i in rest:
            label[i] = i in kept
    return [bool(x) for x in label]


def _source_side(near: dict[int, dict[int, float]], score: list[float]) -> set:
    """The nodes that the source reaches when no more flow fits: layers by distance from the source, then paths along them till none is left."""
    room = {i: dict(ties) for i, ties in near.items()} | {"source": {}, "sink": {}}
    for i in near:
        a, b = ("source", i) if score[i] > 0 else (i, "sink")
        room[a][b] = abs(score[i])
        room[b].setdefault(a, 0.0)
    while True:
        layer, queue = {"source": 0}, deque(["source"])
        while queue:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and j not in layer:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        if "sink" not in layer:
            return set(layer)
        left = {i: iter(list(room[i])) for i in layer}
        path = ["source"]
        while path:
            i = path[-1]
            if i == "sink":
                steps = list(zip(path[:-1], path[1:]))
                flow = min(room[a][b] for a, b in steps)
                full = 0
                for k, (a, b) in reversed(list(enumerate(steps))):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if room[a][b] <= 1e-9:
                        full = k
                del path[full + 1 :]
                left[path[-1]] = iter([j for j in room[path[-1]] if layer.get(j) == layer[path[-1]] + 1 and room[path[-1]][j] > 1e-9]) if full == 0 else left[path[-1]]
                continue
            for j in left[i]:
                if room[i][j] > 1e-9 and layer.get(j) == layer[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()


def _scores(found: list, model: Model) -> list[float]:
    weights = model.weights
    return [max(-MOST, min(MOST, holder.score + sum(weights.get(f, 0.0) * v for f, v in own.items()))) for _, own, holder in found]


def _ties(found: list) -> dict[tuple[int, int], float]:
    """Ties of unit strength: of each block to the one before it, and to the last one of the same parent."""
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, _, holder) in enumerate(found):
        if i:
            ties[i - 1, i] = 0.3 + 1.2 / (1 + _distance(found[i - 1][2], holder))
        parent = id(holder.up) if holder.up is not None else 0
        if (j := last.get(parent)) is not None:
            ties[j, i] = ties.get((j, i), 0.0) + 0.5
        last[parent] = i
    return ties


def labelled(page: str, model: Model | None = None) -> tuple[list[str], list[bool], list[bool]]:
    """The blocks of a page, which of them the minimum cut keeps, and which the classifier alone would."""
    model = model or Model()
    found = _cut(page, model.weights)
    scores = _scores(found, model)
    ties = {k: w * model.tie for k, w in _ties(found).items()}
    return [b for b, _, _ in found], minimum_cut(scores, ties), [s > 0 for s in scores]


def main_text(page: str, model: Model | None = None) -> str:
    """The content blocks of a page, joined by newlines."""
    found, keep, _ = labelled(page, model)
    return "\n".join(b for b, k in zip(found, keep) if k)


def _weak_labels(found: list) -> list[bool | None]:
    """Content by the page's one article (or main), None for what has no label."""
    for tag in ("article", "main"):
        holders = {}
        for i, (_, _, e) in enumerate(found):
            while e is not None and e.tag != tag:
                e = e.up
            if e is not None:
                holders.setdefault(id(e), []).append(i)
        if holders:
            break
    if len(holders) != 1:
        return [None] * len(found)
    (within,) = map(set, holders.values())
    doubtful = {f for f, w in PRIOR.items() if w <= -1 and f not in _OTHERS} | {"hidden"}
    return [i in within if i not in within or not e.features & doubtful else None for i, (_, _, e) in enumerate(found)]


def fit(pages: list[str]) -> Model:
    """A model from pages: weights by weak labels, ties by how well they label the pages where article and main are withheld."""
    read = [(found, _weak_labels(found)) for found in (_cut(p, PRIOR) for p in pages)]
    rows: list[tuple[dict[str, float], bool]] = []
    for found, labels in read:
        for (_, own, e), label in zip(found, labels):
            if label is not None:
                rows += [(own | dict.fromkeys(e.features, 1.0), label), (own | dict.fromkeys(e.features - _WITHHELD, 1.0), label)]
    if not rows:
        return Model()
    seen: dict[str, int] = {}
    for features, _ in rows:
        for f in features:
            seen[f] = seen.get(f, 0) + 1
    names = [f for f in seen if f in PRIOR or seen[f] >= 10]
    place = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [sum(f in place for f in features) for features, _ in rows])
    col = np.array([place[f] for features, _ in rows for f in features if f in place])
    value = np.array([v for features, _ in rows for f, v in features.items() if f in place])
    y = np.array([label for _, label in rows], float)
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w = prior.copy()
    pace = 4.0 / (np.bincount(col, weights=value**2 * np.bincount(row, minlength=len(rows))[row], minlength=len(names)) / len(rows) + 0.05)
    for _ in range(300):  # descent on the mean loss, with the weights held to the prior ones
        error = 1 / (1 + np.exp(-np.bincount(row, weights=w[col] * value, minlength=len(rows)))) - y
        w -= pace * (np.bincount(col, weights=error[row] * value, minlength=len(names)) / len(rows) + 0.002 * (w - prior))
    model = Model(PRIOR | dict(zip(names, map(float, w))))
    bare = Model({f: 0.0 if f in _WITHHELD else v for f, v in model.weights.items()})
    wrong = []
    for tie in TIES:
        bare.tie = tie
        n = 0
        for page, (_, labels) in zip(pages, read):
            n += sum(k != x for k, x in zip(labelled(page, bare)[1], labels) if x is not None)
        wrong.append((n, abs(math.log(tie)), tie))
    model.tie = min(wrong)[2]
    return model


def train(pages: DataFrame, html_column: str = "html") -> Model:
    """A model fitted to at most SAMPLE_PAGES of the pages."""
    own, at, _ = plain(pages)
    page = F.col(at(html_column))
    usable = own.select(page.alias("html"), F.xxhash64(*own.columns).alias("hash")).filter(F.octet_length(page).between(1, SAMPLE_BYTES))
    every = max(1, usable.count() // SAMPLE_PAGES)  # so that a task sends few pages, however many tasks there are
    some = usable.filter(F.pmod("hash", F.lit(every)) == 0).orderBy("hash", "html").limit(SAMPLE_PAGES)
    return fit(sorted(r["html"] for r in some.collect()))


def _extract(batches: Iterator[pa.RecordBatch], name: str, model: Model) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, name):
        texts = [main_text(p, model) if p else "" for p in column(block, name).to_pylist()]
        out = block.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))
        yield from out.combine_chunks().to_batches()


def extract(pages: DataFrame, html_column: str = "html", model: Model | None = None) -> DataFrame:
    """pages with text, the main text of each, and n_chars, its code points."""
    model = model or train(pages, html_column)
    own, at, back = plain(pages)
    return back(own.transform(mapped, lambda it: _extract(it, at(html_column), model), schema_of(own, "text string", "n_chars long")))
