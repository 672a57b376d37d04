"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page becomes a tree of block elements. Each node has features: size, density and links of its subtree, tokens of its
attributes and of its nearest marked ancestor, depth, place among its siblings. Boosted trees give each node the odds
of being content. The decoding labels nodes from the root down as outside, inside or dropped; along any path a label
may only go on in that order, so no descendant contradicts its ancestor, and the labels of the best total are chosen.

The trees are fitted to pages of the table itself: a bounded sample is labelled by its semantic elements, and variants
of each page, in which those elements are replaced or other boilerplate is added, teach the other signs.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import batches, rows_of

# Fixed values of HTML: elements without content, elements whose text is not markup, elements whose content is not text
# of the page, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
DROPPED = frozenset("noscript template svg object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
# An opening element of the key closes an open element of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "body": {"head"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("table ul ol dl select td th body html article section main div".split())
CONTENT_TOKENS = frozenset("article articlebody body content entry main post story text".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement advertisements banner breadcrumb breadcrumbs comment comments consent contact cookie cookies copyright disqus "
    "footer form gdpr header login masthead menu meta nav navbar navigation newsletter notice notices pagination popup promo promotion related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
TRAINING_PAGES = 300
TRAINING_CHARS = 1 << 16
# `<!-->` is a whole comment; a tag with an unclosed quote ends at the next `>`.
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "tokens", "role", "parent", "children", "items", "truth", "position")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.children, self.items = tag, parent, [], []
        named = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
        self.tokens = {x.lower() for x in _PARTS.findall(named)}
        self.truth = attributes.get("data-truth")
        self.position = len(parent.children) if parent is not None else 0  # among its siblings
        if parent is not None:
            parent.children.append(self)
            parent.items.append(self)


def parse(page: str) -> list[Node]:
    """The block elements of a page in order, root first. Each node's items are its texts, (text, in a link) pairs,
    and its child nodes. Elements that are never closed end with their parent; blocks end an open svg."""
    root = Node("html", None, {})
    nodes, open_tags = [root], [("html", root)]  # (tag, block node it belongs to)
    links, hidden, at, end = 0, 0, 0, len(page)

    def close_from(i: int) -> None:
        nonlocal links, hidden
        links -= sum(t == "a" for t, _ in open_tags[i:])
        hidden -= sum(t in DROPPED for t, _ in open_tags[i:])
        del open_tags[i:]

    while at < end:
        found = _TAG.search(page, at)
        text = page[at : found.start() if found else end]
        if text and not hidden:
            open_tags[-1][1].items.append((entities.unescape(text), links > 0))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in RAW and not closing:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br" or tag in VOID:
            if not hidden:
                open_tags[-1][1].items.append((" ", False))
            continue
        if closing:
            places = [i for i in range(len(open_tags) - 1, 0, -1) if open_tags[i][0] == tag]
            # An inline element's end does not close blocks.
            if places and (tag in BLOCK or tag in DROPPED or not any(t in BLOCK for t, _ in open_tags[places[0] + 1 :])):
                close_from(places[0])
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in open_tags):
            continue
        if tag in BLOCK:
            foreign = [i for i, (t, _) in enumerate(open_tags) if t in ("svg", "foreignobject")] if hidden else []
            if foreign and open_tags[foreign[-1]][0] == "svg":
                close_from(foreign[-1])
            shut = CLOSES.get(tag, set()) | ({"p"} if tag not in ("body", "head") else set())
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i][0] in shut:
                    close_from(i)
                    break
                if open_tags[i][0] in SCOPES or open_tags[i][0] in DROPPED:
                    break
            if hidden:
                open_tags.append((tag, open_tags[-1][1]))
                continue
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(found[3])}
            node = Node(tag, open_tags[-1][1], attributes)
            nodes.append(node)
            open_tags.append((tag, node))
        elif not found[3].rstrip().endswith("/") or tag in DROPPED and tag != "svg":
            links += tag == "a"
            hidden += tag in DROPPED
            open_tags.append((tag, open_tags[-1][1]))
    return nodes


TAGS = ("article main section div p li ul ol nav aside footer header form table td h1 h2 h3 blockquote pre figure menu body html".split())
_PLACE = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = len(TAGS) + 19


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [place[id(x.parent)] if x.parent else -1 for x in nodes]
    own = np.zeros((n, 6))  # characters, characters in links, stops, words, 1, paragraphs
    for i, x in enumerate(nodes):
        for t in x.items:
            if not isinstance(t, Node):
                size = len(t[0].strip())
                own[i, :4] += size, size * t[1], sum(map(t[0].count, ".,;:!?")), t[0].count(" ") + 1
        own[i, 4:] = 1, x.tag == "p"
    whole = own.copy()
    for i in range(n - 1, 0, -1):
        whole[parent[i]] += whole[i]
    out = np.zeros((n, N_FEATURES))
    page = max(1.0, whole[0, 0])
    marks = np.zeros((n, 2))
    for i, x in enumerate(nodes):
        if x.tag in _PLACE:
            out[i, _PLACE[x.tag]] = 1
        good, other = len(x.tokens & CONTENT_TOKENS), len(x.tokens & OTHER_TOKENS)
        above = marks[parent[i]] if i else (0, 0)
        good_tag, other_tag = x.tag in ("article", "main"), x.tag in ("nav", "aside", "footer", "header", "form", "menu", "select")
        marks[i] = (1 if good or good_tag else above[0]), (1 if other or other_tag else above[1])
        depth = out[parent[i], -1] + 1 if i else 0
        brothers = x.parent.children if x.parent else [x]
        rest = (
            good, other, *above, np.log1p(own[i, 0]), np.log1p(whole[i, 0]), whole[i, 0] / page, whole[i, 1] / max(1.0, whole[i, 0]),
            whole[i, 0] / whole[i, 4], whole[i, 2] / max(1.0, whole[i, 3]), whole[i, 3] / whole[i, 4], whole[i, 5], whole[i, 4], len(x.children),
            x.position / len(brothers), len(brothers), whole[i, 0] / max(1.0, whole[parent[i], 0]) if i else 1, whole[i, 5] / whole[i, 4], depth,
        )
        out[i, len(TAGS) :] = rest
    return out


class Trees:
    """Gradient-boosted regression trees of fixed depth on the logistic loss, over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        odds = np.full(len(y), self.base)
        width, rows = self.bins + 1, np.arange(x.shape[1]) * (self.bins + 1)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, value = np.zeros(2**self.depth, int), np.full(2**self.depth, np.inf), np.zeros(2 ** (self.depth + 1))
            node = np.ones(len(y), int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    mine = np.flatnonzero(node == k)
                    if len(mine) < 2:
                        continue
                    flat = (binned[mine] + rows).ravel()
                    size = width * x.shape[1]
                    gl = np.bincount(flat, np.repeat(g[mine], x.shape[1]), size).reshape(-1, width).cumsum(1)
                    hl = np.bincount(flat, np.repeat(h[mine], x.shape[1]), size).reshape(-1, width).cumsum(1)
                    gt, ht = g[mine].sum(), h[mine].sum()
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least / 20) | (ht - hl < self.least / 20)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        feature[k], cut[k] = f, edges[f][b]
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > cut[node])
            gs, hs = np.bincount(node, g, 2 ** (self.depth + 1)), np.bincount(node, h, 2 ** (self.depth + 1))
            value = self.rate * gs / (hs + 1)
            self.trees.append((feature, cut, value))
            odds += value[node]
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            total += value[node]
        return total


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """For each node whether it is inside, by the best labels that only go from outside to inside to dropped."""
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [place[id(x.parent)] if x.parent else -1 for x in nodes]
    inside = -np.logaddexp(0, -odds)
    other = -np.logaddexp(0, odds)
    score = np.stack([other, inside, other], 1)  # outside, inside, dropped
    for i in range(len(nodes) - 1, 0, -1):
        best = np.maximum.accumulate(score[i][::-1])[::-1]  # of this label or a later one
        score[parent[i]] += best
    label = np.zeros(len(nodes), int)
    for i in range(len(nodes)):
        first = label[parent[i]] if i else 0
        label[i] = first + int(score[i][first:].argmax())
    return (label == 1).tolist()


def main_text(nodes: list[Node], kept: list[bool]) -> str:
    """The blocks of kept nodes in page order, each with single spaces, joined by line ends."""
    chosen = {id(x) for x, k in zip(nodes, kept, strict=True) if k}
    blocks, waiting = [], []

    def close() -> None:
        if line := " ".join("".join(waiting).split()):
            blocks.append(line)
        waiting.clear()

    stack = [iter(nodes[0].items)]
    owners = [nodes[0]]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            close()
            stack.pop()
            owners.pop()
        elif isinstance(item, Node):
            close()
            stack.append(iter(item.items))
            owners.append(item)
        elif id(owners[-1]) in chosen:
            waiting.append(item[0])
    close()
    return "\n".join(blocks)


def weak_truth(nodes: list[Node]) -> np.ndarray | None:
    """Labels by semantic elements and marked variants; None if a page has no such element."""
    out, known = np.zeros(len(nodes)), False
    place = {id(x): i for i, x in enumerate(nodes)}
    for i, x in enumerate(nodes):
        above = out[place[id(x.parent)]] if x.parent else 0
        if x.truth:
            out[i] = x.truth == "1"
        elif x.tag in ("article", "main"):
            out[i] = 1
        elif x.tag in ("nav", "aside", "footer", "header", "form", "menu") or x.tokens & OTHER_TOKENS:
            out[i] = 0
        else:
            out[i] = above
        known |= bool(out[i])
    return out if known else None


def variants(page: str, seed: int) -> list[str]:
    """The page, and versions in which its article is another element and more boilerplate stands around and in it."""
    rnd = random.Random(seed)
    words = re.sub(r"<[^>]*>", " ", page).split() or ["x"]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [page]
    boxes = [
        lambda: f'<aside class="sidebar" data-truth="0"><h3>{said(3)}</h3><ul>' + "".join(f'<li><a href="#">{said(4)}</a></li>' for _ in range(5)) + "</ul></aside>",
        lambda: f'<div class="{rnd.choice(["comments", "comment-list", "user-comments"])}" data-truth="0"><h3>{said(2)}</h3>' + "".join(f'<div class="comment"><p>{said(rnd.randint(5, 60))}</p></div>' for _ in range(3)) + "</div>",
        lambda: f'<form data-truth="0"><label>{said(3)}</label><select><option>{said(1)}</option></select><p>{said(8)}</p></form>',
        lambda: f'<div class="{rnd.choice(["cookie-notice", "notice", "gdpr consent", "newsletter signup", "popup"])}" data-truth="0"><p>{said(rnd.randint(6, 40))}</p></div>',
        lambda: f'<header data-truth="0"><div>{said(4)}</div><ul><li><a href="#">{said(2)}</a></li></ul></header>',
        lambda: f'<div class="{rnd.choice(["ad", "advert", "sponsored", "related", "share-bar", "promo"])}" data-truth="0">{said(rnd.randint(3, 30))}</div>',
        lambda: f'<div id="{rnd.choice(["menu", "breadcrumbs", "sidebar", "footer"])}" data-truth="0">' + "".join(f"<p>{said(4)}</p>" for _ in range(rnd.randint(1, 6))) + "</div>",
    ]
    for _ in range(4):
        tag, name = rnd.choice([("div", "post-content"), ("div", "entry"), ("section", "story"), ("main", ""), ("article", ""), ("div", "article-body"), ("div", "main")])
        v = re.sub(r"<article[^>]*>", f'<{tag} class="{name}" data-truth="1">', page).replace("</article>", f"</{tag}>")
        around = [m.end() for m in re.finditer(r"<body[^>]*>|</nav>|</footer>", v)]
        inner = [m.start() for m in re.finditer(r"<p>", v)]
        for spots, n in ((around, 3), (inner, 2)):
            for place in sorted(rnd.sample(spots, min(n, len(spots))), reverse=True):
                v = v[:place] + rnd.choice(boxes)() + v[place:]
        out.append(v)
    return out


def made_page(seed: int) -> str:
    """A page with an article between menus and notes, of invented words, for corpora without marked articles."""
    rnd = random.Random(seed)
    said = lambda low, high: " ".join("".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9))) for _ in range(rnd.randint(low, high)))
    links = "".join(f'<li><a href="/{i}">{said(1, 3)}</a></li>' for i in range(rnd.randint(3, 8)))
    body = "".join(f"<p>{said(15, 80)}</p>" for _ in range(rnd.randint(2, 12)))
    return (
        f"<html><head><title>{said(2, 6)}</title></head><body><nav><ul>{links}</ul></nav>"
        f"<article><h1>{said(2, 8)}</h1>{body}<h2>{said(2, 5)}</h2><p>{said(20, 60)}</p></article>"
        f"<footer><p>{said(3, 12)}</p></footer></body></html>"
    )


def fit(pages: DataFrame, max_pages: int = TRAINING_PAGES, max_chars: int = TRAINING_CHARS) -> Trees:
    """Trees fitted to at most max_pages pages, those with the least hashes among a few times as many.

    Pages of max_chars characters and more are not learned from (they are extracted like all others). If no learned
    page marks its article, trees are fitted to pages the library makes itself, so they are never without training.
    """
    rows = pages.where("html IS NOT NULL").select("page_id", "html")
    n = rows.count()
    if n > 4 * max_pages:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "page_id", F.length("html")), F.lit(1 << 50)) < max(1, (4 * max_pages << 50) // n))
    sample = rows.where(F.length("html") < max_chars).orderBy(F.xxhash64("html"), "page_id").limit(max_pages).toArrow()
    return _fitted(sample["html"].to_pylist()) or _fitted([made_page(i) for i in range(100)])


def _fitted(pages: list[str]) -> Trees | None:
    xs, ys = [], []
    for i, page in enumerate(pages):
        for text in variants(page, i):
            nodes = parse(text)
            truth = weak_truth(nodes)
            if truth is not None:
                xs.append(features(nodes))
                ys.append(truth)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys)) if ys else None


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url and text of every row; the text is empty where nothing is content.

    A null or empty html gives an empty text. Null ids and urls stay null; repeated rows are extracted each; other
    columns are ignored. Pages are read whole, whatever their length; broken markup is read as far as it goes.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(parts):
        def rows():
            held = []
            for row in rows_of(parts, "page_id", "url", "html"):
                held.append((row[0], row[1], parse(row[2] or "")))
                if len(held) == 64:
                    yield from told(held)
                    held = []
            yield from told(held)

        def told(held):
            if not held:
                return
            x = [features(nodes) for _, _, nodes in held]
            odds = np.split(sent.value.odds(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
            for (page_id, url, nodes), o in zip(held, odds, strict=True):
                yield page_id, url, main_text(nodes, decode(nodes, o))

        yield from batches(rows(), schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
