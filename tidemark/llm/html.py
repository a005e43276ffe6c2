"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Each element is content or not. Potentials connect an element with its parent and score its own features (tag,
words of class, id and role, length and share of links of its text). Sum-product messages go up the tree and down
again, and give each element its marginal; text stays where that is at least one half. The weights are fitted, by the
gradient of the exact log likelihood, on the labelled pages of labelled_pages(); nothing is learned from the pages to extract.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = RAW | frozenset("head template noscript svg math select option button object audio video canvas datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head caption tbody td tfoot th thead tr legend summary figcaption".split())
#: An opening tag of the first kind ends an open element of the others, up to an enclosing element of the last.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("th", "td"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
_TAG = re.compile(
    r"<(?:!--(?:.*?--!?>|.*\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_HINT = re.compile(r"(?:\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))", re.I)
_WORD = re.compile(r"[a-z]+")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)", re.I)
_NO_DISPLAY = re.compile(r"\bstyle\s*=\s*[\"'][^\"']*\bdisplay\s*:\s*none", re.I)


# Class words of page parts that aren't the article, in wide use.
AROUND = {
    "nav": ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "topbar"],
    "header": ["header", "masthead", "banner", "site", "logo"],
    "footer": ["footer", "colophon", "copyright", "legal", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "complementary", "rail", "promo", "trending"],
    "div": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "cookie", "consent", "notice", "banner", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "share", "social", "sharing", "login", "gdpr", "privacy", "paywall"],
    "section": ["comments", "comments", "comments", "comment", "comment", "discussion", "replies", "reply", "disqus", "respond", "responses", "related", "newsletter"],
    "form": ["search", "login", "signup", "subscribe", "contact", "newsletter"],
}
_AROUND = frozenset(w for words in AROUND.values() for w in words)


@functools.lru_cache(maxsize=None)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


def _unseen(attrs: str) -> bool:
    """Whether an element has the attribute hidden or a style that doesn't display it."""
    return "hidden" in attrs and bool(_HIDDEN.search(_QUOTED.sub("", attrs))) or "none" in attrs and bool(_NO_DISPLAY.search(attrs))


class Node:
    __slots__ = ("tag", "parent", "hints", "chars", "linked", "odds", "up", "label", "dead")

    def __init__(self, tag: str, parent: int, hints: str, dead: bool):
        self.tag, self.parent, self.hints, self.dead = tag, parent, hints, dead
        self.chars = self.linked = 0
        self.odds = self.up = 0.0
        self.label = -1


def parse(html: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Elements in page order, parents first, and the page's parts in order: (element, text) or (element, None) where a block begins or ends."""
    nodes, parts = [Node("#root", -1, "", False)], []
    stack, at, size = [0], 0, len(html)
    # Where in the stack the elements of each tag are, so that the innermost one is found at any depth.
    places: dict[str, list[int]] = defaultdict(list)

    def inner(*tags: str) -> int:
        return max(places[t][-1] if places.get(t) else 0 for t in tags)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            gone = nodes[stack.pop()]
            places[gone.tag].pop()
            if gone.tag in BLOCK:
                parts.append((stack[-1], None))

    def text(a: int, b: int) -> None:
        if b > a:
            parts.append((stack[-1], html[a:b]))

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if end:
            if depth := inner(name):
                pop_to(depth)
            elif name == "p":
                parts.append((stack[-1], None))
            continue
        if name in CLOSES_P and (depth := inner("p")) > inner("table", "td", "th", "button", "caption"):
            pop_to(depth)
        if name in IMPLIED:
            ends, within = IMPLIED[name]
            border = inner(*within)
            if (depth := inner(ends[0])) > border or (depth := inner(*ends)) > border:
                pop_to(depth)
        if name in BLOCK:
            parts.append((stack[-1], None))
        if name in VOID:
            continue
        parent = stack[-1]
        hints = " ".join(w for h in _HINT.finditer(attrs) for w in _WORD.findall((h[2] or h[3] or h[4] or "").lower())) if "=" in attrs else ""
        nodes.append(Node(name, parent, hints, nodes[parent].dead or name in NEVER or bool(attrs) and _unseen(attrs)))
        if name in RAW:
            close = _closing(name).search(html, at)
            at = close.end() if close else size
            continue
        places[name].append(len(stack))
        stack.append(len(nodes) - 1)
    return nodes, parts


@functools.lru_cache(maxsize=100_000)
def _names(tag: str, hints: str, size: int, links: int) -> tuple[str, ...]:
    return ("bias", f"tag {tag}", *[f"named {tag}"] * bool(hints), *["around"] * (not _AROUND.isdisjoint(hints.split())), *{f"hint {w}" for w in hints.split()}, f"size {size}", f"links {links}")


def features(node: Node) -> tuple[str, ...]:
    size = 0 if not node.chars else min(1 + int(math.log(node.chars, 4)), 7)
    return _names(node.tag, node.hints, size, (4 * node.linked) // node.chars if node.chars else 0)


def _measure(nodes: list[Node], parts: list) -> None:
    for i, t in parts:
        if t is not None and not nodes[i].dead:
            nodes[i].chars += (n := len(t.strip()))
            nodes[i].linked += n * (nodes[i].tag == "a")
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.chars += node.chars
        up.linked += node.chars if up.tag == "a" else node.linked


def _kind(node: Node) -> int:
    return 0 if node.tag in BLOCK else 1


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def propagate(nodes: list[Node], unary: dict[str, float], tie: list[list[float]]) -> list[float]:
    """Marginal of content for each element. tie[kind]: log potentials of (parent, child) 00, 01, 10, 11."""
    for node in nodes:
        node.odds = sum(unary.get(f, 0.0) for f in features(node))
    for node in reversed(nodes[1:]):
        a, b, c, d = tie[_kind(node)]
        node.up = _lse(c, d + node.odds) - _lse(a, b + node.odds)
        nodes[node.parent].odds += node.up
    # Downward: odds of each element given all evidence, from its parent's without what the element itself sent.
    total = [nodes[0].odds]
    for node in nodes[1:]:
        rest = total[node.parent] - node.up
        a, b, c, d = tie[_kind(node)]
        total.append(node.odds + _lse(b, d + rest) - _lse(a, c + rest))
    return [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in total]


def extract_text(html: str, model: tuple[dict[str, float], list[list[float]]]) -> str:
    """The main text: blocks with single blanks, one a line."""
    nodes, parts = parse(html)
    _measure(nodes, parts)
    p = propagate(nodes, *model)
    blocks, now = [], []
    for i, t in parts:
        if t is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif p[i] >= 0.5 and not nodes[i].dead:
            now.append(unescape(t) if "&" in t else t)
    if now:
        blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def labelled_pages(count: int = 320, seed: int = 11) -> list[str]:
    """Pages whose elements carry data-y="1" (content) or "0"; the label holds for what is below until another one. A page without any label is all content."""
    r = random.Random(seed)
    letters = "etaoinshrdlu"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
    def other(tag: str) -> str:
        own = "div" if r.random() < 0.25 else tag
        hint = "" if own == tag and tag != "div" and tag != "section" and r.random() < 0.5 else f' {r.choice(["class", "id"])}="{r.choice(AROUND[tag])}{r.choice(["", " box", "-wrap", " " + word()])}"'
        inside = {
            "nav": menu,
            "header": lambda: r.choice([menu(), f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>"]),
            "footer": lambda: r.choice([words(3, 20), f"<p>{words(4, 30)}</p>", menu(), f"&copy; {word()} &middot; {words(3, 12)}"]),
            "aside": lambda: r.choice([f"<h3>{words(1, 4)}</h3>{menu()}", f"<p>{words(5, 60)}</p>", words(5, 40)]),
            "div": lambda: r.choice([words(3, 40), f"<p>{words(4, 40)}</p>", f"<p>{words(3, 20)}</p>{link()}", f"<span>{words(2, 14)}</span>"]),
            "section": lambda: f"<h2>{words(1, 3)}</h2>" + "".join(f'<div class="{r.choice(["comment", "reply"])}"><p>{words(3, 50)}</p></div>' for _ in range(r.randint(1, 5))) if r.random() < 0.6 else "".join(f"<p>{words(1, 40)}</p>" for _ in range(r.randint(1, 4))),
            "form": lambda: f"<label>{words(1, 4)}</label><input name=q><p>{words(1, 10)}</p>",
        }[tag]()
        return f'<{own}{hint} data-y="0">{inside}</{own}>'

    def named() -> str:
        """A class or id that tells nothing, or none."""
        return r.choice(["", "", "", f' class="{word()}"', f' id="{word()}"', f' class="{r.choice(["row", "col", "inner", "wrap", "box", "block", "text", "para", "paragraph", "x1"])}"'])

    def nested(inside: str) -> str:
        """inside in divs, few or many."""
        depth = r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2, 3, 6, r.randint(10, 60)])
        return "".join(f"<div{named()}>" for _ in range(depth)) + inside + "</div>" * depth

    def short() -> list[str]:
        """An article of a few blocks, of which each may stand in a div of its own."""
        wrap = r.choice([lambda x: f"<p{named()}>{x}</p>", lambda x: f"<p>{x}</p>", lambda x: f"<p>{x}</p>", lambda x: f"<div{named()}>{x}</div>", lambda x: f"<div{named()}><p>{x}</p></div>", lambda x: r.choice([f"<p>{x}</p>", f"<div>{x}</div>"])])
        blocks = [wrap(words(1, r.choice([4, 12, 30, 90]))) for _ in range(r.choice([1, 1, 1, 1, 2, 2, 3, 4, 6, 10]))]
        return ([f"<h1>{words(1, 9)}</h1>"] if r.random() < 0.5 else []) + blocks

    def small_article() -> str:
        inner = "".join(short())
        while r.random() < 0.5:
            inner += other(r.choice(["section", "section", "section", "section", "div", "aside", "form"]))
        kind = r.choice(["article", "article", "article", "article", "main", "main", "div", "section", ""])
        if not kind:  # blocks straight in the body, each labelled
            return "".join(re.sub(r"^<(\w+)", r'<\1 data-y="1"', block) for block in short())
        hint = "" if kind in ("article", "main") and r.random() < 0.8 else r.choice([' class="content"', ' class="post"', ' class="entry text"', ' id="main"', named()])
        return f'<{kind}{hint} data-y="1">{nested(inner)}</{kind}>'

    def article() -> str:
        if r.random() < 0.6:
            return small_article()
        inner = [f"<h1>{words(3, 12)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.2:
            inner = [f"<header>{''.join(inner)}<p>{words(4, 20)}</p></header>"]
        for _ in range(r.randint(1, 14)):
            inner.append(
                r.choices(
                    [
                        lambda: f"<p>{words(1, 160)}</p>",
                        lambda: f"<p><b>{words(2, 40)}<br>",
                        lambda: f"<p>{words(5, 60)} {link()} {words(5, 60)} <em>{words(1, 4)}</em></p>",
                        lambda: f"<h2>{words(1, 8)}</h2>",
                        lambda: "<ul>" + "".join(f"<li>{words(2, 30)}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
                        lambda: f"<blockquote><p>{words(5, 60)}</p></blockquote>",
                        lambda: f"<div>{words(5, 100)}</div>",
                        lambda: f"<div><p>{words(2, 60)}</p><p>{words(2, 60)}</p></div>",
                        lambda: f"<section><h3>{words(1, 6)}</h3><p>{words(8, 90)}</p></section>",
                        lambda: f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>",
                        lambda: f"<pre><code>{words(3, 40)}</code></pre>",
                        lambda: f"<figure><figcaption>{words(3, 15)}</figcaption></figure>",
                        lambda: other(r.choice(["div", "aside", "form", "nav", "footer"])),
                    ],
                    [12, 2, 4, 2, 2, 1, 1, 2, 1, 1, 1, 1, 1.5],
                )[0]()
            )
        if r.random() < 0.25:
            inner.append(other("section"))
        kind = r.choices(["<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post entry">', '<div class="article body text">', '<div class="story">', "<section>"], [8, 3, 2, 1, 2, 1, 1, 1])[0]
        if '"' in kind and r.random() < 0.4:
            kind = kind.replace('">', r.choice([" box", " wrap", " x", " column"]) + '">')
        return kind.replace(">", ' data-y="1">') + "".join(inner) + f"</{kind[1:].split()[0].rstrip('>')}>"

    pages = []
    for _ in range(count):
        if r.random() < 0.12:  # a fragment, or a body with nothing else in it
            inside = r.choice(["".join(short()), words(1, r.choice([4, 30, 90])), f"<p>{words(1, 40)} <b>{words(1, 40)}"])
            pages.append(r.choice([inside, inside, f'<html data-y="0"><head><title>{words(2, 8)}</title></head><body data-y="1">{inside}</body></html>']))
            continue
        before = [other(r.choice(["nav", "header", "div", "form", "aside"])) for _ in range(r.randint(0, 4))]
        after = [other(r.choice(["aside", "section", "div", "footer", "nav", "form"])) for _ in range(r.randint(0, 4))]
        if r.random() < 0.7:
            before.insert(0, f'<nav data-y="0">{menu()}</nav>')
            after.append(other("footer"))
        if r.random() < 0.1:  # nothing else on the page
            before, after = [], []
        body = "".join([*before, article(), *after])
        if r.random() < 0.4:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "layout"])}">{body}</div>'
        pages.append(f'<!DOCTYPE html><html data-y="0"><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>')
    return pages


_LABEL = re.compile(r'data-y="([01])"')


def fit(pages: list[str], rounds: int = 60, rate: float = 0.5) -> tuple[dict[str, float], list[list[float]]]:
    """Weights that raise the likelihood of the labels: gradients are observed less expected counts."""
    trees = []
    for html in pages:
        marks = iter([m[1] if (m := _LABEL.search(t[0])) else None for t in _TAG.finditer(html) if (t["name"] and not t["end"] and t["name"].lower() not in VOID)])
        nodes, parts = parse(html)
        nodes[0].label = int(not _LABEL.search(html))
        for node in nodes[1:]:
            mark = next(marks, None)
            node.label = nodes[node.parent].label if mark is None else int(mark)
        _measure(nodes, parts)
        trees.append(nodes)
    unary: dict[str, float] = defaultdict(float)
    tie = [[0.5, 0.0, 0.0, 0.5], [1.0, 0.0, 0.0, 1.0]]
    total = sum(map(len, trees))
    moved: dict[str, float] = defaultdict(float)
    shift = [[0.0] * 4, [0.0] * 4]
    for _ in range(rounds):
        grad: dict[str, float] = defaultdict(float)
        pair = [[0.0] * 4, [0.0] * 4]
        for nodes in trees:
            p = propagate(nodes, unary, tie)
            for node, q in zip(nodes, p, strict=True):
                for f in features(node):
                    grad[f] += node.label - q
            for i, node in enumerate(nodes[1:], 1):
                up, kind = nodes[node.parent], _kind(node)
                pair[kind][2 * up.label + node.label] += 1
                # The pair's marginal: the child's odds under each state of the parent.
                a, b, c, d = tie[kind]
                on1, on0 = 1 / (1 + math.exp(-(d - c + node.odds))), 1 / (1 + math.exp(-(b - a + node.odds)))
                x = p[node.parent]
                for k, v in enumerate(((1 - x) * (1 - on0), (1 - x) * on0, x * (1 - on1), x * on1)):
                    pair[kind][k] -= v
        for f, g in grad.items():
            g = g / total - 0.00003 * unary[f]
            moved[f] += g * g
            unary[f] += rate * g / (math.sqrt(moved[f]) + 1e-6)
        for kind in (0, 1):
            for k in range(4):
                g = pair[kind][k] / total - 0.00003 * tie[kind][k]
                shift[kind][k] += g * g
                tie[kind][k] += rate * g / (math.sqrt(shift[kind][k]) + 1e-6)
    return dict(unary), tie


@functools.lru_cache(maxsize=1)
def trained() -> tuple[dict[str, float], list[list[float]]]:
    return fit(labelled_pages())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model=None) -> DataFrame:
    """One row per row of pages: id_col, the columns in keep, text (empty if none), n_chars (its code points).

    Null and empty pages have an empty text; broken markup is read as browsers do, unclosed comments and raw elements
    reach the end. Pages of any length and depth are read whole. Repeated rows, ties and null ids stay as they are; other columns are left
    out, whatever their names. An empty table gives an empty one.
    """
    model = model or trained()
    rows = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("_html"), F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])

    def run(batches):
        for batch in batches:
            for at, count in slices(batch.column(0)):
                part = batch.slice(at, count)
                texts = [extract_text(h, model) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", *[f"_{i}" for i in range(len(keep))], "text", "n_chars"])

    types = dict(rows.dtypes)
    schema = ", ".join([f"_id {types['_id']}", *[f"_{i} {types[f'_{i}']}" for i in range(len(keep))], "text string", "n_chars long"])
    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
