"""Operator 5: main text of web pages by a tree-structured graphical model.

Each DOM node is content or not. A logistic model of the node's own features gives its potential:
its kind of tag, its size, links and sentences, and the words of its class, id and role, whose weights
are learned like all others. A table by kind of tag gives the potential of a parent and child;
sum-product messages up and down the tree give exact marginals in two passes. Both are trained on
labelled pages. The tables hold none, so ``labelled_pages`` writes a bounded, seeded set: skeletons
in many variants, with and without names, whose containers carry the label.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_blocks
from .htmltree import Node, Tree, parse

TRAIN_PAGES = 1000
#: Pages of the training set that a name must be on to get a weight.
NAMED_PAGES = 4
GROUPS = ("page", "main", "paragraph", "heading", "box", "list", "item", "table", "cell", "quote", "nav", "form", "control", "link", "inline", "raw")
_GROUP_OF = {
    **dict.fromkeys(("#page", "html", "body"), "page"), **dict.fromkeys(("article", "main"), "main"),
    **dict.fromkeys(("p", "address", "center"), "paragraph"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "heading"),
    **dict.fromkeys(("div", "section", "details", "summary", "figure", "header"), "box"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "item"), **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr"), "table"),
    **dict.fromkeys(("td", "th", "caption"), "cell"),
    **dict.fromkeys(("blockquote", "pre", "figcaption"), "quote"), **dict.fromkeys(("nav", "footer", "aside", "search"), "nav"),
    **dict.fromkeys(("form", "fieldset", "legend", "dialog"), "form"), **dict.fromkeys(("button", "label", "select", "option"), "control"), "a": "link",
    **dict.fromkeys(("head", "script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "noembed", "noframes", "xmp"), "raw"),
}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GROUP_INDEX = {g: i for i, g in enumerate(GROUPS)}
_ENTRIES = {_GROUP_INDEX[g] for g in ("box", "item", "main")}


@functools.lru_cache(maxsize=4096)
def _words(value: str) -> tuple[str, ...]:
    return tuple(sorted({w.lower() for w in _NAME.findall(value)}))


def names(node: Node) -> tuple[str, ...]:
    """A node's tag, and the words of its class, id and role."""
    if not node.attrs:
        return (f"<{node.tag}>",)
    return (f"<{node.tag}>", *_words(" ".join((node.attrs.get("class", ""), node.attrs.get("id", ""), node.attrs.get("role", "")))))


def _group(node: Node) -> int:
    return _GROUP_INDEX[_GROUP_OF.get(node.tag, "inline")]


_CONTROLS = ("button", "input", "select", "textarea")
_SIGNED = ("b", "strong", "span", "a", "cite", "time", "img", "em", "i", "small")


def _signals(tree: Tree) -> tuple[list[int], list[float]]:
    """Of each node how many controls are in it, and how many of its siblings are signed entries like it: the same
    tag and children, the first of them a name or mark, with text or blocks after it. Four are a full 1."""
    n = len(tree.nodes)
    controls = [int(v.tag in _CONTROLS) for v in tree.nodes]
    tags: list[list[str]] = [[] for _ in range(n)]
    for i in range(1, n):
        tags[tree.nodes[i].parent].append(tree.nodes[i].tag)
    for i in range(n - 1, 0, -1):
        controls[tree.nodes[i].parent] += controls[i]
    shapes = [(v.parent, v.tag, *tags[i]) if i and len(tags[i]) > 1 and tags[i][0] in _SIGNED and _group(v) in _ENTRIES else None for i, v in enumerate(tree.nodes)]
    count = Counter(s for s in shapes if s)
    return controls, [min(1.0, (count[s] - 1) / 3) if s else 0.0 for s in shapes]


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all nodes, names apart, and their tag groups."""
    n = len(tree.nodes)
    links, stops, texts, marks = [0] * n, [0] * n, [0] * n, [0.0] * n
    before, seen = [-1] * n, 0
    for _, node, t, linked in tree.runs:
        size = len(t.strip())
        texts[node] += size
        links[node] += size if linked else 0
        stops[node] += t.count(". ") + t.count(".\n") + t.rstrip().endswith((".", "!", "?", "…", "。"))
        marks[node] = max(marks[node], float("©" in t))
        before[node] = seen if before[node] < 0 else before[node]
        seen += size
    own_stops, below, first = stops[:], texts[:], before[:]
    for i in range(n - 1, 0, -1):
        parent = tree.nodes[i].parent
        below[parent] += below[i]
        stops[parent] += stops[i]
        links[parent] += links[i]
        marks[parent] = max(marks[parent], 0.5 * marks[i])
        if first[i] >= 0 and (first[parent] < 0 or first[i] < first[parent]):
            first[parent] = first[i]
    controls, twins = _signals(tree)
    total, prose = max(1, below[0]), max(1, below[0] - links[0])
    entries = [False] * n  # whether signed entries are among a node's children
    for i in range(1, n):
        entries[tree.nodes[i].parent] |= twins[i] > 0
    rows, groups = [], []
    form, hidden, linky = [False] * n, [False] * n, [0.0] * n
    for i, node in enumerate(tree.nodes):
        up = node.parent if i else 0
        style = node.attrs.get("style", "").replace(" ", "").lower() if node.attrs else ""
        hidden[i] = (i > 0 and hidden[up]) or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        g = _group(node)
        form[i] = (i > 0 and form[up]) or GROUPS[g] == "form"
        size = below[i]
        linky[i] = links[i] / max(1, size)
        row = [0.0] * len(GROUPS)
        row[g] = 1.0
        rows.append(row + [
            float(hidden[i]), float(form[i]), float(GROUPS[g] == "control" and form[i]), float(node.tag in ("header", "address")), float(len(names(node)) > 1),
            math.log1p(size) / 8, size / total, (size - links[i]) / prose, linky[i], linky[up], float(linky[i] > 0.6), min(1.0, 60 * stops[i] / max(60, size)),
            float(own_stops[i] > 0), math.log1p(texts[i]) / 8, float(texts[i] > 0 and size < 40), marks[i],
            float(node.tag == "a" and linky[up] > 0.6), float(node.tag == "a" and 2 * texts[up] < below[up]), float(node.tag == "a" and texts[up] == 0),
            float(controls[i] > 0 and size < 300), float(controls[up] > 0 and below[up] < 300), twins[i], twins[up], float(i > 0 and entries[up]),
            max(0, first[i]) / total, float(first[i] + size >= 0.97 * total and size < 0.2 * total), float(size == 0), 1.0,
        ])
        groups.append(g)
    return np.array(rows), np.array(groups)


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray  # group of the child x parent's state x child's state, log
    named: dict[str, tuple[float, float]]  # weights of a name, on the node itself and on one around it

    def unary(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of content of each node by itself, and the nodes' groups."""
        x, groups = features(tree)
        around, named = [0.0] * len(groups), np.zeros(len(groups))
        for i, node in enumerate(tree.nodes):
            on, below = 0.0, around[node.parent] if i else 0.0
            named[i] = below
            for w in names(node):
                a, b = self.named.get(w, (0.0, 0.0))
                on, below = on + a, below + b
            named[i] += on
            around[i] = below
        return np.clip(x @ self.weights + named, -30, 30), groups

    def marginals(self, tree: Tree) -> np.ndarray:
        """Probability of content of every node: messages from the leaves to the root and back."""
        unary, groups = self.unary(tree)
        odds = unary.tolist()  # log-odds of content from the node and what is below it
        pair = self.pair.tolist()
        n, parents, gs = len(odds), [v.parent for v in tree.nodes], groups.tolist()
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            p, o = pair[gs[i]], odds[i]
            up[i] = _add(p[1][0], p[1][1] + o) - _add(p[0][0], p[0][1] + o)
            odds[parents[i]] += up[i]
        belief = [0.0] * n
        belief[0] = odds[0]
        for i in range(1, n):
            p, above = pair[gs[i]], belief[parents[i]] - up[i]
            belief[i] = odds[i] + _add(p[0][1], p[1][1] + above) - _add(p[0][0], p[1][0] + above)
        return 1 / (1 + np.exp(-np.clip(belief, -500, 500)))


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[str]) -> Model:
    """A model from pages whose elements carry ``data-y`` (0 or 1), which holds for all below that
    have none of their own; a node without text of its own takes the majority below it."""
    xs, gs, ys, parents, offset = [], [], [], [], 0
    words: list[tuple[str, ...]] = []
    on_pages: Counter[str] = Counter()
    for page in pages:
        tree = parse(page)
        x, g = features(tree)
        label, mass = [0] * len(g), [[0, 0] for _ in g]
        for i, node in enumerate(tree.nodes):
            label[i] = int(node.attrs.get("data-y", label[node.parent] if i else 0))
            mass[i][label[i]] += node.own
        for i in range(len(g) - 1, 0, -1):
            for k in (0, 1):
                mass[tree.nodes[i].parent][k] += mass[i][k]
        label = [y if node.own else int(m[1] > m[0]) for y, node, m in zip(label, tree.nodes, mass)]
        xs.append(x), gs.append(g), ys.append(label)
        parents.append([v.parent + offset if i else -1 for i, v in enumerate(tree.nodes)])
        offset += len(g)
        own = [names(v) for v in tree.nodes]
        words += own
        on_pages.update({w for ws in own for w in ws})
    x, g, y, up = np.concatenate(xs), np.concatenate(gs), np.concatenate(ys), np.concatenate(parents)
    column = {w: x.shape[1] + i for i, w in enumerate(sorted(w for w, k in on_pages.items() if k >= NAMED_PAGES))}
    k, m = x.shape[1], len(column)
    x = np.concatenate([x, np.zeros((len(x), 2 * m))], axis=1)
    for i, ws in enumerate(words):
        x[i, [column[w] for w in ws if w in column]] = 1.0
        if up[i] >= 0:
            x[i, k + m :] = x[up[i], k : k + m] + x[up[i], k + m :]
    pair = np.full((len(GROUPS), 2, 2), 1.0)
    has = up >= 0
    np.add.at(pair, (g[has], y[up[has]], y[has]), 1.0)
    prior = pair.sum(axis=1, keepdims=True)
    pair = np.log(pair / pair.sum(axis=2, keepdims=True)) - np.log(prior / prior.sum(axis=2, keepdims=True))
    w = np.zeros(x.shape[1])
    for _ in range(15):  # Newton's steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1.0 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-2:
            break
    return Model(w[:k], pair, {c: (float(w[i]), float(w[i + m])) for c, i in column.items()})


_SYLLABLES = "an be cha do en fil gor ha in ka lor mi na ol per qui ra st tu ver wen xi yo zu é ü ñ ç ка но 日 の".split()


#: Names that sites give to parts of a page, and names that any part can have.
PART_NAMES = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense outbrain taboola",
    "notice": "cookie cookies cookie-notice consent notice notices alert gdpr popup modal overlay privacy-banner",
    "side": "sidebar side-bar side rail widget related recommended secondary more-stories related-posts trending popular",
    "comments": "comments comment-list reader-comments discussion replies responses disqus respond comment feedback reviews",
    "form": "search newsletter subscribe login signup register search-form subscription newsletter-signup contact-form",
    "crumbs": "breadcrumb breadcrumbs crumbs share sharing social social-share tags byline meta post-meta author-box pagination pager categories",
    "menu": "nav navbar navigation menu menubar main-menu toolbar site-nav links toc topnav",
    "head": "header masthead site-header top branding page-header topbar",
    "foot": "footer foot bottom site-footer copyright legal colophon disclaimer page-footer",
    "main": "article content entry main post story article-body entry-content post-content prose page-content blog-post document text body",
    "any": "page container wrapper wrap inner outer row col column box section block list items steps note lead intro table figure left right center clearfix grid layout group",
}


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 12) -> list[str]:
    """Seeded pages in varied skeletons; ``data-y`` marks main text and all else. A third of them have
    few names or none: there only tags, links and sentences tell the parts from each other."""
    rng = random.Random(seed)
    pick = rng.choice
    known = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(5000)]
    word = lambda: pick(known)
    words = lambda a, b: " ".join(rng.choices(known, k=rng.randint(a, b)))
    sentence = lambda a=3, b=25: words(a, b).capitalize() + pick(".....!?")

    def para() -> str:
        if rng.random() < 0.08:  # text without sentences
            return pick((words(20, 200), " ".join([word()] * rng.randint(5, 400)), words(1, 2)))
        return " ".join(sentence() for _ in range(pick((1, 1, 2, 4, 8, 14, 40))))

    maybe = lambda p, make: make() if rng.random() < p else ""
    bare = False  # whether the page at hand names its parts

    def links(k: int) -> str:
        one = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
        shape = pick(("<ul>{}</ul>", "<ul>{}</ul>", "{}", "<p>{}</p>", "<ol>{}</ol>"))
        joint = pick((" | ", " ", "<br>", " &middot; "))
        return shape.format("".join(f"<li>{one()}</li>" for _ in range(k)) if "l>" in shape else joint.join(one() for _ in range(k)))

    turns = {part: itertools.cycle(rng.sample(ns.split(), len(ns.split()))) for part, ns in PART_NAMES.items()}

    def named(part: str) -> str:
        name = next(turns[part])
        return " " + pick((f'class="{name}"', f'id="{name}"', f'class="{word()} {name}-{rng.randint(1, 9)}"', f'class="{name} {word()}"', f'class="{pick(PART_NAMES["any"].split())} {name}"'))

    def any_name() -> str:
        return maybe(0.5, lambda: f' class="{pick((word(), pick(PART_NAMES["any"].split())))}"')

    def box(part: str, inside: str, tags: str = "div", sure: str = "") -> str:
        """A part that isn't main text: by a name, or in a bare page by the tag ``sure`` of such parts."""
        if bare:
            return f'<{sure} data-y="0">{inside}</{sure}>' if sure else ""
        tag = pick(tags.split())
        return f'<{tag}{named(part)} data-y="0">{inside}</{tag}>'

    def inline(t: str) -> str:
        ws = t.split(" ")
        if len(ws) > 4 and rng.random() < 0.35:
            i = rng.randrange(len(ws))
            ws[i] = pick((
                f"<b>{ws[i]}</b>", f'<a href="/{word()}">{ws[i]}</a>', f"<em>{ws[i]}</em>", f'<span class="{word()}">{ws[i]}</span>', f"<label>{ws[i]}</label>",
                f"<button>{ws[i]}</button>", f'<span class="{pick(PART_NAMES["any"].split())}">{ws[i]}</span>', f'<a class="{word()}" href="/">{ws[i]}</a>', f'<code class="{word()}">{ws[i]}</code>',
            ))
        return " ".join(ws)

    def content() -> str:
        lists = lambda item: "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 5)))
        kinds = [lambda: f"<p{maybe(0.1, any_name)}>{inline(para())}</p>"] * 9 + [
            lambda: f"<h2>{words(1, 6)}</h2>", lambda: f"<h3{any_name()}>{words(1, 6)}</h3>", lambda: f"<blockquote><p>{para()}</p></blockquote>", lambda: f"<blockquote>{para()}</blockquote>",
            lambda: f"<ul{any_name()}>{lists(sentence)}</ul>", lambda: f"<ol{any_name()}>{lists(lambda: words(2, 9))}</ol>", lambda: f"<ul{any_name()}>{lists(lambda: inline(para()))}</ul>",
            lambda: f"<dl><dt>{words(1, 3)}</dt><dd>{sentence()}</dd></dl>", lambda: f"<div{any_name()}>{inline(para())}</div>", lambda: f"<div{any_name()}>{para()}</div>", lambda: f"<pre>{words(3, 20)}</pre>",
            lambda: f"<table{any_name()}><tr><th>{words(1, 2)}</th><td>{words(1, 6)}</td></tr><tr><td>{words(1, 3)}</td><td>{sentence()}</td></tr></table>",
            lambda: f"<p><b>{sentence()}<br>", lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>", lambda: f"<section{any_name()}><h3>{words(1, 5)}</h3><p>{para()}</p></section>",
            lambda: f"{para()}<br><br>{para()}<br>",
            lambda: "".join(f"<div{any_name()}><b>{sentence(3, 9)}</b><p>{para()}</p></div>" for _ in range(rng.randint(2, 5))),
            lambda: f"<ul>{lists(lambda: f'<b>{words(1, 3)}</b> {sentence()} <i>{words(1, 3)}</i>')}</ul>",
        ]
        return pick(kinds)()

    def comments() -> str:
        if bare:  # signed entries of one shape, without a name
            tag, sign = pick(("div", "div", "li", "section", "article")), pick(("<b>{}</b>", "<strong>{}</strong>", "<span>{}</span>", '<a href="/u">{}</a>', "<b>{}</b><small>{}</small>", "<b>{}</b> <time>{}</time>"))
            entry = lambda: f"<{tag}>{sign.format(words(1, 2), rng.randint(1, 28))}<p>{para()}</p></{tag}>"
            entries = "".join(entry() for _ in range(rng.randint(2, 6)))
            entries = f"<ul>{entries}</ul>" if tag == "li" else pick((entries, entries, f"<div>{entries}</div>"))
            level, wrap = pick(("h2", "h3", "h3", "h4", "p")), pick(("div", "div", "section"))
            title = maybe(0.75, lambda: f"<{level}>{maybe(0.6, lambda: str(rng.randint(2, 40)))} {words(1, 2)}</{level}>")
            return f'<{wrap} data-y="0">{title}{entries}</{wrap}>'
        each = lambda: pick((f'<div class="comment"><p>{para()}</p></div>', f"<article{named('comments')}><b>{word()}</b><p>{para()}</p></article>", f"<li><p>{para()}</p></li>", f"<p>{para()}</p>"))
        return box("comments", maybe(0.6, lambda: f"<h3>{words(1, 3)}</h3>") + "".join(each() for _ in range(rng.randint(1, 5))), "section div ol")

    ad = lambda: box("ad", pick((sentence(), para(), f'<p>{sentence()}</p><a href="/x">{words(1, 3)}</a>')), "div div aside p section")
    def asked() -> str:
        """A notice or a form without a name: a few words and what to press or to fill in."""
        more = pick((f"<button>{word()}</button>", f'<button>{word()}</button> <a href="/p">{words(1, 3)}</a>', f'<input name="e"><button>{word()}</button>', '<input type="text"> <input type="submit">'))
        text = " ".join(sentence(3, 14) for _ in range(rng.randint(1, 3)))
        return f'<div data-y="0">{pick((text, f"<p>{text}</p>", f"<span>{text}</span>"))} {more}</div>'

    notice = lambda: asked() if bare else box("notice", pick((para(), f"<p>{para()}</p>")) + maybe(0.5, lambda: f"<button>{word()}</button>"))
    side = lambda: box("side", f"<h3>{words(1, 3)}</h3>" + pick((links(4), f"<p>{para()}</p>", f"<p>{sentence()}</p>" + links(3))), "aside div div section", "aside")
    crumbs = lambda: box("crumbs", pick((words(2, 8), links(3), sentence())), "div p ul span")
    menu = lambda: box("menu", links(rng.randint(3, 9)), "div div ul nav", pick(("nav", "div", "div")))
    form = lambda: f'<form{"" if bare else named("form")} data-y="0"><label>{words(1, 4)}</label><input name="q"><p>{sentence()}</p><select><option>{word()}</option></select><button>{word()}</button></form>'
    rights = lambda: pick((f"&copy; {rng.randint(1998, 2026)} {words(1, 3)}. {sentence()}", f"© {word()}", f"&copy; {word()} &middot; {para()}"))
    out = []
    for k in range(n):
        bare = k % 3 == 0
        body = [maybe(0.8, lambda: f"<h1>{words(2, 12)}</h1>")]
        for _ in range(pick((1, 2, 2, 4, 7, 12))):
            body.append(content())
            body.append(maybe(0.06, ad) + maybe(0.03, notice) + maybe(0.03, crumbs) + maybe(0.02, form))
        if rng.random() < 0.08:
            body[0] = f"<header>{body[0] or f'<h1>{words(2, 6)}</h1>'}</header>"
        if bare:  # what ends a page can be text as well
            body += [f'<{t}>{" ".join(sentence(3, 12) for _ in range(rng.randint(1, 4)))}</{t}>' for t in rng.choices(("div", "p", "div"), k=pick((0, 0, 1, 2)))]
        tail = maybe(0.15, comments) + maybe(0.08, crumbs)
        inner = "".join(body) + tail
        if bare:
            shape = pick(("{}", "{}", "<div{n}>{}</div>", "<div><div>{}</div></div>", "<article>{}</article>", "<main>{}</main>", "<section>{}</section>"))
            main = f'<body data-y="1">{inner}' if shape == "{}" else '<body data-y="0">' + shape.replace("{n}", any_name()).format(inner).replace(">", ' data-y="1">', 1)
        else:
            tag, name = pick((("article", ""),) * 4 + (("main", ""),) + (("article", named("main")), ("div", named("main")), ("div", named("main")), ("section", named("main")), ("main", named("main"))))
            main = f'<{tag}{name} data-y="1">{inner}</{tag}>'
            main = pick((main, main, f"<main>{main}</main>", f"<div{any_name()}>{main}</div>", f"<div{any_name()}><div{any_name()}>{main}</div></div>"))
        link_box = lambda: f'<div data-y="0">{links(rng.randint(1, 9))}</div>'
        hidden = lambda: pick(('<div style="display:none" data-y="0">{}</div>', '<p hidden data-y="0">{}</p>', '<ul aria-hidden="true" data-y="0"><li>{}</li></ul>')).format(pick((para(), sentence(), words(1, 4))))
        loose = lambda: pick((" | ", " ", "<br>")).join(f'<a href="/{word()}" data-y="0">{words(1, 3)}</a>' for _ in range(rng.randint(1, 4)))
        head = lambda: pick(("<header{} data-y=\"0\">{}</header>", "<div{} data-y=\"0\">{}</div>")).format(named("head"), pick((f"<p>{sentence()}</p>", f"<a href='/'>{words(1, 3)}</a>", f"<p>{words(1, 5)}</p><nav>{links(4)}</nav>", f"<h2>{words(1, 3)}</h2>")))
        if bare:
            if shape == "{}" and rng.random() < 0.3:  # a column of links in a table
                main = f'<body data-y="0"><table><tr><td data-y="0">{links(rng.randint(3, 9))}</td><td data-y="1">{inner}</td></tr></table>'
            top = [maybe(0.1, hidden), maybe(0.15, loose), maybe(0.25, asked), maybe(0.3, lambda: f'<nav data-y="0">{links(rng.randint(3, 8))}</nav>'), maybe(0.35, link_box), maybe(0.15, form)]
            end = [maybe(0.2, loose), maybe(0.3, link_box), maybe(0.2, side), maybe(0.1, form), maybe(0.25, asked), maybe(0.3, comments)]
            foot = pick(("", f'<footer data-y="0">{rights()}</footer>', f'<p data-y="0">{rights()}</p>', f'<div data-y="0">{rights()}</div>', f'<hr><div data-y="0">{links(4)} {rights()}</div>'))
        else:
            top = [maybe(0.1, hidden), maybe(0.1, loose), maybe(0.7, lambda: f'<nav data-y="0">{links(rng.randint(3, 8))}</nav>'), maybe(0.4, head), maybe(0.15, lambda: f"<header data-y=\"0\"><a href='/'>{words(1, 3)}</a><p>{sentence()}</p></header>"), maybe(0.6, ad), maybe(0.4, notice), maybe(0.2, form), maybe(0.3, crumbs), maybe(0.4, menu)]
            end = [maybe(0.5, side), maybe(0.4, comments), maybe(0.3, ad), maybe(0.3, notice), maybe(0.15, form), maybe(0.3, crumbs), maybe(0.1, menu)]
            foot = maybe(0.8, lambda: pick(('<footer data-y="0">{}</footer>', '<footer data-y="0">{}</footer>', "<div" + named("foot") + ' data-y="0">{}</div>', "<div" + named("foot") + ' data-y="0"><p>{}</p></div>')).format(pick((rights(), rights(), para(), links(4) + sentence()))))
        rng.shuffle(top), rng.shuffle(end)
        page = "".join(top) + (main[main.index(">") + 1 :] if bare else main) + "".join(end) + foot
        start = main[: main.index(">") + 1] if bare else "<body>"
        if bare and k % 4 == 0:  # a fragment, without a head or body
            out.append(f'<p data-y="1">{para()}</p>' * rng.randint(0, 2) + "".join(x.replace(">", ' data-y="1">', 1) for x in body if x.startswith("<p") and "<b>" not in x) + maybe(0.5, link_box))
            continue
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head>{start}{page}" + maybe(0.9, lambda: "</body></html>"))
    return out


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(page: str | None, model: Model | None = None) -> str:
    """Main text of a page: blocks whose nodes are content, in page order, white space inside a
    block as one space, joined by newlines; empty if there are none."""
    if not page:
        return ""
    tree = parse(page)
    content = (model or default_model()).marginals(tree) > 0.5
    raw = np.array([_group(v) == _GROUP_INDEX["raw"] for v in tree.nodes])
    for i, node in enumerate(tree.nodes):
        if i and raw[node.parent]:
            raw[i] = True
    keep = content & ~raw
    blocks: dict[int, list[str]] = {}
    for block, node, t, _ in tree.runs:
        if keep[node]:
            blocks.setdefault(block, []).append(t)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "html"):
            texts = [extract(p, model) for p in b.column("html").to_pylist()]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), sizes], [*keep, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages(page_id, url, html, ...)`` to ``(page_id, url, text, n_chars)``, a row per input row.

    A null or empty page, or one without main text, has an empty text. Null ids and repeated rows
    stay as they are, other columns are not read, an empty table gives an empty result."""
    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(
        _extract(model or default_model(), ["page_id", "url"]),
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long",
    )
