"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed into a tree of block elements whose leaves are runs of text. Every node has a hidden state, content or
boilerplate. Node potentials are log-linear in tag, class and id tokens, role, text length, link density and place;
parent-child potentials connect each node with its parent. The tree makes sum-product exact: one pass upward and one
downward give the marginal of every node, and leaves with a content marginal of at least one half are the text.

The weights are trained from labelled pages by gradient steps on the exact likelihood (the same two passes give the
expectations). Labelled pages may be given as (html, set of content blocks); by default a fixed, seeded set of
``TRAINING_PAGES`` pages is built by rule from the names that layouts customarily use, each block labelled by the part
it was written for. The model is trained once per driver process and sent to the tasks (about 1,000 numbers); pages
are parsed and scored in their own partition, so nothing is shuffled. Half of the pages built by rule have layouts
without customary names: hashed class names, no or many wrappers, columns, layout tables, one form around all.

Output: character references decoded, white space inside a block to one space, blocks in page order joined by one
space; nothing is cut. Scripts, styles, comments, head, form fields (textarea, button, select) and elements that say they
are not shown (hidden, display:none, visibility:hidden) never become text.

Defined cases: null, empty or textless pages have the text ""; unclosed, misnested and unknown tags are repaired by
closing rules, an unclosed comment ends with the page; a marginal of exactly one half counts as content; depth is not limited (no recursion); repeated rows keep one row
each; columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import ship

TRAINING_PAGES, EPOCHS, SEED = 1200, 8, 11

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("script style template noscript title svg math iframe object canvas".split())
#: Form fields whose inside is no text of the page; one that is never closed hides nothing.
FIELDS = frozenset("textarea button select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An element that starts closes an open element of these kinds, up to the given border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOT_IN_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "names", "parent", "text", "chars", "linked", "leaves", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, depth: int):
        self.tag, self.names, self.parent, self.depth = tag, names, parent, depth
        self.text: str | None = None
        self.chars = self.linked = self.leaves = 0


def _names(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            found.append("role=" + value.lower())
        elif key in ("class", "id"):
            found += re.findall(r"[a-z]{2,}", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(found)


def _hidden(attributes: str) -> bool:
    """Whether an element says of itself that it is not shown."""
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key == "hidden" or key == "style" and NOT_SHOWN.search(m[2] or m[3] or m[4] or ""):
            return True
    return False


def parse(html: str | None) -> list[Node]:
    """Nodes of a page, parents before children; text runs are leaves with tag ``#text``."""
    nodes = [Node("#root", (), -1, 0)]
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # open elements; an inline one keeps the number of its block
    run: list[str] = []
    run_linked = links = dark = 0

    def flush() -> None:
        nonlocal run, run_linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                at = stack[-1][1]
                leaf = Node("#text", (), at, nodes[at].depth + 1)
                leaf.text, leaf.chars, leaf.linked, leaf.leaves = text, len(text), min(run_linked, len(text)), 1
                nodes.append(leaf)
            run, run_linked = [], 0

    def close(to: int) -> None:
        nonlocal links, dark
        while len(stack) > to:
            tag, _, hidden = stack[-1]
            if tag not in INLINE:
                flush()
            elif tag == "a":
                links -= 1
            dark -= hidden
            stack.pop()

    def add(text: str) -> None:
        nonlocal run_linked
        if text and not dark:
            text = unescape(text)
            run.append(text)
            if links:
                run_linked += len(text.strip())

    html = html or ""
    place, end = 0, len(html)
    while place < end:
        m = TAG.search(html, place)
        if m is None:
            add(html[place:])
            break
        add(html[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes its element if that is open
            if tag == "head":
                close(1)
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag in ("p", "br"):
                    flush()
            continue
        if tag in INVISIBLE:
            if not m[3].endswith("/"):
                e = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, place)
                place = e.end() if e else end
            continue
        if tag in FIELDS:
            e = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, place)
            if e:
                run.append(" ")
                place = e.end()
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                close(1)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                run.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in INLINE:
            if not m[3].endswith("/"):
                hidden = _hidden(m[3])
                links += tag == "a"
                dark += hidden
                stack.append((tag, stack[-1][1], hidden))
            continue
        if tag in NOT_IN_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in CLOSES:
            ends, border = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
        flush()
        nodes.append(Node(tag, _names(m[3]), stack[-1][1], nodes[stack[-1][1]].depth + 1))
        hidden = _hidden(m[3])
        dark += hidden
        stack.append((tag, len(nodes) - 1, hidden))
    close(1)
    flush()
    for n in reversed(nodes[1:]):
        p = nodes[n.parent]
        p.chars += n.chars
        p.linked += n.linked
        p.leaves += n.leaves
    kept = {i: k for k, i in enumerate(i for i, n in enumerate(nodes) if n.leaves)}
    out = [nodes[i] for i in kept]
    for n in out:
        n.parent = kept.get(n.parent, -1)
    return out


def describe(nodes: list[Node]) -> list[tuple[str, ...]]:
    """Names of the features that hold at each node."""
    total = max(nodes[0].chars, 1) if nodes else 1
    longest = max((n.chars for n in nodes if n.tag == "#text"), default=0)
    prose = [0] * len(nodes)  # children that are runs or bare paragraphs of plain text
    for n in nodes[1:]:
        prose[n.parent] += n.tag in ("#text", "p") and not n.names and 5 * n.linked < n.chars
    out = []
    for n, k in zip(nodes, prose, strict=True):
        link = f"{min(4, int(5 * n.linked / max(n.chars, 1)))}"
        size = f"{min(9, int(math.log2(n.chars + 1)))}"
        if n.tag == "#text":
            p = nodes[n.parent]
            end = n.text[-1] if n.text[-1] in ".!?:" else "-"
            f = ("text", f"text link {link}", f"text size {size}", f"text in {p.tag}", f"text end {end}", "text sign" if "©" in n.text else "text plain", "text top" if n.chars == longest else "text low", f"text share {min(4, int(5 * n.chars / total))}", f"text among {min(4, prose[p.parent])} in {p.tag}")
            if p.tag in ("#root", "div"):
                f += (f"loose size {size}",)
        else:
            share = f"{min(4, int(5 * n.chars / total))}"
            within = f"{n.tag} in {nodes[n.parent].tag if n.parent >= 0 else '-'}"
            f = ("block", f"tag {n.tag}", f"block link {link}", f"block share {share}", f"block share {share} link {link}", f"block size {size}", f"prose {min(4, k)} share {share if n.parent >= 0 else '-'}", within, f"bare {n.tag}" if not n.names else "named", f"{'named' if n.names else 'bare'} {within} {'named' if n.parent >= 0 and nodes[n.parent].names else 'bare'}", *(f"name {x}" for x in set(n.names)))
        out.append(f)
    return out


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(nodes: list[Node], score: list[float], edge: dict[bool, list[float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Content marginal of each node, and of each (parent, child) pair of states, by sum-product on the tree.

    ``score`` is the log-odds potential of content; ``edge[is_leaf]`` holds the potentials of the state pairs
    (parent, child) in the order 00, 01, 10, 11.
    """
    n = len(nodes)
    zero, one = [0.0] * n, list(score)
    to_parent = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        e = edge[nodes[i].tag == "#text"]
        m0, m1 = _log_sum(zero[i] + e[0], one[i] + e[1]), _log_sum(zero[i] + e[2], one[i] + e[3])
        to_parent[i] = (m0, m1)
        p = nodes[i].parent
        zero[p] += m0
        one[p] += m1
    belief = [0.0] * n
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        if i:
            p, e = nodes[i].parent, edge[nodes[i].tag == "#text"]
            out0, out1 = zero[p] - to_parent[i][0], one[p] - to_parent[i][1]
            j = (out0 + zero[i] + e[0], out0 + one[i] + e[1], out1 + zero[i] + e[2], out1 + one[i] + e[3])
            top = max(j)
            x = [math.exp(v - top) for v in j]
            s = sum(x)
            pairs[i] = tuple(v / s for v in x)
            down0, down1 = _log_sum(out0 + e[0], out1 + e[2]), _log_sum(out0 + e[1], out1 + e[3])
            zero[i] += down0
            one[i] += down1
        belief[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, zero[i] - one[i]))))
    return belief, pairs


class TreeModel:
    """Weights of the node features and of the two kinds of edges."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.edge = {False: [0.0] * 4, True: [0.0] * 4}

    def infer(self, nodes: list[Node]) -> tuple[list[float], list, list[tuple[str, ...]]]:
        features = describe(nodes)
        w = self.weight.get
        return *marginals(nodes, [sum(w(f, 0.0) for f in fs) for fs in features], self.edge), features

    def fit(self, pages: Iterable[tuple[str, set[str]]], epochs: int = EPOCHS) -> TreeModel:
        """Gradient ascent on the likelihood of labelled pages: (html, texts of the content blocks)."""
        data = []
        for html, content in pages:
            nodes = parse(html)
            if not nodes:
                continue
            good = [0] * len(nodes)
            for i in range(len(nodes) - 1, -1, -1):
                if nodes[i].tag == "#text" and nodes[i].text in content:
                    good[i] = nodes[i].chars
                if i:
                    good[nodes[i].parent] += good[i]
            data.append((nodes, [int(2 * g > n.chars) for g, n in zip(good, nodes, strict=True)]))
        seen: dict = {}
        order = random.Random(SEED)
        total: dict = {}  # sums of the weights after each of the later epochs; their mean is steadier than the last
        for epoch in range(epochs):
            order.shuffle(data)
            for nodes, state in data:
                belief, pairs, features = self.infer(nodes)
                grad: dict = {}
                for i, fs in enumerate(features):
                    g = state[i] - belief[i]
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + g
                    if i:
                        leaf = nodes[i].tag == "#text"
                        at = 2 * state[nodes[i].parent] + state[i]
                        for k in range(4):
                            grad[leaf, k] = grad.get((leaf, k), 0.0) + (k == at) - pairs[i][k]
                for key, g in grad.items():
                    seen[key] = seen.get(key, 1e-3) + g * g
                    step = 0.3 * g / math.sqrt(seen[key])
                    if isinstance(key, str):
                        self.weight[key] = (1 - 1e-4) * self.weight.get(key, 0.0) + step
                    else:
                        self.edge[key[0]][key[1]] += step
            if 2 * epoch >= epochs:
                now = {**self.weight, **{(leaf, k): e[k] for leaf, e in self.edge.items() for k in range(4)}}
                for key, w in now.items():
                    total[key] = total.get(key, 0.0) + w / (epochs - (epochs + 1) // 2)
        for key, w in total.items():
            if isinstance(key, str):
                self.weight[key] = w
            else:
                self.edge[key[0]][key[1]] = w
        return self

    def extract(self, html: str | None) -> str:
        nodes = parse(html)
        if not nodes:
            return ""
        belief = self.infer(nodes)[0]
        return " ".join(n.text for n, b in zip(nodes, belief, strict=True) if n.text is not None and b >= 0.5)


# Names that layouts customarily give to their parts: (tags, class or id names).
PARTS = {
    "menu": ("nav div ul header", "nav navbar menu main-menu navigation breadcrumb breadcrumbs topbar pagination pager tabs toc"),
    "header": ("header div", "header site-header masthead banner logo page-header top brand tagline"),
    "footer": ("footer div", "footer site-footer page-footer bottom copyright legal colophon foot"),
    "sidebar": ("aside div section", "sidebar side-bar side widget related recommended rail secondary trending popular more-stories teaser"),
    "advert": ("div aside section p", "ad ads advert advertisement adsense sponsor sponsored promo promotion adbox ad-slot banner-ad"),
    "notice": ("div section p aside", "cookie cookies cookie-notice cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer"),
    "form": ("form form div", "form search search-form login signup register subscribe contact feedback newsletter"),
    "comments": ("section div ol ul article", "comments comment comment-list commentlist comment-body responses discussion replies reply reader-comments respond thread"),
    "share": ("div ul", "share sharing social tags toolbar buttons meta"),
}
CONTENT = ("article article main div section", "article content post entry entry-content post-content post-body article-body story story-body main-content page-content text body-text single")
SYLLABLES = "an ber co da el fi gu ha in jo ka lo mu ne or pa que ri sto tu und ver wi xa yo zen".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[tuple[str, set[str]]]:
    """Pages built by rule with the texts of their content blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def prose(lo: int, hi: int) -> str:
        w = [word() for _ in range(r.randint(lo, hi))]
        for i in range(len(w)):
            if r.random() < 0.12:
                w[i] += r.choice(",..")
        return " ".join(w).capitalize() + r.choice(["."] * 6 + ["", "!"])

    def open_tag(tag: str, names: str, bare: float) -> str:
        if r.random() < bare:
            return f"<{tag}>"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names.split())}">'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + "</ul>"

    def hashed() -> str:
        """A name that says nothing, as style tools and obfuscators make them."""
        some = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
        return r.choice([f"sc-{some(6)}", f"css-{some(7)}", f"_{some(5)}", some(4), f"{word()}{r.randint(1, 99)}", f"{word()}__{some(5)}", f"c{r.randint(1, 9)}", f"{word()} {some(6)}"])

    def box(inner: str, bare: float = 0.25, tags: str = "div div div section center") -> str:
        """A container without a known name around a part of a page."""
        tag = r.choice(tags.split())
        return f"<{tag}>{inner}</{tag}>" if r.random() < bare else f'<{tag} {r.choice(["class", "class", "id"])}="{hashed()}">{inner}</{tag}>'

    def part(kind: str, foreign: bool = False) -> str:
        tags, names = PARTS[kind]
        tag = r.choice(tags.split())
        plain = tag in ("nav", "footer", "aside", "form", "header")
        head = open_tag(tag, names, 0.5 if plain else 0.0)
        # A name may say nothing where the tag or the inside (links, a copyright line) still tells the part.
        if foreign and (plain or kind in ("menu", "share", "footer")) and r.random() < 0.6:
            head = f'<{tag} class="{hashed()}">'
        if kind == "form":
            body = f"<label>{prose(1, 4)}</label><input name=q><select><option>{word()}<option>{word()}</select><button>{word()}</button>" + (f"<p>{prose(3, 14)}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            body = "".join(f'<{c} class="{r.choice(["comment", "reply", "comment-body"])}"><p>{prose(2, 60)}</p></{c}>' for c in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 4)))
            body = (f"<h3>{prose(1, 3)}</h3>" if r.random() < 0.5 else "") + body
        elif kind in ("menu", "share"):
            body = links(r.randint(2, 8))
        elif kind == "footer":
            body = r.choice([f"&copy; {word()}.example &middot; {prose(2, 14)}", f"<p>{prose(2, 25)}</p>", links(4) + f"<p>&copy; {prose(1, 6)}</p>"])
        elif kind == "header":
            body = r.choice([f"<a href=/>{word()}</a>", f"<h1>{prose(1, 4)}</h1><p>{prose(2, 8)}</p>", f"<div>{prose(1, 5)}</div>", f"<p>{prose(3, 12)}</p>"])
        elif kind == "sidebar":
            body = r.choice([f"<h3>{prose(1, 4)}</h3>" + links(r.randint(2, 6)), f"<h4>{prose(1, 5)}</h4><p>{prose(5, 50)}</p>", f"<p>{prose(4, 40)}</p>" * r.randint(1, 3)])
        else:
            body = r.choice([prose(2, 30), f"<p>{prose(3, 40)}</p>", f'<p>{prose(2, 12)} <a href="#">{word()}</a></p>', f"<div>{prose(2, 20)}</div>"])
        return f"{head}{body}</{tag}>"

    for _ in range(n):
        content: set[str] = set()

        def keep(text: str, content: set[str] = content) -> str:
            content.add(text)
            return text

        tiny = r.choice([3, 12]) if r.random() < 0.2 else 0  # words at most of a page whose article is a few words
        longest = r.choice([110, 110, 30])  # words of a paragraph

        def block(tiny: int = tiny, longest: int = longest) -> str:
            k = r.random()
            if k < 0.7:
                t = keep(prose(1, tiny or 3) if tiny or r.random() < 0.2 else prose(1, 14) if r.random() < 0.25 else prose(12, longest))
                return r.choice([f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p><em>{t}</em></p>", f'<p class="{word()}">{t}</p>', f'<div class="paragraph">{t}</div>'] if r.random() < 0.4 else [f"<p>{t}</p>"])
            if k < 0.8:
                return f"<h2>{keep(prose(1, 8))}</h2>"
            if k < 0.86:
                return "<ul>" + "".join(f"<li>{keep(prose(1, 25))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if k < 0.92:
                return f"<blockquote><p>{keep(prose(4, 40))}</p></blockquote>"
            if k < 0.95:
                return "<table>" + "".join(f"<tr><td>{keep(prose(1, 4))}</td><td>{keep(prose(1, 4))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
            if k < 0.98:
                return f"<figure><img src=x><figcaption>{keep(prose(2, 12))}</figcaption></figure>"
            return f"<pre>{keep(prose(3, 20))}</pre>"

        foreign = r.random() < 0.5  # a layout without customary names
        alone = foreign and r.random() < 0.25  # a page of nothing but its article
        tag = r.choice(CONTENT[0].split())
        body = [f"<h1>{keep(prose(1, tiny or 10))}</h1>" if r.random() < (0.5 if foreign else 0.9) else ""]
        if body[0] and r.random() < 0.15:
            body[0] = f"<header>{body[0]}</header>"
        if foreign and not tiny and r.random() < 0.15:  # loose text between line breaks
            loose = [prose(8, longest) for _ in range(r.randint(1, 6))]
            keep(" ".join(loose))
            body.append("<br><br>".join(loose))
        for _b in range(0 if body[-1].find("<br>") > 0 else 1 if tiny else r.choice([1, 2, 3, 3, 4, 5, 8, 13])):
            body.append(block())
            if r.random() < 0.06:
                body.append(part(r.choice(["advert", "share", "sidebar", "notice", "form"])))
        if r.random() < 0.12:
            body.append(part("comments"))
        inner = "".join(body)
        if foreign:
            main = inner
            if not tiny and len(body) > 3 and r.random() < 0.15:  # columns
                cut = r.randint(1, len(body) - 1)
                main = box("".join(body[:cut])) + box("".join(body[cut:]))
            elif r.random() < 0.35:
                main = box(main, 0.6, "article article main")
            for _w in range(r.choice([0, 0, 0, 1, 1, 2, 3, 5])):
                main = box(main)
        else:
            main = f"{open_tag(tag, CONTENT[1], 0.6 if tag in ('article', 'main') else 0.15)}{inner}</{tag}>" if r.random() < 0.94 else inner
        if not foreign and r.random() < 0.3:
            main = f'<div class="{r.choice(["container", "wrapper", "row", "page", "layout", "site"])}">{main}{part("sidebar") if r.random() < 0.5 else ""}</div>'
        before = [part(k, foreign) for k in ("notice", "header", "menu", "advert", "form", "share") if not alone and r.random() < (0.7 if k == "menu" else 0.35)]
        after = [part(k, foreign) for k in ("sidebar", "comments", "share", "advert", "form", "notice") if not alone and r.random() < 0.3]
        foot = part("footer", foreign) if not alone and r.random() < 0.85 else ""
        r.shuffle(before)
        r.shuffle(after)
        page = "".join(before) + main + "".join(after) + foot
        if foreign:
            k = r.random()
            if k < 0.15:  # cells of a layout table
                rows = [f"<tr><td>{x}</td></tr>" for x in before] if r.random() < 0.5 else []
                cells = "".join(f"<td>{x}</td>" for x in ([] if rows else before) + [main] + after)
                page = f"<table>{''.join(rows)}<tr>{cells}</tr></table>{foot}"
            elif k < 0.25:  # one form around the whole page
                page = f'<form id="{r.choice(["form1", "aspnetForm", hashed()])}">{page}</form>'
            elif k < 0.55:
                for _w in range(r.randint(1, 3)):
                    page = box(page)
        yield f"<!DOCTYPE html><html><head><title>{prose(1, 8)}</title></head><body>{page}</body></html>", {unescape(t) for t in content}


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return TreeModel().fit(labelled_pages())


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [model.extract(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
