"""Main text of web pages from flat text blocks and a decision tree.

A page is read into a flat sequence of text blocks. Each block has its word count and link
density, those of the blocks before and after it, the kind of its own element, what its
containers are named, and whether a short one has the wording of a legal line. A decision tree, trained on a labelled
table of pages of mixed layouts, classifies the blocks; the text is the main blocks in page
order. Element and class names are features among others: what they leave open, blocks in
plain containers above all, is decided by word counts and link densities.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import STEP_BYTES

# Comments, elements whose content is no text, declarations, tags. A quote delimits only after `=`.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^=<>]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>][^\s<>]*)|=)*+)>",
    re.S | re.I,
)
_CLASS = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")

# Elements that do not end a text block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be left out; they hold no others' kind of container.
OPEN_ENDED = frozenset("p li dt dd td th tr option".split())
# Containers of what is not main text, and of what is.
SIDE = frozenset("nav header footer aside form button select menu dialog fieldset".split())
MAIN = frozenset("article main".split())
# Words of class, id and role that tell the same, and words that go with them.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus discussion footer gdpr header login menu modal nav "
    "navbar navigation newsletter notice notices pager pagination popup promo promoted related recommended reply replies search share sharing sidebar signup social sponsor "
    "sponsored subscribe tags toolbar widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story body text".split())
NEUTRAL_WORDS = MAIN_WORDS | frozenset(
    "a area bar block bottom box buttons column container fixed global group inner item items left legal link links list mobile outer page panel primary reader region right row "
    "secondary section site sticky the title top user wrap wrapper".split()
)
# Wording of legal lines.
_LEGAL = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b|\bterms of (?:use|service)\b|\bprivacy policy\b", re.I)

PLAIN, IN_MAIN, MAIN_IN_DOUBT, IN_DOUBT, IN_SIDE = range(5)
HEADING, PARAGRAPH, ITEM, OTHER = range(4)
FEATURES = "words density words_before density_before words_after density_after element container page_has_main legal".split()


@dataclass
class Block:
    text: str
    words: int
    linked: int
    element: int
    container: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _marks(attributes: str) -> int:
    """What the class, id and role names say: IN_SIDE if a name is of side words only, IN_DOUBT if one has others too, IN_MAIN, or PLAIN."""
    said = PLAIN
    for found in _CLASS.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            parts = _PARTS.findall(name)
            if not SIDE_WORDS.isdisjoint(parts):
                said = max(said, IN_SIDE if all(p in SIDE_WORDS or p in NEUTRAL_WORDS for p in parts) else IN_DOUBT)
            elif not MAIN_WORDS.isdisjoint(parts):
                said = max(said, IN_MAIN)
    return said


def _container(name: str, attributes: str, now: int) -> int:
    """What an element says of its contents, given what holds around it: side stays side."""
    if now == IN_SIDE or name == "header" and now in (IN_MAIN, MAIN_IN_DOUBT):
        return now
    if name in SIDE:
        return IN_SIDE
    said = _marks(attributes) if attributes and name not in INLINE and name not in ("body", "html") else PLAIN
    if said == IN_SIDE:
        return IN_SIDE
    if said == IN_DOUBT:
        return MAIN_IN_DOUBT if now in (IN_MAIN, MAIN_IN_DOUBT) or name in MAIN else IN_DOUBT
    if name in MAIN or said == IN_MAIN:
        return now if now in (MAIN_IN_DOUBT, IN_DOUBT) else IN_MAIN
    return now


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order; scripts, styles, comments and the head's title are none."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    parts: list[str] = []
    links, element = 0, OTHER
    linked: list[str] = []

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(words, len(html.unescape(" ".join(linked)).split())), element, stack[-1][1] if stack else PLAIN))
        parts.clear()
        linked.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            parts.append(piece)
            if links:
                linked.append(piece)
        at = token.end()
        name = (token[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if token[2] else links + 1
            elif name == "br":
                parts.append(" ")
            continue
        end_block()
        links = 0
        if token[2]:
            if open_[name]:
                while True:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
            element = OTHER
            continue
        if name == "p":
            element = PARAGRAPH
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            element = HEADING
        else:
            element = ITEM if name in ("li", "dt", "dd", "td", "th", "option") else OTHER
        if name not in VOID and (name not in OPEN_ENDED or token[4] and _container(name, token[4], PLAIN)) and not token[4].rstrip().endswith("/"):
            stack.append((name, _container(name, token[4], stack[-1][1] if stack else PLAIN)))
            open_[name] += 1
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block; before the first and after the last block there are no words."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.density for b in found), 0], float)
    container = np.array([b.container for b in found], float)
    marked = np.full(len(found), float((container == IN_MAIN).any()))
    own = [[b.element, b.container] for b in found]
    said = [[b.words <= 40 and _LEGAL.search(b.text) is not None] for b in found]
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], np.array(own, float), marked, np.array(said, float)])


class Pages:
    """Writes labelled pages of mixed layouts: main blocks are wrapped in {{ }}.

    Rules of the table: what stands in an article container is main but for menus, notices,
    adverts, shares, related stories and comments in it; where no container is named, the
    running text with its headings, lists and short paragraphs is main, and menus, lines of
    links, legal lines and taglines around it are not.
    """

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        letters = self.rng.integers(0, 19, (3000, 9))
        self.vocabulary = ["".join("aeioubcdfghklmnprst"[k] for k in row[: 2 + i % 8]) for i, row in enumerate(letters.tolist())]

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(lo), np.log(hi + 1))))
        return " ".join(self.vocabulary[k] for k in self.rng.integers(0, 3000, n).tolist())

    def sentence(self, lo: int, hi: int) -> str:
        return self.words(lo, hi).capitalize() + self.pick(".", ".", ".", "!", "?", ":")

    def link(self, lo: int = 1, hi: int = 4) -> str:
        return f"<a href=x>{self.words(lo, hi)}</a>"

    def links(self, n: int) -> str:
        kind = self.pick("<li>%s</li>", "<div>%s</div>", "%s ", "<p>%s</p>", "%s | ")
        body = "".join(kind % self.link() for _ in range(n))
        return f"<ul>{body}</ul>" if "li" in kind else f"<div>{body}</div>"

    def wrapped(self, body: str, names: tuple, tags: tuple = ("div", "section", "div")) -> str:
        """body in an element that a name of side words marks."""
        if names and self.chance(0.5):
            name = self.pick(*names)
            name = self.pick(name, name, f"{name}-box", f"site-{name}", f"{name}s", f"post {name}")
            tag = self.pick(*tags)
            return f'<{tag} {self.pick("class", "id")}="{name}">{body}</{tag}>'
        return body

    def side(self, kind: str) -> str:
        """A part that is not main text, in an element that says so."""
        n = int(self.rng.integers(2, 7))
        if kind == "menu":
            return self.pick(f"<nav>{self.links(n)}</nav>", f'<div class="{self.pick("menu", "navbar", "nav")}">{self.links(n)}</div>')
        if kind == "comments":
            body = "".join(f"<p>{self.sentence(2, 60)}</p>" for _ in range(n))
            return f'<{(t := self.pick("section", "div", "ol"))} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "reader-comments", "disqus", "replies")}">{body}</{t}>'
        if kind == "form":
            return f"<form><label>{self.words(1, 4)}</label><p>{self.sentence(3, 20)}</p><button>{self.words(1, 2)}</button></form>"
        if kind == "foot":
            return f"<footer><p>{self.pick('&copy; 2020 ', '', 'Copyright ')}{self.words(1, 30)}</p>{self.links(n)}</footer>"
        name = {"ad": ("ad", "advert", "sponsored", "promo"), "cookie": ("cookie", "consent", "cookie-notice", "gdpr"), "share": ("share", "social", "sharing"), "bar": ("sidebar", "widget"), "related": ("related", "recommended"), "head": ("header", "banner"), "letter": ("newsletter", "subscribe", "signup")}[kind]
        body = {"share": lambda: self.links(n), "related": lambda: self.links(n) + self.pick("", f"<p>{self.sentence(8, 40)}</p>"), "bar": lambda: f"<h3>{self.words(1, 4)}</h3><p>{self.sentence(6, 50)}</p>" + self.pick("", self.links(n))}
        inner = body.get(kind, lambda: self.pick(f"<p>{self.sentence(3, 40)}</p>", self.sentence(3, 40), f"<p>{self.sentence(3, 30)} {self.link()}</p>"))()
        tag = "aside" if kind == "bar" and self.chance(0.4) else "header" if kind == "head" and self.chance(0.4) else "div"
        said = self.pick(*name)
        return f'<{tag} class="{said}">{inner}</{tag}>'

    def plain_side(self, first: bool) -> str:
        """A part that is not main text and has no name: menus, lines of links, legal lines, taglines."""
        n = int(self.rng.integers(2, 8))
        legal = self.pick("&copy; 2021 " + self.words(1, 6), "Copyright 2020 " + self.words(1, 5), self.words(1, 3) + " All rights reserved" + self.pick("", "."), "Terms of use", "Privacy policy")
        rest = self.pick(
            self.links(n), self.links(n), f"<div>{self.words(1, 4)}</div>", f"<p>{self.link()} {self.words(1, 2)} {self.link()}</p>", f"<{self.pick('p', 'div')}>{self.sentence(2, 8)}</div>{self.links(n)}",
            f"<h1>{self.words(1, 3)}</h1>{self.links(n)}", f"<h3>{self.words(1, 3)}</h3>{self.links(n)}",
        )
        tag = self.pick("p", "div", "div")
        return rest if first else self.pick(rest, f"<{tag}>{legal}</{tag}>", f"<{tag}>{legal}</{tag}", f"<{tag}>{self.link()} {self.link()} {legal}</{tag}>").replace("</p</", "</p></")

    def run(self, tag: str, named: bool) -> str:
        """Main blocks: headings, running text with short paragraphs between, lists, tables, quotes."""
        out = [f"<h1>{{{{{self.words(2, 12)}}}}}</h1>"] if self.chance(0.7) else []
        n = int(self.rng.integers(2, 9))
        for i in range(n):
            kind = self.rng.random()
            if kind < 0.62 or i in (0, n - 1) and not named:
                out.append(f"<{tag}>{{{{{' '.join(self.sentence(4, 25) for _ in range(self.rng.integers(1, 6)))}}}}}</{tag}>")
            elif kind < 0.72:
                out.append(f"<{tag}>{{{{{self.sentence(1, 6)}}}}}</{tag}>")
            elif kind < 0.78:
                out.append(f"<h2>{{{{{self.words(1, 8)}}}}}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{{{{{self.sentence(3, 18)}}}}}</li>" for _ in range(self.rng.integers(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{{{{{self.sentence(6, 30)}}}}}</blockquote>")
            elif kind < 0.95:
                out.append(f"<{tag}>{{{{{self.sentence(5, 20)} {self.link(1, 6)} {self.sentence(3, 15)}}}}}</{tag}>")
            if named and self.chance(0.3):  # an article may hold any block: short, linked in part or as a whole, legal
                out.append(f"<{self.pick(tag, 'li', 'h3')}>{{{{{self.words(1, 6)} {self.link(1, 6)}}}}}</{tag}>")
            if named and self.chance(0.15):
                out.append(self.pick(f"<p>{{{{{self.pick(self.sentence(1, 9), '')} All rights reserved.}}}}</p>", f"<{tag}>{{{{Copyright {self.sentence(1, 9)}}}}}</{tag}>", f"<p><a>{{{{{self.words(1, 9)}}}}}</a></p>", f"<table><tr><td>{{{{{self.words(1, 4)}}}}}</td><td>{{{{{self.words(1, 4)}}}}}</td></tr></table>", f"{{{{{self.words(2, 12)}}}}}"))
        return "".join(out)

    def page(self) -> str:
        head = [self.side(k) for k in self.rng.permutation(["menu", "cookie", "head", "ad", "letter", "form"])[: self.rng.integers(0, 4)]]
        tail = [self.side(k) for k in self.rng.permutation(["foot", "related", "bar", "comments", "letter", "share", "ad"])[: self.rng.integers(0, 4)]]
        head += [self.plain_side(True) for _ in range(self.rng.integers(0, 3))]
        tail += [self.plain_side(False) for _ in range(self.rng.integers(0, 4))]
        if self.chance(0.4):
            line = self.pick(f"Copyright {self.words(1, 20)}", f"&copy; {self.words(1, 12)}.", f"{self.words(1, 12)} all rights reserved{self.pick('', '.')}")
            tail.append(f"<{(t := self.pick('p', 'div', 'h4', 'td'))}>{line}</{t}>")
        style = self.rng.random()
        if style < 0.45:  # a container that says so
            body = self.run(self.pick("p", "p", "p", "div"), True)
            if self.chance(0.3):
                body += self.side(self.pick("comments", "share", "related", "ad"))
            if self.chance(0.35):  # a part of the article whose name only sounds like a side
                name = self.pick("social", "share", "comment", "header", "menu", "search", "related", "ad") + "-" + self.pick("history", "price", "law", "theory", "study", "hoc")
                body += f'<{(t := self.pick("section", "div"))} class="{name}">{self.run("p", False)}</{t}>'
            open_ = self.pick("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div id="post-body">%s</div>', "<article><header>%s</header></article>")
            body = open_ % body
        else:  # plain paragraphs, or plain divisions
            body = self.run(self.pick("p", "div"), False)
            body = self.pick(body, f"<div>{body}</div>")
            if self.chance(0.2):
                body = f'<div class="{self.pick("social", "share", "search")}-{self.pick("history", "price", "theory")}">{body}</div>'
        return "<html><body>" + "".join(self.rng.permutation(head)) + body + "".join(self.rng.permutation(tail)) + "</body></html>"


def labelled(n: int = 1200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main) of the blocks of n labelled pages."""
    writer, xs, ys = Pages(seed), [], []
    for _ in range(n):
        page = writer.page()
        xs.append(features(blocks(page.replace("{{", "").replace("}}", ""))))
        ys += [float("{{" in b.text) for b in blocks(page)]
    return np.vstack(xs), np.array(ys)


class Tree:
    """A classification tree by Gini impurity: (feature, threshold, low, high) or the share of main blocks in a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16, leaf: int = 2) -> None:
        self.leaf = leaf
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share, n = float(y.mean()), len(y)
        if depth == 0 or share in (0.0, 1.0) or n < 2 * self.leaf:
            return share
        best = (n * share * (1 - share) - 1e-6, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= self.leaf) & (n - cut - 1 >= self.leaf)]
            if len(cut):
                a, b = cut + 1, n - cut - 1
                left, right = ones[cut], ones[-1] - ones[cut]
                impurity = left * (a - left) / a + right * (b - right) / b
                k = int(np.argmin(impurity))
                if impurity[k] < best[0] - 1e-9:
                    best = (float(impurity[k]), (f, float(v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            return share
        f, t = best[1]
        left = x[:, f] <= t
        return f, t, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def main(self, x: np.ndarray) -> list[bool]:
        out = []
        for row in x.tolist():
            node = self.root
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            out.append(node >= 0.5)
        return out

    def used(self) -> Counter:
        """How often each feature splits."""
        todo, out = [self.root], Counter()
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out[FEATURES[node[0]]] += 1
                todo += node[2:]
        return out


@functools.cache
def tree() -> Tree:
    """Trained once, on the labelled table."""
    return Tree(*labelled())


def main_text(page: str | None, model: Tree | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, (model or tree()).main(features(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Tree | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    The text is that of the main blocks, joined by empty lines; n_chars counts its code
    points. A null or empty page, or one without main blocks, has the empty text. Unclosed
    and wrongly nested tags are read as they come. Pages of any length are read whole, in
    linear time; about STEP_BYTES of text are kept beside the one that is read. A block on
    which the leaf's labels tie is main. Repeated rows give repeated rows; null ids and
    urls stay null; other columns are not read; an empty table gives an empty result.
    """
    model = model or tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "n_chars"]

        def made(batch: pa.RecordBatch, at: int, texts: list[str]) -> pa.RecordBatch:
            part = batch.slice(at, len(texts))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

        for batch in batches:
            at, texts, held = 0, [], 0
            for page in batch.column(2):
                texts.append(main_text(page.as_py(), model))
                held += len(texts[-1])
                if held > STEP_BYTES:
                    yield made(batch, at, texts)
                    at, texts, held = at + len(texts), [], 0
            if texts:
                yield made(batch, at, texts)

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
