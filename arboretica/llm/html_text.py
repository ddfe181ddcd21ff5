"""HTML main text: flat blocks with word counts and link densities of neighbours, judged by a trained decision tree.

A page is cut into blocks of text. Each has its number of words and its link density, and those of the blocks before and
after it; how its container is named counts beside them. The tree is grown in two steps: first by words and links alone, then,
in those leaves that they leave mixed, by the container too. So every decision begins with words and links, and names settle
only what these leave open.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: The rest of a tag up to its end, quoted values skipped; possessive, so a failure costs one pass.
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
# Elements whose content is never text of the page.
_RAW = frozenset("script style template noscript iframe object svg math canvas audio video textarea select title head datalist".split())
# Elements that stand inside a line of text; all others end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr option output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements around an article's text, words that name such parts, and words that name the article's own parts.
_APART_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
_APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alertdialog author banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo "
    "cookie cookies copyright discussion disqus dialog footer form gdpr legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup popular promo promoted promotion recommended related reply replies respond response responses search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags teaser toolbar topbar trending warning widget widgets".split()
)
_OWN_WORDS = frozenset("article body content entry main post story text".split())
_FRAME_WORDS = frozenset("area block box container inner item items list outer posts section wrap wrapper".split())
_MAIN_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li td th dt dd tr caption figcaption".split())
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th".split()) | _HEADINGS

#: How a container stands: named as apart from the article, named as both, not named, or part of an article element.
APART, MIXED, PLAIN, WITHIN = range(4)


@dataclass(slots=True)
class Block:
    """A run of text between block boundaries, and where it stood."""

    text: str
    words: int
    link_words: int
    tag: str
    standing: int


def _named(attributes: str) -> int:
    """APART if a name's last word, frame words aside, says so and none names a part of the article; MIXED if both occur."""
    apart = own = some = False
    for found in _NAMES.findall(attributes):
        for name in "".join(found).split():
            parts = [w.lower() for w in _PART.findall(name)]
            some = some or not _APART_WORDS.isdisjoint(parts)
            heads = [w for w in parts if w not in _FRAME_WORDS] or parts
            if heads:
                apart, own = apart or heads[-1] in _APART_WORDS, own or heads[-1] in _OWN_WORDS
    return APART if apart and not own else MIXED if some else PLAIN


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page, in order; white space inside a block is one space, character references are decoded.

    A malformed page never fails, and no page takes more than a few passes: unclosed elements end with an outer one, stray end
    tags are ignored, a tag or comment that the end of the page cuts off is dropped, and from a quote on that never ends tags
    end at the next ``>``.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, its standing, whether it or an outer one is an article element
    open_names: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    tag, in_link, quotes = "", False, True

    def end() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                link_words = len(entities.unescape("".join(linked)).split())
                out.append(Block(text, text.count(" ") + 1, link_words, tag, stack[-1][1] if stack else PLAIN))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text + " ")

    def pop(n: int) -> None:
        for name, _, _ in stack[n:]:
            open_names[name] -= 1
        del stack[n:]

    page, at = page or "", 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith(("<!", "<?"), lt):
            close = "-->" if page.startswith("<!--", lt) else ">"
            found = page.find(close, lt + 2)
            if found < 0:
                break
            at = found + len(close)
            continue
        closing = page.startswith("/", lt + 1)
        named = _NAME.match(page, lt + 1 + closing)
        if named is None:
            add("<")
            at = lt + 1
            continue
        rest = _REST.match(page, named.end()) if quotes else None
        at = rest.end() if rest else page.find(">", named.end()) + 1
        if not at:
            break
        quotes = quotes and rest is not None
        name, attributes = named[0].lower(), page[named.end() : at - 1]
        empty = attributes.rstrip().endswith("/")
        if name in _RAW:
            if closing or (empty and name != "head"):
                continue
            if name == "head":  # holds no text; without its end tag, the body begins it
                end()
                stop = _HEAD_END.search(page, at) if not open_names["head"] else None
                open_names["head"] = 1  # a second one is looked for no more
                at = stop.end() if stop else at
            else:
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if name not in ("svg", "math", "canvas"):
                    add(" ")
                at = stop.end() if stop else len(page)
            continue
        if name in _INLINE:
            if name == "br":
                add(" ")
            elif name == "a":
                in_link = not closing
            continue
        end()
        in_link = False
        if closing:
            if open_names[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            tag = ""
            continue
        tag = name
        if name in _VOID or empty:
            continue
        if name in _CLOSED_BY_NEXT:
            # these end implicitly: an open one of the same kind is closed by the next
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][0] == name or stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in ("li", "dt", "dd", "tr", "td", "th"):
                    break
        _, standing, main = stack[-1] if stack else ("", PLAIN, False)
        if name in _MAIN_TAGS:
            main, standing = True, standing if standing == APART else WITHIN
        elif standing != APART:
            if name in _APART_TAGS or (name == "header" and not main) or _HIDDEN.search(attributes):
                standing = APART
            elif attributes and name not in ("body", "html"):
                own = _named(attributes)
                standing = own if own != PLAIN else standing
        stack.append((name, standing, main))
        open_names[name] += 1
    end()
    return out


TEXT_FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")
FEATURES = (*TEXT_FEATURES, "standing", "heading", "item", "page_has_main")


def features(own: list[Block]) -> np.ndarray:
    """A row for each block: its word count and link density, its neighbours', and then what it stood in."""
    if not own:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in own], float)
    links = np.array([min(1.0, b.link_words / b.words) for b in own])
    before, after = (lambda a: np.concatenate([[0.0], a[:-1]])), (lambda a: np.concatenate([a[1:], [0.0]]))
    standing = np.array([b.standing for b in own], float)
    return np.stack([
        words, links, before(words), before(links), after(words), after(links), standing, np.array([b.tag in _HEADINGS for b in own], float),
        np.array([b.tag in _ITEMS for b in own], float), np.full(len(own), float((standing == WITHIN).any())),
    ], axis=1)


class DecisionTree:
    """A binary tree of thresholds, grown by Gini impurity on a small table.

    ``text_depth`` levels ask the first ``text`` features only; leaves that are still mixed go on with all of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, text: int = len(TEXT_FEATURES), text_depth: int = 3, least: int = 2):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self.text, self.least = text, least
        self._grow(np.asarray(x, float), np.asarray(y, float), depth, text_depth)

    def _best(self, x, y, columns):
        best = None
        for f in columns:
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
            rest, m = t.sum() - ones, len(t) - n
            cost = 2 * (ones * (1 - ones / n) + rest * (1 - rest / m))
            cost[(v[1:] == v[:-1]) | (n < self.least) | (m < self.least)] = np.inf
            k = int(np.argmin(cost)) if len(cost) else 0
            if len(cost) and np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-12):
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        return best

    def _grow(self, x, y, depth, text_depth) -> int:
        at, share = len(self.nodes), float(y.mean())
        self.nodes.append((-1, 0.0, -1, -1, share))
        if share in (0.0, 1.0) or depth + text_depth <= 0:
            return at
        best = self._best(x, y, range(self.text)) if text_depth > 0 else None
        if best is None or best[0] >= 2 * len(y) * share * (1 - share) - 1e-12:
            text_depth, best = 0, self._best(x, y, range(x.shape[1])) if depth > 0 else None
        if best is None or best[0] >= 2 * len(y) * share * (1 - share) - 1e-12:
            return at
        left = x[:, best[1]] <= best[2]
        rest = (depth, text_depth - 1) if text_depth > 0 else (depth - 1, 0)
        low, high = self._grow(x[left], y[left], *rest), self._grow(x[~left], y[~left], *rest)
        self.nodes[at] = (best[1], best[2], low, high, share)
        return at

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The leaf of each row, and for each node the features that its path has asked."""
        out, asked = np.zeros(len(x), np.int64), [[] for _ in self.nodes]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, cut, low, high, _ = self.nodes[at]
            if f < 0:
                out[rows] = at
                continue
            asked[low] = asked[high] = [*asked[at], f]
            left = x[rows, f] <= cut
            todo += [(low, rows[left]), (high, rows[~left])]
        return out, asked

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The share of positive training rows at each row's leaf."""
        return np.array([n[4] for n in self.nodes])[self.leaves(x)[0]]


# ---- the labelled table

#: Pages of the labelled table. Each is composed of the kinds of parts below, whose labels were set by hand.
LABELLED_PAGES = 400
_FILLER = "the committee met on the second day of the month and agreed after some debate that the bridge will be closed to heavy traffic until the piers have been inspected again by the city".split()


def _sentence(rng: random.Random, least: int, most: int) -> str:
    return " ".join(rng.choice(_FILLER) for _ in range(rng.randint(least, most)))


def _labelled_page(rng: random.Random) -> list[tuple[int | None, str]]:
    """A page as (label, markup) parts; 1 is main text, None markup without text."""
    text = lambda a, b: _sentence(rng, a, b)
    link = lambda a, b: f'<a href="/x">{text(a, b)}</a>'
    several = lambda make, a, b: "".join(make() for _ in range(rng.randint(a, b)))
    menu = lambda: f"<ul>{several(lambda: f'<li>{link(1, 4)}</li>', 2, 8)}</ul>"
    inside = lambda tag, make: lambda: f"<{tag}>{make()}</{tag.split()[0]}>"

    def paragraph() -> tuple[int, str]:
        kind = rng.random()
        if kind < 0.25:
            return 1, several(lambda: f"<p>{text(1, 4)}</p>", 1, 5)
        if kind < 0.45:
            return 1, f"<p>{text(5, 16)}</p>"
        if kind < 0.8:
            return 1, f"<p>{text(17, 160)}</p>"
        if kind < 0.86:
            return 1, f"<p>{text(10, 60)} {link(1, 4)} {text(4, 30)}</p>"
        if kind < 0.9:
            return 1, f"<p>{text(12, 30)}</p><p>{link(3, 12)}</p><p>{text(12, 30)}</p>"
        if kind < 0.94:
            return 1, f"<ul>{several(lambda: f'<li>{text(1, 9)}</li>', 2, 5)}</ul>"
        if kind < 0.96:
            return 1, f"<blockquote>{text(8, 50)}</blockquote>"
        return 1, f"<h3>{text(1, 8)}</h3><p>{text(10, 60)}</p>"

    apart = [
        inside('div class="ad"', lambda: text(3, 14)), inside('div class="share-box"', lambda: link(1, 3) + " " + text(1, 3)), inside("aside", lambda: f"<h4>{text(1, 4)}</h4><p>{text(8, 60)}</p>"),
        inside('div class="newsletter"', lambda: f"<p>{text(6, 24)}</p>"), inside("form", lambda: f"<p>{text(2, 18)}</p>"), inside('div class="related-posts"', menu), inside('p class="byline"', lambda: text(2, 6)),
    ]
    around = [
        inside("nav", menu), inside('div id="menu"', menu), inside("header", lambda: f"<h2>{text(1, 5)}</h2><p>{text(3, 16)}</p>"), inside('div class="cookie-notice"', lambda: f"<p>{text(12, 60)}</p>"),
        inside('div class="ad"', lambda: text(3, 14)), inside('div class="sidebar"', lambda: f"<h3>{text(1, 3)}</h3><p>{text(10, 50)}</p>"), inside("div", lambda: f"<p>{link(1, 4)} {link(1, 4)} {link(1, 3)}</p>"),
    ]
    below = [
        inside('section id="comments"', lambda: several(lambda: f"<p>{text(1, 60)}</p>", 1, 6)), inside("div", lambda: several(lambda: f"<p>{link(3, 10)}</p>", 2, 5)), inside('div class="comment-list"', lambda: several(lambda: f"<div>{text(3, 50)}</div>", 1, 4)),
        inside("aside", menu), inside('div role="complementary"', lambda: f"<p>{text(8, 40)}</p>"),
    ]
    kind = rng.choice(["article", "article", "article", "main", "main", 'div class="content"', "div", "div"])
    named = kind in ("article", "main")
    parts: list[tuple[int | None, str]] = [(None, "<body>")]
    parts += [(0, make()) for make in rng.sample(around, rng.randint(0, 4))]
    parts += [(None, f"<{kind}>")]
    if named or rng.random() < 0.7:
        parts.append((1, f"<h1>{text(1, 60 if rng.random() < 0.2 else 12)}</h1>"))
    for k in range(rng.randint(2, 9)):
        parts.append(paragraph() if named or k else (1, f"<p>{text(20, 90)}</p>"))
        if rng.random() < 0.12:
            parts.append((0, rng.choice(apart)()))
        elif rng.random() < 0.06:
            parts.append((0, menu()))  # links that stand in the article and are none of its text
        elif rng.random() < 0.06:
            parts.append((1, f'<div class="entry-meta-wrapper post"><p>{text(20, 80)}</p></div>'))
    if not named:
        parts.append((1, f"<p>{text(20, 90)}</p>"))
    parts.append((None, f"</{kind.split()[0]}>"))
    parts += [(0, make()) for make in rng.sample(below, rng.randint(0, 3))]
    if named and rng.random() < 0.4:
        parts.append((0, f"<div>{several(lambda: f'<p>{text(2, 40)}</p>', 1, 3)}</div>"))
    if rng.random() < 0.85:
        parts.append((0, f"<footer>&copy; {text(1, 12)}</footer>"))
    return [*parts, (None, "</body>")]


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 17) -> list[list[tuple[int | None, str]]]:
    rng = random.Random(seed)
    return [_labelled_page(rng) for _ in range(n)]


def page_table(page: list[tuple[int | None, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of one labelled page."""
    own, labels = blocks("".join(m for _, m in page)), []
    for label, markup in page:
        if label is not None:
            labels += [label] * len(blocks(markup))
    if len(labels) != len(own):
        raise ValueError("a labelled page does not split as its parts do")
    return features(own), np.array(labels)


@functools.cache
def trained_tree() -> DecisionTree:
    xs, ys = zip(*map(page_table, labelled_pages()))
    return DecisionTree(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, tree: DecisionTree | None = None) -> str:
    """The blocks that the tree takes for main text, joined by an empty line; empty where there is none."""
    own = blocks(page)
    if not own:
        return ""
    took = (tree or trained_tree())(features(own)) > 0.5
    return "\n\n".join(b.text for b, ok in zip(own, took) if ok)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows ``(id, url, text, n_chars)``, one for each input row; null and empty pages have an empty text.

    Row by row over whole pages, no shuffle; repeated rows, null ids and null URLs stay; other columns are not read.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, "id long, url string, text string, n_chars long")
