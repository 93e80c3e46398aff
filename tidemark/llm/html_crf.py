"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with
its open elements.  Every block is content or not; the field scores a page's
labels by features of ancestor tags, class and id words and the text, and by
pairs of neighbours, and Viterbi decoding finds the best labels.

Training: up to TRAIN_PAGES pages (the lowest by a hash of page_id and url among
those of at most TRAIN_CHARS characters with an <article> element) are labelled
by their own markup.  So that weights do not hang on that one tag, each page is
laid out again in several ways: in plain divisions, with or without telling
names, with sidebars, notices, forms and comments between and after its
paragraphs.  A table without such pages trains on paragraphs made by a rule.

Blocks: character references are decoded, white space becomes one space, ends are
trimmed; blocks without text vanish.  A line break ends a block.

Cases: null or empty html gives an empty text; broken markup is read as far as it
goes, an element without end tag lasts until its parent ends; scripts, styles and
hidden elements are never text; repeated rows are separate; an empty table gives
no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

TRAIN_PAGES = 120
TRAIN_CHARS = 50_000
SEED = 7

# Elements of the HTML standard, and words that pages use as names.
_RAW = {"script", "style", "title", "textarea", "template", "iframe", "svg", "noscript", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
           "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
              "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = {"article", "main", "section", "div", "body", "nav", "aside", "header", "footer", "form", "ul", "ol",
             "table", "blockquote", "dl"}
_TAG_FEATURES = {"article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "ol", "table",
                 "figure", "blockquote", "dialog", "button", "label", "select", "fieldset", "address", "menu"}
_HEADINGS = ("h1", "h2")
_NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner adsense outbrain taboola",
    "side": "sidebar side aside widget rail related recommended more popular trending teaser",
    "comment": "comment comments reply replies respond discussion disqus responses feedback reader",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay toast disclaimer warning",
    "form": "form search subscribe subscription newsletter signup login register contact",
    "foot": "footer foot copyright legal imprint credits colophon bottom",
    "head": "header head masthead topbar logo branding top toolbar",
    "share": "share sharing social follow tags meta byline author date",
    "content": "content article post entry main body story text page prose document",
}
_NAME_OF = {word: group for group, words in _NAMES.items() for word in words.split()}
_STOCK = re.compile(r"©|\(c\)|all rights reserved|cookie|privacy|subscribe|sign up|log ?in|advert|javascript",
                    re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/=>]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")


@dataclass(eq=False, slots=True)
class Element:
    """An open element, linked to the one it stands in, with what a block inherits from all of them.

    Sets are shared with the parent where the element adds nothing, so depth costs
    one object a level.
    """

    tag: str
    groups: frozenset[str] = frozenset()
    hidden: bool = False
    label: str | None = None
    parent: Element | None = None
    tags_above: frozenset[str] = frozenset()
    groups_above: frozenset[str] = frozenset()
    inner: str = "none"

    def inside(self, parent: Element | None) -> Element:
        self.parent = parent
        tags, groups = (parent.tags_above, parent.groups_above) if parent else (frozenset(), frozenset())
        own = self.tag in _TAG_FEATURES and self.tag not in tags
        self.tags_above = tags | {self.tag} if own else tags
        self.groups_above = groups if self.groups <= groups else groups | self.groups
        self.inner = self.tag if self.tag not in _INLINE else parent.inner if parent else "none"
        if self.label is None and parent:
            self.label = parent.label
        return self


@dataclass
class Block:
    text: str
    element: Element | None
    link_chars: int
    features: list[str] = field(default_factory=list)

    @property
    def path(self) -> tuple[Element, ...]:
        """The open elements from the outermost in."""
        out, at = [], self.element
        while at:
            out.append(at)
            at = at.parent
        return tuple(reversed(out))


def _element(tag: str, attributes: str) -> Element:
    if not attributes.strip():
        return Element(tag)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = _WORD.findall(" ".join((found.get("class", ""), found.get("id", ""), found.get("role", ""))).lower())
    style = found.get("style", "").replace(" ", "").lower()
    return Element(tag, frozenset(_NAME_OF[w] for w in names if w in _NAME_OF),
                   "display:none" in style or "visibility:hidden" in style or "hidden" in found,
                   found.get("data-label"))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    links = link_chars = hidden = 0

    def close() -> None:
        nonlocal link_chars
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, link_chars))
            held.clear()
        link_chars = 0

    def pop() -> None:
        nonlocal links, hidden
        gone = stack.pop()
        open_tags[gone.tag] -= 1
        links -= gone.tag == "a"
        hidden -= gone.hidden

    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        end = token.start() if token else n
        if end > at and not hidden:
            held.append(page[at:end])
            link_chars += (end - at) if links else 0
        if not token:
            break
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            close()
        if token[1] or token[4]:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        attributes = token[3] if token[2] else token[6]
        alone = (attributes or "").endswith("/")
        if tag in _RAW and not (alone and tag == "svg"):  # of these only svg may close itself
            finish = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = finish.end() if finish else n
        elif tag not in _VOID and not alone:
            closes = _CLOSED_BY.get(tag, ())
            for i in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in closes) else ():
                if stack[i].tag in closes:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in _BARRIERS:
                    break
            element = _element(tag, attributes or "").inside(stack[-1] if stack else None)
            stack.append(element)
            open_tags[tag] += 1
            links += tag == "a"
            hidden += element.hidden
    close()
    return out


def _describe(page: list[Block]) -> None:
    """Give every block its features."""
    total, heading = len(page), False
    inherited: dict[tuple, list[str]] = {}
    for place, block in enumerate(page):
        at = block.element
        key = (at.tags_above, at.groups_above, at.inner) if at else (frozenset(), frozenset(), "none")
        if key not in inherited:
            tags, groups, inner = key
            inherited[key] = ([f"in:{t}" for t in sorted(tags)] + [f"name:{g}" for g in sorted(groups)]
                              + [f"leaf:{inner}"] + ["bare"] * (not tags and not groups))
        text, words = block.text, block.text.count(" ") + 1
        linked = block.link_chars / max(1, len(text))
        f = block.features = list(inherited[key])
        f.append("words:" + ("1-2" if words < 3 else "3-5" if words < 6 else "6-12" if words < 13 else
                             "13-30" if words < 31 else "31+"))
        f.append("linked:" + ("none" if not linked else "some" if linked < 0.4 else "most"))
        f.append("ends:" + ("mark" if text[-1] in ".!?…\"'”»" else "else"))
        if _STOCK.search(text):
            f.append("stock")
        heading = heading or at is not None and (
            at.tag in _HEADINGS or at.parent is not None and at.parent.tag in _HEADINGS)
        f.append("after heading" if heading else "before heading")
        if place == 0:
            f.append("first")
        if place == total - 1:
            f.append("last")


def blocks_with_features(page: str) -> list[Block]:
    found = blocks(page)
    _describe(found)
    return found


@dataclass
class Model:
    """Weights by feature (log-odds of content) and by pair of neighbouring labels."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the labels of highest score."""
        get, pairs = self.weights.get, self.pairs
        best = (0.0, 0.0)
        back: list[tuple[int, int]] = []
        for i, block in enumerate(page):
            own = (0.0, sum([get(f, 0.0) for f in block.features]))
            if i:
                came = tuple(int(best[1] + pairs[1][y] > best[0] + pairs[0][y]) for y in (0, 1))
                best = tuple(best[came[y]] + pairs[came[y]][y] + own[y] for y in (0, 1))
                back.append(came)
            else:
                best = own
        label = int(best[1] > best[0])
        out = [label] if page else []
        for came in reversed(back):
            label = came[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def gradients(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray,
              t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels y and its gradients by weights and pairs, by forward and backward sums.

    x (pages, blocks, features), y and mask (pages, blocks); pages are padded at their end.
    """
    n, length = mask.shape
    unary = np.stack([np.zeros((n, length)), (x @ w.astype(x.dtype)).astype(float)], axis=2)
    both = mask[:, 1:]
    seen_t = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    forward = np.zeros((n, length, 2))
    forward[:, 0] = unary[:, 0]
    for j in range(1, length):
        step = np.logaddexp(forward[:, j - 1, 0, None] + t[0], forward[:, j - 1, 1, None] + t[1]) + unary[:, j]
        forward[:, j] = np.where(mask[:, j, None], step, forward[:, j - 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros((n, length, 2))
    expected_t = np.zeros((2, 2))
    for j in range(length - 2, -1, -1):
        later = unary[:, j + 1] + backward[:, j + 1]
        step = np.logaddexp(t[:, 0] + later[:, 0, None], t[:, 1] + later[:, 1, None])
        backward[:, j] = np.where(mask[:, j + 1, None], step, backward[:, j + 1])
        pair = np.exp(forward[:, j, :, None] + t + later[:, None, :] - total[:, None, None])
        expected_t += pair[mask[:, j + 1]].sum(axis=0)
    content = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
    own = ((unary[:, :, 1] * y) * mask).sum() + (seen_t * t).sum()
    return (float(own - total.sum()), np.einsum("ijk,ij->k", x, ((y * mask) - content).astype(x.dtype)),
            seen_t - expected_t)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, l2: float = 0.02, rate: float = 0.3) -> Model:
    """Maximum likelihood by full gradients; pages of all lengths at once, padded and masked."""
    names = sorted({f for page, _ in pages for b in page for f in b.features})
    number = {f: i for i, f in enumerate(names)}
    n, length = len(pages), max(len(p) for p, _ in pages)
    x = np.zeros((n, length, len(names)), np.float32)
    y, mask = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (page, labels) in enumerate(pages):
        mask[i, :len(page)] = True
        y[i, :len(page)] = labels
        for j, block in enumerate(page):
            x[i, j, [number[f] for f in block.features]] = 1
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    squares_w, squares_t = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    scale = mask.sum()
    for _ in range(rounds):
        _, by_w, by_t = gradients(x, y, mask, w, t)
        grad_w = by_w / scale - l2 * w / len(names)
        grad_t = by_t / scale - l2 * t / len(names)
        squares_w += grad_w ** 2
        squares_t += grad_t ** 2
        w += rate * grad_w / np.sqrt(squares_w)
        t += rate * grad_t / np.sqrt(squares_t)
    return Model(dict(zip(names, w.tolist(), strict=True)), tuple(map(tuple, t.tolist())))


def _sentence(rng: np.random.Generator, words: int) -> str:
    made = ["".join(rng.choice(list("abdefgilmnorstu"), rng.integers(2, 9))) for _ in range(words)]
    return " ".join(made).capitalize() + "."


def layouts(title: str, paragraphs: list[str], spare: list[str], rng: np.random.Generator) -> Iterator[str]:
    """Labelled pages of one article; spare are sentences for what stands around it."""
    esc = entities.escape
    pick = lambda: esc(spare[rng.integers(len(spare))])
    short = lambda: " ".join(pick().split()[:int(rng.integers(1, 4))]).rstrip(".")
    item = lambda: f'<li><a href="#">{short()}</a></li>'
    menu = lambda: f"<ul>{''.join(item() for _ in range(rng.integers(3, 8)))}</ul>"
    body = [f"<h1>{esc(title)}</h1>", *[f"<p>{esc(p)}</p>" for p in paragraphs]]
    content = lambda parts: f'<div data-label="1">{"".join(parts)}</div>'
    comments = "".join(f"<li><b>{short()}</b><p>{pick()} {pick()}</p></li>" for _ in range(rng.integers(1, 5)))
    form = f"<form><label>{short()}</label><input><button>{short()}</button><p>{pick()}</p></form>"
    around = {
        "nav": [f"<nav>{menu()}</nav>", f'<div class="menu">{menu()}</div>', f"<header><p>{short()}</p>{menu()}</header>",
                f'<div id="header">{short()}</div>'],
        "side": [f"<aside><h3>{short()}</h3><p>{pick()}</p>{menu()}</aside>",
                 f'<div class="sidebar"><h3>{short()}</h3><p>{pick()}</p></div>',
                 f'<div class="related-posts">{menu()}<p>{pick()}</p></div>'],
        "advert": [f'<div class="ad">{pick()}</div>', f'<div class="advert banner"><p>{pick()}</p></div>',
                   f'<div class="sponsored"><a href="#">{pick()}</a></div>'],
        "notice": [f'<div class="cookie-notice"><p>{pick()}</p><button>{short()}</button></div>',
                   f'<div role="alert">{pick()}</div>', f'<div id="consent"><p>{pick()} {pick()}</p></div>'],
        "form": [form, f'<div class="newsletter">{form}</div>', f'<div class="search">{form}</div>'],
        "comment": [f'<section class="comments"><h2>{short()}</h2><ol>{comments}</ol></section>',
                    f'<div id="comments">{comments}</div>',
                    "".join(f'<div class="comment"><p>{pick()}</p></div>' for _ in range(3))],
        "foot": [f"<footer>&copy; {short()} &middot; {pick()}</footer>", f'<div class="footer"><p>{pick()}</p></div>',
                 f'<div id="footer">{menu()}<p>&copy; {pick()}</p></div>'],
    }
    one = lambda kind: around[kind][rng.integers(len(around[kind]))]
    some = lambda *kinds: "".join(one(k) for k in kinds if rng.random() < 0.6)
    middle = len(body) // 2 + 1
    inside = [*body[:middle], f'<div data-label="0">{some("advert", "side", "form")}</div>', *body[middle:]]
    yield (one("nav") + some("advert", "notice") + f"<article>{content(inside)}</article>"
           + some("comment", "side") + one("foot"))
    yield (one("nav") + one("notice") + f'<main><article>{content(body)}<div data-label="0">{one("comment")}</div>'
           "</article></main>" + one("side") + one("foot"))
    yield one("nav") + f'<div class="post-content">{content(inside)}</div>' + some("comment", "form", "side") + one("foot")
    yield some("nav", "advert") + f'<div id="main">{content(body)}</div>' + one("comment") + some("form", "foot")
    yield (f"<table><tr><td>{menu() if rng.random() < 0.5 else '<br>'.join(item() for _ in range(4))}</td>"
           f"<td>{content(body)}</td></tr></table>" + one("foot"))
    second = f"<h2>{esc(title)}</h2>"
    divided = [second, *[f"<div>{esc(p)}</div>" for p in paragraphs]]
    name = ("story", "text", "entry", "main-text", "article-body")[rng.integers(5)]
    yield one("nav") + f'<div class="{name}">{content(divided)}</div>' + some("side", "comment") + one("foot")
    yield (one("nav") + f"<main><section>{content([second, *body[1:]] if rng.random() < 0.5 else body)}</section></main>"
           + some("comment", "side", "foot"))
    brief = [f"<p>{esc(' '.join(p.split()[:int(rng.integers(5, 16))]))}.</p>" for p in paragraphs[:4]]
    yield f"<article>{content(brief)}</article>" + some("comment") + one("foot")
    yield content(brief) + some("notice", "foot")
    yield one("nav") + f"<div>{content(body)}</div>" + some("advert", "side") + one("foot")


def labelled(pages: list[str], seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of pages with an article, and of their other layouts."""
    rng = np.random.default_rng(seed)
    out, articles = [], []
    outside = {"nav", "aside", "footer", "form"}
    for page in pages:
        found = blocks_with_features(page)
        own = [int(b.element is not None and "article" in b.element.tags_above
                   and not b.element.tags_above & outside) for b in found]
        if any(own):
            out.append((found, own))
            articles.append([b.text for b, y in zip(found, own, strict=True) if y])
    if not articles:
        articles = [[_sentence(rng, 8), *[_sentence(rng, int(rng.integers(10, 60))) for _ in range(6)]]
                    for _ in range(40)]
    spare = [s for a in articles for text in a for s in re.findall(r"[^.]{8,160}\.", text)][:5000] or [
        _sentence(rng, 12) for _ in range(50)]
    for title, *paragraphs in articles:
        for layout in layouts(title, paragraphs or [title], spare, rng):
            found = blocks_with_features(layout)
            labels = [int(b.element.label) if b.element and b.element.label is not None else 0 for b in found]
            out.append((found, labels))
    return out


def fit(pages: DataFrame, n_pages: int = TRAIN_PAGES, max_chars: int = TRAIN_CHARS) -> Model:
    """Train on the bounded sample."""
    fit_for_it = (F.length("html") <= max_chars) & F.contains(F.lower("html"), F.lit("<article"))
    drawn = (pages.select(F.xxhash64("page_id", "url").alias("draw"), F.col("html").cast("string").alias("html"))
             .where(fit_for_it))
    # a threshold on the draw lets about four times the sample through, so that no task sends more than its share
    share = min(1.0, 4 * n_pages / max(1, drawn.count()))
    rows = (drawn.where(F.col("draw") < int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1.0 else F.lit(True))
            .orderBy("draw", "html").limit(n_pages).collect())
    examples = labelled([r["html"] for r in rows])
    longest = 4 * sorted(len(p) for p, _ in examples)[len(examples) // 2] + 20
    return train([(p, y) for p, y in examples if p and len(p) <= longest])


def main_text(page: str, model: Model) -> str:
    found = blocks_with_features(page)
    return "\n".join([b.text for b, keep in zip(found, model.decode(found), strict=True) if keep])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, model) for page in texts(batch.column(2))]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1),
                                   "text": pa.array(found, pa.string()),
                                   "n_chars": pa.array(map(len, found), pa.int64())})

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
