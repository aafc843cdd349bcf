"""HTML extraction by maximum-scoring subsequence.

A page becomes a sequence of runs of text and tags.  Each word of a run scores by what surrounds it: the names, classes, ids and roles of the elements that are open, whether it is
in a link or a paragraph, and how long its run is; each tag scores less than nothing.  All these weights are learned from labelled pages (a logistic regression for words, log odds for tags),
so a menu's or an advert's words score below zero and an article's above.  One linear scan finds the contiguous range with the highest sum.  It is widened to the whole of the
article or main element that it lies in, if any, and runs of negative score inside it (an advert amid an article) are left out.

Only what is never text of a page is skipped by name: comments, declarations, and the inside of elements such as scripts and styles.  An element that is never closed ends with the element
around it, or where an article, a main element or a footer begins.

Defined results: a null or empty page, and a page without words of positive score,
gives the empty string.  Repeated rows give repeated results.  Nothing is shortened; time is linear in the page's length.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailspark.llm.common import steps

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9-]*)")
ATTRS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=/>])|\bdisplay\s*:\s*none|\baria-hidden\s*=\s*[\"']?true", re.I)

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that open anew where one of them is open without its end.
ALONE = frozenset("p li dt dd tr td th option".split())
PAGE_PARTS = frozenset("article main footer".split())
HELD = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def element_features(name: str, tag: str, inside: bool) -> tuple[str, ...]:
    """What an open element says about the words in it; ``inside`` an article or main element a header is another thing."""
    out = [f"{name}{'@in' if inside else ''}" if name not in HELD else name]
    if "=" in tag:
        out += sorted({f".{w}" for v in ATTRS.findall(tag) for w in re.split(r"[^a-z]+", v.lower()) if w})
        if HIDDEN.search(tag):
            out.append("!hidden")
    elif HIDDEN.search(tag):
        out.append("!hidden")
    return tuple(out)


class Open:
    """An open element: what it says, the element around it, and (once it is asked for) the sum of the weights of both."""

    __slots__ = ("says", "around", "total")

    def __init__(self, says: tuple[str, ...], around: Open | None):
        self.says, self.around, self.total = says, around, None


@dataclass
class Item:
    """A run of text (``name`` empty) or a tag."""

    name: str
    text: str = ""
    around: Open | None = None
    own: tuple[str, ...] = ()
    words: int = 0
    held: int = 0  # number of the outermost article or main element around it


def items(page: str) -> list[Item]:
    raw: list[tuple[str, str, str]] = []
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            raw.append(("w", page[at : m.start()], ""))
        at = m.end()
        tag = m[0]
        if m[1] or tag.startswith(("<!", "<?")):
            continue
        raw.append(("c" if tag[1] == "/" else "o", NAME.match(tag)[1].lower(), tag))
    if at < len(page):
        raw.append(("w", page[at:], ""))
    # which opening tags have an end of their own
    waiting: dict[str, list[int]] = {}
    closed: set[int] = set()
    opens_of: dict[int, int] = {}
    for i, (kind, name, tag) in enumerate(raw):
        if kind == "o" and name not in VOID and not tag.endswith("/>"):
            waiting.setdefault(name, []).append(i)
        elif kind == "c" and waiting.get(name):
            j = waiting[name].pop()
            closed.add(j)
            opens_of[i] = j

    out: list[Item] = []
    stack: list[tuple[int, str, Open]] = []
    places: dict[int, None] = {}  # places of the open elements
    links = inside = held = numbers = 0

    def pop() -> None:
        nonlocal links, inside, held
        place, name, _ = stack.pop()
        del places[place]
        links -= name == "a"
        if name in HELD:
            inside -= 1
            held = held if inside else 0

    for i, (kind, value, tag) in enumerate(raw):
        if kind == "w":
            n = len(value.split())
            block = next((s[1] for s in reversed(stack[-6:]) if s[1] in BLOCKS), "body")
            own = ("#link" if links else "#text", "#prose" if block in PROSE else "#block", f"#long{min(4, max(1, n.bit_length() // 2))}", "#held" if inside else "#loose")
            out.append(Item("", value, stack[-1][2] if stack else None, own, n, held))
            continue
        if kind == "o":
            if value in PAGE_PARTS:
                while stack and stack[-1][0] not in closed:
                    pop()
            elif value in ALONE:
                while stack and stack[-1][0] not in closed and stack[-1][1] not in ("ul", "ol", "table", "div"):
                    pop()
            out.append(Item(value, held=held))
            if value not in VOID and not tag.endswith("/>"):
                if value in HELD:
                    if not inside:
                        numbers += 1
                        held = numbers
                    inside += 1
                    out[-1].held = held
                links += value == "a"
                stack.append((i, value, Open(element_features(value, tag, inside > 0), stack[-1][2] if stack else None)))
                places[i] = None
        else:
            if i in opens_of and opens_of[i] in places:
                while stack[-1][0] != opens_of[i]:
                    pop()
                pop()
            out.append(Item(value, held=held))
    return out


@dataclass
class Weights:
    words: dict[str, float]  # by feature; "" is what every word has
    tags: dict[str, float]
    unknown: float = -0.3  # a tag that no labelled page holds


def run_features(item: Item) -> Counter:
    out, at = Counter(("", *item.own)), item.around
    while at is not None:
        out.update(at.says)
        at = at.around
    return out


def fit(labelled: Iterable[tuple[str, list[str]]], epochs: int = 500) -> Weights:
    """Weights from labelled pages: (html, texts of its content blocks). A run is content if its text is part of a content block; tags between two runs of content count as such too."""
    rows: list[tuple[Counter, bool, int]] = []
    good, bad = Counter(), Counter()
    for page, content in labelled:
        joined = "\n".join(content)
        seen = items(page)
        is_good = [not x.name and bool(x.text.strip()) and " ".join(html_lib.unescape(x.text).split()) in joined for x in seen]
        first = next((i for i, x in enumerate(is_good) if x), len(seen))
        last = max((i for i, x in enumerate(is_good) if x), default=-1)
        for i, x in enumerate(seen):
            if x.name:
                (good if first <= i <= last else bad)[x.name] += 1
            elif x.words:
                rows.append((run_features(x), is_good[i], x.words))
    number = {f: i for i, f in enumerate(sorted({f for r, _, _ in rows for f in r}))}
    at = np.array([(i, number[f], n) for i, (r, _, _) in enumerate(rows) for f, n in r.items()], np.int64).reshape(-1, 3)
    y = np.array([1.0 if g else 0.0 for _, g, _ in rows])
    share = np.sqrt(np.array([n for _, _, n in rows], float))
    share /= share.sum() or 1
    w, pace = np.zeros(len(number)), np.full(len(number), 1e-8)
    for _ in range(epochs):
        z = np.bincount(at[:, 0], w[at[:, 1]] * at[:, 2], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.bincount(at[:, 1], error[at[:, 0]] * at[:, 2], len(w)) + 3e-5 * w
        pace += grad**2
        w -= 0.15 * grad / np.sqrt(pace)
    g, b = sum(good.values()) or 1, sum(bad.values()) or 1
    odds = {t: math.log((good[t] + 0.5) / (g + 1)) - math.log((bad[t] + 0.5) / (b + 1)) for t in good.keys() | bad.keys()}
    return Weights({f: float(w[i]) for f, i in number.items()}, {t: min(-0.02, max(-1.0, 0.25 * x)) for t, x in odds.items()})


def labelled_pages(count: int = 800, seed: int = 7) -> list[tuple[str, list[str]]]:
    """A bounded set of labelled pages in many layouts, made from a seed: articles among menus, headers, sidebars, notices, adverts, forms, comments and footers, under names that sites
    give them, and articles under names that look like those."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    text = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{i}">{text(1, 3)}</a></li>' for i in range(r.randint(a, b)))
    loose = lambda a, b: " ".join(f"<a href=#>{text(1, 4)}</a>" for _ in range(r.randint(a, b)))
    named = lambda *xs: r.choice([f' class="{r.choice(xs)}"', f' id="{r.choice(xs)}"', f' class="{r.choice(xs)} {word()}"', f' class="{word()}-{r.choice(xs)}"'])
    junk = {
        "menu": lambda: r.choice([f"<nav><ul>{links(3, 12)}</ul></nav>", f"<div{named('menu', 'nav', 'navbar', 'navigation', 'main-menu', 'breadcrumb', 'breadcrumbs', 'topbar', 'skip', 'toolbar')}>{loose(2, 9)}</div>", f"<ul{named('menu', 'nav', 'pagination', 'pager')}>{links(3, 9)}</ul>", f'<div role="navigation">{loose(3, 9)}</div>', f"<menu>{links(2, 5)}</menu>"]),
        "header": lambda: r.choice([f"<header><a href=/>{text(1, 3)}</a> <span>{text(2, 8)}</span></header>", f"<div{named('header', 'site-header', 'masthead', 'banner', 'page-head')}><p>{text(2, 9)}</p>{loose(0, 5)}</div>", f'<div role="banner">{text(2, 6)}</div>', f"<header><h1>{text(1, 4)}</h1><p>{text(3, 9)}</p></header>"]),
        "side": lambda: r.choice([f"<aside{r.choice(['', named('sidebar', 'widget')])}><h3>{text(1, 4)}</h3><p>{text(4, 30)}</p><ul>{links(0, 6)}</ul></aside>", f"<div{named('sidebar', 'side', 'widget', 'widgets', 'related', 'recommended', 'recommendations', 'teaser', 'teasers', 'outbrain', 'taboola', 'popular')}><h3>{text(1, 4)}</h3><p>{text(4, 25)}</p>{loose(0, 5)}</div>", f'<div role="complementary"><p>{text(5, 25)}</p></div>', f"<section{named('related', 'recommended', 'teaser', 'popular')}><h2>{text(1, 3)}</h2><p>{text(5, 25)}</p></section>", f'<article{named("teaser", "related", "card")}><h3><a href=#>{text(2, 6)}</a></h3><p>{text(4, 12)}</p></article>']),
        "notice": lambda: f"<{(e := r.choice(['div', 'div', 'section', 'p']))}{named('notice', 'notices', 'cookie', 'cookies', 'cookie-notice', 'cookie-banner', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'overlay', 'paywall', 'dialog', 'newsletter', 'subscribe', 'signup')}>{text(4, 30)} <a href=#>{text(1, 2)}</a></{e}>",
        "ad": lambda: r.choice([f"<div{named('ad', 'ads', 'advert', 'adverts', 'advertisement', 'advertising', 'adbox', 'adslot', 'ad-slot', 'sponsor', 'sponsored', 'promo', 'promotion', 'banner')}>{text(1, 25)}</div>", f'<ins class="adsbygoogle">{text(1, 15)}</ins>', f"<aside{named('ad', 'advert', 'promo')}><p>{text(3, 20)}</p></aside>", f"<p{named('ad', 'sponsored', 'promo')}>{text(3, 20)}</p>"]),
        "form": lambda: f"<form{r.choice(['', named('search', 'login', 'contact', 'signup', 'newsletter')])}><label>{text(1, 4)}</label><input> <button>{text(1, 2)}</button> <p>{text(2, 9)}</p></form>",
        "hidden": lambda: r.choice([f"<div hidden>{text(3, 20)}</div>", f'<div style="display:none"><p>{text(3, 30)}</p></div>', f'<span aria-hidden="true">{text(1, 6)}</span>', f"<dialog>{text(3, 15)}</dialog>"]),
        "share": lambda: f"<div{named('share', 'sharing', 'social', 'tags', 'meta', 'buttons')}>{loose(2, 6)}</div>",
        "comments": lambda: f"<{(e := r.choice(['section', 'div', 'ol', 'ul']))}{named('comments', 'comment', 'commentlist', 'comment-list', 'disqus', 'replies', 'reply', 'respond', 'discussion')}>" + "".join(r.choice([f'<div class="comment"><b>{word()}</b><p>{text(3, 40)}</p></div>', f"<p>{text(4, 40)}</p>", f'<article class="comment"><p>{text(4, 30)}</p></article>', f"<li><p>{text(4, 40)}</p></li>"]) for _ in range(r.randint(1, 5))) + f"</{e}>",
        "footer": lambda: r.choice([f"<footer><p>&copy; {text(2, 20)}</p>{loose(0, 6)}</footer>", f"<footer>&copy; {text(3, 20)}</footer>", f"<div{named('footer', 'foot', 'site-footer', 'copyright', 'bottom')}><p>{text(3, 20)}</p>{loose(0, 5)}</div>", f'<div role="contentinfo">{text(3, 15)}</div>']),
    }
    holders = [
        "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', "<div id=content>{}</div>", "<section>{}</section>", '<div class="post">{}</div>', '<div class="entry-content">{}</div>',
        '<div class="article-body">{}</div>', '<div class="story">{}</div>', '<div id="main">{}</div>', '<div role="main">{}</div>', '<div class="text">{}</div>', "<div>{}</div>", "<div><div>{}</div></div>", "{}", "{}", "<table><tr><td>{}</td></tr></table>",
        '<div class="page"><div class="column">{}</div></div>', '<div class="post notice-board">{}</div>', '<div class="header-image story">{}</div>', '<section class="search story">{}</section>', '<article class="post has-sidebar">{}</article>',
        '<div class="content with-comments">{}</div>', '<div class="layout sidebar-left"><div class="content">{}</div></div>', '<article class="ad-free entry">{}</article>', '<div class="main-content menu-open">{}</div>',
    ]
    out = []
    for k in range(count):
        parts, blocks = [], []

        def add(body: str, *texts: str, parts=parts, blocks=blocks) -> None:
            parts.append(body)
            blocks.extend(texts)

        title = text(2, 10)
        add(r.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f'<div class="entry-header"><h2>{title}</h2></div>', f"<h2>{title}</h2>"]), title)
        for _ in range(r.choice((1, 2, 3, 5, 8))):
            t = text(6, 60) if r.random() < 0.85 else text(1, 6)
            a, b, c = text(3, 20), text(1, 3), text(3, 20)
            x = r.random()
            if x < 0.6:
                add(r.choice([f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br><p>", f"<div>{t}</div>"]), t)
            elif x < 0.75:
                add(f"<p>{a} <a href=#>{b}</a> {c}</p>", a, b, c)
            elif x < 0.82:
                add(f"<h3>{b}</h3>", b)
            elif x < 0.88:
                add(f"<ul><li>{a}</li><li>{c}</li></ul>", a, c)
            elif x < 0.93:
                add(r.choice([f"<blockquote>{a}</blockquote>", f"<pre>{a}</pre>", f"<figure><img><figcaption>{a}</figcaption></figure>", f"<section><p>{a}</p></section>"]), a)
            else:
                add(f"<p>{a} <b>{b}</b> <i>{c}</i></p>", a, b, c)
            if r.random() < 0.3:
                parts.append(junk[r.choice(("ad", "ad", "ad", "share", "side", "notice", "hidden", "form"))]())
        if r.random() < 0.2:
            parts.append(junk[r.choice(("share", "comments", "side"))]())
        some = lambda *names: "".join(junk[n]() for n in names if r.random() < 0.6)
        before, after = list(("header", "menu", "notice", "ad", "side", "form", "hidden")), list(("comments", "side", "ad", "share", "form", "notice", "footer"))
        r.shuffle(before)
        if k % 9 == 0:  # hardly more than the text itself
            before, after = r.sample(before, r.choice((0, 0, 1))), r.sample(after, r.choice((0, 0, 1)))
        page = some(*before) + holders[k % len(holders)].format("".join(parts)) + some(*after)
        out.append((r.choice([f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{page}</body></html>", f"<body>{page}", page]), blocks))
    return out


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous range with the highest sum, the first of several; (0, 0) if no score is positive."""
    best, total, start, at = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, at = total, (start, i + 1)
    return at


def item_scores(seq: list[Item], weights: Weights) -> list[float]:
    """The score of each run (its words' scores, within 3 either way) and tag."""
    out, get, known = [], weights.words.get, {}
    base = get("", 0.0)

    def of(says: tuple[str, ...]) -> float:
        if says not in known:
            known[says] = sum(get(f, 0.0) for f in says)
        return known[says]

    for x in seq:
        if x.name:
            out.append(weights.tags.get(x.name, weights.unknown))
            continue
        chain, at = [], x.around
        while at is not None and at.total is None:
            chain.append(at)
            at = at.around
        for one in reversed(chain):
            one.total = of(one.says) + (one.around.total if one.around is not None else 0.0)
        out.append(x.words * max(-3.0, min(3.0, base + (x.around.total if x.around is not None else 0.0) + of(x.own))))
    return out


def extract(page: str | None, weights: Weights | None = None) -> str:
    if not page:
        return ""
    weights = weights if weights is not None else default_weights()
    seq = items(page)
    scores = item_scores(seq, weights)
    start, end = best_region(scores)
    if start == end:
        return ""
    # the whole of the article or main element that the region lies in
    numbers = {x.held for x in seq[start:end] if not x.name and x.words}
    numbers.discard(0)
    if numbers:
        inside = [i for i, x in enumerate(seq) if x.held in numbers]
        start, end = min(start, inside[0]), max(end, inside[-1] + 1)
    # and whole blocks around it
    while start > 0 and not (seq[start - 1].name in BLOCKS) and not (not seq[start - 1].name and scores[start - 1] < 0):
        start -= 1
    while end < len(seq) and not (seq[end].name in BLOCKS) and not (not seq[end].name and scores[end] < 0):
        end += 1
    blocks, parts = [], []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            blocks.append(line)

    for i in range(start, end):
        x = seq[i]
        if not x.name:
            if scores[i] >= 0:
                parts.append(html_lib.unescape(x.text))
        elif x.name in BLOCKS:
            flush()
        elif x.name == "br":
            parts.append(" ")
    flush()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, html_column: str = "html", weights: Weights | None = None) -> DataFrame:
    """The pages with a column ``text``; other columns stay, but one named ``text`` is replaced."""
    kept = [c for c in pages.columns if c not in (html_column, "text")]
    source = pages.select(*kept, html_column)
    schema = pages.select(*kept).schema.add("text", "string", False)
    weights = weights if weights is not None else default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, html_column):
            texts = [extract(x, weights) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    return source.mapInArrow(run, schema)
