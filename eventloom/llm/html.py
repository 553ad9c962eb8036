"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text with no block element inside, each with the open elements around it. A block
has features of its element, its ancestors' elements, the words of their classes and ids, and of its text: length, ends,
share of letters inside links. Two labels, main and other, form a chain; weights are fitted by gradient steps on the
log-likelihood of labelled pages (`labelled_pages`, made here by rule over many layouts, or the caller's) and pages are
decoded by Viterbi. Main blocks are joined by an empty line.

Cases: null or empty html has no blocks and an empty text; broken markup is read as far as it goes (unclosed comments,
scripts and tags end with the page, stray ends are skipped); very long pages are read whole; equal rows give equal texts;
an empty table gives an empty result; a column with the name of a result is replaced.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches

#: Elements of HTML that stand as blocks, that have no end, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
#: Elements that end an open one of the second set, within the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words of classes and ids, by what they say.
HINTS = {
    "main": "article content main post entry story body text prose markdown",
    "comment": "comment comments discussion disqus reply replies respond reader readers thread response responses feedback",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense commercial",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pager pagination tabs",
    "edge": "header footer masthead topbar bottom copyright legal colophon brand site",
    "side": "sidebar side aside widget related recommended trending popular more rail recirc",
    "notice": "cookie cookies consent notice gdpr privacy alert banner popup modal overlay toast announcement disclaimer warning message",
    "form": "form search login signup subscribe subscription newsletter input field register contact",
    "share": "share sharing social follow tags meta byline author date",
}
_HINT = {w: k for k, v in HINTS.items() for w in v.split()}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]
    hints: tuple[str, ...]
    linked: float


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        text = " ".join("".join(references.unescape(t) for t, _ in parts).split())
        if text:
            inside = sum(len(t) for t, a in parts if a)
            out.append(Block(text, tuple(t for t, _ in stack), tuple(dict.fromkeys(h for _, v in stack for h in v)), inside / max(1, sum(len(t) for t, _ in parts))))
        parts.clear()

    def close(names: set[str], within: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if not m[2]:
            continue
        name, ending = m[2].lower(), bool(m[1])
        if name in RAW and not ending:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append((" ", links > 0))
        elif name == "a":
            links = 0 if ending else 1
        if name not in BLOCKS:
            continue
        if ending:
            if any(t == name for t, _ in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
                links = 0
            elif name == "p":
                flush()
            continue
        flush()
        close({"p"}, {"td", "th", "button", "table"})
        if name in CLOSES:
            close(*CLOSES[name])
        if name not in VOID:
            said = " ".join("".join(x) for x in _NAMED.findall(m[3]))
            hints = tuple(dict.fromkeys(_HINT[w] for w in (x.lower() for x in _WORD.findall(said)) if w in _HINT))
            stack.append((name, hints))
    flush()
    return out


#: Elements that are features by themselves.
TAGS = "p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption div section article main aside nav header footer form button label select option textarea title head body legend summary ul ol table span".split()
TEXT = ["short", "middle", "long", "sentence", "linked", "half linked", "copyright", "bias"]
NAMES = {n: i for i, n in enumerate([f"in {t}" for t in TAGS] + [f"is {t}" for t in TAGS] + [f"hint {h}" for h in HINTS] + ["article first", "article header", "article footer"] + TEXT)}


def features(b: Block) -> list[int]:
    out = {f"in {t}" for t in b.tags} | {f"is {t}" for t in b.tags[-1:]} | {f"hint {h}" for h in b.hints}
    if "article" in b.tags or "main" in b.tags:
        inner = b.tags[max(k for k, t in enumerate(b.tags) if t in ("article", "main")) :]
        out |= {f"article {t}" for t in ("header", "footer") if t in inner}
        if len(inner) <= 2:
            out.add("article first")
    n = len(b.text)
    out |= {"short" if n < 40 else "middle" if n < 160 else "long", "bias"}
    if b.text[-1] in ".!?\"'”»…:":
        out.add("sentence")
    if b.linked > 0.5:
        out.add("linked")
    elif b.linked > 0.2:
        out.add("half linked")
    if "©" in b.text or "all rights reserved" in b.text.lower():
        out.add("copyright")
    return sorted(NAMES[x] for x in out if x in NAMES)


class Field(NamedTuple):
    """weights: feature x label; steps: label x label; first: label. Label 1 is main."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray


def viterbi(field: Field, found: list[list[int]]) -> list[int]:
    if not found:
        return []
    own = [field.weights[f].sum(axis=0) for f in found]
    best, back = field.first + own[0], []
    for e in own[1:]:
        to = best[:, None] + field.steps
        back.append(to.argmax(axis=0))
        best = to.max(axis=0) + e
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 250, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Adam steps on the mean log-likelihood of pages (features, labels), all pages at once, padded."""
    pages = [p for p in pages if p[0]]
    n, top = len(pages), max(len(p[0]) for p in pages)
    x = np.zeros((n, top, len(NAMES)), np.float32)
    y, on = np.zeros((n, top), int), np.zeros((n, top), bool)
    for k, (found, labels) in enumerate(pages):
        on[k, : len(found)], y[k, : len(found)] = True, labels
        for t, f in enumerate(found):
            x[k, t, f] = 1
    gold = np.eye(2)[y] * on[..., None]
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    theta = [np.zeros((len(NAMES), 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    total = on.sum()
    rows = x[on]

    def join(a: np.ndarray, axis: int) -> np.ndarray:
        top_ = a.max(axis=axis, keepdims=True)
        return (top_ + np.log(np.exp(a - top_).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        w, steps, first = theta
        own = np.zeros((n, top, 2))
        own[on] = rows @ w.astype(np.float32)
        fore, aft = np.zeros((n, top, 2)), np.zeros((n, top, 2))
        fore[:, 0] = first + own[:, 0]
        for t in range(1, top):
            new = join(fore[:, t - 1, :, None] + steps, 1) + own[:, t]
            fore[:, t] = np.where(on[:, t, None], new, fore[:, t - 1])
        for t in range(top - 2, -1, -1):
            new = join(steps + (own[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
            aft[:, t] = np.where(on[:, t + 1, None], new, 0.0)
        z = join(fore[:, -1], 1)
        share = np.exp(fore + aft - z[:, None, None]) * on[..., None]
        two = np.exp(fore[:, :-1, :, None] + steps + (own[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        grads = [rows.T @ (gold - share)[on] / total - l2 * w, (pairs - two.sum(axis=(0, 1))) / total - l2 * steps, (gold[:, 0] - share[:, 0]).sum(axis=0) / total]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] + rate * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)
    return Field(*theta)


#: Stands in the main blocks of a page in the making.
MARK = "\ue000"


def labelled_pages(n: int = 260, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages by rule, with the label of each leaf block: layouts with and without article elements, and furniture
    before, after and inside the article."""
    out = []
    for k in range(n):
        r = random.Random(seed * 100_003 + k)
        word = lambda r=r: "".join(r.choice("aeioulnrstdmpkbv") for _ in range(r.randint(2, 8)))
        words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()  # noqa: B023,E731

        def block(tag: str, text: str, main: int) -> str:
            return f"<{tag}>{MARK * main}{text}</{tag.split()[0]}>"

        para = lambda main, a=1, b=60: block("p", words(a, b) + r.choice([".", ".", ".", "!", ""]), main)  # noqa: B023,E731

        def menu(tag: str = "nav", attrs: str = "") -> str:
            items = "".join(block("li", f'<a href="/{word()}">{words(1, 3)}</a>', 0) for _ in range(r.randint(2, 7)))  # noqa: B023
            return f"<{tag}{attrs}><ul>{items}</ul></{tag}>"

        def advert() -> str:
            name = r.choice(["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "ad-slot", "advertisement"])  # noqa: B023
            return block(f'{r.choice(["div", "aside", "section"])} class="{name}"', words(2, 25) + ".", 0)  # noqa: B023

        def notice() -> str:
            name = r.choice(["cookie-notice", "notice", "consent", "cookie-banner", "alert", "gdpr", "announcement", "popup"])  # noqa: B023
            return f'<div class="{name}">' + para(0, 5, 30) + (block("button", words(1, 2), 0) if r.random() < 0.5 else "") + "</div>"  # noqa: B023

        def comments() -> str:
            name = r.choice(["comments", "comment-list", "reader-comments", "discussion", "responses"])  # noqa: B023
            inner = "".join(r.choice([f'<div class="comment">{para(0, 3, 50)}</div>', f"<article class=\"comment\">{para(0, 3, 50)}</article>", f"<ol>{block('li', words(3, 40) + '.', 0)}</ol>", para(0, 3, 60)]) for _ in range(r.randint(1, 4)))  # noqa: B023
            head = block(r.choice(["h2", "h3"]), r.choice(["Comments", words(1, 3)]), 0) if r.random() < 0.6 else ""  # noqa: B023
            tag = r.choice(["section", "div"])  # noqa: B023
            return f'<{tag} {r.choice(["class", "id"])}="{name}">{head}{inner}</{tag}>'  # noqa: B023

        def form() -> str:
            return f'<form action="/x">{block("label", words(1, 4), 0)}<input name="q"></form>' if r.random() < 0.3 else f'<form>{para(0, 2, 20)}<input name="q">{block("button", words(1, 2), 0)}</form>'  # noqa: B023

        def aside() -> str:
            tag = r.choice(["aside", 'div class="sidebar"', 'div class="related"', 'aside class="widget"', 'div id="sidebar"'])  # noqa: B023
            return f"<{tag}>{block('h3', words(1, 4), 0) if r.random() < 0.6 else ''}{''.join(para(0, 2, 40) for _ in range(r.randint(1, 3)))}</{tag.split()[0]}>"  # noqa: B023

        def body() -> str:
            def one() -> str:
                c = r.random()  # noqa: B023
                if c < 0.72:
                    return para(1)
                if c < 0.80:
                    return block(r.choice(["h2", "h3", "h4"]), words(1, 8), 1)  # noqa: B023
                if c < 0.86:
                    return "<ul>" + "".join(block("li", words(1, 20), 1) for _ in range(r.randint(1, 4))) + "</ul>"  # noqa: B023
                if c < 0.90:
                    return f"<blockquote>{para(1, 4, 40)}</blockquote>"
                if c < 0.94:
                    return "<table><tr>" + "".join(block("td", words(1, 5), 1) for _ in range(r.randint(1, 4))) + "</tr></table>"  # noqa: B023
                return block("pre", words(3, 20), 1)

            return "".join(one() for _ in range(r.randint(1, 12)))  # noqa: B023

        extra = lambda p: (r.choice([advert, notice, form, aside, comments])() if r.random() < p else "")  # noqa: B023,E731
        bare = r.random() < 0.15
        title = block("title", words(2, 8), 0) if not bare else ""
        top = (f'<header class="{r.choice(["site-header", "top", "masthead"])}">' + (block("h1", words(1, 4), 0) if r.random() < 0.4 else para(0, 1, 10)) + (menu() if r.random() < 0.4 else "") + "</header>") if r.random() < 0.5 else ""
        top += r.choice([menu(), menu("div", ' class="menu"'), ""]) if r.random() < 0.8 else ""
        top += extra(0.5) + extra(0.3)
        shape = r.choice(["article", "article", "article", "main", "main article", 'div class="content"', 'div id="main-content"', 'div class="post-body"', "plain"])
        head = block("h1", words(1, 10), 1) if r.random() < 0.8 else ""
        if head and r.random() < 0.2:
            head = f"<header>{head}</header>"
        inner = head + extra(0.12) + body() + extra(0.2) + (body() if r.random() < 0.3 else "") + (comments() if r.random() < 0.15 else "")
        if shape == "main article":
            inner = f"<main><article>{inner}</article></main>"
        elif shape != "plain":
            inner = f"<{shape}>{inner}</{shape.split()[0]}>"
        if bare:
            top = ""
        end = (comments() if r.random() < 0.3 else "") + extra(0.4) + (aside() if r.random() < 0.3 else "")
        end += r.choice([block("footer", "&copy; " + words(2, 15), 0), f"<footer>{para(0, 2, 20)}</footer>", block('div class="footer"', words(2, 15), 0), ""])
        page = f"<!DOCTYPE html><html><head>{title}</head><body>{top}{inner}{end}</body></html>"
        if bare and r.random() < 0.5:
            page = inner
        out.append((page.replace(MARK, ""), [int(MARK in b.text) for b in blocks(page)]))
    return out


_default: list[Field] = []


def default_field() -> Field:
    """Trained once in a process."""
    if not _default:
        made = [([features(b) for b in blocks(page)], label) for page, label in labelled_pages()]
        _default.append(train(made))
    return _default[0]


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, viterbi(field, [features(b) for b in found]), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", field: Field | None = None) -> DataFrame:
    """pages with text, the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    pages = pages.drop("text")
    modest_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(shared.value, v.as_py()) for v in part.column(html)], pa.string())], [*part.schema.names, "text"])

    return pages.mapInArrow(run, pages.withColumn("text", F.lit("")).schema)
