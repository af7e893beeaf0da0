"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read tag by tag into leaf blocks: text between the borders of block elements, with the open elements above
it. Only scripts, styles and what is no text of a page (its head, titles and descriptions of drawings) are left out here; whatever else
elements hold, formulas, captions and text for browsers that show no video among it, is read. Each block is labelled main or not from its ancestors' tags, classes and ids and from its text; Viterbi
finds the likeliest labels of the whole page. The model is trained here on PAGES generated and labelled
pages of many layouts, from a fixed seed; nothing is taken from the tables.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, slices
from .crf import LinearChainCRF, feature_rows

PAGES, SEED = 1500, 31
MAIN, REST = 1, 0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.DOTALL)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
# fixed values: elements by how they are read
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset({"head", "title"})
_THROUGH = frozenset("math svg iframe object canvas audio video picture map".split())
#: In formulas and drawings all elements are inline but those that end them.
_FOREIGN = ("math", "svg")
_UNSHOWN = ("title", "desc", "metadata")
_ENDS_FOREIGN = frozenset("address article aside blockquote body center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style")
#: Elements that an opening tag of the same kind, or of one of these, ends.
_ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}


class Block:
    """A leaf block: its text with references decoded and white space as one space, its ancestors, and the share of links."""

    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[str, str], ...], links: float) -> None:
        self.text, self.path, self.links = text, path, links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order. Any text gives some result; tags needn't match."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = anchors = 0
    dropped = foreign = ""
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                out.append(Block(said, tuple(stack), min(1.0, linked / len(said))))
            text.clear()
        linked = 0

    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            at += 1
            continue
        at = m.end()
        if (plain := m[5]) is not None or (plain := m[1]) is not None:
            if not dropped:
                text.append(plain)
                if anchors:
                    linked += len(plain)
            continue
        name = (m[3] or "").lower()
        if not name:
            continue
        if dropped:
            if m[2] and name == dropped or dropped in ("head", "title") and name == "body":
                dropped = ""
            if not (name == "body" and not m[2]):
                continue
        if foreign:
            if m[2] and name == foreign or name in _ENDS_FOREIGN:
                foreign = ""
            elif name not in _RAW and not (name in _UNSHOWN and not m[2]):
                continue
        if not m[2]:
            if name in _RAW or foreign:
                to = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = to.end() if to else end
                continue
            if name in _THROUGH:
                if name in _FOREIGN and not m[4].endswith("/"):
                    foreign = name
                continue
            if name in _DROPPED:
                if not m[4].endswith("/"):
                    dropped = name
                    close()
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in _INLINE or name in _VOID:
                anchors += name == "a"
                if name == "hr":
                    close()
                elif name in ("img", "input"):
                    text.append(" ")
                continue
            close()
            while stack and name in _ENDS.get(stack[-1][0], ()):
                stack.pop()
            stack.append((name, " ".join(_PARTS.findall(" ".join(a or b or c for _, a, b, c in _NAMES.findall(m[4])).lower())) if m[4] else ""))
        elif name in _INLINE or name in _VOID or name in _THROUGH:
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name == "br":
                text.append(" ")
        else:
            close()
            anchors = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
    close()
    return out


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    out = {"bias", f"depth{min(8, len(path))}"}
    for k, (tag, names) in enumerate(reversed(path)):
        out.add(f"in {tag}")
        if k < 2:
            out.add(f"up{k} {tag}")
        out.update(f"named {n}" for n in names.split())
    return sorted(out)


_WORDY = re.compile(r"[^\W\d_]{2,}")


def text_features(b: Block, k: int, n: int) -> list[str]:
    s = b.text
    size = len(s)
    out = [f"len{min(9, size.bit_length())}", f"link{int(4 * b.links)}", f"end{s[-1] if s[-1] in '.!?:;,' else '-'}", f"at{min(3, k)}", f"left{min(3, n - 1 - k)}"]
    if "©" in s[:40] or "(c)" in s[:40]:
        out.append("rights")
    if size < 200:
        low = s.lower()
        out += [w for w in ("cookie", "subscribe", "newsletter", "sign in", "log in", "share", "advert", "sponsored", "all rights", "privacy", "terms", "reply") if w in low]
        out.append(f"words{min(6, len(_WORDY.findall(s)) // 3)}")
    return out


class Extractor:
    """A trained model with its weights by name."""

    def __init__(self, model: LinearChainCRF) -> None:
        self.model, self.paths, self.names = model, {}, {}

    def _score(self, names: list[str]) -> tuple[float, float]:
        a = b = 0.0
        for n in names:
            w = self.names.get(n)
            if w is None:
                w = self.names[n] = tuple(self.model.weights[feature_rows([[n]], self.model.size)[0, 0]].tolist())
            a += w[0]
            b += w[1]
        return a, b

    def label(self, found: list[Block]) -> list[int]:
        emit = np.zeros((len(found), 2))
        for k, b in enumerate(found):
            p = self.paths.get(b.path)
            if p is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                    self.names.clear()
                p = self.paths[b.path] = self._score(path_features(b.path))
            t = self._score(text_features(b, k, len(found)))
            emit[k] = p[0] + t[0], p[1] + t[1]
        return _viterbi2(emit.tolist(), self.model)

    def __call__(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.label(found), strict=True) if y == MAIN)


def _viterbi2(emit: list[list[float]], model: LinearChainCRF) -> list[int]:
    """``model.decode`` for two labels, in plain numbers, which is faster for short pages."""
    if not emit:
        return []
    (a, b), (c, d) = model.moves.tolist()
    x, y = emit[0][0] + model.first[0], emit[0][1] + model.first[1]
    back = []
    for p, q in emit[1:]:
        to0, to1 = (0, x + a) if x + a >= y + c else (1, y + c), (0, x + b) if x + b >= y + d else (1, y + d)
        back.append((to0[0], to1[0]))
        x, y = to0[1] + p, to1[1] + q
    at = 0 if x + model.last[0] >= y + model.last[1] else 1
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return out[::-1]


def labelled_page(r: random.Random) -> tuple[str, list[str]]:
    """A generated page and the texts of its main blocks. Layouts, names and the order of parts vary."""
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgéüñ") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    pick = r.choice
    main: list[str] = []

    def named(*names: str) -> str:
        k = pick(["class", "class", "id", ""])
        return f' {k}="{pick(names)}"' if k else f' class="{pick(names)}"' if r.random() < 0.6 else ""

    def sure(*names: str) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(names)}"'

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))

    def para(keep: bool, a: int = 1, b: int = 60) -> str:
        if b == 60 and r.random() < 0.3:
            a, b = 40, 200
        text = words(a, b).capitalize() + pick([".", ".", ".", "", "!", "?", ":"])
        if keep and r.random() < 0.03:
            text = pick(["All rights reserved.", "Share your thoughts.", "Read the privacy terms first.", "Licensed under CC BY 4.0.", "Reply soon.", "Subscribe to the idea.", "Copyright 2020 by the author.", "See the terms."])
        if keep:
            main.append(text)
        inner = text
        if r.random() < 0.2:
            ws = text.split(" ")
            k = r.randrange(len(ws))
            ws[k] = pick(["<b>{}</b>", "<a href='#'>{}</a>", "<em>{}</em>", "<span>{}</span>"]).format(ws[k])
            inner = " ".join(ws)
        return inner

    def flow(keep: bool) -> str:
        kind = r.random()
        if kind < 0.08:
            odd = pick(["<video controls src=x><p>{}</p></video>", "<noscript><p>{}</p></noscript>", "<object data=x><p>{}</p></object>", "<template><p>{}</p></template>", "<div>{}</div>", "<audio src=x>{}</audio>", "<svg><text>{}</text></svg>"])
            return odd.format(para(keep))
        if kind < 0.1:
            sides = [f"{word()[:2]}{r.randint(1, 99)}" for _ in range(2)]
            if keep:
                main.append("=".join(sides))
            return pick(["<math><mi>{}</mi><mo>=</mo><mn>{}</mn></math>", "<div><math>{}={}</math></div>", "<p><math>{}={}</math></p>"]).format(*sides)
        if kind < 0.72:
            return f"<p>{para(keep)}" + pick(["</p>", "</p>", "</p>", ""])
        if kind < 0.8:
            h = pick(["h2", "h3", "h4"])
            return f"<{h}>{para(keep, 1, 7)}</{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{para(keep, 2, 16)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{para(keep)}</p></blockquote>"
        if kind < 0.93:
            return f"<pre>{para(keep, 3, 20)}</pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{para(keep, 1, 4)}</td><td>{para(keep, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{para(keep, 3, 12)}</figcaption></figure>"

    def advert() -> str:
        tag = pick(["div", "div", "aside", "section"])
        return f"<{tag}{sure('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'banner', 'advertisement', 'ad-slot')}>{pick(['', 'Advertisement '])}{words(2, 20)}.</{tag}>"

    def comments() -> str:
        tag = pick(["div", "section"])
        each = "".join(f"<{pick(['div', 'li', 'article'])} class='{pick(['comment', 'reply', 'comment-body', 'user-comment'])}'><{'b' if r.random() < 0.5 else 'h4'}>{word()}</{'b'}><p>{words(3, 50).capitalize()}.</p></div>" for _ in range(r.randint(1, 5)))
        return f"<{tag}{sure('comments', 'comment-list', 'reader-comments', 'discussion', 'disqus', 'responses')}><h3>{pick(['Comments', words(1, 2)])}</h3>{each}</{tag}>"

    def aside() -> str:
        tag = pick(["aside", "aside", "div"])
        name = sure("sidebar", "widget", "related", "rail", "side", "most-read", "recommended", "related-posts") if tag == "div" else named("sidebar", "widget", "related")
        return f"<{tag}{name}><h3>{words(1, 3)}</h3>" + pick([f"<ul>{links(2, 6)}</ul>", f"<p>{words(4, 40).capitalize()}.</p>"]) + f"</{tag}>"

    def notice() -> str:
        tag = pick(["div", "section", "div", "dialog"])
        if r.random() < 0.15:
            return f"<noscript>{pick(['', '<p>'])}{pick(['Please enable JavaScript ', 'Your browser ', ''])}{words(3, 12)}.</noscript>"
        return f"<{tag}{sure('cookie', 'cookie-notice', 'cookie-banner', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'paywall')}><p>{pick(['We use cookies ', ''])}{words(4, 30)}.</p><button>{word()}</button></{tag}>"

    def form() -> str:
        return f"<form{named('newsletter', 'subscribe', 'search', 'login', 'signup')}><label>{words(1, 3)}</label><input name=q>" + pick(["", f"<p>{words(4, 25).capitalize()}.</p>"]) + f"<button>{word()}</button><select><option>{word()}<option>{word()}</select></form>"

    def share() -> str:
        return f"<div{sure('share', 'social', 'share-buttons', 'tags', 'breadcrumb', 'breadcrumbs', 'pagination', 'byline-tools')}><a href='#'>{word()}</a> <a href='#'>{word()}</a></div>"

    extra = [advert, advert, comments, aside, notice, form, share]
    head = []
    if r.random() < 0.85:
        head.append(pick([f"<nav{named('menu', 'nav', 'navbar')}><ul>{links(3, 9)}</ul></nav>", f"<div{sure('menu', 'nav', 'navigation', 'topnav', 'navbar', 'main-menu')}><ul>{links(3, 9)}</ul></div>", f"<ul{sure('menu', 'nav', 'navigation')}>{links(3, 9)}</ul>"]))
    if r.random() < 0.6:
        head.append(pick([f"<header{named('site-header', 'masthead')}><h1>{words(1, 4)}</h1><p>{words(2, 12)}</p></header>", f"<div{sure('header', 'masthead', 'top', 'site-header', 'branding')}><p>{words(1, 6)}</p></div>", f"<header><a href='/'>{words(1, 3)}</a></header>"]))
    head += [pick(extra[:1] + extra[3:])() for _ in range(r.randint(0, 3))]
    r.shuffle(head)
    title = f"<h1>{para(True, 2, 10)}</h1>" if r.random() < 0.85 else ""
    if title and r.random() < 0.15:
        title = f"<header{named('entry-header')}>{title}</header>"
    body = [title] if title else []
    for _ in range(r.randint(1, 14)):
        body.append(flow(True))
        if r.random() < 0.1:
            body.append(pick([advert, aside, share, form, notice])())
    if r.random() < 0.25:
        body.append(comments())
    if r.random() < 0.15:
        body.append(f"<footer>{words(2, 12)}</footer>")
    inside = "".join(f"<section>{x}</section>" if r.random() < 0.05 else x for x in body)
    article = pick([
        f"<article{named('post', 'entry')}>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>",
        f"<div{sure('content', 'article', 'post', 'entry-content', 'story', 'article-body', 'main', 'main-content', 'post-body', 'text', 'body')}>{inside}</div>",
        f"<div{sure('wrapper', 'container', 'page')}><div{sure('content', 'article', 'post', 'story')}>{inside}</div></div>", f"<section{sure('content', 'article', 'story')}>{inside}</section>", f"<table><tr><td{sure('content', 'main')}>{inside}</td></tr></table>", f"<div>{inside}</div>",
    ])
    tail = [pick(extra)() for _ in range(r.randint(0, 3))]
    if r.random() < 0.85:
        says = pick(["&copy; ", "© ", "Copyright ", "", ""]) + words(2, 16) + pick([".", ""])
        tail.append(pick([f"<footer{named('footer', 'site-footer')}>{says}</footer>", f"<footer><p>{says}</p><ul>{links(1, 5)}</ul></footer>", f"<div{sure('footer', 'site-footer', 'copyright', 'legal', 'bottom')}>{says}</div>"]))
    return f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(head)}{article}{''.join(tail)}</body></html>", main


@functools.cache
def trained(pages: int = PAGES, seed: int = SEED) -> LinearChainCRF:
    """The model; the same for the same arguments."""
    r, rows = random.Random(seed), []
    for _ in range(pages):
        page, main = labelled_page(r)
        found, left = blocks(page), list(main)
        tags = []
        for b in found:  # main blocks come in page order
            hit = bool(left) and b.text == left[0]
            if hit:
                left.pop(0)
            tags.append(MAIN if hit else REST)
        if found:
            feats = [[*path_features(b.path), *text_features(b, k, len(found))] for k, b in enumerate(found)]
            rows.append((feature_rows(feats, 1 << 14), np.array(tags)))
    return LinearChainCRF(2, 1 << 14).fit(rows, epochs=8)


def query(pages: DataFrame, sample: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    A null or empty html, and a page without main blocks, has an empty text. Rows that repeat a page_id, or have none,
    are read each. An empty table gives an empty result.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(model.value)
        for b in slices(batches):
            text = [extract(raw.decode("utf-8")) if raw else "" for raw in byte_rows(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
