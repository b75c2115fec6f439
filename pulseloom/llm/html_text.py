"""Main text of web pages by a bidirectional LSTM that labels every block of a page in the context of the whole page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of HTML: elements that start a block, elements without content, and elements whose content isn't markup.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea".split())
#: Elements left out whole where they have an end: what browsers with scripts don't show, form controls, drawings.
SKIP = frozenset("noscript template select datalist svg math canvas object".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table td th article section main div body select".split())
#: Elements and names (of classes, ids, roles) that hold a page's main text, and those that don't: weak labels for training pages.
MAIN = frozenset("article main".split())
OTHER = frozenset("head nav aside footer form button option label legend title dialog".split())
OTHER_NAMES = re.compile(r"(?:^|[-_])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav|navbar|menu|breadcrumbs?|sidebar|footer|cookie|consent|notice|popup|modal|newsletter|subscribe|comments?|commentlist|reply|respond|related|share|social|widget|masthead)(?:$|[-_])")

PATHS, WORDS, EXTRA, HIDDEN = 192, 64, 4, 24
INPUT = PATHS + WORDS + EXTRA
SAMPLE_PAGES, MADE_PAGES, EPOCHS, WINDOW = 300, 1000, 5, 64
#: Longer pages don't teach; longer runs of blocks are labelled window by window.
SAMPLE_BYTES, LONG = 1 << 20, 4096
#: A comment, a tag (with a quote left open up to the first >), or anything else that begins like one.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"|'[^']*')*+)|[^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_CUT_OFF = re.compile(r"<[a-zA-Z!?/]")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block(NamedTuple):
    text: str
    path: np.ndarray
    links: float
    main: bool


def _bucket(token: str) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % PATHS


class _Open:
    """The open elements of a page. Where the last one of each name stands is known, so no tag searches all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, np.ndarray, bool | None]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, path: np.ndarray, main: bool | None) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, path, main))

    def cut(self, to: int) -> list[str]:
        """Closes the elements from place `to` on; their names."""
        gone = [tag for tag, _, _ in self.stack[to:]]
        for tag in gone:
            self.places[tag].pop()
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        del self.stack[to:]
        return gone


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with the hashed path of each, its share of link text, and its weak label.

    Character references are decoded and white space becomes one space. Comments, scripts, styles and form controls
    are no text. The time is linear in the page, however badly its tags nest.
    """
    out: list[Block] = []
    nothing = np.zeros(PATHS, np.uint8)
    opened = _Open()
    parts: list[str] = []
    linked = links = 0
    path, main = nothing, None
    endless: set[str] = set()
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, path, min(1.0, linked / len(text)), bool(main)))
        linked = 0

    def close(to: int) -> None:
        nonlocal path, main, links
        if opened.blocks and opened.blocks[-1] >= to:
            flush()
        gone = opened.cut(to)
        links -= gone.count("a")
        path, main = opened.stack[-1][1:] if opened.stack else (nothing, None)

    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at) if at <= last_end else None
        cut = None if found else _CUT_OFF.search(page, at)
        end = found.start() if found else cut.start() if cut else size
        if end > at:
            parts.append(page[at:end])
            linked += (end - at) if links else 0
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            there = opened.last((tag,))
            # The end of an inline element doesn't close the blocks in it.
            if there >= 0 and (tag in BLOCKS or not opened.blocks or opened.blocks[-1] < there):
                close(there)
            continue
        if tag in BLOCKS or tag == "br":
            parts.append(" ") if tag == "br" else flush()
        if tag in VOID:
            continue
        if (tag in RAW or tag in SKIP) and tag not in endless:
            stop = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            if stop or tag in RAW:
                at = stop.end() if stop else size
                continue
            endless.add(tag)
        ends = ENDS.get(tag, ())
        if tag in BLOCKS and tag not in ("button", "label", "option"):
            ends = (*ends, "p")
        if ends:
            there = opened.last(ends)
            if there > opened.last(t for t in SCOPE if t not in ends):
                close(there)
        names = [x.lower() for m in _NAMES.finditer(found[3] or "") for x in (m[2] or m[3] or m[4] or "").split()] if found[3] else []
        bits = {_bucket("<" + tag)} | {_bucket(name) for name in names} | {_bucket("." + piece) for name in names for piece in re.split(r"[-_]+", name)}
        if not all(path[k] for k in bits):
            path = path.copy()
            path[list(bits)] = 1
        if tag in OTHER or any(OTHER_NAMES.search(n) for n in names) or (tag == "header" and not main):
            main = False
        elif tag in MAIN and main is None:
            main = True
        links += tag == "a"
        opened.push(tag, path, main)
    flush()
    return out


def inputs_of(pages: list[list[Block]], cache: dict[str, int]) -> np.ndarray:
    """The input rows of all blocks of all pages: path bits, hashed word shares, and four lengths."""
    blocks = [b for page in pages for b in page]
    out = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return out
    words = [b.text.split() for b in blocks]
    counts = np.array([len(w) for w in words])
    if len(cache) > 200_000:
        cache.clear()
    ids = []
    for group in words:
        for w in group:
            k = cache.get(w)
            if k is None:
                k = crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
                if len(w) <= 64:
                    cache[w] = k
            ids.append(k)
    where = np.repeat(np.arange(len(blocks)), counts) * WORDS + np.array(ids, np.int64)
    out[:, :PATHS] = np.stack([b.path for b in blocks])
    out[:, PATHS : PATHS + WORDS] = np.bincount(where, minlength=len(blocks) * WORDS).reshape(-1, WORDS) / counts[:, None]
    out[:, -4] = np.log1p(counts) / 5
    out[:, -3] = [b.links for b in blocks]
    out[:, -2] = [b.text[-1] in ".!?…。" for b in blocks]
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    model = {}
    for side in ("f", "b"):
        model["x" + side] = random.normal(0, 0.1, (INPUT, 4 * HIDDEN)).astype(np.float32)
        model["h" + side] = random.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        model["c" + side] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
    model["out"] = random.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
    model["bias"] = np.zeros(1, np.float32)
    return model


def _run(model: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """Hidden states of one direction over x (steps, pages, INPUT); masked steps leave the state as it is.

    `state` is what to begin with, (h, c), and then holds what it ended with.
    """
    h, c = state or [np.zeros((x.shape[1], HIDDEN), np.float32)] * 2
    into = x @ model["x" + side] + model["c" + side]
    states = np.zeros((x.shape[0], x.shape[1], HIDDEN), np.float32)
    for t in range(x.shape[0]):
        z = into[t] + h @ model["h" + side]
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        new = f * c + i * g
        th, m = np.tanh(new), mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, th, m))
        h, c = m * (o * th) + (1 - m) * h, m * new + (1 - m) * c
        states[t] = h
    if state is not None:
        state[:] = [h, c]
    return states


def label(model: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The chance of each block (steps, pages) to be main text."""
    ahead, back = _run(model, "f", x, mask), _run(model, "b", x[::-1], mask[::-1])[::-1]
    return _sigmoid(np.concatenate((ahead, back), 2) @ model["out"] + model["bias"])[:, :, 0]


def label_long(model: dict, blocks: list[Block], cache: dict[str, int], window: int = LONG) -> np.ndarray:
    """The same chances for one page of any length: inputs are made window by window, and the state goes on from one to the next."""
    states = {}
    for side in ("f", "b"):
        state, parts = [np.zeros((1, HIDDEN), np.float32)] * 2, []
        starts = range(0, len(blocks), window)
        for k in starts if side == "f" else reversed(starts):
            x = inputs_of([blocks[k : k + window]], cache)[:, None]
            parts.append(_run(model, side, x if side == "f" else x[::-1], np.ones(x.shape[:2], np.float32), None, state)[:, 0])
        states[side] = np.concatenate(parts)
    return _sigmoid(np.concatenate((states["f"], states["b"][::-1]), 1) @ model["out"] + model["bias"])[:, 0]


def _gradients(model: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    kept: dict[str, list] = {"f": [], "b": []}
    sides = {"f": (x, mask), "b": (x[::-1], mask[::-1])}
    states = {s: _run(model, s, *sides[s], kept[s]) for s in sides}
    both = np.concatenate((states["f"], states["b"][::-1]), 2)
    error = (_sigmoid(both @ model["out"] + model["bias"])[:, :, 0] - y) * mask / mask.sum()
    out = {"out": np.einsum("tbh,tb->h", both, error)[:, None], "bias": error.sum(keepdims=True)[0]}
    into = error[:, :, None] * model["out"][:, 0]
    for s, own in (("f", into[:, :, :HIDDEN]), ("b", into[::-1, :, HIDDEN:])):
        xs, w = sides[s][0], model["h" + s]
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        dz_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
        dw = np.zeros_like(w)
        for t in range(x.shape[0] - 1, -1, -1):
            h, c, i, f, o, g, th, m = kept[s][t]
            dh = dh + own[t]
            to_h, to_c = dh * m, dc * m
            cell = to_c + to_h * o * (1 - th * th)
            dz = np.concatenate((cell * g * i * (1 - i), cell * c * f * (1 - f), to_h * th * o * (1 - o), cell * i * (1 - g * g)), 1)
            dz_all[t] = dz
            dw += h.T @ dz
            dh = dh * (1 - m) + dz @ w.T
            dc = dc * (1 - m) + cell * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        out |= {"x" + s: xs.reshape(-1, INPUT).T @ flat, "h" + s: dw, "c" + s: flat.sum(0)}
    return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), INPUT), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def train(pages: list[list[Block]], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """A model fitted to the blocks' labels by Adam on windows of up to WINDOW blocks."""
    model, random, cache = new_model(), np.random.default_rng(seed), {}
    windows = [p[k : k + WINDOW] for p in pages for k in range(0, len(p), WINDOW)]
    rows = [(inputs_of([w], cache), np.array([b.main for b in w], np.float32)) for w in windows]
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for _ in range(epochs if rows else 0):
        order = random.permutation(len(rows))
        for k in range(0, len(order), 32):
            some = [rows[i] for i in order[k : k + 32]]
            x, mask = _padded([r[0] for r in some])
            y = np.zeros(mask.shape, np.float32)
            for j, r in enumerate(some):
                y[: len(r[1]), j] = r[1]
            step += 1
            for name, g in _gradients(model, x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model[name] = (model[name] - 0.02 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


#: Fixed values for made pages: names that tell what a container holds, neutral ones that don't, and words of boilerplate.
_HOLDERS = ["<article>", "<main>", "<main><article>", "<article class='post'>", "<div class='content'>", "<div id='content'>", "<div class='post'>", "<div class='entry-content'>", "<div class='article-body'>", "<section class='story'>", "<div id='main-content'>", "<div role='main'>"]
_AROUND = [("<nav>", "l"), ("<nav class='menu'>", "l"), ("<div class='menu'>", "l"), ("<ul class='navbar'>", "l"), ("<div class='breadcrumbs'>", "l"), ("<header>", "p"), ("<header class='site-header'>", "l"), ("<div class='header'>", "p"), ("<div id='masthead'>", "p"), ("<div class='ad'>", "p"), ("<div class='advert'>", "p"), ("<div class='ads banner'>", "p"), ("<div class='sponsored'>", "p"), ("<div class='cookie-notice'>", "p"), ("<div class='notice'>", "p"), ("<div id='consent'>", "p"), ("<div class='popup modal'>", "p")]
_AFTER = [("<footer>", "p"), ("<footer class='site-footer'>", "l"), ("<div class='footer'>", "p"), ("<aside>", "p"), ("<aside class='sidebar'>", "l"), ("<div class='sidebar'>", "p"), ("<div class='widget'>", "l"), ("<div class='related'>", "l"), ("<div class='share social'>", "l"), ("<form>", "f"), ("<form class='search'>", "f"), ("<div class='newsletter'>", "f"), ("<section class='comments'>", "p"), ("<div id='comments'>", "p"), ("<ol class='commentlist'>", "c"), ("<div class='comment'>", "p"), ("<div class='promo'>", "p")]
_NEUTRAL = "box row col wrap inner block section page node panel pane area body text copy unit module group grid cell item field left right center top wide main-col l-main c-body rte prose markdown richtext field-body".split()
_PHRASES = ["Home", "About us", "Contact", "Log in", "Sign up", "Search", "Menu", "Read more", "Share this", "Print this page", "Subscribe to our newsletter", "Accept all cookies", "Privacy policy", "Terms of use", "All rights reserved", "Copyright 2024", "Advertisement", "Sponsored", "Back to top", "Next page", "Previous", "Related articles", "Most read", "Follow us", "Leave a comment", "Posted by admin", "3 comments", "Site map", "Help", "Jobs"]


def made_pages(main: list[str], other: list[str], count: int = MADE_PAGES, seed: int = 11) -> list[list[Block]]:
    """Pages made of sampled texts in many layouts, with the labels that the layout gives: training beyond the sample's own templates.

    Containers are telling or neutral ones. In a neutral one only the shape of what it holds tells: running text
    is an article's, while link lists, form fields and stock phrases are not.
    """
    random = np.random.default_rng(seed)
    main, other = main or ["A first sentence of some length.", "Another one, and it is longer than the first."], other or ["Home", "About us", "All rights reserved"]
    mark = "\u0002"

    def pick(texts: list[str], most: int = 0) -> str:
        text = texts[random.integers(len(texts))]
        return html.escape(" ".join(text.split()[:most]) if most else text)

    def neutral() -> str:
        tag = ["div", "div", "div", "section", "td", "span"][random.integers(6)]
        name = _NEUTRAL[random.integers(len(_NEUTRAL))] if random.random() < 0.6 else "".join(chr(97 + k) for k in random.integers(0, 26, 5))
        kind = ["", f" class='{name}'", f" id='{name}'", f" class='{name} x{random.integers(100)}'"][random.integers(4)]
        return f"<{tag}{kind}>"

    def wrapped(holder: str, inner: str) -> str:
        return holder + inner + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", holder)))

    def around(holder: str, shape: str) -> str:
        n = int(random.integers(1, 7))
        short = [pick(_PHRASES) if random.random() < 0.4 else pick(other if random.random() < 0.5 else main, 3) for _ in range(n)]
        if shape == "l":
            links = [f"<a href='/{k}'>{t}</a>" for k, t in enumerate(short)]
            form = random.integers(4)
            return wrapped(holder, "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if form < 2 else " | ".join(links) if form == 2 else "".join(f"<div>{x}</div>" for x in links))
        if shape == "f":
            return wrapped(holder, "".join(f"<label>{t}</label><input name=q>" for t in short) + "<button>OK</button>")
        if shape == "s":
            return wrapped(holder, "".join(f"<{t}>{x}</{t}>" for x in short[:3] for t in [["p", "div", "span", "small"][random.integers(4)]]))
        prose = [pick(main if random.random() < 0.5 else other) for _ in range(n)]
        if shape == "c":
            return wrapped(holder, "".join(f"<li class='comment'>{p}</li>" for p in prose))
        return wrapped(holder, "".join(f"<p>{p}</p>" for p in prose) if random.random() < 0.7 or n > 1 else prose[0])

    def beside(telling: list[tuple[str, str]]) -> str:
        if random.random() < 0.4:
            return around(neutral(), ["l", "l", "s", "f"][random.integers(4)])
        return around(*telling[random.integers(len(telling))])

    def body() -> str:
        text, few = mark + pick(main), mark + pick(main, int(random.integers(1, 7)))
        level = random.integers(2, 5)
        return [f"<p>{text}</p>"] * 9 + [f"<p><b>{few}</b> {pick(main)}<br>", f"<h{level}>{few}</h{level}>", f"<ul><li>{text}</li><li>{few}</li></ul>", f"<blockquote>{text}</blockquote>", f"<figure><img src=x><figcaption>{few}</figcaption></figure>", f"<table><tr><th>{few}</th><td>{few}</td></tr></table>", f"<pre>{text}</pre>", f"<dl><dt>{few}</dt><dd>{text}</dd></dl>", f"<div>{text}</div>", f"{text}<br><br>{pick(main)}", f"<p>{text} <a href=/x>{pick(main, 3)}</a></p>"]

    out = []
    for _ in range(count):
        parts = ["<html><head><title>t</title></head><body>", *(beside(_AROUND) for _ in range(random.integers(0, 5)))]
        holder = _HOLDERS[random.integers(len(_HOLDERS))] if random.random() < 0.5 else "".join(neutral() for _ in range(random.integers(1, 4)))
        inner = []
        if random.random() < 0.7:
            inner.append(f"<h1>{mark}{pick(main, int(random.integers(1, 9)))}</h1>")
        for _ in range(int(random.integers(1, 10))):
            forms = body()
            inner.append(forms[random.integers(len(forms))])
            if random.random() < 0.08:
                inner.append(beside(_AROUND + _AFTER))
        parts.append(wrapped(holder, "".join(inner)))
        parts += [beside(_AFTER) for _ in range(random.integers(0, 6))]
        page = []
        for b in blocks_of("".join(parts)):
            clean = " ".join(b.text.replace(mark, "").split())
            if clean:
                page.append(Block(clean, b.path, b.links, mark in b.text))
        out.append(page)
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, np.ndarray]:
    """A model trained on at most sample_pages pages, those of the smallest hash of page_id, and on pages made of their texts.

    Only this sample comes to the driver; it holds one html, of at most SAMPLE_BYTES, for each page_id. Its blocks are
    labelled by the elements and names around them. Pages in which nothing is marked as main text teach nothing.
    """
    fit = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES)).select("page_id", "html")
    ids = fit.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    some = fit.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    texts = [r["html"] for r in some.orderBy("page_id").toLocalIterator()]
    real = [p for p in (blocks_of(t) for t in texts) if any(b.main for b in p)]
    main = [b.text[:2000] for p in real for b in p if b.main][:20_000]
    other = [b.text[:2000] for p in real for b in p if not b.main][:20_000]
    return train(real + made_pages(main, other))


def main_texts(pages: list[str], model: dict, cache: dict[str, int]) -> list[str]:
    """The main text of each page: its main blocks in order, joined by empty lines."""
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k, p in enumerate(parsed) if p), key=lambda k: len(parsed[k]))
    while order:
        some, steps = [], len(parsed[order[0]])
        if steps > LONG:
            some = [order.pop(0)]
            chance = label_long(model, parsed[some[0]], cache)[:, None]
        else:
            # Pages of like length, and a bounded number of blocks, are labelled together.
            while order and (not some or ((len(some) + 1) * len(parsed[order[0]]) <= 2 * LONG and len(parsed[order[0]]) <= 1.3 * steps + 4)):
                some.append(order.pop(0))
            rows = np.split(inputs_of([parsed[k] for k in some], cache), np.cumsum([len(parsed[k]) for k in some])[:-1])
            chance = label(model, *_padded(rows))
        for j, k in enumerate(some):
            out[k] = "\n\n".join(b.text for b, c in zip(parsed[k], chance[:, j], strict=False) if c > 0.5)
    return out


def extract_main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html, ...).

    A null or empty html, and a page without main blocks, give an empty text. Every block of the whole page is
    labelled in the context of all others; nothing is cut. Null ids and urls and repeated rows are kept as they
    are; other columns are ignored; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(fit(pages, sample_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in small_batches(batches, "html", 2 << 20):
            texts = main_texts(batch.column("html").to_pylist(), sent.value, cache)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
