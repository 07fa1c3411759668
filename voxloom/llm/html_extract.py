"""Main text of web pages, by a recurrent labeller of their blocks.

A page becomes the sequence of its blocks: runs of text between block-level
tags, each with the path of open elements. A bidirectional LSTM in numpy reads
for each block a vector of its path (hashed tag, class and id names) and of its
hashed words, so that each decision knows all of the page. It is trained on
pages that ``training_pages`` lays out in many ways with known roles, from a
fixed seed; no page of the input is needed for that.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style template noscript iframe noembed noframes svg math head title textarea select option object canvas audio video xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that may stand in head; any other one ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An open element of these bounds what an implied end tag closes.
SCOPES = frozenset("html body article section main div aside nav header footer table td th ul ol dl form blockquote figure".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")

PATH_SIZE, WORD_SIZE, EXTRA = 128, 32, 5
SIZE = PATH_SIZE + WORD_SIZE + EXTRA
HIDDEN_SIZE = 16
#: Pages to train on, passes over them, and the seed of both.
TRAINING_PAGES, EPOCHS, SEED = 480, 12, 7


@dataclass
class Block:
    """One run of text: its path of element names, its text, and how much of that is in links."""

    path: tuple[str, ...]
    text: str
    linked: int


def _names(tag: str, attributes: str) -> str:
    found = [tag]
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            found += _PART.findall((m[1] or m[2] or m[3] or "").lower())
    return " ".join(found)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; unclosed and misnested elements are put up with."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = hidden = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(path, text, linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, path
        if hidden and stack[-1][0] == "head" and text.strip(" \t\n\f\r"):
            leave_head("")
        if not text or hidden:
            return
        if not parts or not path:
            path = tuple(names for tag, names in stack if tag not in INLINE)
        parts.append(text)
        if any(tag == "a" for tag, _ in stack):
            linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal hidden
        for tag, _ in stack[to:]:
            hidden -= tag in HIDDEN
        del stack[to:]

    def leave_head(tag: str) -> None:
        """Closes an open head and what is open in it; a template or noscript there keeps its elements, but for body in noscript."""
        names = [name for name, _ in stack]
        if "head" in names:
            k = names.index("head")
            if "template" not in names[k:] and ("noscript" not in names[k:] or tag == "body"):
                pop(k)

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if tag == "br":
            add(" ")
        if not inline:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if hidden and tag not in IN_HEAD:
            leave_head(tag)
        if tag in VOID or m[3].endswith("/"):
            continue
        if not inline:
            closing = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closing:
                    pop(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        stack.append((tag, _names(tag, m[3])))
        hidden += tag in HIDDEN
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if end:
                at = end.start()
            else:
                at = len(page)
    add(page[at:])
    flush()
    return out


@lru_cache(1 << 16)
def _hashed(name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode())
    return h % size, 1.0 if h >> 31 else -1.0


_CACHE: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _CACHE:
        if len(_CACHE) > 20_000:
            _CACHE.clear()
        v = np.zeros(PATH_SIZE, np.float32)
        for name in {n for names in path for n in names.split()}:
            k, sign = _hashed(name, PATH_SIZE)
            v[k] += sign
        for name in path[-1:]:
            k, sign = _hashed(f"last {name.split()[0]}", PATH_SIZE)
            v[k] += sign
        _CACHE[path] = v
    return _CACHE[path]


def vectors(blocks: list[Block]) -> np.ndarray:
    """What the network reads: a row for each block."""
    out = np.zeros((len(blocks), SIZE), np.float32)
    for row, b in zip(out, blocks, strict=True):
        row[:PATH_SIZE] = _path_vector(b.path)
        sums = [0.0] * WORD_SIZE
        for w in _WORD.findall(b.text.lower()):
            k, sign = _hashed(w, WORD_SIZE)
            sums[k] += sign
        words = row[PATH_SIZE : PATH_SIZE + WORD_SIZE]
        words[:] = sums
        words /= max(1.0, float(np.sqrt(words @ words)))
        n = len(b.text)
        row[-EXTRA:] = (np.log1p(n) / 5 - 0.8, b.linked / n, len(b.path) / 8, b.text[-1] in ".!?", min(n, 400) / 400)
    return out


@dataclass
class Network:
    """Weights of both directions and of the output."""

    w: dict[str, np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        """Random weights."""
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, SIZE**-0.5, (SIZE, 4 * HIDDEN_SIZE)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, HIDDEN_SIZE**-0.5, (HIDDEN_SIZE, 4 * HIDDEN_SIZE)).astype(np.float32)
            w[f"c{d}"] = np.zeros(4 * HIDDEN_SIZE, np.float32)
            w[f"c{d}"][HIDDEN_SIZE : 2 * HIDDEN_SIZE] = 1
        w["o"] = rng.normal(0, 0.2, 2 * HIDDEN_SIZE).astype(np.float32)
        w["b"] = np.zeros(1, np.float32)
        return cls(w)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """One direction over pages x steps; padding comes last for the forward one and is left out by the mask."""
        pages, steps, _ = x.shape
        h = c = np.zeros((pages, HIDDEN_SIZE), np.float32)
        out, kept = np.zeros((pages, steps, HIDDEN_SIZE), np.float32), []
        drive = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = drive[:, t] + h @ self.w[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN_SIZE : (k + 1) * HIDDEN_SIZE])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN_SIZE :])
            m = mask[:, t, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, squashed, m))
            h, c = np.where(m, o * squashed, h), np.where(m, new, c)
            out[:, t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """A logit for each page and step."""
        forward, kept_f = self._pass(x, mask, "f")
        backward, kept_b = self._pass(x, mask, "b")
        both = np.concatenate([forward, backward], -1)
        return both @ self.w["o"] + self.w["b"], (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by back-propagation through time."""
        logits, (both, kept_f, kept_b) = self.logits(x, mask)
        error = (1 / (1 + np.exp(-logits)) - labels) * mask / mask.sum()
        out = {"o": np.einsum("pt,pth->h", error, both), "b": error.sum(keepdims=True)[0]}
        back = error[..., None] * self.w["o"]
        for d, kept, part in (("f", kept_f, back[..., :HIDDEN_SIZE]), ("b", kept_b, back[..., HIDDEN_SIZE:])):
            dz = np.zeros((*mask.shape, 4 * HIDDEN_SIZE), np.float32)
            dh = dc = np.zeros((len(x), HIDDEN_SIZE), np.float32)
            out[f"h{d}"] = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, o, g, squashed, m in reversed(kept):
                dh = dh + part[:, t]
                into = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + into * o * (1 - squashed**2)
                z = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), into * squashed * o * (1 - o), dnew * i * (1 - g**2)], 1)
                dz[:, t] = z
                out[f"h{d}"] += h.T @ z
                dh, dc = np.where(m, z @ self.w[f"h{d}"].T, dh), np.where(m, dnew * f, dc)
            out[f"x{d}"] = np.einsum("pti,ptj->ij", x, dz)
            out[f"c{d}"] = dz.sum((0, 1))
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one array with a mask of the steps that are real."""
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, SIZE), np.float32), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


# Fixed values for the training pages: names and phrases that sites commonly use.
_SITE_WORDS = "home about contact news sports login register search menu privacy terms sitemap help jobs shop cart account subscribe".split()
_ROLES = {
    "nav": ('<nav>{links}</nav>', '<div class="menu"><ul>{items}</ul></div>', '<ul id="navigation">{items}</ul>', '<nav class="breadcrumb">{links}</nav>', '<nav><ul>{items}</ul></nav>'),
    "header": ("<header><h1>{short}</h1><p>{short}</p></header>", '<div id="header"><a href="/">{short}</a></div>', "<header>{links}</header>", '<div class="banner">{short}</div>'),
    "footer": ("<footer>&copy; {short}</footer>", '<div id="footer"><p>{short} all rights reserved</p></div>', "<footer><ul>{items}</ul><p>{text}</p></footer>"),
    "aside": ("<aside><h3>{short}</h3><p>{text}</p></aside>", '<div class="sidebar"><p>{text}</p><ul>{items}</ul></div>', '<div class="related"><h4>{short}</h4>{links}</div>', '<div id="sidebar">{text}</div>', '<div class="widget share social">{links}</div>'),
    "notice": ('<div class="cookie-notice">we use cookies {text}</div>', '<div id="consent" class="banner"><p>{text}</p><button>accept</button></div>', '<div class="notice">{text}</div>', '<div class="newsletter popup">subscribe {text}</div>', '<div class="alert">{short}</div>'),
    "ad": ('<div class="ad">{text}</div>', '<div class="ad">{short}</div>', '<div class="ads advert"><a href="#">{text}</a></div>', '<div class="sponsored promo"><p>{text}</p></div>', '<div id="advertisement">{text}</div>'),
    "form": ('<form action="/search"><label>{short}</label><input><button>go</button></form>', '<form class="login"><p>{short}</p></form>'),
    "comments": ('<div class="comments"><h3>comments</h3><p>{text}</p><p>{text}</p></div>', '<section id="comments"><div class="comment"><b>{short}</b><p>{text}</p></div></section>', '<ol class="commentlist"><li class="comment">{text}</li></ol>', '<div id="disqus" class="comment-thread"><p>{text}</p><span class="reply">reply</span></div>'),
}
_MAIN = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ("<main><article>", "</article></main>"), ('<div class="article-body">', "</div>"), ("<section>", "</section>"))


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages with, for each of their blocks, whether it is main text. Made-up words; main ones start with a mark that is taken out."""
    rng = Random(seed)

    def word() -> str:
        return "".join(rng.choice("an er ti on re st en al or ed in és ü the of".split()) for _ in range(rng.randint(1, 3)))

    def some(low: int, high: int) -> str:
        return " ".join(word() if rng.random() < 0.97 else rng.choice(_SITE_WORDS) for _ in range(rng.randint(low, high)))

    def fill(form: str) -> str:
        names = [word() if rng.random() < 0.6 else rng.choice(_SITE_WORDS) for _ in range(rng.randint(2, 6))]
        return form.format(links=" ".join(f'<a href="/{x}">{x}</a>' for x in names), items="".join(f'<li><a href="/{x}">{x}</a></li>' for x in names), short=some(1, 7), text=some(4, 40) + ".")

    def main() -> Iterator[str]:
        if rng.random() < 0.8:
            yield f"<{(h := rng.choice(('h1', 'h1', 'h2')))}>\0{some(2, 12)}</{h}>"
        for _ in range(rng.randint(1, 14)):
            k, text = rng.random(), "\0" + some(1, 90) + rng.choice((".", ".", "", "!"))
            if k < 0.62:
                yield f"<p>{text}</p>"
            elif k < 0.72:
                yield f"<p><b>{text}<br>"
            elif k < 0.8:
                yield f"<h2>\0{some(1, 8)}</h2><p>{text}</p>"
            elif k < 0.86:
                yield "<ul>" + "".join(f"<li>\0{some(1, 15)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            elif k < 0.9:
                yield f"<blockquote><p>{text}</p></blockquote>"
            elif k < 0.93:
                yield f'<p>{text} <a href="/x">{some(1, 4)}</a></p>'
            elif k < 0.95:
                yield f"<table><tr><td>\0{some(1, 5)}</td><td>\0{some(1, 5)}</td></tr></table>"
            else:
                yield fill(rng.choice(_ROLES[rng.choice(("ad", "aside", "notice"))]))

    out = []
    for _ in range(n):
        before = [fill(rng.choice(_ROLES[r])) for r in ("notice", "header", "nav", "form", "ad", "aside") if rng.random() < 0.45]
        after = [fill(rng.choice(_ROLES[r])) for r in ("aside", "ad", "form", "nav", "notice") if rng.random() < 0.25]
        start, end = rng.choice(_MAIN) if rng.random() < 0.6 else _MAIN[0]
        body = "".join(main())
        if rng.random() < 0.3:
            body += fill(rng.choice(_ROLES["comments"]))
        elif rng.random() < 0.3:
            after.insert(0, fill(rng.choice(_ROLES["comments"])))
        if rng.random() < 0.8:
            after.append(fill(rng.choice(_ROLES["footer"])))
        rng.shuffle(before)
        inner = "".join(before) + start + body + end + "".join(after)
        if rng.random() < 0.3:
            inner = f'<div class="wrapper">{inner}</div>'
        page = f"<html><head><title>{some(1, 5)}</title></head><body>{inner}</body></html>"
        labels = ["\0" in b.text for b in blocks_of(page)]
        out.append((page.replace("\0", ""), labels))
    return out


def train(pages: list[tuple[str, list[bool]]], epochs: int = EPOCHS, seed: int = SEED, batch: int = 16) -> Network:
    """Adam over batches of pages."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    ready = [(vectors(blocks_of(page)), np.array(labels, np.float32)) for page, labels in pages if labels]
    first, second, step = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2)), None, 0
    mean, square = first
    for epoch in range(epochs):
        order = rng.permutation(len(ready))
        for start in range(0, len(order), batch):
            some = [ready[k] for k in order[start : start + batch]]
            x, mask = padded([v for v, _ in some])
            labels = np.zeros(mask.shape, np.float32)
            for k, (_, y) in enumerate(some):
                labels[k, : len(y)] = y
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in net.gradients(x, mask, labels).items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net.w[k] = net.w[k] - (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label(net: Network, pages: list[list[Block]], most: int = 4096) -> list[np.ndarray]:
    """For each page, which blocks are main text; pages of like length go through the network together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        steps = len(pages[order[-1]])
        some = [order.pop() for _ in range(min(len(order), max(1, most // steps)))]
        x, mask = padded([vectors(pages[k]) for k in some])
        logits, _ = net.logits(x, mask)
        for row, k in zip(logits, some, strict=True):
            out[k] = row[: len(pages[k])] > 0
    return out


def extract(pages: DataFrame, net: Network) -> DataFrame:
    """A row for each page: page_id, url, text (empty if none), n_chars.

    White space inside a block becomes one space, blocks are joined by one
    space. Null and empty pages have no text; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 2 << 20):
            found = [blocks_of(x) for x in batch.column("html").to_pylist()]
            texts = [" ".join(b.text for b, main in zip(blocks, keep, strict=True) if main) for blocks, keep in zip(found, label(net, found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
