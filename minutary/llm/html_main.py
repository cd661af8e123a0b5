"""Operator 10: main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: text between block-level tags, with the tags, classes, ids and
roles around it. Each block becomes a vector (hashed tag path, hashed words, length, share of
link text, marks, step in the tree) and a bidirectional LSTM in NumPy reads the page's blocks in
both directions, so that every block is labelled with the whole page in view. Blocks labelled main
are joined.
The weights are trained by ``train_labeller`` on generated pages and stored beside this module.

Null and empty pages give an empty text; broken mark-up never fails (a ``<`` that opens no tag is
text); null ids and urls stay null; repeated rows give repeated results; extra columns are
ignored; an empty table gives no rows. Scripts, styles, templates, text areas and the title are
not read; all else is a block for the labeller to judge.
"""

from __future__ import annotations

import re
import zlib
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

ANCESTORS, LEAF, WORD_DIM, EXTRA, HIDDEN = 192, 96, 96, 14, 24
DIM = ANCESTORS + LEAF + WORD_DIM + EXTRA
WEIGHTS = Path(__file__).with_name("html_labeller.npz")
#: Attributes as HTML reads them; a quoted value ends with its quote only where a tag can go on after it.
_ATTRS = r"(?:[\s/]++|[^\s/<>][^\s/<>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s<>]*+))?+)*+"
#: Comments, elements whose content isn't shown, tags, declarations, and a tag that the end of the page cuts off.
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template|textarea|title)(?=[\s/>]){_ATTRS}>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRS})>|<(?:[!?]|/(?![a-zA-Z]))[^<>]*+>|</?[a-zA-Z][a-zA-Z0-9]*+(?:\s(?=[^<>]*+\Z)[^<>=]*+=[^<>]*+)?\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE, _NAME = re.compile(r"\s+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that end a block of text, elements of running text, and elements without content.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same group, up to the nearest of the elements that hold such groups.
_GROUPS = {n: g for g in (frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["tr"]), frozenset(["td", "th"]), frozenset(["option"])) for n in g}
_HOLDERS = frozenset("ul ol menu dl table select div article section body main aside nav".split())


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "ignore")) % size


def _tag_names(name: str, attrs: str, known: dict) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Buckets of an element's name, classes, id and role: as an ancestor, and as the element around a text."""
    key = (name, attrs)
    if key not in known:
        if len(known) > 20_000:
            known.clear()
        found = ["<" + name]
        for _, *values in _ATTR.findall(attrs):
            found += [x.lower() for x in _NAME.findall("".join(values))]
        known[key] = tuple(_bucket(x, ANCESTORS) for x in found), tuple(_bucket(x, LEAF) for x in found)
    return known[key]


class Place:
    """An open element: the one around it, how deep it stands, the buckets of all names around (as bits) and of its own."""

    __slots__ = ("name", "up", "depth", "around", "own", "holder")

    def __init__(self, name: str, up: "Place | None", buckets: tuple[tuple[int, ...], tuple[int, ...]]):
        self.name, self.up, self.depth = name, up, up.depth + 1 if up else 1
        self.around, self.own = up.around if up else 0, buckets[1]
        for b in buckets[0]:
            self.around |= 1 << b
        #: depth of the nearest element, this one included, that holds groups
        self.holder = self.depth if name in _HOLDERS else up.holder if up else 0


def blocks(html: str, known: dict) -> list[tuple[Place | None, str, int]]:
    """(the element around it, text, characters inside links) of each leaf block with text, in page order.

    Each element is opened and closed once, and an end is sought only among elements that are open, so that reading takes time
    in proportion to the page however deep it is nested.
    """
    out: list = []
    stack: list[Place] = []
    open_: dict[str, list[int]] = {}  # depths of the open elements of each name
    piece: list[str] = []
    linked, in_link, path = 0, False, None
    at = 0

    def close() -> None:
        nonlocal linked
        if piece:
            text = _SPACE.sub(" ", "".join(piece)).strip()
            if text:
                out.append((path, text, min(linked, len(text))))
            piece.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal path, linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            if not piece:
                if text.isspace():
                    return
                path = stack[-1] if stack else None
            piece.append(text)
            if in_link:
                linked += len(text.strip())

    def cut(depth: int) -> None:
        while len(stack) >= depth:
            open_[stack.pop().name].pop()

    def pop(names: frozenset) -> None:
        nearest = max(open_[n][-1] if open_.get(n) else 0 for n in names)
        if stack and nearest > stack[-1].holder:
            cut(nearest)

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m[2]
            continue
        if name == "br":
            if piece:
                piece.append(" ")
            continue
        if name in BLOCK:
            close()
        if name in VOID:
            continue
        if m[2]:
            if open_.get(name):
                cut(open_[name][-1])
        else:
            if name in _GROUPS:
                pop(_GROUPS[name])
            elif name in BLOCK and stack and stack[-1].name == "p":
                cut(len(stack))  # an element of its own block ends a paragraph
            if not m[4].endswith("/") or name in BLOCK:
                stack.append(Place(name, stack[-1] if stack else None, _tag_names(name, m[4], known)))
                open_.setdefault(name, []).append(len(stack))
    add(html[at:])
    close()
    return out


_MARK = re.compile(r"[.,;:!?。，،]")


def features(found: list[tuple[Place | None, str, int]], known: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row for each block from start to stop: hashed names around it, hashed words, measures of the text and its place."""
    stop = len(found) if stop is None else min(stop, len(found))
    x = np.zeros((stop - start, DIM), np.float32)
    word_of = known.setdefault("words", {})
    if len(word_of) > 200_000:
        word_of.clear()
    before = found[start - 1][0] if start else None
    for i, row in enumerate(x, start):
        path, text, linked = found[i]
        if path:
            row[:ANCESTORS] = np.unpackbits(np.frombuffer(path.around.to_bytes(ANCESTORS // 8, "little"), np.uint8), bitorder="little")
        for weight, place in ((1.0, path), (0.5, path and path.up)):
            for b in place.own if place else ():
                row[ANCESTORS + b] += weight
        words = text.lower().split()
        try:
            at = [word_of[w] for w in words]
        except KeyError:
            for w in words:
                if w not in word_of:
                    word_of[w] = _bucket(w.strip(".,;:!?()\"'"), WORD_DIM)
            at = [word_of[w] for w in words]
        counts = np.bincount(at, minlength=WORD_DIM)
        row[ANCESTORS + LEAF : ANCESTORS + LEAF + WORD_DIM] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
        x1, x2 = path, before
        while x1 is not x2:  # up from the deeper one; every step is an element opened or closed since the block before
            if x2 is None or x1 is not None and x1.depth >= x2.depth:
                x1 = x1.up
            else:
                x2 = x2.up
        depth, shared, n = path.depth if path else 0, x1.depth if x1 else 0, len(text)
        gone = (before.depth if before else 0) - shared
        row[-EXTRA:] = (
            np.log1p(n) / 6, linked / n, min(1.0, 10 * len(_MARK.findall(text)) / n), min(1.0, len(words) / 40), "\N{COPYRIGHT SIGN}" in text, n > 80 and linked < n / 2, text[-1] in ".!?。؟",
            sum(map(str.isdigit, text[:200])) / min(n, 200), len(words) == 1, depth / 10, (depth - shared) / 5, gone / 5, i < 3, i >= len(found) - 3,
        )
        before = path
    return x


def gates(found: list[tuple[Place | None, str, int]], known: dict, w: dict) -> np.ndarray:
    """What a page's blocks give to the gates of both directions; some blocks at a time."""
    both = np.concatenate((w["xf"], w["xr"]), axis=1)
    parts = [features(found, known, k, k + 4096) @ both for k in range(0, len(found), 4096)]
    return np.concatenate(parts) if parts else np.zeros((0, 8 * HIDDEN), np.float32)


def _direction(z_in: np.ndarray, keep: np.ndarray, w: dict, side: str) -> np.ndarray:
    """What each block (time, page) adds to the verdict in one direction; keep: 1 where the page has a block."""
    steps, pages, _ = z_in.shape
    h, c, out = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros((steps, pages), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = z_in[t] + w[f"b{side}"] + h @ w[f"h{side}"]
        g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        new = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
        k = keep[t][:, None]
        c = np.where(k, new, c)
        h = np.where(k, g[:, 2 * HIDDEN :] * np.tanh(new), h)
        out[t] = h @ w[f"o{side}"]
    return out


def label(pages: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """Main or not for each block of each page, given as ``gates``; pages of like length are read together."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        group = [order[at]]
        at += 1
        while at < len(order) and len(group) < 256 and (len(group) + 1) * len(pages[order[at]]) <= 40_000:
            group.append(order[at])
            at += 1
        steps = len(pages[group[-1]])
        x, keep = np.zeros((steps, len(group), 8 * HIDDEN), np.float32), np.zeros((steps, len(group)), bool)
        for k, i in enumerate(group):
            x[: len(pages[i]), k], keep[: len(pages[i]), k] = pages[i], True
        z = _direction(x[:, :, : 4 * HIDDEN], keep, w, "f") + _direction(x[:, :, 4 * HIDDEN :], keep, w, "r") + w["o"]
        for k, i in enumerate(group):
            out[i] = z[: len(pages[i]), k] > 0
    return out


def load_weights() -> dict:
    with np.load(WEIGHTS) as z:
        return {k: z[k] for k in z.files}


def main_texts(htmls: list[str | None], w: dict, known: dict) -> list[str]:
    """The main text of each page."""
    found = [blocks(h or "", known) for h in htmls]
    marks = label([gates(f, known, w) for f in found], w)
    return ["\n".join(t for (_, t, _), m in zip(f, mark) if m) for f, mark in zip(found, marks)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        w, known = load_weights(), {}
        for b in common.batches(batches, 512):
            texts = main_texts(b.column("html").to_pylist(), w, known)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
