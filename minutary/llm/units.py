"""Exact tokenization through units.

A unit is a short stretch of text, such as a space with the word after it, at whose ends the
tokenizer never joins characters; a document's ids are then the ids of its units in order, and
a unit's ids may be kept in a table. Where a document's spacing or marks make such ends unsure,
it is cut more coarsely or encoded whole. Special strings hold no space, full stop, comma or
line end, so they stay within a unit and the tokenizer treats them there as it does in the text.
"""

from __future__ import annotations

import os
import re
from itertools import compress, count, repeat
from operator import is_
from unicodedata import is_normalized

import numpy as np

# White space other than spaces and line ends, and NUL, which marks the cuts.
_ODD_CHAR = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
# Full stops and commas that don't follow a letter or digit, and line ends that none follows.
_ODD_STOP = re.compile(r"[.,](?<![^\W_][.,])|\n(?![^\W_])")
# Full stops and commas beside anything but letters, digits, spaces and line ends.
_ODD_MARK = re.compile(r"[.,](?:(?<!(?:[^\W_]|[ \n])[.,])|(?!\Z|[^\W_]|[ \n]))|İ")


def _odd_space(t: str) -> bool:
    """Whether a space or line end stands beside another or at the end, or there is other white space."""
    return "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t.endswith(" ") or not t.replace("\n", "").isprintable() and _ODD_CHAR.search(t) is not None


_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per Python worker, on one thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitCache:
    """Table from unit to value: token count (width 0) or ids packed in ``width`` bytes each.

    ``frequent`` holds a broadcast first tier, which stays. The second tier is of two
    generations of at most ``limit`` units; when the younger is full, the older one goes, which
    bounds memory and costs only time. Units that the table lacks are encoded together: joined,
    and cut again at the tokens that begin (byte level) or end (word level) a unit; a part whose
    cuts don't fit its units is encoded unit by unit.
    """

    PART = 1000

    def __init__(self, path: str, width: int, limit: int = 600_000, frequent: dict | None = None):
        self.tok, self.width, self.limit = tokenizer(path), width, limit
        self.known: dict = {**(frequent or {}), "": b"" if width else 0}
        self.base, self.old = dict(self.known), {}
        self.marks = self._marks()
        self.met: set[int] = set()  # hashes of texts met, and what texts met again came to
        self.again: dict[str, list] = {}

    @classmethod
    def of_worker(cls, path: str, width: int, frequent=None) -> "UnitCache":
        """The cache of this Python worker, which serves all its tasks; frequent: makes the first tier."""
        key = f"{cls.__name__} {path} {width}"
        if key not in _LOADED:
            _LOADED[key] = cls(path, width, frequent=frequent() if frequent else None)
        return _LOADED[key]

    def _tokens(self) -> list[str]:
        return [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]

    def _cut(self, ids: np.ndarray, ends: list[int]) -> list:
        if not self.width:
            return [j - i for i, j in zip(ends, ends[1:])]
        raw, w = ids.astype(f"<u{self.width}").tobytes(), self.width
        ends = [w * i for i in ends]
        return [raw[i:j] for i, j in zip(ends, ends[1:])]

    def _each(self, texts: list[str]) -> list:
        return [self._cut(np.array(e.ids, np.uint32), [0, len(e.ids)])[0] for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, units: list[str], glue: str, begins: bool) -> dict:
        """Values of the units of all parts whose cuts fit."""
        out: dict = {}
        parts = [units[i : i + self.PART] for i in range(0, len(units), self.PART)]
        for part, e in zip(parts, self.tok.encode_batch_fast([glue.join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self.marks[ids])
            if len(cut) == len(part) and (cut[0] == 0 if begins else cut[-1] == len(ids) - 1):
                out.update(zip(part, self._cut(ids, [*cut.tolist(), len(ids)] if begins else [0, *(cut + 1).tolist()])))
        return out

    def documents(self, texts: list[str | None]) -> list[list]:
        """For each text (null counts as empty) the values of its units in order."""
        texts = [t or "" for t in texts]
        copies = [i for i, t in enumerate(texts) if t in self.again]
        repeats = []
        for i, t in enumerate(texts):
            h = hash(t)
            if h in self.met:
                repeats.append(i)
            else:
                self.met.add(h)
        if len(self.met) > 200_000:
            self.met.clear()
        done = {i: self.again[texts[i]] for i in copies}
        flat, ends, whole = self._units(["" if i in done else t for i, t in enumerate(texts)])
        values = list(map(self.known.get, flat))
        lacks = list(map(is_, values, repeat(None)))
        missing = set(compress(flat, lacks))
        if missing:
            if len(self.known) + len(missing) > self.limit + len(self.base):
                self.old, self.known = self.known, dict(self.base)
                missing.update(set(flat).difference(self.known))
                lacks = repeat(True, len(flat))
            again = {u: self.old[u] for u in missing if u in self.old}
            self.known.update(again)
            self.known.update(self._encode([u for u in missing if u not in again]))
            for i in compress(count(), lacks):
                values[i] = self.known[flat[i]]
        out = [values[i:j] for i, j in zip([0, *ends], ends)]
        for i, v in zip(whole, self._each([texts[i] for i in whole])):
            out[i] = [v]
        for i, v in done.items():
            out[i] = v
        for i in repeats:
            if i not in done and len(texts[i]) < 20_000 and len(self.again) < 2000:
                self.again[texts[i]] = [b"".join(out[i]) if self.width else sum(out[i])]
        return out


class ByteUnits(UnitCache):
    """Units of a byte-level tokenizer that keeps white space: cut before spaces, before full stops and commas after a word, and around line ends."""

    def _marks(self):
        return np.array([t.startswith("\u0120") for t in self._tokens()])

    def _units(self, texts):
        flat, ends, whole = [], [], []
        for i, t in enumerate(texts):
            if _odd_space(t):
                whole.append(i)
            else:
                t = t.replace(" ", "\0 ")
                if not _ODD_STOP.search(t):
                    t = t.replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0")
                flat += t.split("\0")
            ends.append(len(flat))
        return flat, ends, whole

    def _encode(self, units):
        out = self._together([u for u in units if u[0] == " "], "", True)
        rest = [u for u in units if u not in out]
        return out | dict(zip(rest, self._each(rest)))


class WordUnits(UnitCache):
    """Units of a tokenizer that lower-cases, drops white space and marks the ends of words."""

    def _marks(self):
        return np.array([t.endswith("</w>") for t in self._tokens()])

    def _units(self, texts):
        flat, ends = [], []
        for t in texts:
            if not _ODD_MARK.search(t) and is_normalized("NFC", t):  # full stops and commas stand alone: they are words of their own
                t = t.replace(".", " . ").replace(",", " , ")
            if t.isascii() and "<|" not in t:
                t = t.lower()
            flat += t.replace("\n", " ").split(" ")
            ends.append(len(flat))
        return flat, ends, []

    def _encode(self, units):
        out = self._together([u for u in units if u.isalpha()], " ", False)
        rest = [u for u in units if u not in out]
        return out | dict(zip(rest, self._each(rest)))
