"""Vectorised views of a batch of texts: code points, n-gram hashes, word and line statistics."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


class Batch:
    """The texts of a batch side by side, a zero after each: no hash of a text's inside crosses its end."""

    def __init__(self, texts: list[str], mapping: np.ndarray):
        whole = "\0".join([*texts, ""])
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        self.raw = raw
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths + 1)
        self.codes = mapping[np.minimum(raw, len(mapping) - 1)]
        weighted = self.codes.astype(np.uint64) * powers(BASE, len(raw))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        self.texts = len(texts)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n mapped characters from each position on."""
        count = len(self.codes) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[n : n + count] - self.sums[:count]) * powers(INVERSE, count) + np.uint64(n)

    def spans(self, inside: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the runs where `inside` holds; a character that is `alone` is a run of its own."""
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        if alone is None or not alone.any():
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        else:
            split = np.concatenate([alone & inside, [False]])
            split[1:] |= split[:-1]
            new = split & np.concatenate([inside, [False]])
            starts = np.flatnonzero((edge == 1) | new)
            ends = np.flatnonzero((edge == -1) | (new & (edge != 1)))
        return starts, ends, (self.sums[ends] - self.sums[starts]) * powers(INVERSE, len(self.codes) + 1)[starts]


#: Code points that the tables hold; no letter or digit lies above.
POINTS = 0x33480


def _table(value, points: int = POINTS) -> np.ndarray:
    return np.array([value(chr(i)) for i in range(points)], np.uint32)


_maps: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Letters lower-cased, all else one blank."""
    if "letters" not in _maps:
        _maps["letters"] = _table(lambda c: ord(c.lower()[0]) if c.isalpha() else 32)
        _maps["letters"][0] = 0
    return _maps["letters"]


def words_only() -> np.ndarray:
    """Letters and digits lower-cased, all else one blank."""
    if "words" not in _maps:
        _maps["words"] = _table(lambda c: ord(c.lower()[0]) if c.isalnum() else 32)
        _maps["words"][0] = 0
    return _maps["words"]


#: Unicode blocks of scripts that put no blanks between words (Thai and Lao, Myanmar, Khmer, kana, Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x33479))


def unspaced() -> np.ndarray:
    """Whether a code point belongs to a script without blanks between words."""
    if "unspaced" not in _maps:
        _maps["unspaced"] = np.zeros(POINTS, bool)
        for a, b in UNSPACED:
            _maps["unspaced"][a : b + 1] = True
    return _maps["unspaced"]


#: Classes of characters whose shares describe a text.
CLASSES = ("other", "lower", "upper", "digit", "blank", "break", "stop", "comma", "bang", "bar", "mark", "quote", "dash", "symbol")


def classes() -> np.ndarray:
    if "classes" not in _maps:
        single = {"\n": "break", ".": "stop", ",": "comma", "!": "bang", "?": "bang", "|": "bar", "#": "mark", "$": "mark", "%": "mark", "&": "mark", "*": "mark", "'": "quote", '"': "quote", "-": "dash"}

        def of(c: str) -> int:
            kind = unicodedata.category(c)
            name = single.get(c) or ("upper" if kind in ("Lu", "Lt") else "lower" if kind[0] in "LM" else "digit" if kind[0] == "N" else "blank" if c.isspace() else "symbol" if kind[0] in "PS" else "other")
            return CLASSES.index(name)

        _maps["classes"] = _table(of, 0x10000)
    return _maps["classes"]


def profile(texts: list[str]) -> np.ndarray:
    """A row of shape and repetition measures for each text; an empty text gives the same finite row each time."""
    identity = _maps.setdefault("identity", np.arange(0x10000, dtype=np.uint32))
    b = Batch(texts, identity)
    kinds = classes()[np.minimum(b.raw, 0xFFFF)]
    kinds = np.where(b.raw == 0, 0, kinds)
    n = b.texts
    counts = np.bincount(b.owner.astype(np.int64) * len(CLASSES) + kinds, minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    counts[:, 0] -= 1  # the zero after each text
    chars = np.maximum(b.lengths, 1)[:, None]
    shares = counts / chars
    starts, ends, hashes = b.spans((kinds != CLASSES.index("blank")) & (kinds != CLASSES.index("break")) & (b.raw != 0))
    owner, size = b.owner[starts], ends - starts
    per = lambda w: np.bincount(owner, w, minlength=n)
    words = np.maximum(per(None), 1)
    mean = per(size) / words
    spread = np.sqrt(np.maximum(per(size.astype(float) ** 2) / words - mean**2, 0))
    same = np.zeros(len(owner))
    if len(owner) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct = lambda own, h: np.bincount(np.unique(np.stack([own.astype(np.uint64), h]), axis=1)[0].astype(np.int64), minlength=n) if len(own) else np.zeros(n)
    if len(owner):
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        kinds_of_word = np.bincount(owner[order][new], minlength=n)
    else:
        kinds_of_word = np.zeros(n)
    l_starts, _, l_hashes = b.spans((b.raw != 10) & (b.raw != 0))
    lines = np.maximum(np.bincount(b.owner[l_starts], minlength=n), 1)
    line_kinds = np.maximum(distinct(b.owner[l_starts], l_hashes), 1)
    initial = np.isin(kinds[starts], [CLASSES.index("upper")])
    tail = kinds[np.maximum(ends - 1, 0)]
    share = lambda w: per(w.astype(float)) / words
    extra = np.stack(
        [mean / 10, spread / 10, share(size <= 3), share(size >= 12), share(initial), share(same), kinds_of_word / words, line_kinds / lines, share(tail == CLASSES.index("mark")), share(tail == CLASSES.index("bang")), share(size == 1), words / lines / 50], axis=1
    )
    return np.concatenate([shares, extra, np.log(shares + 0.002), np.log(extra + 0.02), np.log1p(b.lengths)[:, None], np.log1p(words)[:, None]], axis=1)
