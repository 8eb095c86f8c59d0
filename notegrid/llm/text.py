"""Vectorised text primitives over blocks of documents.

A block of texts becomes one array of code points with a line feed after each
text, so that no word crosses a border. All functions are exact for any Unicode
text; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
#: Characters handled at once; bounds a worker's memory, never a text (a longer one is a block of its own).
BLOCK_CHARS = 1_500_000
_BASE, _MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


@cache
def classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit; white space; its lower case; does it end a sentence."""
    n = 0x110000
    alnum, space, lower = np.zeros(n, bool), np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x33480)]:
        ch = chr(c)
        if ch.isalnum():
            alnum[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif ch.isspace():
            space[c] = True
    stop = np.zeros(n, bool)
    stop[[ord("."), ord("!"), ord("?")]] = True
    return alnum, space, lower, stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works on the array in place."""
    h ^= h >> U(32)
    h *= _MIX
    h ^= h >> U(29)
    h *= _BASE
    h ^= h >> U(32)
    return h


def blocks(texts: list, most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together."""
    lo = total = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield lo, k
            lo, total = k, 0
        total += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and where each begins (one entry more than texts)."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    raw = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass") if texts else b""
    return np.frombuffer(raw, np.uint32), begin


_POWER = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWER[0]) < n:
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(n + n // 2, base, U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWER[k] = p
    return _POWER


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(flag)]))
    return edge[::2], edge[1::2]


def words(cp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: 64-bit hash of its lower-cased letters, number of its text, start, end."""
    alnum, _, lower, _ = classes()
    start, end = runs(alnum[cp])
    power, back = _powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, U)
    low = lower[cp]
    last = end[cp[end - 1] == 0x3A3] - 1  # a sigma that ends a word of more letters is written in its final form
    if len(last):
        low[last[np.isin(last, start, invert=True) & is_letter(cp, last - 1)]] = 0x3C2
    np.cumsum(mix(low.astype(U) + U(7)) * power[: len(cp)], out=total[1:])
    h = mix((total[end] - total[start]) * back[start])
    return h, np.searchsorted(begin, start, "right") - 1, start, end


def is_letter(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Does a letter with case stand at the places?"""
    return np.array([(c := chr(cp[k])).lower() != c.upper() for k in at], bool)


def hash_word(word: str) -> int:
    """The hash ``words`` gives to a single word."""
    h = words(*points([word]))[0]
    return int(h[0]) if len(h) == 1 else 0


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the number of the text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    s = np.zeros(n, U)
    for j in range(k):
        s = s * U(0xA24BAED4963EE407) + h[j : j + n]
    same = doc[:n] == doc[k - 1 :]
    return mix(s[same]), doc[:n][same]


def distinct(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in rising order; the texts come in order."""
    s = s.copy()
    at = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for lo, hi in zip(at, [*at[1:], len(s)]):
        s[lo:hi].sort()
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[first], doc[first]
