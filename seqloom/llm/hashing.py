"""64-bit hashes of words, computed over whole texts in numpy."""

from __future__ import annotations

import numpy as np

from .common import LOWER

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd number, so its powers have inverses modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once at most.
LONG = 1 << 22
_powers: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, where each text's words begin, one more at the end).

    A word is a run without ASCII white space, A-Z in lower case; its hash is a polynomial
    in its bytes, read off prefix sums over the joined texts, then mixed with its length.
    A text of more than ``LONG`` bytes is read in pieces cut at white space.
    """
    if sum(map(len, texts)) <= LONG:
        return _hash_joined(texts)
    parts, first = [], [0]
    for text in texts:
        n, at = 0, 0
        while at < len(text):
            end = at + LONG
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            parts.append(_hash_joined([text[at:end]])[0])
            n += len(parts[-1])
            at = end
        first.append(first[-1] + n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(first)


def _hash_joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(texts).translate(LOWER) + b" "
    a = np.frombuffer(joined, np.uint8)
    space = _SPACE[a]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(a))
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        h = (run[end] - run[begin]) * down[begin]
        h = mix64(h ^ ((end - begin).astype(np.uint64) << np.uint64(48)))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(begin, offsets)
