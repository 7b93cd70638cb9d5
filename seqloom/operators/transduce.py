"""Spelling rules with context, compiled to one finite-state transducer and run over whole texts.

An entry says what is written, which sounds it is read as, and which letters may stand before and
after it (``#`` is the edge of a word). Words are the runs of letters and marks of any script. In a
word, from left to right, the longest entry that fits applies; of equally long ones the first in
the file. A letter that no entry fits is silent.

A state is what a decision can still depend on: the letter before, and the letters that are read
but not decided. So there is no going back: each letter is one look-up. All words of a batch are
read side by side, a letter of each at a time, whatever texts they are in; long texts cost no more
than short ones of the same words. A null text has null sounds, an empty one none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE, OTHER = "#", "\0"
#: Characters that are read at once; bounds the memory of a task. A longer text is read by itself.
PIECE = 1 << 21


class BadSpelling(ValueError):
    """Entries that cannot be compiled."""


@dataclass(frozen=True)
class Entry:
    write: str
    read: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


def _tuple(value) -> tuple[str, ...]:
    if value is None:
        return ()
    return tuple(map(str, value)) if isinstance(value, (list, tuple)) else (str(value),)


def entries_of(parsed: dict, plain: Sequence[str] = ("consonant_mappings", "diacritic_mappings")) -> list[Entry]:
    """Entries of a parsed file: its list ``spelling`` (write, read, before, after), then the maps named in ``plain``, of which only plain values count."""
    found = []
    for e in parsed.get("spelling") or ():
        unknown = set(e) - {"write", "read", "before", "after"}
        if unknown or not e.get("write"):
            raise BadSpelling(f"{e}: {sorted(unknown) or 'nothing is written'}")
        found.append(Entry(str(e["write"]), _tuple(e.get("read")), _tuple(e.get("before")), _tuple(e.get("after"))))
    for part in plain:
        found += [Entry(str(k), (v,)) for k, v in (parsed.get(part) or {}).items() if isinstance(v, str) and k]
    return found


def _decide(entries: Sequence[Entry], before: str, pending: str, ended: bool) -> tuple[int, tuple[str, ...]] | None:
    """Letters and sounds of the entry that applies at the start of ``pending``; None: what follows decides."""
    for e in entries:
        n = len(e.write)
        if e.before and before not in e.before:
            continue
        if pending[:n] == e.write:
            after = pending[n] if len(pending) > n else EDGE if ended else None
            if e.after and after is None:
                return None
            if not e.after or after in e.after:
                return n, e.read
        elif not ended and e.write.startswith(pending):
            return None
    return 1, ()


@dataclass(frozen=True)
class Transducer:
    """``letters``: code points in order, whose class is their place and one; class 0 is any other letter."""

    letters: np.ndarray
    step: np.ndarray  # state, class -> state
    emit: np.ndarray  # state, class -> place in ``starts``; the last column: at the end of a word
    starts: np.ndarray
    sounds: np.ndarray  # sounds of all outputs, one after another, as places in ``names``
    names: tuple[str, ...]

    def _words(self, codes: np.ndarray) -> np.ndarray:
        """Which code points are letters or marks."""
        seen, place = np.unique(codes, return_inverse=True)
        known = np.isin(seen, self.letters)
        return np.array([k or unicodedata.category(chr(c))[0] in "LM" for c, k in zip(seen, known)], bool)[place]

    def read(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of sounds of all texts, one after another, and where each text's begin and end."""
        lengths = np.array([0 if t is None else len(t) for t in texts], np.int64)
        # an edge behind each text, so that no word goes over from one to the next
        joined = "\n".join([t or "" for t in texts]) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self._words(codes)
        inside[np.cumsum(lengths + 1) - 1] = False
        # the first place behind a word is an edge: it takes what the word's last state gives
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        first, last = change[0::2], change[1::2]
        place = np.searchsorted(self.letters, codes).clip(max=max(len(self.letters) - 1, 0))
        kind = np.where(self.letters[place] == codes, place + 1, 0) if len(self.letters) else np.zeros(len(codes), np.int64)
        out = np.zeros(len(codes), np.int64)
        order = np.argsort(first - last, kind="stable")  # longest first
        at, size = first[order], (last - first)[order]
        state = np.zeros(len(at), np.int64)
        shrink = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for t, n in enumerate(shrink):  # the first n words are longer than t letters
            here = at[:n] + t
            out[here] = self.emit[state[:n], kind[here]]
            state[:n] = self.step[state[:n], kind[here]]
        out[at + size] = self.emit[state, -1]
        many = np.diff(self.starts)[out]
        ends = np.concatenate([[0], np.cumsum(many)])
        found = self.sounds[np.repeat(self.starts[out] - ends[:-1], many) + np.arange(ends[-1])]
        return found, ends[np.concatenate([[0], np.cumsum(lengths + 1)])]

    def column(self, text: Column | str) -> Column:
        """Sounds of a text, an array."""
        names = pa.array(self.names, pa.string())

        def sounds(texts: pa.Array) -> pa.Array:
            parts, rows, size = [], [], 0
            values = texts.to_pylist()
            for k, t in enumerate(values):
                rows.append(t)
                size += len(t or "") + 1
                if size >= PIECE or k == len(values) - 1:
                    found, ends = self.read(rows)
                    offsets = pa.array(ends.astype(np.int32), mask=np.array([*(r is None for r in rows), False]))
                    parts.append(pa.ListArray.from_arrays(offsets, names.take(pa.array(found))))
                    rows, size = [], 0
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

        sounds.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(sounds, "array<string>")(F.col(text) if isinstance(text, str) else text)


def compiled(entries: Iterable[Entry], most: int = 50_000) -> Transducer:
    """The transducer of the entries; more than ``most`` states are an error."""
    rank = sorted(entries, key=lambda e: -len(e.write))
    if any(not e.write or EDGE in e.write or OTHER in e.write for e in rank):
        raise BadSpelling("an entry writes nothing, or an edge")
    letters = sorted({c for e in rank for x in (e.write, *e.before, *e.after) for c in x} - {EDGE})
    if any(len(x) != 1 for e in rank for x in (*e.before, *e.after)):
        raise BadSpelling("a letter before or after is one letter")
    matter = {x for e in rank for x in e.before}
    outputs: dict[tuple[str, ...], int] = {(): 0}
    number = {(EDGE if EDGE in matter else OTHER, ""): 0}
    todo, step, emit = list(number), [], []

    def run(before: str, pending: str, ended: bool) -> tuple[tuple[str, str], int]:
        said: tuple[str, ...] = ()
        while pending and (found := _decide(rank, before, pending, ended)) is not None:
            n, sounds = found
            said += sounds
            before, pending = (pending[n - 1] if pending[n - 1] in matter else OTHER), pending[n:]
        return (before, pending), outputs.setdefault(said, len(outputs))

    for before, pending in todo:  # grows while it is gone through
        to, says = [], []
        for c in (OTHER, *letters):
            state, said = run(before, pending + c, False)
            if state not in number:
                if len(number) == most:
                    raise BadSpelling(f"more than {most} states")
                number[state] = len(number)
                todo.append(state)
            to.append(number[state])
            says.append(said)
        step.append(to)
        emit.append([*says, run(before, pending, True)[1]])
    names = tuple(sorted({s for out in outputs for s in out}))
    index = {s: k for k, s in enumerate(names)}
    return Transducer(
        np.array([ord(c) for c in letters], np.uint32), np.array(step, np.int64), np.array(emit, np.int64),
        np.cumsum([0, *map(len, outputs)]), np.array([index[s] for out in outputs for s in out], np.int64), names,
    )
