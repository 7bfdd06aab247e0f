"""Remembered encodings of text pieces, looked up and gathered by numpy.

A batch of texts is cut into pieces by byte tests, pieces get 64-bit fingerprints, and each distinct one is
looked up in a sorted table; what is new is encoded once.  A worker process keeps its tables across tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lumenql.llm import kernel as K


class PieceTable:
    """Fingerprint -> payloads (one array of each dtype).  Of `room` entries at most; beyond, it starts anew.

    encode() gives for each payload the values of all pieces, one after the other, and how many each piece has."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], dtypes: tuple[type, ...], room: int = 1_200_000):
        self.encode, self.dtypes, self.room = encode, dtypes, room
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.size = 0
        self.starts = [np.zeros(1 << 14, np.int64) for _ in self.dtypes]
        self.many = [np.zeros(1 << 14, np.int32) for _ in self.dtypes]
        self.flat = [np.zeros(1 << 16, d) for d in self.dtypes]
        self.used = [0 for _ in self.dtypes]

    @staticmethod
    def _fit(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
        out[: len(a)] = a
        return out

    def _add(self, keys: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n = len(keys)
        for p, (flat, many) in enumerate(found):
            self.starts[p], self.many[p] = self._fit(self.starts[p], self.size + n), self._fit(self.many[p], self.size + n)
            self.flat[p] = self._fit(self.flat[p], self.used[p] + len(flat))
            self.many[p][self.size : self.size + n] = many
            self.starts[p][self.size : self.size + n] = self.used[p] + np.cumsum(many) - many
            self.flat[p][self.used[p] : self.used[p] + len(flat)] = flat
            self.used[p] += len(flat)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.slots = np.insert(self.slots, at, (self.size + order).astype(np.int32))
        self.size += n

    def slots_of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The entry of each piece; pieces data[starts:stops] that are new are encoded and added."""
        if self.size > self.room:
            self._clear()
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = data.tobytes()
            where = first[new]
            self._add(keys[new], self.encode([raw[a:b].decode() for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)]))
            at = np.searchsorted(self.keys, keys)
        return self.slots[at][inverse]

    def gather(self, payload: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(payloads of the entries one after the other, where each ends, with 0 first)."""
        many = self.many[payload][slots]
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        at = np.repeat(self.starts[payload][slots] - ends[:-1], many) + np.arange(ends[-1])
        return self.flat[payload][at], ends


def word_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, starts, stops, first): words between ASCII white space."""
    return K.words(data, ends)


def spaced_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for pieces that tile a text: a word with the one space before it; of other white space before a
    word its last character, and what precedes that; white space at the end."""
    _, starts, stops, first = K.words(data, ends)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    before = np.concatenate([[0], stops[:-1]]) if len(starts) else starts
    head = first[:-1][np.diff(first) > 0]
    before[head] = ends[:-1][row[head]]
    gap = starts - before
    spaced = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 0x20)
    last = ends[:-1].copy()
    some = np.diff(first) > 0
    last[some] = stops[first[1:][some] - 1]
    tail = last[last < ends[1:]]
    mark = np.zeros(len(data), bool)
    for places in (starts - spaced, before[gap > 1], (starts - 1)[(gap > 0) & ~spaced], tail):
        mark[places] = True
    begin = np.flatnonzero(mark)
    stop = np.append(begin[1:], len(data))
    return K.Ranges(data).of(begin, stop), begin, stop, np.searchsorted(begin, ends)
