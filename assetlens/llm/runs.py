"""Runs of words between any separators, counted exactly batch by batch: pieces shared by the counting operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import Words, join, mix


class Runs(Words):
    """The words of some texts, kept one after the other with one space behind each.

    kinds tells of each byte whether it belongs to a word (0), separates words (1) or also ends a piece (2); line feed
    must end one. Runs of words (grams) stay within a piece. label[i] numbers the group of text i: equal words of
    different groups have different hashes.
    """

    def __init__(self, texts: list[bytes], kinds: np.ndarray, label: np.ndarray | None = None, salt: np.ndarray | None = None):
        raw = np.frombuffer(b"\n".join([*texts, b" " * 16]), np.uint8)
        raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        kind = kinds[raw]
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        behind = inside.copy()
        behind[1:] |= inside[:-1]
        self.buf = np.concatenate([np.where(inside, raw, np.uint8(32))[behind], np.full(16, 32, np.uint8)])
        size = end - begin
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.owner = np.searchsorted(np.cumsum(sizes), begin, "right")
        self.text = np.searchsorted(np.flatnonzero(kind == 2), begin)
        self.hash = self._hashes()
        self.label = np.zeros(len(begin), np.int64) if label is None else label[self.owner]
        if salt is not None:
            self.hash = mix(join(salt[self.label], self.hash))

    def counted(self, at: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of n words at `at`: a place, the hash and the count of each different one.

        Runs are compared word by word: one that shares the hash of another is counted by itself.
        """
        value, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        like = at[first][which]
        odd = self.label[at] != self.label[like]
        for k in range(n):
            odd |= self.differ(at + k, like + k)
        if odd.any():
            np.subtract.at(count, which[odd], 1)
        lone = np.flatnonzero(odd)
        return np.concatenate([at[first], at[lone]]), np.concatenate([value, hashes[lone]]), np.concatenate([count, np.ones(len(lone), np.int64)])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The texts of the runs of n words at `at`, their words joined by a space."""
        return texts_at(self.buf, self.start[at], self.end[at + n - 1])


def texts_at(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The UTF-8 texts from start to end in buf, as an Arrow array of strings."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = buf[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def portions(texts: list[bytes], stop: re.Pattern[bytes], most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and texts of about `most` bytes together; a longer text is cut where `stop` matches, without loss."""
    which: list[int] = []
    out: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        begin = 0
        while begin < len(text):
            found = stop.search(text, begin + most) if len(text) - begin > most else None
            end = found.end() if found else len(text)
            if out and size + end - begin > most:
                yield which, out
                which, out, size = [], [], 0
            which.append(i)
            out.append(text[begin:end])
            size += end - begin
            begin = end
    if out:
        yield which, out
