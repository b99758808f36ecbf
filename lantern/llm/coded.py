"""Blocks of documents whose tokens are codes of the block's own words, and compact arrays that travel between tasks.

A table that grows with the corpus (a vocabulary, counts of n-grams) can be neither broadcast nor held by a task. What a block
of documents needs of it is bounded by the block, though: the block's distinct words go to the table, and their rows come back.
So common words travel once a block, not once an occurrence.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa

from .common import LOWER, Substrings, byte_class, mix, ragged, words

#: Bytes of text of a block, about; a longer text is a block of its own.
CODED_BYTES = 16 << 20


# --- arrays as bytes --------------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Non-negative integers as one byte for the width, then all their lowest bytes, then the next ones, and so on: the upper
    planes of small values are missing, and planes compress where rows don't."""
    v = values.astype(np.uint64)
    top = int(v.max()) if len(v) else 0
    width = (top.bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unplaned(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    if n:
        out[: data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n)
    return np.ascontiguousarray(out.T).view(np.uint64).reshape(n)


# --- blocks -----------------------------------------------------------------------------------------------------


class Coder:
    """Gathers rows' words, and gives them as codes of the distinct words once there is a block of them."""

    def __init__(self, kind: np.ndarray, breaks: np.ndarray | None = None, keep_words: bool = True):
        """kind: the bytes of words. breaks: bytes that part the pieces of a text."""
        self.kind, self.breaks, self.keep_words = kind, breaks, keep_words
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, data: np.ndarray, offs: np.ndarray, salt: np.ndarray | None = None) -> None:
        """Rows of UTF-8 bytes. salt: a hash a row; equal words of rows with other salts are other words."""
        low = LOWER[data]
        starts, ends, first = words(low, offs, self.kind)
        sums = Substrings(low)
        h = sums.hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        if salt is not None:
            h = mix(h + salt[row])
        uniq, at, code = np.unique(h, return_index=True, return_inverse=True)
        text, check = None, None
        if self.keep_words:
            check = Substrings(low, 1).hashes(starts, ends) if len(starts) else h
            if salt is not None:
                check = mix(check ^ salt[row])
            if not np.array_equal(check, check[at][code]):  # two words with one hash: 128 bits tell them apart
                pair = np.unique(np.stack([h, check], 1), axis=0, return_index=True, return_inverse=True)
                uniq, at, code = pair[0][:, 0], pair[1], pair[2].reshape(-1)
            check = check[at]
            size = ends[at] - starts[at]
            text = (low[np.repeat(starts[at], size) + ragged(size)], size)
        piece = None
        if self.breaks is not None:
            passed = np.cumsum(self.breaks[low]) if len(low) else np.zeros(0, np.int64)
            piece = (passed[starts] if len(starts) else np.zeros(0, np.int64)) + row  # a row begins a piece as well
        self.parts.append((uniq, check, text, code.astype(np.int64), np.diff(first), piece, row[at]))
        self.size += len(data)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the distinct words, code of each token, tokens of each row, first part and row of each word's)."""
        h = np.concatenate([p[0] for p in self.parts])
        if self.keep_words:
            pair = np.stack([h, np.concatenate([p[1] for p in self.parts])], 1)
            pair = np.ascontiguousarray(pair).view([("h", np.uint64), ("c", np.uint64)]).reshape(-1)
            order = np.lexsort((pair["c"], pair["h"]))
            new = np.ones(len(order), bool)
            new[1:] = pair[order][1:] != pair[order][:-1]
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(new) - 1
            at = order[new]
        else:
            _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        base = np.cumsum([0, *[len(p[0]) for p in self.parts]])
        codes = np.concatenate([inverse[b + p[3]] for b, p in zip(base, self.parts, strict=False)]) if self.parts else np.zeros(0, np.int64)
        return h[at], codes, np.concatenate([p[4] for p in self.parts]), at

    def words_of(self, at: np.ndarray) -> pa.Array:
        """The words themselves, by where `merged` found them."""
        size = np.concatenate([p[2][1] for p in self.parts])
        data = np.concatenate([p[2][0] for p in self.parts])
        begin = np.cumsum(size) - size
        offsets = np.append(0, np.cumsum(size[at])).astype(np.int32)
        picked = data[np.repeat(begin[at], size[at]) + ragged(size[at])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(picked.tobytes()))

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        """A row, counted over all parts, that holds the word."""
        before = np.cumsum([0, *[len(p[4]) for p in self.parts]])
        return np.concatenate([b + p[6] for b, p in zip(before, self.parts, strict=False)])[at]

    def piece_starts(self) -> np.ndarray:
        """Which tokens begin a piece."""
        out = []
        for p in self.parts:
            new = np.ones(len(p[5]), bool)
            new[1:] = p[5][1:] != p[5][:-1]
            out.append(new)
        return np.concatenate(out)


def block_name() -> str:
    """A name that no other block has, a repeated task's included."""
    return uuid.uuid4().hex


#: Bytes of words `[^\x20\x09]+` of pieces that end at `[.,;:!?\x0A-\x0D]`, and of those ends.
BREAKS = byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
PIECE_WORDS = ~(BREAKS | byte_class((0x20, 0x20), (0x09, 0x09)))
