"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over its byte positions. A leaf holds the rank of the pair that starts at
that live position, an inner node the smaller of its children's ranks, so the root's descent to the left on ties finds
the leftmost pair of minimum rank. A merge changes two leaves at most: the pair at the merged position and the pair of
its live predecessor; each is a point update of logarithmic cost. A pre-token that is itself a token is taken whole.

Defined results: null text is empty (0 tokens); texts of any length are encoded whole; repeated rows give repeated rows;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare

_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merger:
    """Ranks and what is derived from them; one a worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pieces = {v: k for k, v in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        ranks, longest = self.ranks, self.longest
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank = len(piece), ranks.get
        if n < 2:
            return [ranks[piece[i : i + 1]] for i in range(n)]
        # a leaf for each pair of neighbours; its place is that of the pair's first byte
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * size + [rank(piece[i : i + 2], _NONE) for i in range(n - 1)] + [_NONE] * (size - n + 1)
        for i in range(size - 1, 0, -1):
            one, two = tree[2 * i], tree[2 * i + 1]
            tree[i] = one if one <= two else two
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) != _NONE:
            node = 1
            while node < size:
                node *= 2
                if tree[node] != least:
                    node += 1
            at = node - size
            gone = after[at]
            end = after[at] = after[gone]
            if end < n:
                before[end] = at
                to = after[end]
                value = rank(piece[at:to], _NONE) if to - at <= longest else _NONE
            else:
                value = _NONE
            # point updates: up from a leaf as long as an inner node changes
            while True:
                tree[node] = value
                if node == 1:
                    break
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
            if gone < n - 1:
                node, value = size + gone, _NONE
                while True:
                    tree[node] = value
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if not node or tree[node] == value:
                        break
            left = before[at]
            if left >= 0:
                node, value = size + left, rank(piece[left:end], _NONE) if end - left <= longest else _NONE
                while True:
                    tree[node] = value
                    if node == 1:
                        break
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if tree[node] == value:
                        break
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out


class Pieces(dict):
    """Ids, as bytes, of pre-tokens seen lately: a young and an old generation of at most `most` each, so memory is bounded."""

    def __init__(self, merger: Merger, most: int = 400_000):
        super().__init__()
        self.merger, self.most, self.old = merger, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            made = self.merger.merge(piece.encode("utf-8", "surrogateescape"))
            ids = struct.pack(f"<{len(made)}I", *made)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: The codec that a worker made last, by the digest of its ranks and its pattern; later tasks of the worker take it over.
_MADE: dict[tuple[str, str], Codec] = {}


def codec_of(vocabulary: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(vocabulary).hexdigest(), pattern
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Codec(read_ranks(vocabulary), pattern)
    return _MADE[key]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger = Merger(ranks)
        self.find = regex.compile(pattern).findall
        self.known = Pieces(self.merger)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.find(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.merger.pieces.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if kept, token_ids.

    `vocabulary` is the content of a rank file, which has a fixed size and so may be broadcast.
    """
    spark = docs.sparkSession
    prepare(spark)
    if len(vocabulary) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, pattern)
        for batch in batches:
            counts, ids_sha, text_sha, kept = [], [], [], []
            for value in batch.column(1).cast(pa.binary()):
                ids = codec.encode((value.as_py() or b"").decode("utf-8", "surrogateescape"))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = small.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else "")
    return small.mapInArrow(run, schema).withColumnRenamed("id", id_col)
