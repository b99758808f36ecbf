"""Trigram signatures of blocks of files: which blocks can't hold a string, without reading them.

A block is about a megabyte of consecutive files of a task. Its signature is a bitmap with a bit for the hash of each three
consecutive bytes of its lower-cased texts; it stands in the block's first row, in a column of its own, which is read without the
texts. A string can be in a block only if the bits of all its trigrams are set; strings of fewer than three bytes can be in any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.postings import NAMED, any_of, names_of_task

#: Bits of a signature, as a power of two, and bytes of text of a block, about.
BITS, BLOCK_BYTES = 17, 1 << 20
#: How the files are written: with row groups of a few blocks, so that blocks that are not asked for are not read.
WRITE = {"parquet.block.size": str(4 << 20), "parquet.page.size": str(256 << 10)}


def places(text: bytes, bits: int = BITS) -> np.ndarray:
    """The bits of a text's trigrams."""
    return np.unique(_hashes(text, bits))


def _hashes(text: bytes, bits: int) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def signature(texts: list[str | None], bits: int = BITS) -> bytes:
    out = np.zeros(1 << bits, bool)
    for t in texts:
        out[_hashes((t or "").lower().encode("utf-8", "surrogatepass"), bits)] = True
    return np.packbits(out, bitorder="little").tobytes()


def signed(files: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of files with `block` and, in the first row of each block, its `signature`."""
    at = files.columns.index(text)
    schema = T.StructType([*files.schema.fields, T.StructField("block", T.LongType()), T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, numbers = 0, names_of_task()

        def flush() -> Iterator[pa.RecordBatch]:
            own, block = [t for b in held for t in b.column(at).to_pylist()], next(numbers)
            bits: list = [signature(own)]
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, block, np.int64)), pa.array(bits + [None] * (b.num_rows - len(bits)), pa.binary())], schema.names)
                bits = []

        for batch in batches:
            length = np.cumsum(pc.binary_length(batch.column(at).fill_null("")).to_numpy())
            a = 0
            while a < batch.num_rows:
                room = block_bytes - size + (int(length[a - 1]) if a else 0)
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(length, room, "right"))))
                held.append(batch.slice(a, b - a))
                size += int(length[b - 1]) - (int(length[a - 1]) if a else 0)
                if size >= block_bytes or b < batch.num_rows:
                    yield from flush()
                    held.clear()
                    size = 0
                a = b
        if held:
            yield from flush()

    return files.mapInArrow(run, schema)


class Wanted:
    """The trigrams of some strings."""

    def __init__(self, strings: list[str], bits: int = BITS):
        own = [places(s.lower().encode("utf-8", "surrogatepass"), bits) for s in strings]
        self.always = any(not len(x) for x in own)
        own = [x for x in own if len(x)]
        self.begin = np.cumsum([0, *map(len, own)])[:-1]
        self.flat = np.concatenate(own) if own else np.zeros(0, np.uint32)

    def may_hold(self, bits: bytes) -> bool:
        """Whether any of the strings may be in a block of that signature."""
        if self.always or not len(self.begin):
            return self.always
        held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        return bool(np.minimum.reduceat(held[self.flat], self.begin).any())


def signatures_of(files: DataFrame) -> DataFrame:
    """block, signature of signed files."""
    return files.filter("signature is not null").select("block", "signature")


def pruned(files: DataFrame, signatures: DataFrame, strings: list[str]) -> DataFrame:
    """The rows of the blocks that may hold one of the strings; of other blocks the texts are not read."""
    sent = files.sparkSession.sparkContext.broadcast(Wanted(strings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = [sent.value.may_hold(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            yield batch.select([0]).filter(pa.array(may, pa.bool_()))

    found = signatures.select("block", "signature").mapInArrow(run, "block long")
    some = [r[0] for r in found.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return files.filter(any_of("block", some))
    return files.join(found, "block", "left_semi")
