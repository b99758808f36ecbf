"""What the training-data operators share: shipping, shared scratch tables, Arrow text blocks and vectorised hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.scratch import clear, saved, scratch_path, shared_dir
from lantern.shipping import ship

__all__ = ["clear", "saved", "scratch_path", "shared_dir"]

#: Bytes of text that a worker turns into arrays at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors and bound the bytes of Arrow batches; see `ship`."""
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits of a row's content as two longs."""
    return F.xxhash64(F.lit(1), *columns).alias("k1"), F.xxhash64(F.lit(2), *columns).alias("k2")


def named(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return df["`" + name.replace("`", "``") + "`"]


def row_of(df: DataFrame, names: list[str] | None = None) -> Column:
    """All columns, or those named, as one struct `row`, so that no name of theirs meets another; see `columns_of`."""
    return F.struct(F.lit(0).alias(""), *[named(df, c).alias(c) for c in (df.columns if names is None else names)]).alias("row")


def columns_of(row: Column, names: list[str]) -> list[Column]:
    return [row[c].alias(c) for c in names]


# --- Arrow text -------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of rows in them; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(batch: pa.RecordBatch, text: str | int, limit: int = BLOCK_BYTES):
    """Slices of a batch with at most `limit` bytes of text each, or a single row."""
    n = batch.num_rows
    if not n:
        return
    _, offs = text_bytes(batch.column(text))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in text whose A-Z are lower-cased.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def words(low: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and for each row the index of its first word (one more entry at the end)."""
    mask = kind[low]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    before = np.empty(len(low), bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(len(low), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


# --- hashing ----------------------------------------------------------------------------------------------------

_TABLES: dict[str, np.ndarray] = {}
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _TABLES[name] = np.multiply.accumulate(t)
    return _TABLES["up"], _TABLES["down"]


class Substrings:
    """64-bit hashes of any substrings of a byte array by prefix sums of a polynomial in an odd base. Hashes of another
    family give the bytes other, unrelated values."""

    def __init__(self, data: np.ndarray, family: int = 0):
        values = _TABLES.get(f"byte{family}")
        if values is None:
            values = _TABLES[f"byte{family}"] = mix(np.arange(1 + 256 * family, 257 + 256 * family, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Substrings(low).hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def tokens(text: str, kind: np.ndarray = ALNUM) -> list[bytes]:
    """The words of one text; for small fixed texts and tests."""
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = words(low, np.array([0, len(low)]), kind)
    data = low.tobytes()
    return [data[a:b] for a, b in zip(s, e, strict=True)]


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
