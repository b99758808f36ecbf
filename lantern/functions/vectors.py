"""Vector functions as column expressions over array<double>."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import hash_tokens, let


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    return let(v, lambda u: let(norm(u), lambda n: F.transform(u, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))))


def matryoshka(v: Column, dim: int) -> Column:
    return normalize(F.slice(v, 1, dim))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


# --- hash embedding ---------------------------------------------------------------------------------------------


def _places(tokens: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each token: its MD5 as a number of two halves."""
    digests = b"".join([md5(t).digest() for t in tokens.cast(pa.binary()).to_numpy(zero_copy_only=False)])
    high, low = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64).T
    sign = np.where(low & np.uint64(256), 1.0, -1.0)
    if dim >= 1 << 31:  # products of remainders might not fit
        return np.array([((int(h) << 64) | int(x)) % dim for h, x in zip(high, low, strict=True)], np.int64), sign
    d = np.uint64(dim)
    return (((high % d) * np.uint64((1 << 64) % dim) + low % d) % d).astype(np.int64), sign


def _signed_sums(row: np.ndarray, tokens: pa.Array, rows: int, dim: int) -> np.ndarray:
    """Unit sums of the tokens' signed buckets by row: the MD5 as a number modulo dim, its bit 8 as the sign."""
    coded = tokens.dictionary_encode()
    bucket, sign = _places(coded.dictionary, dim)
    code = coded.indices.to_numpy()
    sums = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=rows * dim).reshape(rows, dim) if len(code) else np.zeros((rows, dim))
    return _unit(sums)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length == 0, 1.0, length)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _rows(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def _embedded(df: DataFrame, keys: list[str], tokens: Column, dim: int, one: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    if dim < 1:
        raise ValueError("a vector has at least one dimension")
    small = df.select(*keys, tokens.alias("__tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(one(batch.columns[-1]))], [*keys, "embedding"])

    return small.mapInArrow(run, small.drop("__tokens").schema.add("embedding", T.ArrayType(T.DoubleType())))


def hash_vectors(df: DataFrame, keys: str | list[str], text: str | Column, dim: int = 64) -> DataFrame:
    """keys, embedding: the hash embedding of every row's text (unit length, or zero), of any positive dimension. It needs no
    shuffle, as a text is in one row; each distinct token of a batch is hashed once."""

    def one(tokens: pa.Array) -> np.ndarray:
        return _signed_sums(_rows(tokens), tokens.flatten(), len(tokens), dim)

    column = F.col(text) if isinstance(text, str) else text
    return _embedded(df, [keys] if isinstance(keys, str) else keys, hash_tokens(F.coalesce(column, F.lit(""))), dim, one)


def mean_hash_vectors(df: DataFrame, keys: str | list[str], texts: Column, dim: int = 64) -> DataFrame:
    """keys, embedding: the unit mean of the hash embeddings of an array of texts; zero for an empty array."""

    def one(tokens: pa.Array) -> np.ndarray:
        each, owner = tokens.flatten(), _rows(tokens)
        sums = np.zeros((len(tokens), dim))
        np.add.at(sums, owner, _signed_sums(_rows(each), each.flatten(), len(each), dim))
        many = np.bincount(owner, minlength=len(tokens))[:, None]
        return _unit(sums / np.maximum(many, 1))

    return _embedded(df, [keys] if isinstance(keys, str) else keys, F.transform(texts, lambda t: hash_tokens(F.coalesce(t, F.lit("")))), dim, one)


def chunked_hash_vectors(df: DataFrame, key: str, texts: Column, keep: Column, dim: int = 64) -> DataFrame:
    """key, embedding as of `mean_hash_vectors`, and chunks: the vectors of the texts themselves, where `keep` is true; else none."""
    small = df.select(key, F.coalesce(keep, F.lit(False)).alias("__keep"), F.transform(texts, lambda t: hash_tokens(F.coalesce(t, F.lit("")))).alias("__tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, kept = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)
            each, owner = tokens.flatten(), _rows(tokens)
            own = _signed_sums(_rows(each), each.flatten(), len(each), dim)
            sums = np.zeros((len(tokens), dim))
            np.add.at(sums, owner, own)
            many = np.bincount(owner, minlength=len(tokens))
            edge = np.append(0, np.cumsum(np.where(kept, many, 0))).astype(np.int32)
            chunks = pa.ListArray.from_arrays(pa.array(edge), _lists(own[kept[owner]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_unit(sums / np.maximum(many, 1)[:, None])), chunks], [key, "embedding", "chunks"])

    vector = T.ArrayType(T.DoubleType())
    return small.mapInArrow(run, small.select(key).schema.add("embedding", vector).add("chunks", T.ArrayType(vector)))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, embedding: the unit mean of a key's vectors, summed in the tasks before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.filter(F.col(vector).isNotNull()).groupBy(key).agg(mean.alias("mean")).select(key, normalize(vector_to_array("mean")).alias("embedding"))
