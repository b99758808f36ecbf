"""Postings in document shards, for searches that should read what their terms ask for and no more.

A shard is some thousands of documents, numbered in the order of their paths. Its postings are cut into blocks; a block names
its first and last document, its largest term weight and its shortest document, which together bound what any of its documents
can score, whatever the average length is by then. Blocks are written in ranges of term and shard with small row groups, so that
the statistics of terms let a scan skip those of other terms, and a common term is in many files.

A search scores the shards side by side. In a shard it takes a query's terms by falling bound. Once k documents are scored, a
block is passed over if none of its documents can come up to the k-th of them with all that is left to come; so towards
the end of a query, when the terms left can't lift an unseen document that far, common terms are looked up for the few
documents that still may enter and nothing else."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.scratch import saved

#: Documents of a shard, and postings of a block.
SHARD_DOCS, BLOCK = 4096, 128
#: Bytes of a row group and of a page of the written postings.
PAGE = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(64 << 10)}
#: Queries and distinct terms of a search by postings; larger batches read so much that a scan of all documents is no dearer.
QUERIES, TERMS = 256, 512
#: A search by postings is taken if its terms have less than this share of all postings.
SHARE = 0.25
#: Values that are named one by one in a filter that the scan sees.
NAMED = 1000
#: The columns of a forward table, for a type of paths, and a document's place in the shards.
FORWARD, PLACE = "path {}, dl long, terms array<string>, tf_title array<int>, tf_body array<int>", ", shard long, ord int"


@dataclass(frozen=True)
class Shards:
    """rows: the blocks (see `blocks_of`), given or made once they are asked for; dead: shard, ord of documents that count no more;
    and the sums over live documents."""

    given: DataFrame | Callable[[], DataFrame]
    dead: DataFrame | None
    docs: int
    words: int
    postings: int

    @cached_property
    def rows(self) -> DataFrame:
        return self.given() if callable(self.given) else self.given


def any_of(column: str, values: list) -> Column:
    """A filter that reaches the scan whatever the number of values."""
    if not values:
        return F.lit(False)
    tests = [F.col(column) == F.lit(v) for v in values]
    while len(tests) > 1:  # a balanced tree, as a chain would be as deep as it is long
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    # a row is looked up in a set; only those that are in it go through the tests
    return F.col(column).isin(values) & tests[0] if len(values) > 1 else tests[0]


def names_of_task() -> Iterator[int]:
    """Numbers that no other task gives, a repeated one's included, in rising order, so that rows that follow each other have
    numbers that do, which is what statistics tell apart."""
    return count((uuid.uuid4().int >> 65) & ~((1 << 20) - 1))


def sharded(terms: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A forward table (path, dl, terms, tf_title, tf_body) with shard and ord: the documents of a task, so many a shard, by path."""
    kind = terms.schema["path"].dataType.simpleString()
    names = ["path", "dl", "terms", "tf_title", "tf_body"]
    return terms.select(*names).mapInArrow(lambda batches: in_shards(batches, shard_docs), FORWARD.format(kind) + PLACE)


def in_shards(batches: Iterator[pa.RecordBatch], shard_docs: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task with shard and ord."""
    held: list[pa.RecordBatch] = []
    numbers = names_of_task()

    def flush(n: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        own, rest = table.slice(0, n), table.slice(n)
        held.extend(rest.to_batches())
        own = own.sort_by("path")
        own = own.append_column("shard", pa.array(np.full(n, next(numbers), np.int64))).append_column("ord", pa.array(np.arange(n, dtype=np.int32)))
        yield from own.to_batches(max_chunksize=512)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= shard_docs:
            yield from flush(shard_docs)
    if left := sum(b.num_rows for b in held):
        yield from flush(left)


def blocks_of(terms: DataFrame, title_weight: float, body_weight: float, block: int = BLOCK) -> DataFrame:
    """term, shard, first, last, most (largest weighted count), shortest (length), ords, counts (weighted), lengths: the postings of
    a sharded forward table, whose rows stand shard by shard; a shard cut in two by its reader gives more blocks, no others."""

    def made(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.concatenate([p.column(1).value_lengths().to_numpy() for p in parts])
        row = np.repeat(np.arange(len(size)), size)
        coded = pa.concat_arrays([p.column(1).flatten() for p in parts]).dictionary_encode()
        if not len(coded):
            return
        order_of = np.empty(len(coded.dictionary), np.int64)
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        order_of[by_name] = np.arange(len(by_name))
        term = order_of[coded.indices.to_numpy()]
        ords = np.concatenate([p.column(5).to_numpy() for p in parts])[row]
        weight = title_weight * np.concatenate([p.column(2).flatten().to_numpy() for p in parts]) + body_weight * np.concatenate([p.column(3).flatten().to_numpy() for p in parts])
        length = np.concatenate([p.column(0).to_numpy() for p in parts])[row]
        sort = np.lexsort((ords, term))
        term, ords, weight, length = term[sort], ords[sort], weight[sort].astype(np.float32), length[sort].astype(np.int32)
        within = np.arange(len(term)) - np.searchsorted(term, term)
        head = np.flatnonzero(within % block == 0)
        edge = np.append(head, len(term)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (ords, weight, length)]
        names = coded.dictionary.take(pa.array(by_name)).take(pa.array(term[head]))
        columns = [names, pa.array(np.full(len(head), shard, np.int64)), pa.array(ords[head]), pa.array(ords[edge[1:] - 1]), pa.array(np.maximum.reduceat(weight, head)), pa.array(np.minimum.reduceat(length, head)), *lists]
        whole = pa.RecordBatch.from_arrays(columns, ["term", "shard", "first", "last", "most", "shortest", "ords", "counts", "lengths"])
        for a in range(0, whole.num_rows, 4096):
            yield whole.slice(a, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            shards = batch.column(4).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1]) if len(shards) else np.zeros(0, bool)), len(shards))
            for a, b in zip(edge, edge[1:], strict=False):
                if shards[a] != at and held:
                    yield from made(at, held)
                    held = []
                at = int(shards[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from made(at, held)

    kind = "term string, shard long, first int, last int, most float, shortest int, ords array<int>, counts array<float>, lengths array<int>"
    blocks = terms.select("dl", "terms", "tf_title", "tf_body", "shard", "ord").mapInArrow(run, kind)
    return blocks.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard", "first")


class Shard:
    """The blocks of one shard that a search has read, by term."""

    def __init__(self, table: pa.Table, average: float, k1: float, b: float, dead: np.ndarray | None = None):
        self.average, self.k1, self.b = average, k1, b
        names = table.column("term").to_pylist()
        self.first, self.last, most, shortest = (table.column(c).to_numpy() for c in ("first", "last", "most", "shortest"))
        self.bound = self.score(most.astype(np.float64), shortest)
        self.lists = [table.column(c).combine_chunks() for c in ("ords", "counts", "lengths")]
        self.edge = self.lists[0].offsets.to_numpy()
        self.flat = [x.values.to_numpy() for x in self.lists]
        self.blocks: dict[str, list[int]] = {}
        for i, t in enumerate(names):
            self.blocks.setdefault(t, []).append(i)
        self.size = int(self.last.max(initial=-1)) + 1
        self.alive = np.ones(self.size, bool)
        if dead is not None:
            self.alive[dead[dead < self.size]] = False
        #: blocks whose postings were looked at
        self.opened = 0

    def score(self, weight: np.ndarray, length: np.ndarray) -> np.ndarray:
        return weight / (weight + self.k1 * (1 - self.b + self.b * length / self.average))

    def top(self, query: list[tuple[str, float]], k: int, margin: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
        """(ord, score) of the k best documents for (term, weight) pairs; ties go to the smaller ord at 9 decimals."""
        own = [(w, self.blocks[t]) for t, w in query if t in self.blocks]
        own = sorted(((w * self.bound[b].max(), w, b) for w, b in own), key=lambda x: (-x[0], -x[1]))
        left = np.append(np.cumsum([x[0] for x in own][::-1])[::-1], 0.0)
        total, edge = np.zeros(self.size), -np.inf
        for j, (_, weight, blocks) in enumerate(own):
            for i in blocks:
                # the best that any document of the block may come to
                if edge > -np.inf and total[self.first[i] : self.last[i] + 1].max() + weight * self.bound[i] + left[j + 1] < edge - margin:
                    continue
                self.opened += 1
                a, z = self.edge[i], self.edge[i + 1]
                ords, counts, lengths = (x[a:z] for x in self.flat)
                total[ords] += weight * self.score(counts.astype(np.float64), lengths) * self.alive[ords]
            if np.count_nonzero(total) >= k:
                edge = np.partition(total, -k)[-k]
        found = np.flatnonzero(total > 0)
        order = np.lexsort((found, -np.round(total[found], 9)))[:k]
        return found[order], total[found[order]]


def search_shards(weights, shards: Shards, terms: DataFrame, k: int, average: float, k1: float, b: float, id_kind: str) -> DataFrame:
    """query_id, path, score of the k best, and those that tie with the last. weights: `keyword.Weights` of the queries."""
    spark = shards.rows.sparkSession
    names = weights.terms.to_pylist()
    queries: list[list[tuple[str, float]]] = [[] for _ in weights.ids]
    for t, name in enumerate(names):
        for at in range(weights.begin[t], weights.begin[t + 1]):
            queries[weights.query[at]].append((name, float(weights.weight[at])))
    sent = spark.sparkContext.broadcast((weights.ids, queries))
    own = shards.rows.filter(any_of("term", names))
    kind = f"query_id {id_kind}, shard long, ord int, score double"

    def scored(table: pa.Table, dead: np.ndarray | None) -> pa.Table:
        ids, asked = sent.value
        shard = Shard(table, average, k1, b, dead)
        found = [shard.top(q, k) for q in asked]
        n = [len(x) for x, _ in found]
        at = np.full(sum(n), table.column("shard")[0].as_py() if table.num_rows else 0, np.int64)
        return pa.table([pa.array(ids).take(pa.array(np.repeat(np.arange(len(ids)), n))), pa.array(at), pa.array(np.concatenate([x for x, _ in found]).astype(np.int32)), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "shard", "ord", "score"])

    def alone(table: pa.Table) -> pa.Table:
        return scored(table, None)

    def beside(table: pa.Table, dead: pa.Table) -> pa.Table:
        return scored(table, dead.column("ord").to_numpy())

    if shards.dead is None:
        found = own.groupBy("shard").applyInArrow(alone, kind)
    else:
        gone = shards.dead.select(F.col("shard").alias("of"), "ord").join(own.select(F.col("shard").alias("of")).distinct(), "of", "left_semi")
        found = own.groupBy("shard").cogroup(gone.groupBy("of")).applyInArrow(beside, kind)
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc())
    found = saved(found.withColumn("r", F.rank().over(best)).filter(F.col("r") <= k).drop("r"), "found")
    used = [r[0] for r in found.select("shard").distinct().limit(NAMED + 1).collect()]
    named = terms.select("shard", "ord", "path")
    if len(used) <= NAMED:
        named = named.filter(any_of("shard", used))
    return found.join(named, ["shard", "ord"]).select("query_id", "path", "score")
