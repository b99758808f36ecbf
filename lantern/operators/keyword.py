"""Full-text index and BM25 with column weights.

The index is a forward table: a document's terms with their counts in title and body, in one row, made row by row without a
shuffle; and the same as postings in document shards (see `postings`). A few queries whose terms have a small share of all
postings are searched by the postings. A batch that would read most of them anyway is searched by a scan of the forward table:
the terms of a counted block of queries travel to the tasks with their weights, a task scores its documents by matrix products
and keeps its k best of each query. So a common term is no hot key, and what is shuffled is tasks x queries x k rows. Both ways
give the same rows. Document frequencies are a table of their own, written with the index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.stem import stemmed_form
from lantern.functions.text import index_terms, query_tokens, strip_marks
from lantern.operators import postings as postings_
from lantern.operators.topk import Best

K1, B = 1.2, 0.75
TITLE_WEIGHT, BODY_WEIGHT = 5.0, 1.0
#: Inverse document frequency of a term in half the documents or more.
FLOOR = 1e-6
#: Queries and documents that are scored at once, and blocks of queries that travel to the tasks together, so that the index is
#: read once for all of them.
QUERY_BLOCK, ROWS_AT_ONCE, SCAN_BLOCKS = 512, 512, 16


# --- index ------------------------------------------------------------------------------------------------------


def _counted(title: pa.Array, body: pa.Array, stemmed: bool) -> tuple[pa.Array, ...]:
    """dl, terms, tf_title, tf_body of rows from the lists of their tokens."""
    rows = len(title)
    sizes = [x.value_lengths().fill_null(0).to_numpy() for x in (title, body)]
    row = np.concatenate([np.repeat(np.arange(rows), n) for n in sizes])
    coded = pa.concat_arrays([title.flatten(), body.flatten()]).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    if stemmed and len(names):
        forms = pa.array([stemmed_form(t) for t in names.to_numpy(zero_copy_only=False)], pa.string()).dictionary_encode()
        names, code = forms.dictionary, forms.indices.to_numpy()[code]
    key, place = np.unique(row * np.int64(max(1, len(names))) + code, return_inverse=True)
    in_title = np.bincount(place[: int(sizes[0].sum())], minlength=len(key))
    total = np.bincount(place, minlength=len(key))
    offsets = pa.array(np.searchsorted(key, np.arange(rows + 1) * np.int64(max(1, len(names)))).astype(np.int32))
    lists = [names.take(pa.array(key % max(1, len(names)))), pa.array(in_title.astype(np.int32)), pa.array((total - in_title).astype(np.int32))]
    return pa.array((sizes[0] + sizes[1]).astype(np.int64)), *(pa.ListArray.from_arrays(offsets, x) for x in lists)


def forward(docs: DataFrame, path: str = "path", title: str = "title", body: str = "body", stemmed: bool = True, shard_docs: int = 0) -> DataFrame:
    """path, dl (tokens), terms, tf_title, tf_body: a row a document. Stemmed terms are without diacritics. With `shard_docs`, in
    the same pass, also shard and ord, as `postings.sharded` gives them."""
    kind = docs.schema[path].dataType.simpleString()
    small = docs.select(F.col(path).alias("path"), *[F.coalesce(index_terms(F.col(c), not stemmed), F.array().cast("array<string>")) for c in (title, body)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_counted(batch.column(1), batch.column(2), stemmed)], ["path", "dl", "terms", "tf_title", "tf_body"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return postings_.in_shards(run(batches), shard_docs)

    return small.mapInArrow(dealt if shard_docs else run, postings_.FORWARD.format(kind) + (postings_.PLACE if shard_docs else ""))


def shard_rows(terms: DataFrame) -> DataFrame:
    """The postings of a sharded forward table, with the weights of title and body in their counts."""
    return postings_.blocks_of(terms, TITLE_WEIGHT, BODY_WEIGHT)


def shards_of(terms: DataFrame, write, late: bool = False) -> postings_.Shards:
    """The postings of a written, sharded forward table, and their sums. `write` writes a table and reads it back; if late, once a
    search goes by them."""
    rows = (lambda: write(shard_rows(terms))) if late else write(shard_rows(terms))
    # the sizes of the terms' lists, without the terms
    docs, words, held = terms.agg(F.count("*"), F.sum("dl"), F.sum(F.size("tf_body"))).first()
    return postings_.Shards(rows, None, docs, words or 0, held or 0)


def postings(terms: DataFrame) -> DataFrame:
    """term, path, tf_title, tf_body of a forward table."""
    each = terms.select("path", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf_title", "tf_body")))
    return each.select("term", "path", F.col("tf_title").cast("long").alias("tf_title"), F.col("tf_body").cast("long").alias("tf_body"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """term, n: the number of documents that hold it."""
    return terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def sorted_vocabulary(known: DataFrame) -> DataFrame:
    """By term, so that a search reads the pages of its own terms."""
    return known.repartitionByRange("term").sortWithinPartitions("term")


# --- search -----------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _stems(terms):
    return terms.map(stemmed_form)


def query_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """query_id, term, times: a token given twice counts twice."""
    term = F.lower("term")
    each = queries.select("query_id", F.explode(query_tokens(F.col("q"))).alias("term"))
    each = each.select("query_id", (_stems(strip_marks(term)) if stemmed else term).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count("*").alias("times"))


class Weights:
    """A block of queries: their terms, and each term's weights in the queries that hold it."""

    def __init__(self, rows: list, n_docs: int):
        self.ids = sorted({r.query_id for r in rows})
        names = sorted({r.term for r in rows})
        place, at = {x: i for i, x in enumerate(self.ids)}, {x: i for i, x in enumerate(names)}
        self.terms = pa.array(names, pa.string())
        raw = [math.log((n_docs - r.n + 0.5) / (r.n + 0.5)) for r in rows]
        term = np.array([at[r.term] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        self.begin = np.searchsorted(term[order], np.arange(len(names) + 1))
        self.query = np.array([place[r.query_id] for r in rows], np.int64)[order]
        self.weight = np.array([(x if x > 0 else FLOOR) * r.times * (K1 + 1) for x, r in zip(raw, rows, strict=True)])[order]

    def matrix(self, terms: np.ndarray) -> np.ndarray:
        """The weights of some terms, a row each, in all queries."""
        n = self.begin[terms + 1] - self.begin[terms]
        at = np.arange(n.sum()) + np.repeat(self.begin[terms] - np.cumsum(n) + n, n)
        out = np.zeros((len(terms), len(self.ids)))
        out[np.repeat(np.arange(len(terms)), n), self.query[at]] = self.weight[at]
        return out


def by_postings(queries: DataFrame, terms: DataFrame, known: DataFrame, shards: postings_.Shards, k: int, stemmed: bool) -> DataFrame | None:
    """The search by postings, or None where a scan of all documents is no dearer."""
    asked = query_terms(queries, stemmed).limit(postings_.QUERIES * postings_.TERMS).collect()
    names = sorted({r.term for r in asked})
    if len({r.query_id for r in asked}) > postings_.QUERIES or len(names) > postings_.TERMS or not names:
        return None
    n = {r.term: r.n for r in known.filter(postings_.any_of("term", names)).collect()}
    if not n or sum(n.values()) > postings_.SHARE * shards.postings:
        return None
    weights = Weights([Row(query_id=r.query_id, term=r.term, times=r.times, n=n[r.term]) for r in asked if r.term in n], shards.docs)
    return postings_.search_shards(weights, shards, terms, k, shards.words / shards.docs or 1.0, K1, B, queries.schema["query_id"].dataType.simpleString())


def search(queries: DataFrame, terms: DataFrame, known: DataFrame, k: int, stemmed: bool = True, shards: postings_.Shards | None = None) -> DataFrame:
    """query_id, path, score, rank of the k best documents of each query (query_id, q), among those that hold a term of it.

    terms: a forward table; known: its vocabulary; shards: its postings, if there are any."""
    if shards is not None and (found := by_postings(queries, terms, known, shards, k, stemmed)) is not None:
        return ranked(found, k)
    spark = terms.sparkSession
    n_docs, average = (shards.docs, shards.words / (shards.docs or 1)) if shards is not None else terms.agg(F.count("*"), F.avg("dl")).first()
    average = average or 1.0
    asked = query_terms(queries, stemmed).join(known, "term")
    id_kind, kind = queries.schema["query_id"].dataType.simpleString(), terms.schema["path"].dataType.simpleString()
    scans = max(1, -(-queries.select("query_id").distinct().count() // (QUERY_BLOCK * SCAN_BLOCKS)))
    out = None
    for scan in range(scans):
        own = asked if scans == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == scan)
        rows = sorted(own.collect(), key=lambda r: (r.query_id, r.term))
        block = {x: i // QUERY_BLOCK for i, x in enumerate(dict.fromkeys(r.query_id for r in rows))}
        parts: list[list] = [[] for _ in range(max(block.values(), default=-1) + 1)]
        for r in rows:
            parts[block[r.query_id]].append(r)
        sent = spark.sparkContext.broadcast([Weights(part, n_docs) for part in parts])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = [(weights, Best(len(weights.ids), k, highest=True)) for weights in sent.value]
            for batch in batches if blocks else ():
                for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                    for weights, best in blocks:
                        best.add(*_scores(batch.slice(a, ROWS_AT_ONCE), weights, average))
            for weights, best in blocks:
                if found := best.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(weights.ids).take(pa.array(found[0])), found[2], pa.array(found[1])], ["query_id", "path", "score"])

        got = terms.select("path", "dl", "terms", "tf_title", "tf_body").mapInArrow(run, f"query_id {id_kind}, path {kind}, score double")
        out = got if out is None else out.unionByName(got)
    return ranked(out, k)


def _scores(part: pa.RecordBatch, weights: Weights, average: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(queries, documents) scores, paths, and which documents hold a term of which query."""
    size = part.column(2).value_lengths().to_numpy()
    code = pc.index_in(part.column(2).flatten(), weights.terms).fill_null(-1).to_numpy()
    own = np.flatnonzero(code >= 0)
    row, code = np.repeat(np.arange(len(size)), size)[own], code[own]
    f = TITLE_WEIGHT * part.column(3).flatten().to_numpy()[own] + BODY_WEIGHT * part.column(4).flatten().to_numpy()[own]
    length = part.column(1).to_numpy()[row]
    used, code = np.unique(code, return_inverse=True)
    x = np.zeros((part.num_rows, len(used)))
    x[row, code] = f / (f + K1 * (1 - B + B * length / average))
    scores = (x @ weights.matrix(used)).T
    return scores, part.column(0), scores > 0


def ranked(scores: DataFrame, k: int, ascending: bool = False, digits: int = 9) -> DataFrame:
    """query_id, path, score, rank of the best k of each query, ties to the smaller path; scores are compared at `digits`
    decimals, so that sums in another order rank alike."""
    key = F.round("score", digits)
    order = Window.partitionBy("query_id").orderBy(key.asc() if ascending else key.desc(), "path")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "path", "score", "rank")
