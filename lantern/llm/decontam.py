"""Benchmark decontamination by a distributed positional inverted index.

The corpus is cut into segments of whole documents. A segment stores its terms (64-bit word hashes) with the positions of
each, sorted by (term, position), and its documents' lower-cased bytes, and is written as one row of a Parquet table in the
shared folder. A benchmark window is looked up in every segment: its term with the fewest postings there comes first, and
the position lists of the next rarer terms, shifted by their offsets in the window, are intersected with what is left, for
all windows of a block at once. What remains after all terms are the places of the phrase, which are compared with its words
byte by byte. `proximity_matches` intersects the lists with a tolerance; its terms are known by their hashes alone.

Benchmark items travel in blocks of about BLOCK_WORDS words, whose number follows a count; every block is held against every
segment. With more than one, blocks are taken one after the other, and what each finds is written.

Defined results: null or word-less text has no words, hits or items; texts of any length are indexed whole, a longer one than
a segment as a segment of its own; a null item_id counts as the empty string; items that share an id are one item; repeated
documents are separate rows with equal results; empty tables give no rows or no hits; other columns are ignored or, where
rows are kept, returned as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, columns_of, content_key, prepare, ragged, row_of, saved, text_bytes, word_hashes, words

WINDOW = 10
#: Words of a segment of the index, but for a longer document.
SEGMENT_WORDS = 1 << 19
#: Words of a block of benchmark items.
BLOCK_WORDS = 1 << 21
#: Candidate places that are intersected at once.
AT_ONCE = 1 << 20
#: Places that are compared with a window's words at once.
COMPARED = 1 << 17

#: How segments are written: a row has megabytes, so the writer looks at its size after each row, not after a hundred, and a
#: reader gets a few of them at once, however well they are compressed.
WRITE = {"parquet.block.size": str(16 << 20), "parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


# --- index ------------------------------------------------------------------------------------------------------


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments: ids, first (word at which each document begins, and the end), terms, ends, postings (little-endian), low (the
    documents' bytes), offs (byte at which each begins, and the end), seg (a number of its own)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, texts, sizes, n = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable").astype("<i4")
            terms, size = np.unique(h, return_counts=True)
            column = pa.concat_arrays(ids)
            values = [
                pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column),
                pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), pa.array(first, pa.int64())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (terms.astype("<u8"), np.cumsum(size).astype("<i4"), order, np.concatenate(texts))),
                pa.array([np.append(0, np.cumsum(np.concatenate(sizes)))], pa.list_(pa.int64())),
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(values, ["ids", "first", "terms", "ends", "postings", "low", "offs", "seg"])

        for batch in batches:
            for part in blocks(batch, "text"):
                data, offs = text_bytes(part.column(1))
                low = LOWER[data]
                s, e, at = words(low, offs, ALNUM)
                if n and n + len(s) > segment_words:
                    yield flush()
                    ids, hashes, counts, texts, sizes, n = [], [], [], [], [], 0
                ids.append(part.column(0))
                texts.append(low)
                sizes.append(np.diff(offs))
                hashes.append(word_hashes(low, s, e))
                counts.append(np.diff(at))
                n += len(s)
        if ids:
            yield flush()

    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = small.schema["id"].dataType.simpleString()
    return small.mapInArrow(run, f"ids array<{kind}>, first array<long>, terms binary, ends binary, postings binary, low binary, offs array<long>, seg long")


def stored_index(docs: DataFrame, id_col: str, text_col: str, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    return saved(build_index(docs, id_col, text_col, segment_words), "index", **WRITE)


class Segment:
    def __init__(self, row: pa.RecordBatch, at: int):
        self.ids = row.column(0)[at].values
        self.first = row.column(1)[at].values.to_numpy()
        self.terms = np.frombuffer(row.column(2)[at].as_buffer(), "<u8")
        self.ends = np.frombuffer(row.column(3)[at].as_buffer(), "<i4").astype(np.int64)
        postings = np.frombuffer(row.column(4)[at].as_buffer(), "<i4")
        self.counts = np.diff(self.ends, prepend=0)
        #: (term's number, position), ascending
        self.lists = np.repeat(np.arange(len(self.terms)) << 32, self.counts) + postings
        self.low = np.frombuffer(row.column(5)[at].as_buffer(), np.uint8)
        self.offs = row.column(6)[at].values.to_numpy()
        self.seg = row.column(7)[at].as_py()

    def numbers(self, vocabulary: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[at] == vocabulary, at, -1)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def spelled(self, place: np.ndarray, words_: np.ndarray, items: Items) -> np.ndarray:
        """Whether the words at the places are, byte by byte, those of the rows of words_ (numbers in the items' vocabulary)."""
        out = np.ones(len(place), bool)
        docs, own = np.unique(self.document(place), return_inverse=True)
        size = self.offs[docs + 1] - self.offs[docs]
        data = np.concatenate([self.low[self.offs[d] : self.offs[d + 1]] for d in docs.tolist()] or [self.low[:0]])
        s, e, first = words(data, np.append(0, np.cumsum(size)), ALNUM)
        at = place - self.first[docs][own] + first[:-1][own]
        for a in range(0, len(place), COMPARED):
            for j in range(words_.shape[1]):
                x, y = at[a : a + COMPARED] + j, words_[a : a + COMPARED, j]
                n = e[x] - s[x]
                same = n == items.size[y]
                some = np.flatnonzero(same)
                step = ragged(n[some])
                differ = data[np.repeat(s[x[some]], n[some]) + step] != items.letters[np.repeat(items.begin[y[some]], n[some]) + step]
                same[some] = np.bincount(np.repeat(np.arange(len(some)), n[some]), weights=differ, minlength=len(some)) == 0
                out[a : a + COMPARED] &= same
        return out


# --- benchmark items --------------------------------------------------------------------------------------------


class Items:
    """A block of items: their vocabulary, distinct windows by their length, and which items hold each."""

    def __init__(self, names: list[str], texts: list[list[bytes]], window: int = WINDOW):
        self.names = sorted(set(names))
        number = {x: i for i, x in enumerate(self.names)}
        vocabulary = sorted({w for t in texts for w in t})
        of = {w: i for i, w in enumerate(vocabulary)}
        self.letters = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.size = np.array([len(w) for w in vocabulary], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.vocabulary = word_hashes(self.letters, self.begin, self.begin + self.size)
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, t in zip(names, texts, strict=True):
            if t:
                k = min(window, len(t))
                by_length.setdefault(k, []).append((np.lib.stride_tricks.sliding_window_view(np.array([of[w] for w in t]), k), number[name]))
        self.windows = {}
        for k, parts in by_length.items():
            distinct, inverse = np.unique(np.concatenate([x for x, _ in parts]), axis=0, return_inverse=True)
            owner = np.concatenate([np.full(len(x), i) for x, i in parts])
            pairs = np.unique(np.stack([inverse.ravel(), owner], axis=1), axis=0)
            begin = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
            self.windows[k] = (distinct, begin, pairs[:, 1])


def item_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Items]]:
    """The items of a test set as blocks of bounded size, one at a time; their number follows the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offs = text_bytes(part.column(1))
                low = LOWER[data]
                s, e, at = words(low, offs, ALNUM)
                raw = low.tobytes()
                each = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                joined = [b" ".join(each[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(joined, pa.binary()), pa.array(np.diff(at), pa.int64())], ["name", "w", "n"])

    small = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("name"), benchmark[text_col].cast("string").alias("text"))
    rows = saved(small.mapInArrow(run, "name string, w binary, n long").filter("n > 0").distinct(), "items")
    count = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // block_words))

    def each() -> Iterator[Items]:
        for k in range(count):
            own = sorted((r.name, bytes(r.w)) for r in rows.filter(F.pmod(F.xxhash64("name", "w"), F.lit(count)) == k).collect())
            yield Items([name for name, _ in own], [w.split(b" ") for _, w in own], window)

    return count, each()


# --- search -----------------------------------------------------------------------------------------------------


def phrase_places(seg: Segment, items: Items, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of all exact occurrences of the windows of k words."""
    distinct = items.windows[k][0]
    number = seg.numbers(items.vocabulary)
    terms = number[distinct]
    alive = np.flatnonzero((terms >= 0).all(axis=1))
    found_w, found_p = [], []
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = terms[alive]
    counts = seg.counts[terms]
    order = np.argsort(counts, axis=1, kind="stable")
    lead = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
    many = seg.counts[lead]
    cuts, total = [0], np.cumsum(many)
    while cuts[-1] < len(many):
        base = total[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, base + AT_ONCE, "right"))))
    mask = (1 << 32) - 1
    for a, b in zip(cuts, cuts[1:], strict=False):
        w = np.repeat(np.arange(a, b), many[a:b])
        start = seg.ends[lead[w]] - seg.counts[lead[w]]
        place = (seg.lists[start + ragged(many[a:b])] & mask) - order[w, 0]
        for j in range(1, k):
            off = order[w, j]
            want = (terms[w, off].astype(np.int64) << 32) + place + off
            ok = place >= 0
            at = np.minimum(np.searchsorted(seg.lists, want), len(seg.lists) - 1)
            ok &= seg.lists[at] == want
            w, place = w[ok], place[ok]
            if not len(w):
                break
        doc = seg.document(place)
        inside = (place >= 0) & (place + k <= seg.first[np.minimum(doc + 1, len(seg.first) - 1)])
        found_w.append(alive[w[inside]])
        found_p.append(place[inside])
    w, place = np.concatenate(found_w), np.concatenate(found_p)
    same = seg.spelled(place, distinct[w], items)
    return w[same], place[same]


def near_places(seg: Segment, items: Items, k: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where each of its terms stands at most `within` words away in the same document."""
    distinct = items.windows[k][0]
    terms = seg.numbers(items.vocabulary)[distinct]
    alive = np.flatnonzero((terms >= 0).all(axis=1))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = terms[alive]
    order = np.argsort(seg.counts[terms], axis=1, kind="stable")
    terms = np.take_along_axis(terms, order, 1)
    found_w, found_p = [], []
    for row in range(len(alive)):
        lead = terms[row, 0]
        place = seg.lists[seg.ends[lead] - seg.counts[lead] : seg.ends[lead]] & ((1 << 32) - 1)
        doc = seg.document(place)
        lo, hi = np.maximum(place - within, seg.first[doc]), np.minimum(place + within, seg.first[doc + 1] - 1)
        for t in terms[row, 1:]:
            at = np.searchsorted(seg.lists, (int(t) << 32) + lo)
            ok = (at < len(seg.lists)) & (seg.lists[np.minimum(at, len(seg.lists) - 1)] <= (int(t) << 32) + hi)
            place, lo, hi = place[ok], lo[ok], hi[ok]
            if not len(place):
                break
        found_w.append(np.full(len(place), alive[row]))
        found_p.append(place)
    return np.concatenate(found_w), np.concatenate(found_p)


def _owners(seg: Segment, items: Items, k: int, w: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Distinct (document, item) rows of the places found."""
    _, begin, owner = items.windows[k]
    pairs = np.unique(np.stack([seg.document(place), w], axis=1), axis=0)
    n = begin[pairs[:, 1] + 1] - begin[pairs[:, 1]]
    return np.unique(np.stack([np.repeat(pairs[:, 0], n), owner[np.repeat(begin[pairs[:, 1]], n) + ragged(n)]], axis=1), axis=0)


def _hits(index: DataFrame, items: Broadcast) -> DataFrame:
    """id, seg, ord, n_words, hit (words covered, ascending), items (names, sorted), for every document."""
    kind = index.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        names = pa.array(own.names, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                seg = Segment(batch, row)
                n_docs, n_words = len(seg.ids), int(seg.first[-1])
                cover = np.zeros(n_words + 1, np.int64)
                pairs = [np.zeros((0, 2), np.int64)]
                for k in own.windows:
                    w, place = phrase_places(seg, own, k)
                    if len(w):
                        np.add.at(cover, place, 1)
                        np.add.at(cover, place + k, -1)
                        pairs.append(_owners(seg, own, k, w, place))
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                doc = seg.document(hit)
                pair = np.unique(np.concatenate(pairs), axis=0)
                out = [
                    seg.ids,
                    pa.array(np.diff(seg.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), pa.array(hit - seg.first[doc], pa.int32())),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[:, 0], np.arange(n_docs + 1)), pa.int32()), names.take(pa.array(pair[:, 1]))),
                    pa.array(np.arange(n_docs), pa.int64()),
                    pa.array(np.full(n_docs, seg.seg), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(out, ["id", "n_words", "hit", "items", "ord", "seg"])

    return index.select(*_SEGMENT).mapInArrow(run, f"id {kind.simpleString()}, n_words long, hit array<int>, items array<string>, ord long, seg long")


_SEGMENT = ["ids", "first", "terms", "ends", "postings", "low", "offs", "seg"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, segment_words: int = SEGMENT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids, sorted)."""
    sc = docs.sparkSession.sparkContext
    prepare(docs.sparkSession)
    index = stored_index(docs, id_col, text_col, segment_words)
    count, parts = item_blocks(benchmark, window, block_words=block_words)
    hits = None
    for items in parts:
        sent = sc.broadcast(items)
        found = _hits(index, sent)
        if count > 1:  # the next block comes when this one is done; after the first, documents without a hit are left out
            found = saved(found if hits is None else found.filter(F.size("hit") > 0), "hits")
            sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    if count > 1:
        hits = hits.groupBy("seg", "ord").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return hits.select(
        F.col("id").alias(id_col), "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), "items",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    keys = content_key(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    found = decontaminate(docs.select(F.struct(*keys).alias("key"), docs[text_col].alias("text")), benchmark, "key", "text", window)
    # written before the join, which then deals the documents by itself, so that a frequent text's rows can be split
    leaked = saved(found.filter("contaminated").select("key.k1", "key.k2").distinct(), "leaked")
    if leaked.isEmpty():
        return docs
    whole = docs.select(*keys, row_of(docs))
    return whole.join(leaked, ["k1", "k2"], "left_anti").select(*columns_of(F.col("row"), docs.columns))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = 15, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id for documents where all terms of one of the item's windows stand near its rarest term.

    Near is at most `within` words away in the same document; the rarest term is that with the fewest occurrences in the
    document's segment of the index, the first of the window on ties. Null and empty texts match nothing; rows that repeat an id
    are one; an empty table on either side gives no rows; other columns are ignored."""
    prepare(docs.sparkSession)
    index = stored_index(docs, id_col, text_col)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    count, parts = item_blocks(benchmark, window, block_words=block_words)
    out = None
    for items in parts:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    seg = Segment(batch, row)
                    for k in sent.value.windows:
                        pair = _owners(seg, sent.value, k, *near_places(seg, sent.value, k, within))
                        yield pa.RecordBatch.from_arrays([seg.ids.take(pa.array(pair[:, 0])), pa.array(sent.value.names, pa.string()).take(pa.array(pair[:, 1]))], [id_col, "item_id"])

        got = index.select(*_SEGMENT).mapInArrow(run, f"{id_col} {kind}, item_id string")
        if count > 1:
            got = saved(got, "near")
            sent.destroy()
        out = got if out is None else out.unionByName(got)
    return out.distinct()
