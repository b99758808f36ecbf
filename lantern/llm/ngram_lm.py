"""Scores of texts by a weighted backoff automaton.

Tokens are words and one end a text. The model interpolates n-gram counts by hierarchical Dirichlet smoothing:

    p(w | h) = (c(h w) + S p(w | h')) / (c(h) + S),      p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

where h' is h without its first word, S a strength for the order, and the last formula leaves 0.1 for unknown words. As an
automaton: a state is a context that was seen; a seen n-gram h w is an arc of the state h with the weight log p(w | h), which
leads to the longest seen suffix of h w; a failure arc of h leads to h' with the weight log S / (c(h) + S), which is all
that p(w | h) has for a word not seen after h. A text begins in the state of its first words' context. One pass from left to
right carries the state, follows failure arcs until a state has an arc for the token, and adds up the weights.

The automaton of a whole corpus is too large for a task or a broadcast, but a block of documents passes only through states and
arcs of its own n-grams. So the distinct n-grams of a block, with the block's own counts, are dealt by hash; where they
meet, counts are added up; and what comes back to a block are the totals of n-grams that other blocks hold as well. Of those
that no other block holds the block's own count is the total, which moves nothing. Each block then makes its part of the
automaton and passes its texts through it. An n-gram is known by 64 bits of hash, of words likewise: of 10^9 different words
the chance that any two share theirs is 0.03.

Defined results: a null text is empty, and has its end alone; a null id counts as the empty text where documents are
held out; repeated rows are separate texts, each learned from; texts of any length are scored whole; with nothing to learn
from, N and V are 0 and every text scores log10 1 = 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coded import CODED_BYTES, Coder, block_name, planes, unplaned
from .common import SPACED, blocks as slices_of
from .common import mix, prepare, saved, text_bytes

#: Words of an n-gram, at most.
ORDER = 3
#: Strength of the shorter context, by the words of an n-gram; chosen on documents that may be learned from.
STRENGTH = {2: 4000.0, 3: 20.0, 4: 10.0, 5: 10.0}
#: What each count, and one unknown word, has beside it in the shortest context.
ADDED = 0.1
#: N-grams of one order that meet in a task, about.
MEET_ROWS = 1 << 21

#: Hash of the end of a text. No word has it but by the chance that any two words have one hash.
_END = np.uint64(0x9AE16A3B2F90404F)
_BEGIN = np.uint64(0xC949D7C7509E6557)
_ODD = np.uint64(0x9DDFEA08EB382D69)


# --- n-grams of a block -----------------------------------------------------------------------------------------


@dataclass
class Texts:
    """Hashes of the tokens of some texts, their ends included, and how many each has."""

    hashes: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.last = np.cumsum(self.counts) - 1
        self.first = self.last - self.counts + 1

    def grams(self, order: int) -> np.ndarray:
        """The hash of the n-gram that ends with each token; before a text's first token stand as many begins as it takes."""
        h = self.hashes
        for _ in range(order - 1):
            # the n-gram one shorter that ends before the token, continued by the token
            before = np.empty_like(h)
            before[1:] = h[:-1]
            before[self.first] = _BEGIN
            h = mix(before * _ODD + self.hashes)
        return h


def texts_of(hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Texts:
    """Of the tokens of rows without ends."""
    place = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
    out = np.full(len(codes) + len(counts), _END, np.uint64)
    out[place] = hashes[codes]
    return Texts(out, counts + 1)


def _split(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of hashes begins in sorted keys, and the end of the last."""
    edges = [np.uint64((i << 64) // parts) for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


# --- the automaton ----------------------------------------------------------------------------------------------


class Automaton:
    """States and arcs that some texts pass through.

    totals: for each order the trained counts of the distinct n-grams; places: for each order which of them ends with each
    token."""

    def __init__(self, texts: Texts, places: list[np.ndarray], totals: list[np.ndarray], trained: int, tokens: int, kinds: int, strength: dict[int, float] | None = None):
        strength = strength or STRENGTH
        self.texts, self.places = texts, places
        self.order = len(totals)
        self.starts = trained > 0
        low = (totals[0] + ADDED) / (tokens + ADDED * (kinds + 1))
        p = low
        self.known = [totals[0] > 0]
        #: weight of each arc, and by token that of the failure arc from the context before it
        self.arc, self.fail = [np.log10(low)], [np.zeros(len(texts.hashes))]
        for n in range(2, self.order + 1):
            # a context's count is that of the n-gram one shorter which ends before the token; of begins alone, the texts'
            context = np.empty(len(texts.hashes))
            context[1:] = totals[n - 2][places[n - 2]][:-1]
            context[texts.first] = trained
            s = strength[n]
            at = np.empty(len(totals[n - 1]), np.int64)
            at[places[n - 1]] = np.arange(len(places[n - 1]))
            p = (totals[n - 1] + s * p[places[n - 2][at]]) / (context[at] + s)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(s / (context + s)))
            self.known.append(totals[n - 1] > 0)

    def scores(self) -> np.ndarray:
        """log10 of the probability of each text, by one pass over its tokens.

        The state before a token is carried as the number of words of its context; it is found for all tokens of all texts at
        once, as the longest n-gram known at a token decides which state the pass is in after it."""
        matched = np.ones(len(self.texts.hashes), np.int64)
        for n in range(2, self.order + 1):
            matched[self.known[n - 1][self.places[n - 1]]] = n
        known = self.known[0][self.places[0]]
        after = np.where(known | (matched > 1), np.minimum(matched, self.order - 1), 0)
        state = np.empty_like(after)
        state[1:] = after[:-1]
        state[self.texts.first] = self.order - 1 if self.starts else 0
        weight = np.choose(matched - 1, [a[x] for a, x in zip(self.arc, self.places, strict=True)])
        for n in range(2, self.order + 1):
            # the failure arc from a context of n - 1 words is followed where the state is at least that long and has no arc
            weight += np.where((state >= n - 1) & (matched < n), self.fail[n - 1], 0)
        return np.add.reduceat(weight, self.texts.first) if len(weight) else np.zeros(0)


# --- Spark ------------------------------------------------------------------------------------------------------


def coded_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column, coded_bytes: int = CODED_BYTES) -> DataFrame:
    """block, ids, held, counts (tokens of each text without its end), words (hashes of the distinct words), n, tokens (codes)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), held_out.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, own = Coder(SPACED, keep_words=False), []

        def flush() -> pa.RecordBatch:
            words, codes, counts, _ = coder.merged()
            ids, held = (pa.concat_arrays([x.column(i) for x in own]) for i in (0, 2))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out = [pa.array([block_name()]), one(ids), one(held), one(pa.array(counts)), pa.array([len(words)], pa.int64()), pa.array([planes(np.diff(words, prepend=np.uint64(0)))], pa.binary()), pa.array([len(codes)], pa.int64()), pa.array([planes(codes)], pa.binary())]
            coder.clear()
            own.clear()
            return pa.RecordBatch.from_arrays(out, ["block", "ids", "held", "counts", "kinds", "words", "n", "tokens"])

        for batch in batches:
            for part in slices_of(batch, "text"):
                own.append(part)
                coder.add(*text_bytes(part.column(1)))
                if coder.size >= coded_bytes:
                    yield flush()
        if own:
            yield flush()

    return saved(small.mapInArrow(run, f"block string, ids array<{kind}>, held array<boolean>, counts array<long>, kinds long, words binary, n long, tokens binary"), "coded")


def _open(row: dict) -> tuple[Texts, np.ndarray]:
    """The texts of a block, and which tokens are learned from."""
    counts = np.asarray(row["counts"], np.int64)
    texts = texts_of(np.cumsum(unplaned(row["words"], row["kinds"]), dtype=np.uint64), unplaned(row["tokens"], row["n"]).astype(np.int64), counts)
    return texts, np.repeat(~np.asarray(row["held"], bool), counts + 1)


def met_counts(coded: DataFrame, order: int, parts: int) -> DataFrame:
    """name (the block), n (words of the n-gram), part, shared (bits: which of the block's n-grams of the part other blocks hold as
    well), total (their counts), kinds (in one row of each part: its trained distinct n-grams)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, learned = _open(row)
                for n in range(1, order + 1):
                    keys, place = np.unique(texts.grams(n), return_inverse=True)
                    count = np.bincount(place[learned], minlength=len(keys))
                    cut = _split(keys, parts)
                    out = [(row["block"], n, i, b - a, planes(np.diff(keys[a:b], prepend=keys[a : a + 1])), int(keys[a]).to_bytes(8, "little"), planes(count[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["name", "n", "part", "rows", "steps", "first", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size = np.array([r["rows"] for r in rows])
        keys = np.concatenate([np.cumsum(unplaned(r["steps"], r["rows"]), dtype=np.uint64) + np.uint64(int.from_bytes(r["first"], "little")) for r in rows])
        count = np.concatenate([unplaned(r["counts"], r["rows"]) for r in rows]).astype(np.int64)
        sort = np.argsort(keys, kind="stable")
        head = np.flatnonzero(np.append(True, keys[sort][1:] != keys[sort][:-1]))
        total = np.add.reduceat(count[sort], head)
        held = np.diff(np.append(head, len(sort)))
        each, shared = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        each[sort], shared[sort] = np.repeat(total, held), np.repeat(held > 1, held)
        out, at = [], 0
        for r, n in zip(rows, size, strict=True):
            own = shared[at : at + n]
            out.append((r["name"], r["n"], r["part"], np.packbits(own).tobytes(), planes(each[at : at + n][own]), 0 if at else int((total > 0).sum())))
            at += n
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["name", "n", "part", "shared", "total", "kinds"])

    rows = coded.mapInArrow(deal, "name string, n int, part int, rows long, steps binary, first binary, counts binary")
    met = rows.groupBy("n", "part").applyInArrow(meet, "name string, n int, part int, shared binary, total binary, kinds long")
    return saved(met, "met")


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: dict[int, float] | None = None, meet_rows: int = MEET_ROWS, coded_bytes: int = CODED_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (by the shortest contexts alone), score: log10 probabilities.

    held_out: which documents are not learned from."""
    kind = docs.schema[id_col].dataType.simpleString()
    coded = coded_blocks(docs, id_col, text_col, held_out, coded_bytes)
    ends = F.size("ids")
    learned = F.expr("aggregate(arrays_zip(held, counts), 0L, (s, x) -> s + if(x.held, 0L, x.counts + 1))")
    trained, tokens, most = coded.agg(F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum(learned), F.sum(F.col("n") + ends)).first()
    trained, tokens = trained or 0, tokens or 0
    parts = max(1, -(-(most or 0) // meet_rows))
    met = met_counts(coded, order, parts)
    kinds = met.filter("n = 1").agg(F.sum("kinds")).first()[0] or 0

    def score(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"id": block.column("ids").combine_chunks().flatten() if block.num_rows else None}
        if not block.num_rows:
            return None
        row = {c: block.column(c)[0].as_py() for c in ("held", "counts", "kinds", "words", "n", "tokens")}
        texts, learned_ = _open(row)
        said = {(r["n"], r["part"]): (r["shared"], r["total"]) for r in replies.to_pylist()}
        places, totals = [], []
        for n in range(1, order + 1):
            keys, place = np.unique(texts.grams(n), return_inverse=True)
            total = np.bincount(place[learned_], minlength=len(keys))
            cut = _split(keys, parts)
            for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if b > a:
                    shared, values = said[n, i]
                    own = np.flatnonzero(np.unpackbits(np.frombuffer(shared, np.uint8), count=b - a))
                    total[a + own] = unplaned(values, len(own)).astype(np.int64)
            places.append(place)
            totals.append(total)
        automaton = Automaton(texts, places, totals, trained, tokens, kinds, strength)
        base = automaton.arc[0][places[0]]
        known = automaton.known[0][places[0]]
        size = len(texts.counts)
        return pa.table({
            "id": out["id"], "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(texts.counts, pa.int64()), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), texts.first), pa.int64()),
            "train_tokens": pa.array(np.full(size, tokens), pa.int64()), "base_score": pa.array(np.add.reduceat(base, texts.first) + 0.0), "score": pa.array(automaton.scores() + 0.0),
        })

    scored = coded.groupBy("block").cogroup(met.groupBy("name")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
