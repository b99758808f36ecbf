"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words are ranked by their counts, separately in each language; a word rarer than the least count is in no frequent phrase and
parts texts as punctuation does. Each n-gram belongs to its rarest word, its pivot. So every occurrence of a word w goes to
w's partition with the fragment that n-grams owned by w can use: up to three words to its left that are more frequent than w
(a word equal to w there would be the first one, which owns the n-gram), and up to three to its right that are as frequent
or more, as ranks, blanks after the first rarer word. A partition mines its fragments alone, level by level: only a frequent
n-gram is extended, first the pair at the pivot. It emits only the n-grams that its pivots own, so each n-gram comes from
one partition, with its whole count.

A pivot with more occurrences than a partition should hold is dealt to several by block, without pruning, and their counts
are added up. That adds few rows, as words that are no rarer than a very frequent one are few.

Ranks reach the texts without a broadcast: the distinct words of a block of documents meet the vocabulary, and their
ranks come back to the block. Blocks, vocabulary and n-grams are tables in the shared folder.

Defined results: a null language is `und`, a null text is empty; repeated rows count as often as they are there; texts of any
length are read whole; of equal scores the larger count, then the smaller phrase in the order of UTF-8 bytes comes
first; an empty table gives an empty result; other columns are ignored, whatever their names. Counts are longs; products of them
are decimals, which are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coded import BREAKS, PIECE_WORDS, Coder, block_name, planes, unplaned
from .common import blocks as slices_of
from .common import list_array, mix, prepare, saved, scratch_path, text_bytes

#: Longest phrase.
MOST = 4
#: Least count of a phrase.
LEAST = 30
#: Rows of the report a language.
TOP = 2000
#: Fragments of a partition, about; a pivot with more occurrences is dealt to several.
PARTITION_ROWS = 1 << 19
#: Bytes of text of a block, about.
CODED_BYTES = 8 << 20
#: Shares by which the first rows of a language are found before they meet.
SHARES = 64


# --- words ------------------------------------------------------------------------------------------------------


def coded_blocks(docs: DataFrame, lang_col: str, text_col: str, coded_bytes: int = CODED_BYTES) -> DataFrame:
    """block, n (tokens), tokens (codes from 1, a 0 before each piece), and of each distinct word its lang, text and count."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, langs = Coder(PIECE_WORDS, BREAKS), []

        def flush() -> pa.RecordBatch:
            _, codes, _, at = coder.merged()
            start = coder.piece_starts()
            place = np.arange(len(codes)) + np.cumsum(start)
            tokens = np.zeros(len(codes) + int(start.sum()), np.int64)
            tokens[place] = codes + 1
            own = pa.concat_arrays(langs).take(pa.array(coder.rows_of(at)))
            whole = np.array([0, len(at)])
            columns = [pa.array([block_name()]), pa.array([len(tokens)], pa.int64()), pa.array([planes(tokens)], pa.binary()), list_array(own, whole), list_array(coder.words_of(at), whole), list_array(pa.array(np.bincount(codes, minlength=len(at))), whole)]
            coder.clear()
            langs.clear()
            return pa.RecordBatch.from_arrays(columns, ["block", "n", "tokens", "langs", "words", "counts"])

        for batch in batches:
            for part in slices_of(batch, "text"):
                lang = part.column(0)
                salt = np.array([hash_of(x) for x in lang.to_pylist()], np.uint64)
                langs.append(lang)
                coder.add(*text_bytes(part.column(1)), salt)
                if coder.size >= coded_bytes:
                    yield flush()
        if coder.parts:
            yield flush()

    seen: dict[str, int] = {}

    def hash_of(lang: str) -> int:
        if lang not in seen:
            import hashlib

            if len(seen) > 10_000:
                seen.clear()
            seen[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        return seen[lang]

    small = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    return saved(small.mapInArrow(run, "block string, n long, tokens binary, langs array<string>, words array<string>, counts array<long>"), "coded")


def ranked_words(words: DataFrame, least: int) -> DataFrame:
    """lang, word, c, id: the words with at least that count, numbered from 1 by falling count."""
    spark = words.sparkSession
    frequent = words.groupBy("lang", "word").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    ordered = frequent.repartitionByRange(F.desc("c"), "lang", "word").sortWithinPartitions(F.desc("c"), "lang", "word")
    ordered = saved(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    # a number is a place within a task and what the tasks before it have: one row a task
    before, total = [], 0
    for task, rows in sorted(ordered.groupBy(F.shiftright("place", 33).alias("task")).count().collect()):
        before.append((task, total))
        total += rows
    offsets = spark.createDataFrame(before, "task long, before long")
    numbered = ordered.join(F.broadcast(offsets), F.shiftright("place", 33) == F.col("task"))
    return saved(numbered.select("lang", "word", "c", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).cast("int").alias("id")), "ranked")


# --- fragments --------------------------------------------------------------------------------------------------


def fragments(ids: np.ndarray, reach: int = MOST - 1) -> np.ndarray:
    """Of each token that has a number and a neighbour to use: its number, the words to its left from the nearest on, and
    those to its right; 0 is a blank. Smaller numbers are more frequent words, 0 parts pieces."""
    n = len(ids)
    out = np.zeros((1 + 2 * reach, n), np.uint32)
    out[0] = ids
    pad = np.concatenate([np.zeros(reach, ids.dtype), ids, np.zeros(reach, ids.dtype)])
    for side, (sign, most) in enumerate(((-1, ids - 1), (1, ids))):
        open_ = ids > 0
        for d in range(1, reach + 1):
            other = pad[reach + sign * d : reach + sign * d + n]
            open_ = open_ & (other > 0) & (other <= most)
            out[1 + side * reach + d - 1] = np.where(open_, other, 0)
    used = (out[1] > 0) | (out[1 + reach] > 0)
    return out[:, used]


def mined(rows: np.ndarray, least: int, reach: int = MOST - 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, count) of the n-grams that the fragments' pivots own, longer ones as far as shorter ones are frequent.

    A fragment gives the n-grams of `left` words before the pivot and `right` after it. Where its pivot stands first in an
    n-gram is fixed by the n-gram, so n-grams of other shapes differ."""
    width = 1 + 2 * reach
    # per shape: for each fragment the number of its frequent n-gram, or -1; and the n-grams
    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {(0, 0): (rows[0].astype(np.int64), np.zeros((0, 0)))}
    out = []
    for size in range(2, reach + 2):
        fresh = {}
        for left in range(size):
            right = size - 1 - left
            shape, added = ((left, right - 1), rows[1 + reach + right - 1]) if right else ((left - 1, right), rows[1 + left - 1])
            if shape not in known:
                continue
            before, grams = known[shape]
            own = np.flatnonzero((before >= 0) & (added > 0))
            code, inverse, count = np.unique(before[own] << 32 | added[own].astype(np.int64), return_inverse=True, return_counts=True)
            keep = count >= least
            if not keep.any():
                continue
            number = np.full(len(code), -1)
            number[keep] = np.arange(keep.sum())
            at = np.full(rows.shape[1], -1)
            at[own] = number[inverse]
            head, tail = code[keep] >> 32, code[keep] & 0xFFFFFFFF
            base = head[None, :] if shape == (0, 0) else grams[:, head]
            made = np.concatenate([base, tail[None, :]]) if right else np.concatenate([tail[None, :], base])
            fresh[left, right] = (at, made)
            out.append((made, count[keep]))
        known = fresh
    assert rows.shape[0] == width
    return out


def phrase_counts(coded: DataFrame, ranked: DataFrame, least: int = LEAST, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """key (the numbers of the words), f: the phrases of 2 to MOST words with at least that count."""
    spark = coded.sparkSession
    total = ranked.agg(F.sum("c")).first()[0] or 0
    parts = max(1, -(-total // partition_rows))
    words = coded.select(F.col("block").alias("name"), F.posexplode(F.arrays_zip("langs", "words")).alias("pos", "w")).select("name", "pos", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    needed = words.join(ranked, ["lang", "word"]).select("name", "pos", "id", "c")

    def rewrite(key: tuple, block: pa.Table, own: pa.Table) -> pa.Table:
        out = {"pivot": [], "part": [], "n": [], "rows": []}
        if block.num_rows and own.num_rows:
            tokens = unplaned(block.column("tokens")[0].as_py(), block.column("n")[0].as_py()).astype(np.int64)
            pos, number, count = (own.column(c).to_numpy() for c in ("pos", "id", "c"))
            ids = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
            ids[pos + 1] = number
            rows = fragments(ids[tokens])
            # pivots by number: which of them are dealt to several partitions, and where this block's go
            order = np.argsort(number)
            at = order[np.searchsorted(number[order], rows[0])]
            shares = -(-count[at] // partition_rows)
            name = np.uint64(int(block.column("block")[0].as_py()[:16], 16))
            pivot = np.where(shares > 1, rows[0].astype(np.int64), 0)
            part = np.where(shares > 1, (mix(name + number[at].astype(np.uint64)) % shares.astype(np.uint64)).astype(np.int64), rows[0] % parts)
            order = np.lexsort((rows[0], part, pivot))
            rows, pivot, part = rows[:, order], pivot[order], part[order]
            new = np.ones(len(order), bool)
            new[1:] = (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])
            edge = np.append(np.flatnonzero(new), len(order))
            for a, b in zip(edge, edge[1:], strict=False):
                out["pivot"].append(int(pivot[a]))
                out["part"].append(int(part[a]))
                out["n"].append(int(b - a))
                out["rows"].append([planes(c[a:b]) for c in rows])
        return pa.table({"pivot": pa.array(out["pivot"], pa.int64()), "part": pa.array(out["part"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "rows": pa.array(out["rows"], pa.list_(pa.binary()))})

    dealt = coded.select("block", "n", "tokens").groupBy("block").cogroup(needed.groupBy("name")).applyInArrow(rewrite, "pivot long, part long, n long, rows array<binary>")

    def mine(key: tuple, table: pa.Table) -> pa.Table:
        pieces = [[unplaned(c, n) for c in r] for r, n in zip(table.column("rows").to_pylist(), table.column("n").to_pylist(), strict=True)]
        rows = np.stack([np.concatenate([p[i] for p in pieces]).astype(np.uint32) for i in range(2 * MOST - 1)])
        found = mined(rows, least if key[0].as_py() == 0 else 1)
        keys = [(list_array(pa.array(w.T.ravel().astype(np.int32)), np.arange(w.shape[1] + 1) * w.shape[0]), pa.array(f)) for w, f in found]
        schema = [pa.list_(pa.int32()), pa.int64()]
        return pa.table({"key": pa.chunked_array([k for k, _ in keys], schema[0]), "f": pa.chunked_array([f for _, f in keys], schema[1])})

    counted = dealt.groupBy("pivot", "part").applyInArrow(mine, "key array<int>, f long")
    path = scratch_path(spark, "phrases")
    counted.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).write.parquet(path)
    return spark.read.parquet(path)


# --- scores -----------------------------------------------------------------------------------------------------


def scored(phrases: DataFrame, ranked: DataFrame) -> DataFrame:
    """key, a, l, r, score (of the cut that scores least, of equal ones the first) of phrases that no longer one stands for."""
    known = phrases.unionByName(ranked.select(F.array("id").alias("key"), F.col("c").alias("f")))
    size = F.size("key")
    cuts = phrases.select("key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = cuts.select("key", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.slice("key", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), F.slice("key", F.col("k") + 1, size).alias("part")))).alias("s"))
    sides = sides.select("key", "a", "k", "s.left", "s.part").join(known.withColumnRenamed("key", "part"), "part")
    counts = sides.groupBy("key", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").alias("score")
    best = counts.select("key", "a", "k", "l", "r", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = phrases.filter(size > 2).select("f", "key", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("f", F.explode(F.expr("transform(sequence(1, size(key) - m + 1), s -> slice(key, s, m))")).alias("key"))
    longer = inner.groupBy("key").agg(F.max("f").alias("longer"))
    covered = F.coalesce(F.expr("cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) >= cast(80 as decimal(2,0)) * cast(a as decimal(20,0))"), F.lit(False))
    return best.join(longer, "key", "left").filter(~covered).select("key", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, partition_rows: int = PARTITION_ROWS, coded_bytes: int = CODED_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    coded = coded_blocks(docs, lang_col, text_col, coded_bytes)
    words = coded.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w")).select(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    ranked = ranked_words(words, least)
    found = saved(scored(phrase_counts(coded, ranked, least, partition_rows), ranked), "scored")
    spelled = found.select("key", F.posexplode("key").alias("pos", "id")).join(ranked.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])).alias("phrase"))
    rows = found.join(spelled, "key").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # what is not among the first of its share is not among the first of all
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
