"""The rare-term leg: files that hold a query's distinctive terms, if few files do."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import rare_terms
from lantern.operators import grams
from lantern.scratch import saved

#: Distinct terms, or pairs of terms, that travel to the tasks at once; more go in further blocks.
TERM_BLOCK, PAIR_BLOCK = 50_000, 100_000


def query_rare_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(rare_terms(F.col("q"))).alias("term"))


def _finder(terms: list[str]) -> Callable[[str], list[int]]:
    """A function from text to the numbers of the terms in it, in one pass: with an automaton where there is one, else by the
    characters that a term begins with."""
    try:
        import ahocorasick
    except ImportError:
        k = min(map(len, terms))
        heads: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            heads.setdefault(t[:k], []).append(i)
        return lambda text: sorted({i for a in range(len(text) - k + 1) for i in heads.get(text[a : a + k], ()) if text.startswith(terms[i], a)})
    tree = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        tree.add_word(t, i)
    tree.make_automaton()
    return lambda text: sorted({i for _, i in tree.iter(text)})


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Distinct rows in blocks of a counted size."""
    rows = rows.distinct()
    n = max(1, -(-rows.count() // size))
    for b in range(n):
        yield (rows if n == 1 else rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == b)).collect()


def files_with(terms: DataFrame, files: DataFrame, path: str = "path", text: str = "text", signatures: DataFrame | None = None) -> DataFrame:
    """path, terms: which of the distinct terms a file holds, whatever their case, for files that hold any; a row a file and
    block of terms. A text is read once for all terms of a block; where files have signatures (`grams.signed`), only the blocks of files
    that may hold one of the terms are read."""
    spark = files.sparkSession
    kind = files.schema[path].dataType.simpleString()
    out = None
    for block in _blocks(terms.select("term").filter("term <> ''"), TERM_BLOCK):
        sent = spark.sparkContext.broadcast([r.term for r in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lowered: dict[str, list[str]] = {}
            for t in sent.value:
                lowered.setdefault(t.lower(), []).append(t)
            keys = sorted(lowered)
            find = _finder(keys) if keys else (lambda text: [])
            for batch in batches:
                held = [[t for at in find((value or "").lower()) for t in lowered[keys[at]]] for value in batch.column(1).to_pylist()]
                own = [i for i, x in enumerate(held) if x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array([held[i] for i in own], pa.list_(pa.string()))], ["path", "terms"])

        own = files if signatures is None else grams.pruned(files, signatures, [r.term for r in block])
        got = own.select(path, text).mapInArrow(run, f"path {kind}, terms array<string>")
        out = got if out is None else out.unionByName(got)
    return out


def term_files(terms: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """term, path: the same, a row a match."""
    return files_with(terms, files, path, text).select(F.explode("terms").alias("term"), "path")


def rare_leg(queries: DataFrame, files: DataFrame, max_df: int = 12, signatures: DataFrame | None = None) -> DataFrame:
    """query_id, path, score, rank: 1/df of each term in at most max_df files, and 1/(2 df) of each pair of commoner terms
    that at most max_df files hold together."""
    asked = saved(query_rare_terms(queries), "asked")
    held = saved(files_with(asked, files, signatures=signatures), "held")
    counts = saved(document_counts(held), "counts")
    rare = counts.filter(F.col("df") <= max_df)
    # a common term's files go before anything is joined
    found = held.select(F.explode("terms").alias("term"), "path").join(rare, "term")
    single = asked.join(found, "term").select("query_id", "path", (1.0 / F.col("df")).alias("part"))
    both = common_pairs(asked, counts, held, max_df).select("query_id", "path", "part")
    scores = single.unionByName(both).groupBy("query_id", "path").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "path")
    return scores.withColumn("rank", F.row_number().over(order))


def document_counts(held: DataFrame) -> DataFrame:
    """term, df of what files_with found."""
    return held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def common_pairs(asked: DataFrame, counts: DataFrame, held: DataFrame, max_df: int = 12) -> DataFrame:
    """query_id, term1, term2, path, part: pairs of one query's terms that are each in more than max_df files and together in
    at most so many.

    The files are read twice: tasks count the pairs, and then give the files of those pairs that are in few. So a term that most
    files hold multiplies nothing."""
    spark = held.sparkSession
    common = asked.join(counts.filter(F.col("df") > max_df).select("term"), "term")
    each = common.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pairs = saved(each.select("query_id", F.explode(_pairs_of(F.col("terms"))).alias("p")).select("query_id", "p.term1", "p.term2"), "pairs")
    whole = held.groupBy("path").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    kind = held.schema["path"].dataType.simpleString()

    def together(terms: list[str], wanted: dict[str, list[str]]) -> Iterator[tuple[str, str]]:
        own = set(terms)
        for one in own:
            for two in wanted.get(one, ()):
                if two in own:
                    yield one, two

    def sent_of(block: list) -> object:
        wanted: dict[str, list[str]] = {}
        for r in block:
            wanted.setdefault(r.term1, []).append(r.term2)
        return spark.sparkContext.broadcast(wanted)

    few = None
    for block in _blocks(pairs.select("term1", "term2"), PAIR_BLOCK):

        def count(batches: Iterator[pa.RecordBatch], sent=sent_of(block)) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for terms in batch.column(0).to_pylist():
                    seen.update(together(terms, sent.value))
            rows = sorted(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in rows], pa.string()), pa.array([x[0][1] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], ["term1", "term2", "n"])

        got = whole.select("terms").mapInArrow(count, "term1 string, term2 string, n long").groupBy("term1", "term2").agg(F.sum("n").alias("df")).filter(F.col("df") <= max_df)
        few = got if few is None else few.unionByName(got)
    few = saved(few, "few")
    files = None
    for block in _blocks(few.select("term1", "term2"), PAIR_BLOCK):

        def give(batches: Iterator[pa.RecordBatch], sent=sent_of(block)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *p) for i, terms in enumerate(batch.column(1).to_pylist()) for p in sorted(together(terms, sent.value))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["path", "term1", "term2"])

        got = whole.select("path", "terms").mapInArrow(give, f"path {kind}, term1 string, term2 string")
        files = got if files is None else files.unionByName(got)
    return pairs.join(files.join(few, ["term1", "term2"]), ["term1", "term2"]).select("query_id", "term1", "term2", "path", (0.5 / F.col("df")).alias("part"))


def _pairs_of(terms):
    """All (term1, term2) with term1 before term2 of one query's sorted terms."""
    return F.flatten(F.transform(terms, lambda a, i: F.transform(F.slice(terms, i + 2, F.size(terms)), lambda b: F.struct(a.alias("term1"), b.alias("term2")))))
