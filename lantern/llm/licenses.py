"""License scans by diagonal voting.

Every rolling 3-word hash of every text is joined to the positions of the templates' 3-word hashes. A match whose words
are the template's, which is checked on the text itself, votes for its diagonal: the document word at which the template
would begin. A phrase whose grams all vote for one diagonal stands there word for word; those are the base places.
Neighbouring diagonals of a template (a word or two more or less in between) are merged, and a template of whose distinct grams
COVERED or more are then matched adds its label.

The templates, whole license texts among them, are a fixed list of some thousand grams, so their grams are broadcast. Votes are
a shuffle of matches only; each document also sends one row without a match, so that nothing is joined back.

Defined results: null text is empty and has no words, labels or places (score 0); texts of any length are scanned whole;
repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, mix, prepare, text_bytes, tokens, word_hashes, words
from .license_texts import SENTENCES, TEXTS

K = 3
#: Share of a template's grams that a merged diagonal must match.
COVERED = 0.8
#: Diagonals at most this far from the one before are merged with it.
GAP = 2

# The phrases of the base labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

NOTICES = TEXTS + SENTENCES


def gram_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of k words from the words' hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def _word_hashes(tokens_: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(tokens_), np.uint8)
    size = np.array([len(x) for x in tokens_], np.int64)
    ends = np.cumsum(size + 1) - 1
    return word_hashes(joined, ends - size, ends)


def template_rows(phrases: dict[str, str], notices: list[tuple[str, str]]) -> list[tuple]:
    """(hash, gram, template, position, grams of the template, label, base)."""
    rows = []
    for number, (label, text, base) in enumerate([*((a, b, True) for a, b in phrases.items()), *((a, b, False) for a, b in notices)]):
        w = tokens(text)
        h = gram_hashes(_word_hashes(w)).view(np.int64).tolist()
        if not h:
            raise ValueError(f"a template has {K} words or more: {text}")
        rows += [(x, b" ".join(w[i : i + K]).decode(), number, i, len(h), label, base) for i, x in enumerate(h)]
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offs = text_bytes(part.column(2))
                low = LOWER[data]
                s, e, first = words(low, offs, ALNUM)
                n = np.diff(first)
                g = np.append(gram_hashes(word_hashes(low, s, e)), np.zeros(K, np.uint64)) if len(s) else np.zeros(0, np.uint64)
                # each row's grams that do not run into the next row, and one null at the end
                own = np.maximum(n - K + 1, 0)
                row = np.repeat(np.arange(len(n)), own)
                at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + first[:-1][row]
                to = np.cumsum(own + 1)
                values, empty = np.zeros(int(to[-1]), np.int64), np.zeros(int(to[-1]), bool)
                empty[to - 1] = True
                values[~empty] = g[at].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(values, mask=empty))
                # starts of words, and the end of the text, as places in the row
                to = np.cumsum(n + 1)
                begin, last = np.zeros(int(to[-1]), np.int64), np.zeros(int(to[-1]), bool)
                last[to - 1] = True
                begin[~last] = s - np.repeat(offs[:-1], n)
                begin[last] = np.diff(offs)
                begins = pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(begin, pa.int32()))
                lowered = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), lowered, lists, begins], ["uid", "id", "n_words", "low", "grams", "begins"])

    small = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = small.schema["id"].dataType.simpleString()
    texts = small.mapInArrow(run, f"uid long, id {kind}, n_words long, low binary, grams array<long>, begins array<int>")
    grams = texts.select("uid", "id", "n_words", "low", "begins", F.posexplode("grams").alias("place", "gram"))

    templates = F.broadcast(spark.createDataFrame(template_rows(phrases, notices), "gram long, words string, template int, at int, size int, label string, base boolean"))
    found = grams.join(templates, "gram", "left").filter(F.col("template").isNotNull() | F.col("gram").isNull())
    span = F.expr(f"substring(low, begins[place] + 1, begins[place + {K}] - begins[place])")
    said = F.trim(F.regexp_replace(span.cast("string"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    own = F.when(F.col("template").isNotNull(), said)
    votes = found.select("uid", "id", "n_words", "place", "template", "at", "size", "label", "base", own.eqNullSafe(F.col("words")).alias("same"))
    votes = votes.filter("template is null or same").withColumn("diagonal", F.col("place") - F.col("at")).repartition("uid")

    lines = votes.groupBy("uid", "template", "diagonal").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("size").alias("size"), F.first("label").alias("label"), F.first("base").alias("base"),
        # a gram's position votes once for a diagonal
        F.collect_list("at").alias("ats"),
    )
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1)
    lines = lines.withColumn("new", new).withColumn("cluster", F.sum("new").over(order))
    whole = F.expr("base and size(ats) = size")
    matched = lines.withColumn("place", F.when(whole, F.col("diagonal"))).select("*", F.posexplode_outer("ats").alias("nth", "position"))
    # positions of merged diagonals count once, a line's place with its first position
    merged = matched.groupBy("uid", "template", "cluster", "position").agg(
        *[F.first(c).alias(c) for c in ("id", "n_words", "size", "label")], F.count_if(F.col("place").isNotNull() & (F.col("nth") == 0)).alias("n_base"),
        F.min("place").alias("first_word"), F.max("place").alias("last_word"),
    )
    merged = merged.groupBy("uid", "template", "cluster").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), (F.count("position") / F.first("size")).alias("covered"),
        F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
    )
    return merged.groupBy("uid").agg(
        F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.coalesce(F.sum("n_base"), F.lit(0)).alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.expr("if(n_base > 0, label, null)"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.expr(f"if(n_base > 0 or covered >= {COVERED}, label, null)"))), ",").alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
    ).drop("uid")
