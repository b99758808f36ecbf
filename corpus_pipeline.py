"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

1. quality: documents that the quality classifier rejects (score under the threshold) go.
2. near_dedup: of each component of near-duplicates the document with the smallest doc_id stays; of rows that share that
   doc_id, the one whose fingerprint and text come first, then the first in the order of all columns.
3. repeats: bytes of repeated 200-byte strings go; a cut inside a character drops what is left of it; n_chars follows.
4. decontaminate: documents that hold a benchmark window go.
5. encode: token ids' count and digests of what is left.

All but the last return the columns of documents, with their types; more columns come through as they are, whatever their
names. A null text is scored and linked as an empty one; stage 3 makes it empty, with n_chars 0. A null doc_id is a document
like any other and comes last where the smallest is kept. Repeated rows are near-duplicates, of which one stays. Texts of any
length are treated whole. Of an empty table every stage makes an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import bpe, decontam, nbsvm, simhash, suffix
from lantern.llm.common import row_of, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbsvm.keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the other columns travel as one, so that no name of theirs meets one of the operator's
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix.remove_repeats(docs.select("doc_id", "text", row_of(docs, rest)), carry=("row",))
    own = {"doc_id": cut["doc_id"], "text": cut["kept_text"], "n_chars": F.length(cut["kept_text"]).cast("long")}
    return cut.select(*[(own[c] if c in own else cut["row"][c]).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("decontaminate", decontaminate), ("encode", encode)]

#: Stages that learn or hash with functions SQL lacks; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
