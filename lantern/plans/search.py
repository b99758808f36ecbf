"""Hybrid search and answer-aware recall over a batch of queries (query_id, q) and a corpus (path, title, body)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import embedders
from lantern.functions.text import embedding_texts, fixed_chunks, is_question, plain_words, units_of
from lantern.functions.vectors import chunked_hash_vectors, hash_vectors, mean_hash_vectors
from lantern.operators import grams, keyword, postings, rare, rerank, vector
from lantern.scratch import saved
from lantern.shipping import ship


@dataclass(frozen=True)
class Settings:
    """Sizes and weights of a search; the defaults are those of the engine."""

    chunk_words: int = 350
    rrf_k: int = 60
    keyword_weight: float = 0.5
    vector_pool: int = 50
    section_pool: int = 400
    k: int = 20
    widen_k: int = 150
    widen_at: float = 0.5
    rare_max_df: int = 12
    window_words: int = 600
    max_windows: int = 24
    model: str = "hash:64"
    embed_options: dict = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return embedders.hash_dim(self.model) or int(self.embed_options.get("dim", 768))


@dataclass(frozen=True)
class Words:
    """The keyword part of an index, which is all that a search by words reads."""

    terms: DataFrame
    vocabulary: DataFrame
    shards: postings.Shards

    @staticmethod
    def saved(terms: DataFrame) -> Words:
        """The written tables of a sharded forward table. Postings are written by the first search that goes by them."""
        terms = saved(terms, "terms")
        shards = keyword.shards_of(terms, lambda rows: saved(rows, "postings", **postings.PAGE), late=True)
        return Words(terms, saved(keyword.sorted_vocabulary(keyword.vocabulary(terms)), "vocabulary", **postings.PAGE), shards)


@dataclass(frozen=True)
class Index:
    """The tables of an index: docs (path, title, body, text, words), terms (stemmed, a row a document), vocabulary, doc_vectors,
    sections (with vectors); and, if they were made, the postings in shards and the trigram signatures of blocks of docs."""

    docs: DataFrame
    terms: DataFrame
    vocabulary: DataFrame
    doc_vectors: DataFrame
    sections: DataFrame
    shards: postings.Shards | None = None
    signatures: DataFrame | None = None
    #: of an index that is to be written: whether each text is its body, so that one of them is enough; and the settings by which
    #: its vectors are made of docs, so that they can be made of the written ones
    alike: bool = False
    settings: Settings | None = None

    def saved(self, words: Words | None = None) -> Index:
        """The same index from written tables, so that plans over it do not hold its making; with postings and signatures. words:
        its keyword part, if that is written already."""
        words = words or Words.saved(postings.sharded(self.terms))
        docs = saved(grams.signed(self.docs.drop("text"), "body") if self.alike else grams.signed(self.docs), "docs", **grams.WRITE)
        docs = docs.withColumn("text", F.col("body")) if self.alike else docs
        chunked = saved(self.doc_vectors if self.settings is None else chunk_vectors(docs, self.settings), "doc_vectors")
        sections = self.sections if self.settings is None else chunk_sections(chunked).unionByName(apart_sections(docs, self.settings))
        return Index(docs.drop("signature"), words.terms, words.vocabulary, chunked.select("path", "embedding"), saved(sections, "sections"), words.shards, grams.signatures_of(docs))


def with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("words", F.size(plain_words(F.col("body"))))


def document_vectors(docs: DataFrame, s: Settings) -> DataFrame:
    """path, embedding: the unit mean of the vectors of a document's chunks and, if there is one, its summary."""
    texts = embedding_texts(F.col("title"), fixed_chunks(F.col("body"), s.chunk_words), F.col("summary") if "summary" in docs.columns else None)
    return mean_hash_vectors(docs, "path", texts, s.dim)


def section_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """path, section, hpath, start_word, text of documents of more than chunk_words words."""
    units = docs.filter(F.col("words") > s.chunk_words).select("path", "title", F.posexplode(units_of("body", F.lit(s.chunk_words))).alias("section", "u"))
    return units.select("path", "title", "section", "u.hpath", "u.start_word", "u.text")


def section_vectors(sections: DataFrame, s: Settings) -> DataFrame:
    text = F.concat("title", F.lit(" > "), "hpath", F.lit("\n"), "text")
    return hash_vectors(sections, ["path", "section"], text, s.dim)


def chunks_are_sections(s: Settings) -> Column:
    """Whether a document's sections are its chunks, word for word: it has some, no line that may be a heading, and no white space
    that only one of the two is cut at."""
    heading = F.startswith("body", F.lit("#")) | F.contains("body", F.lit("\n#"))
    odd = F.col("body").rlike(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
    return (F.col("words") > s.chunk_words) & ~heading & ~odd


def chunk_vectors(docs: DataFrame, s: Settings) -> DataFrame:
    """path, embedding of documents, as of `document_vectors`, and the vectors of chunks that are sections, so that their words are
    hashed once."""
    return chunked_hash_vectors(docs, "path", embedding_texts(F.col("title"), fixed_chunks(F.col("body"), s.chunk_words)), chunks_are_sections(s), s.dim)


def chunk_sections(chunked: DataFrame) -> DataFrame:
    return chunked.select("path", F.posexplode("chunks").alias("section", "embedding"))


def apart_sections(docs: DataFrame, s: Settings) -> DataFrame:
    """The vectors of sections that are no chunks."""
    return section_vectors(section_rows(docs.filter(~chunks_are_sections(s)), s), s)


def build(docs: DataFrame, s: Settings = Settings()) -> Index:
    """docs: path, title, body and, where the whole file is another text than the body, text."""
    ship(docs.sparkSession)
    body, given = F.coalesce("body", F.lit("")), docs.columns
    whole = F.coalesce("text", body) if "text" in docs.columns else body
    docs = with_words(docs.select("path", "title", body.alias("body"), whole.alias("text")))
    terms = keyword.forward(docs)
    chunked = chunk_vectors(docs, s)
    return Index(docs, terms, keyword.vocabulary(terms), chunked.select("path", "embedding"), chunk_sections(chunked).unionByName(apart_sections(docs, s)), alike="text" not in given, settings=s)


def query_vectors(queries: DataFrame, s: Settings) -> DataFrame:
    return embedders.embedded(queries, "query_id", "q", s.model, s.embed_options, queries=True)


@dataclass(frozen=True)
class Legs:
    """What the legs find for the largest k that is asked; smaller k cut it, so nothing is searched twice."""

    words: DataFrame
    docs: DataFrame
    sections: DataFrame
    long_paths: DataFrame


def legs(queries: DataFrame, index: Index, k: int, s: Settings = Settings()) -> Legs:
    pool = max(k, s.vector_pool)
    words = keyword.search(queries, index.terms, index.vocabulary, pool, shards=index.shards)
    docs, sections = vector.near(query_vectors(queries, s), index.doc_vectors, index.sections, pool, max(s.section_pool, k))
    return Legs(words, docs, sections, index.sections.select("path").distinct())


def fused(found: Legs, k: int, s: Settings = Settings()) -> DataFrame:
    pool = max(k, s.vector_pool)
    near = vector.leg_of(found.docs, found.sections, found.long_paths, pool, max(s.section_pool, k))
    return vector.fuse([(near, 1.0), (found.words.filter(F.col("rank") <= pool), s.keyword_weight)], s.rrf_k).filter(F.col("rank") <= k)


def hybrid(queries: DataFrame, index: Index, k: int, s: Settings = Settings()) -> DataFrame:
    """query_id, path, score, rank of the best k of each query."""
    return fused(legs(queries, index, k, s), k, s)


def pool_of(queries: DataFrame, index: Index, first: DataFrame, s: Settings) -> DataFrame:
    """The first stage's files and those with rare terms anywhere in the whole file, frontmatter included."""
    return rerank.candidate_pool(first, rare.rare_leg(queries, index.docs, s.rare_max_df, index.signatures))


def score_files(queries: DataFrame, pool: DataFrame, terms: DataFrame) -> DataFrame:
    return rerank.best_windows(rerank.lexical_scores(queries, pool, terms))


def recall(queries: DataFrame, index: Index, s: Settings = Settings(), top: int = 5, question_gate: bool = True) -> DataFrame:
    """query_id, path, score, section window (ord), rank, mode, widened of the best `top` files of each query.

    Queries that are no questions keep the first stage's order without scores. A query whose best file scores under
    widen_at is widened once: files of a larger first stage that are not in the pool are scored among themselves."""
    found = legs(queries, index, max(s.widen_k, s.k), s)
    found = Legs(saved(found.words, "words"), saved(found.docs, "near"), saved(found.sections, "near"), found.long_paths)
    wide = saved(fused(found, max(s.widen_k, s.k), s), "wide")
    first = wide.filter(F.col("rank") <= s.k) if max(s.k, s.vector_pool) == max(s.widen_k, s.vector_pool) else saved(fused(found, s.k, s), "first")
    pool = saved(pool_of(queries, index, first, s), "pool")
    asks = queries.filter(is_question(F.col("q"))) if question_gate else queries
    wanted = wide.select("path").union(pool.select("path")).distinct()
    windows = rerank.file_windows(index.docs.join(wanted, "path", "left_semi"), s.window_words, s.max_windows)
    terms = saved(rerank.window_terms(windows), "terms")
    own = pool.join(asks.select("query_id"), "query_id", "left_semi")
    scored = saved(score_files(asks, own, terms), "scored")
    unsure = scored.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") < s.widen_at).select("query_id")
    size = own.groupBy("query_id").agg(F.max("pos").alias("n"))
    more = wide.join(unsure, "query_id", "left_semi").join(own, ["query_id", "path"], "left_anti").join(size, "query_id")
    more = saved(more.select("query_id", "path", (F.col("n") + F.col("rank")).alias("pos")), "more")
    again = score_files(asks, more, terms)
    ranked = rerank.ranked_files(scored.unionByName(again), own.unionByName(more))
    widened = more.select("query_id").distinct().withColumn("widened", F.lit(True))
    asked = ranked.join(widened, "query_id", "left").select("query_id", "path", "score", "ord", "rank", F.lit("rerank:lexical").alias("mode"), F.coalesce("widened", F.lit(False)).alias("widened"))
    plain = pool.join(asks.select("query_id"), "query_id", "left_anti").select("query_id", "path", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("ord"), F.col("pos").alias("rank"), F.lit("keyword").alias("mode"), F.lit(False).alias("widened"))
    return asked.unionByName(plain).filter(F.col("rank") <= top)
