"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, bpe, collocations, crf, decontam, langid, licenses, nbsvm, negatives, ngram_lm, simhash, suffix, warc
from .common import table
from .labelled import remainder


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "kept_text")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# base32 of a hex digest: five hex digits are four letters
OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
e AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, g * 5 + 1, 5))::INT >> s::INT) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM e
"""

# windows of 200 bytes as hex
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS u, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT u, p, md5(substr(x, 2 * p + 1, 400)) AS k FROM d, unnest(range(0, n - 199)) t(p) WHERE n >= 200),
dup AS (SELECT u, p FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS (SELECT u, p, sum(new) OVER (PARTITION BY u ORDER BY p) AS r FROM (SELECT u, p, CASE WHEN p <= lag(p) OVER (PARTITION BY u ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM dup)),
spans AS (SELECT u, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY u, r),
gaps AS (SELECT u, a, b, coalesce(lag(b) OVER (PARTITION BY u ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT u, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, list({'s': before, 'e': a} ORDER BY a) AS parts FROM gaps GROUP BY u)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN parts IS NULL THEN x ELSE array_to_string(list_transform(parts, lambda q: substr(x, 2 * q.s + 1, 2 * (q.e - q.s))), '') || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (u)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT coalesce(item, '') AS item, least(10, len(w)) AS k, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(s) WHERE len(w) > 0),
dw AS (SELECT u, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) t(s) WHERE len(w) >= k),
hit AS (SELECT u, s, k, item FROM dw JOIN bw USING (k, g)),
n AS (SELECT u, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT u, s, k FROM hit), unnest(range(s, s + k)) t(pos) GROUP BY u),
i AS (SELECT u, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY u)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (u) LEFT JOIN i USING (u)
"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, c[i] AS x, i FROM v, unnest(range(1, len(c) + 1)) t(i)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score FROM e a JOIN e b USING (i) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, w[s:s + m - 1] AS p, count(*) AS f FROM w, unnest([1, 2, 3, 4]) x(m), unnest(range(1, len(w) - m + 2)) y(s) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, p, f AS a, k, p[1:k] AS one, p[k + 1:] AS two FROM f, unnest(range(1, len(p))) x(k)),
t AS (SELECT c.lang, c.p, a, k, f1.f AS l, f2.f AS r, (2000000::HUGEINT * a // (f1.f + f2.f))::BIGINT AS score FROM c JOIN f f1 ON f1.lang = c.lang AND f1.p = one JOIN f f2 ON f2.lang = c.lang AND f2.p = two),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM t) WHERE i = 1),
i AS (SELECT lang, p[s:s + m - 1] AS p, max(f) AS longer FROM f, unnest(range(2, len(p))) x(m), unnest(range(1, len(p) - m + 2)) y(s) GROUP BY ALL),
o AS (SELECT b.*, array_to_string(p, ' ') AS phrase FROM b LEFT JOIN i USING (lang, p) WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN n USING (lang) WHERE rank <= 2000
"""


def _op6_sql() -> str:
    """Diagonals of the templates' word triples, by joins and windows."""
    rows = ", ".join("('%s', %d, %d, %d, '%s', %s)" % (gram, template, at, size, label, str(base).lower()) for _, gram, template, at, size, label, base in licenses.template_rows(licenses.PHRASES, licenses.NOTICES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM documents),
t(g, template, "at", size, label, base) AS (VALUES {rows}),
v AS (SELECT u, template, s - 1 - "at" AS diagonal, "at", size, label, base FROM (SELECT u, s, array_to_string(list_slice(w, s, s + 2), ' ') AS g FROM d, unnest(range(1, len(w) - 1)) x(s) WHERE len(w) > 2) JOIN t USING (g)),
l AS (SELECT u, template, diagonal, any_value(size) AS size, any_value(label) AS label, any_value(base) AND count(*) = any_value(size) AS whole FROM v GROUP BY u, template, diagonal),
c AS (SELECT *, sum(new) OVER (PARTITION BY u, template ORDER BY diagonal) AS cluster FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY u, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS new FROM l)),
m AS (SELECT c.u, c.template, cluster, any_value(c.label) AS label, count(DISTINCT "at") / any_value(c.size)::DOUBLE AS covered FROM c JOIN v ON v.u = c.u AND v.template = c.template AND v.diagonal = c.diagonal GROUP BY c.u, c.template, cluster),
b AS (SELECT u, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM l WHERE whole GROUP BY u),
a AS (SELECT u, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT u, label FROM m WHERE covered >= 0.8 UNION ALL SELECT u, label FROM l WHERE whole) GROUP BY u),
s AS (SELECT u, max(covered) AS score FROM m GROUP BY u)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN b USING (u) LEFT JOIN a USING (u) LEFT JOIN s USING (u)
"""


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op2_ann_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 100 = 0"))


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items")


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.score_texts(docs, remainder(docs["doc_id"], 10) == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run, "op1_warc": op1_warc, "op2_ann_learned_partitions": op2_ann_learned_partitions, "op3_quality_nbsvm": op3_quality_nbsvm, "op4_language_id": op4_language_id, "op5_toxicity_crf": op5_toxicity_crf, "op6_license_scan": op6_license_scan, "op10_decontamination": op10_decontamination, "op10_proximity": op10_proximity, "op7_suffix_array_dedup": op7_suffix_array_dedup, "op8_byte_bpe": op8_byte_bpe, "op9_simhash_bktree": op9_simhash_bktree, "op11_hard_negatives": op11_hard_negatives, "op12_collocations": op12_collocations, "op13_backoff_lm": op13_backoff_lm}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_license_scan": _op6_sql(), "op7_suffix_array_dedup": OP7_SQL, "op10_decontamination": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
