"""Windows, prefilter, scorers and the ranking of files by their best window, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import distinct_content_words, windows_of
from lantern.scratch import saved


def file_windows(files: DataFrame, words: int = 600, most: int = 24, path: str = "path", body: str = "body") -> DataFrame:
    """path, ord, heading, text."""
    return files.select(F.col(path).alias("path"), F.posexplode(windows_of(F.col(body), F.lit(words), F.lit(most))).alias("ord", "w")).select("path", "ord", "w.heading", "w.text")


def window_terms(windows: DataFrame) -> DataFrame:
    """path, ord, words: distinct content words of a window."""
    return windows.select("path", "ord", distinct_content_words(F.col("text")).alias("words"))


def lexical_scores(queries: DataFrame, candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, path, ord, raw, score of every window of a query's candidate files (query_id, path). terms: window_terms.

    raw sums ln(1 + n/df) over the question's words in the window, n and df over that query's windows; score is its share
    of the sum over all of the question's words that any of the windows holds, in [0, 1]. A window's words stay in its row, and
    only those that it shares with the question leave it; a question's weights are one small map."""
    asked = queries.select("query_id", distinct_content_words(F.col("q")).alias("asked"))
    pairs = candidates.select("query_id", "path").join(terms, "path").join(asked, "query_id")
    pairs = saved(pairs.select("query_id", "path", "ord", F.array_intersect("asked", "words").alias("hits")), "hits")
    n = pairs.groupBy("query_id").agg(F.count("*").alias("n"))
    df = pairs.select("query_id", F.explode("hits").alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("df"))
    idf = df.join(n, "query_id").select("query_id", "word", F.ln(1 + F.col("n") / F.col("df")).alias("idf"))
    weights = idf.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "idf"))).alias("weights"), F.sum("idf").alias("most"))
    raw = F.aggregate("hits", F.lit(0.0), lambda total, word: total + F.element_at("weights", word))
    each = pairs.join(weights, "query_id", "left").withColumn("raw", F.coalesce(raw, F.lit(0.0)))
    return each.select("query_id", "path", "ord", "raw", F.coalesce(F.col("raw") / F.col("most"), F.lit(0.0)).alias("score"))


def prefilter(scored: DataFrame, per_file: int) -> DataFrame:
    """The best `per_file` windows of each file by raw, ties to the earlier; smaller files keep all."""
    order = Window.partitionBy("query_id", "path").orderBy(F.round("raw", 9).desc(), "ord")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_file).drop("place")


def best_windows(scored: DataFrame) -> DataFrame:
    """query_id, path, score, ord: the best window of each file, the first on ties; a file without a score has no window."""
    best = scored.groupBy("query_id", "path").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("ord")).alias("back"))).alias("b"))
    return best.select("query_id", "path", F.col("b.score").alias("score"), F.when(F.col("b.score") > 0, -F.col("b.back")).alias("ord"))


def ranked_files(best: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, path, score, ord, rank by score, then by the position in the pool (query_id, path, pos)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")
    return pool.select("query_id", "path", "pos").join(best, ["query_id", "path"], "left").fillna({"score": 0.0}).withColumn("rank", F.row_number().over(order))


def candidate_pool(*legs: DataFrame) -> DataFrame:
    """query_id, path, pos: ordered union of ranked legs (query_id, path, rank), a path at its first place."""
    both = None
    for i, leg in enumerate(legs):
        own = leg.select("query_id", "path", F.struct(F.lit(i).alias("leg"), "rank").alias("place"))
        both = own if both is None else both.unionByName(own)
    first = both.groupBy("query_id", "path").agg(F.min("place").alias("place"))
    return first.select("query_id", "path", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("pos"))


def token_estimate(queries: DataFrame, pool: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, tokens: a third of the characters that a scorer would be sent."""
    sizes = pool.join(windows, "path").join(queries, "query_id")
    return sizes.groupBy("query_id").agg(F.floor(F.sum(F.length("text") + F.length("q") + 200) / 3).alias("tokens"))


def position_scores(pool: DataFrame) -> DataFrame:
    """Scores that fall with the position: 1 - i/n."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return pool.withColumn("score", 1.0 - (F.col("pos") - 1) / n)
