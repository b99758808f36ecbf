"""Index maintenance: what changed between two snapshots, merging, statistics and budgeted builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.scratch import saved


def index_diff(known: DataFrame, files: DataFrame) -> DataFrame:
    """path, status: new, changed, same or gone. known: path, hash, embedded; files: path, hash. A known document without
    vectors counts as changed."""
    old = known.select("path", F.col("hash").alias("old"), F.col("embedded").alias("done"))
    both = files.select("path", "hash").join(old, "path", "full_outer")
    status = F.when(F.col("hash").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("done") & F.col("old").eqNullSafe(F.col("hash")), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def merge(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """The old table without what is gone or replaced, with the new rows of new and changed paths."""
    kept = old.join(diff.filter("status = 'same'").select("path"), "path", "left_semi")
    fresh = new.join(diff.filter("status in ('new', 'changed')").select("path"), "path", "left_semi")
    return kept.unionByName(fresh.select(*old.columns))


def statistics(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: docs, words, pending, sections, long_docs."""
    own = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count_if(~F.col("embedded")).alias("pending"))
    return own.join(F.broadcast(sections.agg(F.count("*").alias("sections"), F.countDistinct("path").alias("long_docs"))))


def mark_pending(known: DataFrame, files: DataFrame) -> DataFrame:
    """path, hash, embedded after a build whose embedder is down: new and changed documents take their new hash and wait."""
    diff = index_diff(known, files)
    rows = files.select("path", "hash").join(diff.filter("status <> 'gone'"), "path")
    return rows.select("path", "hash", (F.col("status") == "same").alias("embedded"))


#: Rows of a range that one task sums.
RANGE_ROWS = 200_000


def budgeted(todo: DataFrame, budget: int) -> DataFrame:
    """path, size, texts, before, fits: smallest first, as long as the texts so far stay within the budget; the first
    always goes. A document that does not fit does not use the budget up, but nor does a larger one after it.

    Running sums are taken within ranges of (size, path), which tasks share; the sums of whole ranges, a row each, are added."""
    ranges = max(1, -(-todo.count() // RANGE_ROWS))
    rows = saved(todo.select("path", "size", "texts").repartitionByRange(ranges, "size", "path").withColumn("range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("range").agg(F.sum("texts").alias("own")).withColumn("upto", F.sum("own").over(Window.orderBy("range")))
    inner = Window.partitionBy("range").orderBy("size", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("upto") - F.col("own") + F.sum("texts").over(inner) - F.col("texts")
    each = rows.join(sums, "range").withColumn("before", before)
    return each.select("path", "size", "texts", "before", ((F.col("before") == 0) | (F.col("before") + F.col("texts") <= budget)).alias("fits"))
