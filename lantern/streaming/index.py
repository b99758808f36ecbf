"""Streams: notes that arrive as files bring the index up to date; spend that arrives as JSON lines is summed by window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lantern.plans import search, store
from lantern.sources import files


def refresh_on_arrival(spark: SparkSession, roots: list[str], index: str, checkpoint: str, s: search.Settings = search.Settings(), extensions: list[str] | None = None, exclude: list[str] | None = None) -> StreamingQuery:
    """Runs until the files there are, under any root, have been seen; each batch of arrivals is one segment of the index.

    Only the arrivals' own files are opened. What was deleted since is found by listing the roots, which opens none. The index
    holds the hash of each path, and is the state of the stream: a batch that is repeated after a failure finds its files there
    and writes nothing."""
    arriving = reduce(DataFrame.unionByName, [files.arrivals(spark, root) for root in roots])

    def batch(seen: DataFrame, number: int) -> None:
        if seen.isEmpty():
            return
        own = {root: seen.filter(F.col("root") == root).select("where", "content") for root in roots}
        store.build(files.documents(files.shown(spark, own, extensions, exclude)), index, s, listed=files.listed(spark, roots, extensions, exclude))

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spend_by_window(ledger: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Streaming sums of usd by sliding window and caller; rows later than `late` are left out."""
    timed = ledger.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, slide), F.when(F.col("caller") == "eval", "eval").otherwise("live").alias("caller")).agg(F.sum("usd").alias("usd"), F.count("*").alias("calls"))
