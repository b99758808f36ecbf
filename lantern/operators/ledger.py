"""Spend ledger: rolling sums, caps and reports. A row is ts, backend, tokens, usd, caller, session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.scratch import saved

DAY = 86_400


def caller_of(caller: Column) -> Column:
    """`eval`, or `live` for anything else, a missing value included."""
    return F.when(caller == "eval", "eval").otherwise("live")


#: Edges and rows of a range whose running sum one task takes.
RANGE_ROWS = 200_000


def rolling_spend(ledger: DataFrame, by: tuple[str, ...] = ("caller",), seconds: int = DAY) -> DataFrame:
    """Each row with spend: the usd of its group in the window that ends with it, equal times included.

    A window's sum is the difference of two running sums, at its end and just before its begin. Rows and these edges are dealt to
    ranges of (group, time), of which a busy group's day takes as many as it has rows for; each range sums its own, and the sums
    of whole ranges, a row a range and group, are added. Sums are decimals, so that differences are exact."""
    rows = ledger.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).filter("micros is not null")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "spend")
    key, usd, none = F.to_json(F.struct(*by)).alias("key"), F.coalesce(F.col("usd").cast("decimal(28,12)"), F.lit(0)).cast("decimal(28,12)").alias("usd"), F.lit(0).cast("decimal(28,12)").alias("usd")
    # edges come after the rows of their time: side 1 is the end, -1 the last moment before the begin, 0 a row itself
    edge = lambda at, side: rows.select(key, at.alias("micros"), F.lit(1).alias("after"), "row", none, F.lit(side).alias("side"))
    events = rows.select(key, "micros", F.lit(0).alias("after"), "row", usd, F.lit(0).alias("side"))
    events = events.unionByName(edge(F.col("micros"), 1)).unionByName(edge(F.col("micros") - seconds * 1_000_000 - 1, -1))
    ranges = max(1, -(-3 * rows.count() // RANGE_ROWS))
    order = ["micros", "after", "row"]
    dealt = saved(events.repartitionByRange(ranges, "key", *order).withColumn("range", F.spark_partition_id()), "edges")
    sums = dealt.groupBy("range", "key").agg(F.sum("usd").alias("own"))
    earlier = F.sum("own").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = saved(sums.select("range", "key", F.coalesce(earlier, F.lit(0)).alias("before")), "sums")
    inner = F.sum("usd").over(Window.partitionBy("range", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = dealt.withColumn("inner", inner).filter("side <> 0").join(sums, ["range", "key"]).select("row", ((F.col("inner") + F.col("before")) * F.col("side")).alias("part"))
    return rows.join(upto.groupBy("row").agg(F.sum("part").cast("double").alias("spend")), "row").drop("row", "micros")


def summary(ledger: DataFrame, now: Column, seconds: int = DAY) -> DataFrame:
    """One row: calls, usd and tokens of the last day, usd of all time, usd of the last day by caller."""
    recent = F.col("ts") >= now - F.expr(f"interval {seconds} seconds")
    usd = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("usd"))), F.lit(0.0)), 4)
    return ledger.agg(
        F.count_if(recent).alias("calls_24h"), usd(recent).alias("usd_24h"), F.coalesce(F.sum(F.when(recent, F.col("tokens"))), F.lit(0)).alias("tokens_24h"),
        usd(F.lit(True)).alias("usd_all_time"), usd(recent & (caller_of(F.col("caller")) == "live")).alias("usd_24h_live"), usd(recent & (caller_of(F.col("caller")) == "eval")).alias("usd_24h_eval"),
    )


def verdict(est: Column, query_usd: Column, day: Column, session_day: Column, caller: Column, has_session: Column, *, per_query: float, daily: float, ceiling: Column | float = 1.0, session_share: float = 0.0) -> Column:
    """Why a spend is refused, or `ok`; tests in their order: eval switched off, nothing to pay, per query, widen reserve,
    daily cap, session share. A cap of 0 is no cap."""
    ceiling = ceiling if isinstance(ceiling, Column) else F.lit(ceiling)
    off = F.lit(not daily)
    out = F.when((caller == "eval") & off, "eval off").when(est <= 0, "ok")
    if per_query:
        out = out.when(query_usd + est > per_query, "per query")
    if daily:
        out = out.when((ceiling < 1) & (day + est > daily * ceiling), "widen reserve").when(day + est > daily, "daily cap")
        if 0 < session_share < 1:
            out = out.when((caller == "live") & has_session & (session_day + est > daily * session_share), "session share")
    return out.otherwise("ok")


def replay(ledger: DataFrame, *, per_query: float, daily: float, session_share: float, ceiling: float = 1.0) -> DataFrame:
    """Each ledger row with what the caps would have said to it: spend before it in its day, by caller and by session."""
    day = rolling_spend(ledger.withColumn("caller", caller_of(F.col("caller")))).withColumnRenamed("spend", "day")
    both = rolling_spend(day, ("caller", "session")).withColumnRenamed("spend", "session_day")
    before = both.withColumn("day", F.col("day") - F.col("usd")).withColumn("session_day", F.col("session_day") - F.col("usd"))
    said = verdict(F.round("usd", 6), F.lit(0.0), F.round("day", 6), F.round("session_day", 6), F.col("caller"), F.col("session").isNotNull(), per_query=per_query, daily=daily, ceiling=ceiling, session_share=session_share)
    return before.withColumn("verdict", said)


def order_statistics(rows: DataFrame, column: str, ranks: list[int], small: int = 10_000, ranges: int = 1024) -> list[float]:
    """The values at ranks (from 0) of a column of finite doubles, exactly and without a sort of all rows: counts by ranges say
    which range holds a rank, and that range is counted by finer ones until few rows are left."""
    x, out = F.col(column), []
    values = rows.select(x.cast("double").alias(column)).filter(x.isNotNull())
    for rank in ranks:
        own, at = values, rank
        while True:
            n, low, high = own.agg(F.count("*"), F.min(column), F.max(column)).first()
            if n <= at:
                raise ValueError(f"there are {n} values, but no rank {at}")
            if low == high or n <= small:
                out.append(low if low == high else sorted(r[0] for r in own.collect())[at])
                break
            place = F.least(F.floor((x - low) / (high - low) * ranges), F.lit(ranges - 1))
            seen = 0
            for r in sorted(own.groupBy(place.alias("place")).count().collect()):
                if seen + r["count"] > at:
                    own, at = own.filter(place == r["place"]), at - seen
                    break
                seen += r["count"]
    return out


def usage_report(log: DataFrame) -> DataFrame:
    """One row over a recall log (mode, top_score, widen_at, widened, usd, secs, top1, first1): counts and percentiles."""
    rr = F.startswith(F.col("mode"), F.lit("rerank"))
    at = F.when(F.coalesce("widen_at", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("widen_at"))
    n = F.count_if(rr)
    secs = log.filter(rr).select("secs").filter("secs is not null")
    many = secs.count()
    low, high, p90 = order_statistics(secs, "secs", [(many - 1) // 2, many // 2, int(0.9 * (many - 1))]) if many else (0.0, 0.0, 0.0)
    return log.agg(
        F.count("*").alias("queries"), n.alias("reranked"), F.count_if(rr & (F.col("top_score") >= at)).alias("confident_top1"), F.count_if(rr & (F.col("top_score") < at)).alias("low_confidence"),
        F.count_if(rr & F.col("widened")).alias("widened"), F.count_if(F.startswith(F.col("mode"), F.lit("first-stage"))).alias("fallbacks"), F.count_if(rr & (F.col("top1") != F.col("first1"))).alias("top1_differs_from_search"),
        F.round(F.lit((low + high) / 2), 2).alias("secs_p50"), F.round(F.lit(p90), 2).alias("secs_p90"),
        F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 4).alias("usd"), F.round(F.coalesce(F.sum(F.when(rr, F.col("usd"))), F.lit(0.0)) / F.greatest(n, F.lit(1)), 5).alias("usd_per_reranked"),
    )
