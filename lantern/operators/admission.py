"""Which questions of a batch may be scored, within caps of spend.

Caps are tested as if the questions came one after the other in the order of their ids: what is admitted counts for those after
it, what is refused does not. Questions are dealt to ranges of ids, and a range gives its sums. A range that fits whole is
admitted by its sum, one of which nothing fits is refused by its smallest estimate, and only a range in which a cap may bind is
gone through question by question; so the driver holds one range at a time, and a row a range."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.scratch import saved

#: Questions of a range, about.
RANGE_ROWS = 4096
#: Sums are trusted to this share; closer to a cap a range is gone through.
EXACT = 1e-9


@dataclass(frozen=True)
class Caps:
    """Caps in US dollars, 0 for none, and the spend of the last day before the batch, by all of the caller's kind and by the
    session. ceiling: the share of the daily cap that may be used."""

    per_query: float = 0.0
    daily: float = 0.0
    caller: str = "live"
    session: str | None = None
    session_share: float = 0.0
    day: float = 0.0
    session_day: float = 0.0
    ceiling: float = 1.0

    def after(self, usd: float) -> Caps:
        return replace(self, day=self.day + usd, session_day=self.session_day + usd)

    def limits(self) -> list[tuple[str, float, float]]:
        """Why a spend is refused, the spend so far that counts, and its cap, in the order of the tests."""
        out = []
        if self.daily and self.ceiling < 1:
            out.append((f"widen reserve: {self.ceiling:.0%} of ${self.daily:.2f} a day are for first passes", self.day, self.daily * self.ceiling))
        if self.daily:
            out.append((f"daily cap of ${self.daily:.2f} for {self.caller} calls", self.day, self.daily))
        if self.daily and self.caller == "live" and self.session and 0 < self.session_share < 1:
            out.append((f"session share: {self.session_share:.0%} of ${self.daily:.2f} a day", self.session_day, self.daily * self.session_share))
        return out

    @property
    def off(self) -> bool:
        return self.caller == "eval" and not self.daily

    def room(self) -> float:
        """What fits under all caps of the day."""
        return min((cap - before for _, before, cap in self.limits()), default=float("inf"))

    def too_dear(self, usd: float, before: float) -> bool:
        return bool(self.per_query) and before + usd > self.per_query

    def refusal(self, usd: float, before: float = 0.0) -> str | None:
        """Why a spend is refused, or None. before: what the question has cost so far."""
        if self.off:
            return OFF
        if usd <= 0:
            return None
        if self.too_dear(usd, before):
            return f"the query would cost ${before + usd:.4f}, more than ${self.per_query:.2f}"
        return next((why for why, so_far, cap in self.limits() if so_far + usd > cap), None)

    def refusals(self, usd: Column, before: Column, day: Column, session_day: Column) -> Column:
        """The same for columns, with the spend of the day in columns as well."""
        if self.off:
            return F.lit(OFF)
        out = F.when(usd <= 0, F.lit(None).cast("string"))
        if self.per_query:
            out = out.when(before + usd > self.per_query, F.format_string(f"the query would cost $%.4f, more than ${self.per_query:.2f}", before + usd))
        so_far = {False: day, True: session_day}
        for why, by_session, cap in replace(self, day=0.0, session_day=1.0).limits():
            out = out.when(so_far[bool(by_session)] + usd > cap, why)
        return out


OFF = "evaluations are off"


def admit(rows: DataFrame, caps: Caps, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, Caps]:
    """query_id, due, why (null: admitted) of rows (query_id, due, before), and the caps with what was admitted."""
    spark, kind = rows.sparkSession, rows.schema["query_id"].dataType.simpleString()
    due, before = F.col("due"), F.col("before")
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = saved(rows.select("query_id", "due", "before").repartitionByRange(ranges, "query_id").withColumn("range", F.spark_partition_id()), "due")
    pays = (due > 0) & (~(before + due > caps.per_query) if caps.per_query else F.lit(True))
    sums = dealt.groupBy("range").agg(F.sum(F.when(pays, due)).alias("usd"), F.min(F.when(pays, due)).alias("least")).orderBy("range").collect()
    # by range: the caps that hold in it; or what came of each of its questions
    states: list[tuple[int, float, float]] = []
    said: DataFrame | None = None
    for r in sums:
        usd, room = r.usd or 0.0, caps.room()
        if caps.off or not usd or usd <= room - EXACT * max(1.0, abs(room)) or r.least > room + EXACT * max(1.0, abs(room)):
            fits = not caps.off and usd <= room
            # whole ranges are admitted with the caps as they are where the last of it would still fit
            states.append((r.range, caps.day, caps.session_day) if not fits else (r.range, float("-inf"), float("-inf")))
            caps = caps.after(usd) if fits else caps
            continue
        out = []
        for q in dealt.filter(F.col("range") == r.range).orderBy("query_id").collect():
            why = caps.refusal(q.due, q.before)
            out.append((q.query_id, q.due, why))
            if why is None:
                caps = caps.after(q.due)
        one = spark.createDataFrame(out, f"query_id {kind}, due double, why string")
        said = one if said is None else saved(said.unionByName(one), "said")
    if not states:
        return (spark.createDataFrame([], f"query_id {kind}, due double, why string") if said is None else said), caps
    whole = dealt.join(F.broadcast(spark.createDataFrame(states, "range int, day double, session_day double")), "range")
    test = caps.refusals(due, before, F.col("day"), F.col("session_day"))
    decided = whole.select("query_id", "due", test.alias("why"))
    return (decided if said is None else decided.unionByName(said)), caps
