"""Answer-aware recall with a plug-in scorer for a batch of questions: gate, budget, scores, one widening, records.

All questions of a batch are one plan: they are searched, admitted, scored and widened together, so the index is scanned as often
for ten thousand questions as for ten, but for the searches' own blocks. What is known of a question is a row of a table, not of
the driver. Questions are admitted in the order of their ids by their estimates and the spend so far (`admission`); what was
really spent counts from the second pass on. A question that fails keeps its first order; what was paid is recorded all the
same, and records that can't be written are a note on the result."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.config import Config
from lantern.functions.text import is_question
from lantern.operators import admission, ledger, rerank, scorers
from lantern.plans import search
from lantern.scratch import saved
from lantern.sources import files

FAILED = "first-stage (reranker unavailable)"
HITS = "query_id {0}, path string, score double, section string, passage string, rank int, mode string, note string, kind string, date string"
#: What a pass of scoring says of a question.
SAID = "due double, why string, tokens long, usd double, note string, kind string, fell string, secs double"


def caps_of(c: Config, rows: DataFrame, caller: str, session: str | None) -> admission.Caps:
    """The caps of the configuration, with the spend of the last day from a ledger."""
    recent = rows.filter((F.col("ts") >= F.current_timestamp() - F.expr("interval 24 hours")) & (ledger.caller_of(F.col("caller")) == caller))
    day, own = recent.agg(F.coalesce(F.sum("usd"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("session") == F.lit(session), F.col("usd"))), F.lit(0.0))).first()
    return admission.Caps(c.max_usd_per_query, c.eval_daily_cap_usd if caller == "eval" else c.daily_cap_usd, caller, session, c.session_share_frac, day, own)


@dataclass(frozen=True)
class Pass:
    """One round of scoring: the windows of files, the scores (query_id, path, ord, score), what is said of each question
    (query_id and SAID), and the caps after it."""

    windows: DataFrame
    scores: DataFrame
    said: DataFrame
    caps: admission.Caps

    @property
    def done(self) -> DataFrame:
        """query_id, kind of the questions that were scored."""
        return self.said.filter("why is null and note is null and tokens is not null").select("query_id", "kind")


def scored(c: Config, scorer: scorers.Scorer, index: search.Index, asks: DataFrame, wanted: DataFrame, caps: admission.Caps, kinds: bool, max_windows: int) -> Pass:
    """Score the windows of wanted files (query_id, path) for asks (query_id, q, before: usd so far, kind)."""
    docs = index.docs.join(wanted.select("path").distinct(), "path", "left_semi")
    windows = saved(rerank.file_windows(docs, scorer.window_words, max_windows), "windows")
    asked = asks.select("query_id", "q")
    pairs = wanted.select("query_id", "path").join(asked, "query_id").join(windows, "path")
    if scorer.prefilter_per_file:
        cut = rerank.prefilter(rerank.lexical_scores(asked, wanted, rerank.window_terms(windows)), scorer.prefilter_per_file)
        pairs = pairs.join(cut.select("query_id", "path", "ord"), ["query_id", "path", "ord"], "left_semi")
    pairs, price = saved(pairs, "pairs"), float(scorer.usd_per_token)
    more = (F.length("q") + 900) / 3 if kinds else F.lit(0.0)
    due = scorers.estimates(pairs, scorer, c.scorer).withColumnRenamed("tokens", "estimate").join(asks, "query_id")
    due = saved(due.select("query_id", "estimate", ((F.col("estimate") + more) * price).alias("due"), "before", "kind"), "estimates")
    verdicts, after = admission.admit(due, caps)
    verdicts = saved(verdicts, "verdicts")
    let = verdicts.filter("why is null").select("query_id").join(due.select("query_id", "kind"), "query_id")
    found = saved(scorers.score_windows(pairs.join(let, "query_id"), c.scorer, kinds), "scored")
    # a row a question; a scorer that doesn't say what it was billed is taken to be billed its estimate
    rows = found.filter("tokens is not null").select("query_id", F.col("tokens").alias("billed"), "note", "kind", F.col("fell_back").alias("fell"), "secs")
    said = verdicts.join(rows, "query_id", "left").join(due.select("query_id", "estimate"), "query_id")
    billed = F.when(F.col("billed") > 0, F.col("billed")).when(F.col("billed").isNotNull(), F.when(F.col("note").isNull() & F.lit(price > 0), F.col("estimate")).otherwise(0))
    said = said.withColumn("tokens", billed.cast("long"))
    said = saved(said.select("query_id", "due", "why", "tokens", (F.col("tokens") * price).alias("usd"), "note", "kind", "fell", "secs"), "said")
    real = said.agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0]
    return Pass(windows, found.select("query_id", "path", "ord", "score"), said, caps.after(real))


def spend_rows(said: DataFrame, scorer: scorers.Scorer, caller: str, session: str | None) -> DataFrame:
    """A ledger's rows of a pass."""
    return said.filter("tokens > 0").select(F.lit(time.time()).alias("ts"), F.lit(os.getpid()).alias("pid"), F.lit(scorer.name).alias("backend"), "tokens", "usd", F.lit(caller).alias("caller"), F.lit(session).cast("string").alias("session"))


def recall(queries: DataFrame, index: search.Index, c: Config, s: search.Settings, top: int = 5, caller: str = "live", session: str | None = None, rerank_: bool = True, record: bool = True) -> tuple[DataFrame, DataFrame]:
    """The best `top` files of each query (query_id, q), as in HITS, and a log row a query. With `record`, spend goes to the
    ledger and the log rows to the recall log."""
    began, backend = time.monotonic(), c.scorer.get("backend", "lexical")
    shaped = is_question(F.col("q")) if c.question_gate else F.lit(True)
    mode = F.lit("first-stage") if not rerank_ else F.when(~shaped, "keyword").otherwise("first-stage" if backend == "none" else f"rerank:{backend}")
    asked = saved(queries.select("query_id", "q", mode.alias("mode")), "asked")
    queries = asked.select("query_id", "q")
    found = search.legs(queries, index, max(s.widen_k, s.k), s)
    found = search.Legs(saved(found.words, "words"), saved(found.docs, "near"), saved(found.sections, "near"), found.long_paths)
    first = saved(search.fused(found, s.k, s), "first")
    pool = saved(search.pool_of(queries, index, first, s), "pool")
    asks = asked.filter(F.startswith("mode", F.lit("rerank"))).select("query_id", "q", F.lit(0.0).alias("before"), F.lit(None).cast("string").alias("kind"))
    own = pool.join(asks.select("query_id"), "query_id", "left_semi")

    one = two = best = scorer = None
    wide, windows, widen_at, failed = own, None, s.widen_at, None
    if not asks.isEmpty():
        try:
            scorer = scorers.load(c.scorer)
        except Exception as e:  # whatever a plug-in raises, the queries must be answered
            failed = f"{type(e).__name__}: {str(e)[:200]}"
    if scorer is not None:
        widen_at = scorer.widen_at if c.widen_at == "auto" else float(c.widen_at)
        one = scored(c, scorer, index, asks, own, caps_of(c, files.read_ledger(asks.sparkSession, c.ledger, days=2), caller, session), c.question_kinds, s.max_windows)
        best, windows = saved(rerank.best_windows(one.scores.fillna({"score": 0.0})), "best"), one.windows
        tops = best.groupBy("query_id").agg(F.max("score").alias("top"))
        unsure = (F.coalesce("top", F.lit(0.0)) < widen_at) | F.coalesce(F.col("kind").isin(c.widen_kinds), F.lit(False))
        call = saved(one.done.join(tops, "query_id", "left").filter(unsure).select("query_id", "kind"), "unsure")
        if s.widen_k > s.k and not call.isEmpty():
            two, more = _widened(one, scorer, found, index, asks, own, call, c, s)
            new = two.done.select("query_id")
            best = best.unionByName(rerank.best_windows(two.scores.join(new, "query_id", "left_semi").fillna({"score": 0.0})))
            wide = own.unionByName(more.join(new, "query_id", "left_semi"))
            windows = windows.unionByName(two.windows).dropDuplicates(["path", "ord"])
    states = saved(_states(asked, one, two, failed), "states")
    hits = saved(_hits(pool, wide, best, windows, index, states, top), "hits")
    secs = (time.monotonic() - began) / max(1, states.count())
    log = saved(_log(hits, first, wide, pool, states, widen_at, secs, caller, session), "log")
    if record:
        batch = uuid.uuid4().hex
        spends = [spend_rows(p.said, scorer, caller, session) for p in (one, two) if p is not None]
        wrongs = [_kept(spends[0] if len(spends) == 1 else spends[0].unionByName(spends[1]), c.ledger, F.timestamp_seconds("ts"), batch, "ledger") if spends else None, _kept(log, c.recall_log, F.col("ts"), batch, "recall log")]
        for why in filter(None, wrongs):
            noted = F.concat_ws("; ", "note", F.lit(why))
            hits, log = hits.withColumn("note", noted), log.withColumn("note", noted)
    return hits, log


def _kept(rows: DataFrame, path: str, at: Column, batch: str, name: str) -> str | None:
    """Append records; what went wrong, as the answer stands without them."""
    try:
        files.append_rows(rows, path, at, batch)
    except Exception as e:
        return f"the {name} could not be written: {type(e).__name__}: {str(e).splitlines()[0][:120] if str(e) else path}"
    return None


def _widened(one: Pass, scorer: scorers.Scorer, found: search.Legs, index: search.Index, asks: DataFrame, own: DataFrame, call: DataFrame, c: Config, s: search.Settings) -> tuple[Pass, DataFrame]:
    """A pass over the files of a larger first stage that the pool lacks, and these files (query_id, path, pos)."""
    size = own.groupBy("query_id").agg(F.max("pos").alias("n"))
    more = search.fused(found, s.widen_k, s).join(call, "query_id", "left_semi").join(own, ["query_id", "path"], "left_anti").join(size, "query_id")
    more = saved(more.select("query_id", "path", (F.col("n") + F.col("rank")).cast("int").alias("pos")), "more")
    again = asks.select("query_id", "q").join(call, "query_id").join(one.said.select("query_id", F.col("usd").alias("before")), "query_id")
    caps = replace(one.caps, ceiling=1.0 - c.widen_reserve_frac)
    return scored(c, scorer, index, again, more, caps, False, s.max_windows), more


def _states(asked: DataFrame, one: Pass | None, two: Pass | None, failed: str | None) -> DataFrame:
    """query_id, q, mode, note, widened, usd, tokens, secs, kind: what came of each question."""
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SAID.split(", ")]
    side = lambda p, name: (p.said.select("query_id", F.struct(*[x.split()[0] for x in SAID.split(", ")]).alias(name)) if p is not None else asked.select("query_id", F.struct(*none).alias(name)))
    both = asked.join(side(one, "a"), "query_id", "left").join(side(two, "b"), "query_id", "left")
    scored_ = F.col("a.why").isNull() & F.col("a.note").isNull() & F.col("a.tokens").isNotNull()
    fell = F.coalesce(F.nullif("a.fell", F.lit("")), F.nullif("b.fell", F.lit("")))
    asks = F.startswith("mode", F.lit("rerank"))
    late = lambda c: F.concat(F.lit("widen skipped: "), F.col(c))
    notes = F.concat_ws("; ", F.when(asks, F.lit(failed).cast("string")), "a.why", "a.note", late("b.why"), late("b.note"), F.concat(F.lit("the first route was down: "), fell))
    sums = lambda c, zero: F.coalesce(f"a.{c}", F.lit(zero)) + F.coalesce(f"b.{c}", F.lit(zero))
    mode = F.concat(F.when(asks & ~scored_, FAILED).otherwise(F.col("mode")), F.when(fell.isNotNull(), " (fallback)").otherwise(""))
    widened = F.coalesce(F.col("b.why").isNull() & F.col("b.note").isNull() & F.col("b.tokens").isNotNull(), F.lit(False))
    return both.select("query_id", "q", mode.alias("mode"), F.nullif(notes, F.lit("")).alias("note"), widened.alias("widened"), sums("usd", 0.0).alias("usd"), sums("tokens", 0).cast("long").alias("tokens"), sums("secs", 0.0).alias("secs"), F.coalesce("a.kind", "b.kind").alias("kind"))


def _hits(pool: DataFrame, wide: DataFrame, best: DataFrame | None, windows: DataFrame | None, index: search.Index, states: DataFrame, top: int) -> DataFrame:
    info = states.select("query_id", "mode", "note", F.startswith("mode", F.lit("rerank")).alias("scored"))
    plain = pool.join(info, "query_id").filter("not scored").select("query_id", "path", F.col("pos").cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("ord"), "mode", "note")
    if best is not None:
        own = wide.join(info, "query_id").filter("scored")
        ranked = rerank.ranked_files(best, own.select("query_id", "path", "pos"))
        plain = plain.unionByName(ranked.join(info, "query_id").select("query_id", "path", "rank", "score", "ord", "mode", "note"))
    cut = plain.filter(F.col("rank") <= top)
    if windows is not None:
        cut = cut.join(windows.select("path", "ord", "heading", "text"), ["path", "ord"], "left")
    else:
        cut = cut.withColumns({"heading": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    labelled = [c for c in ("kind", "date") if c in index.docs.columns]
    cut = cut.join(index.docs.select("path", *labelled), "path", "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in labelled else F.lit("")
    return cut.select("query_id", "path", "score", F.col("heading").alias("section"), F.when(F.col("rank") == 1, F.col("text")).alias("passage"), "rank", "mode", "note", given("kind").alias("kind"), given("date").alias("date"))


def _log(hits: DataFrame, first: DataFrame, wide: DataFrame, pool: DataFrame, states: DataFrame, widen_at: float, secs: float, caller: str, session: str | None) -> DataFrame:
    best = hits.filter("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))), lambda x: F.struct(x["path"].alias("path"), x["score"].alias("score"))).alias("top"))
    three = first.filter("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("first_stage_top3"))
    size = pool.groupBy("query_id").agg(F.count("*").alias("pool")).join(wide.groupBy("query_id").agg(F.count("*").alias("wide")), "query_id", "left").select("query_id", F.coalesce("wide", "pool").alias("pool"))
    info = states.withColumn("secs", F.greatest("secs", F.lit(secs)))
    both = info.join(best, "query_id", "left").join(three, "query_id", "left").join(size, "query_id", "left")
    at = F.when(F.startswith("mode", F.lit("rerank")), F.lit(float(widen_at)))
    return both.select(F.current_timestamp().alias("ts"), "q", "mode", "top", F.coalesce("pool", F.lit(0)).alias("pool"), "widened", F.round("usd", 6).alias("usd"), "tokens", F.round("secs", 2).alias("secs"), "note", "kind", "first_stage_top3", at.alias("widen_at"), F.lit(caller).alias("caller"), F.lit(session).cast("string").alias("session"), "query_id")


def logged(log: DataFrame) -> DataFrame:
    """A recall log's rows as `ledger.usage_report` takes them."""
    first = F.try_element_at("top", F.lit(1))
    compared = F.when(F.size("first_stage_top3") > 0, first["path"])
    return log.select("mode", first["score"].alias("top_score"), "widen_at", "widened", "usd", "secs", compared.alias("top1"), F.try_element_at("first_stage_top3", F.lit(1)).alias("first1"))


def percentile(values: list[float], share: float) -> float | None:
    """The order statistic at a share of the number of values; None without any."""
    return sorted(values)[min(len(values) - 1, int(len(values) * share))] if values else None
