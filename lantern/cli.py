"""Command line: init, index, search, recall, status, scorers, report, eval, benchmark, serve.

Exit codes: 0 done, 1 a benchmark question failed, 2 no configuration or wrong settings, 3 an evaluation was refused, 75 another
build is running."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern import config as settings
from lantern.functions import embedders
from lantern.operators import evaluate, ledger, maintain, scorers
from lantern.plans import answer, search, store
from lantern.scratch import saved
from lantern.sources import files


#: Characters of a passage that are shown, and questions that are timed.
PASSAGE, TIMED = 3000, 20


def session() -> SparkSession:
    return SparkSession.builder.appName("lantern").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def search_settings(c: settings.Config) -> search.Settings:
    names = ("chunk_words", "rrf_k", "keyword_weight", "vector_pool", "section_pool", "k", "widen_k", "rare_max_df", "max_windows")
    at = 0.5 if c.widen_at == "auto" else float(c.widen_at)
    return search.Settings(**{n: getattr(c, n) for n in names}, widen_at=at, model=c.embed_model, embed_options=c.embedding)


def one_query(spark: SparkSession, q: str) -> DataFrame:
    return spark.createDataFrame([(0, q)], "query_id long, q string")


def open_index(spark: SparkSession, c: settings.Config) -> search.Index:
    return store.load(spark, c.index, c.embed_model)


def build_index(spark: SparkSession, c: settings.Config, full: bool = False, allow_local: int = 0) -> dict:
    docs = files.documents(files.scan(spark, c.roots, c.extensions, c.exclude), c.labels)
    return store.build(docs, c.index, search_settings(c), full, allow_local=allow_local)


def recall(spark: SparkSession, c: settings.Config, queries: DataFrame, top: int = 5, caller: str = "live", rerank: bool = True) -> tuple[DataFrame, DataFrame]:
    own = os.environ.get("LANTERN_SESSION") or None
    return answer.recall(queries, open_index(spark, c), c, search_settings(c), top, caller, own, rerank)


# --- commands ---------------------------------------------------------------------------------------------------


def run_init(a: argparse.Namespace) -> int:
    """Here by default, as a configuration is found from any folder below; `--home` for all folders."""
    target = (Path.home() if a.home else Path.cwd()) / settings.NAME / "config.toml"
    if target.exists() and not a.force:
        print(f"{target} is there already; --force writes it anew", file=sys.stderr)
        return 1
    text = settings.TEMPLATE
    if a.root:
        text = re.sub(r"(?m)^roots = .*$", lambda _: "roots = " + json.dumps([str(Path(r).expanduser().resolve()) for r in a.root]), text, count=1)
    if a.backend:
        text = re.sub(r"(?m)^backend = .*$", lambda _: "backend = " + json.dumps(a.backend), text, count=1)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    print(f"wrote {target}")
    return 0


def run_scorers(a: argparse.Namespace) -> int:
    for k, v in scorers.available().items():
        print(f"{k:15} {v}")
    return 0


def run_index(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    try:
        print(json.dumps(build_index(spark, c, a.full, a.allow_local)))
    except store.Locked as e:
        print(e, file=sys.stderr)
        return 75
    return 0


def run_search(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    found = search.hybrid(one_query(spark, a.query), open_index(spark, c), a.k, search_settings(c)).orderBy("rank").collect()
    print(json.dumps([[r.path, round(r.score, 5)] for r in found]) if a.json else "\n".join(f"{r.score:.5f}  {r.path}" for r in found))
    return 0


def shown_answer(query: str, rows: list, said) -> dict:
    """An answer as one document."""
    labels = lambda r: {k: v for k, v in (("type", r.kind), ("date", r.date)) if r.kind}
    return {
        "query": query, "mode": said["mode"], "pool": said.pool, "widened": said.widened, "usd": said.usd, "tokens": said.tokens, "secs": said.secs, "note": said.note, "kind": said.kind,
        "reranked": said["mode"].startswith("rerank"), "warning": skipped(said), "results": [{"path": r.path, "score": r.score, "section": r.section} | labels(r) for r in rows], "passage": (rows[0].passage or "") if rows else "",
    }


def skipped(said) -> str:
    """A warning that a question which should have been scored was not."""
    return f"! NOT RERANKED ({said.note or 'no reason given'}): this is the first stage's order; check before citing" if said["mode"].startswith(answer.FAILED) else ""


def run_recall(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    if a.backend:
        c.scorer = {**c.scorer, "backend": a.backend}
    if a.k:
        c.k = a.k
    hits, log = recall(spark, c, one_query(spark, a.query), a.top, rerank=not a.no_rerank)
    rows, said = hits.orderBy("rank").collect(), log.first()
    warning = skipped(said)
    if warning:
        print(warning, file=sys.stderr)
    if a.json:
        print(json.dumps(shown_answer(a.query, rows, said)))
        return 0
    if warning:
        print(warning)
    for r in rows:
        label = f"  [{' · '.join(filter(None, [r.kind, r.date]))}]" if r.kind else ""
        print(f"{'-' if r.score is None else f'{r.score:.2f}'}  {r.path}{label}" + (f"\n      § {r.section[:100]}" if r.section else ""))
    sure = bool(rows) and rows[0].score is not None and rows[0].score >= (said.widen_at or 0)
    if sure and rows[0].passage and not a.no_passage:
        cut = " … (cut; open the file)" if len(rows[0].passage) > PASSAGE else ""
        print(f"\n--- {rows[0].path} ---\n{rows[0].passage[:PASSAGE]}{cut}")
    parts = [said["mode"], f"{said.pool} files", f"${said.usd:.4f}", f"{said.secs:.1f} s", said.kind, "widened" if said.widened else "", said.note]
    print(", ".join(filter(None, parts)), file=sys.stderr)
    if rows and rows[0].score is not None and not sure:
        print("low confidence: no file clearly states the answer", file=sys.stderr)
    return 0


def run_status(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    index = open_index(spark, c)
    out = maintain.statistics(index.docs, index.sections).first().asDict() | {"embedding": c.embed_model}
    out["spend"] = ledger.summary(files.read_ledger(spark, c.ledger), F.current_timestamp()).first().asDict()
    out["caps"] = {"per_query_usd": c.max_usd_per_query, "daily_usd": c.daily_cap_usd, "eval_daily_usd": c.eval_daily_cap_usd}
    out["scorers"] = sorted(scorers.available())
    print(json.dumps(out))
    return 0


def report(spark: SparkSession, c: settings.Config, days: float) -> dict:
    log = files.read_log(spark, c.recall_log).filter(F.col("ts") >= F.current_timestamp() - F.make_interval(secs=F.lit(days * 86400)))
    rows = answer.logged(log)
    modes = {r["mode"]: r["count"] for r in rows.groupBy("mode").count().orderBy("mode").collect()}
    return {"days": days} | ledger.usage_report(rows).first().asDict() | {"modes": modes}


def run_report(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    print(json.dumps(report(spark, c, a.days)))
    return 0


def run_eval(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    if not a.first_stage and not c.eval_daily_cap_usd:
        print("evaluations are refused while eval_daily_cap_usd is 0", file=sys.stderr)
        return 3
    if not a.first_stage and len(a.questions) > 1:
        print("several question files go with --first-stage only", file=sys.stderr)
        return 2
    asked, index, s = files.read_questions(spark, a.questions).orderBy("query_id"), open_index(spark, c), search_settings(c)
    asked = saved(asked.limit(a.limit) if a.limit else asked, "questions")
    known = saved(asked.select("query_id", F.explode("gold").alias("path")).join(index.docs.select("path"), "path", "left_semi"), "gold")
    print(json.dumps(first_stage(asked, known, index, s, a.top, a.depth) if a.first_stage else recall_totals(spark, c, asked, index, s, a.top, a.max_usd)))
    return 0


def first_stage(asked: DataFrame, known: DataFrame, index: search.Index, s: search.Settings, top: int, depth: int) -> dict:
    """Hits of the first stage over all questions with a gold file in the index, and the time of TIMED of them searched alone."""
    own = asked.join(known.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "q")
    ranks = evaluate.first_relevant(search.hybrid(own, index, depth, s), known, depth)
    out = evaluate.hit_rates(ranks, asked.count(), top, depth).first().asDict()
    times = []
    # a search alone takes its time whatever the question is, so a few questions tell
    for r in own.orderBy(F.xxhash64("query_id"), "query_id").limit(TIMED).collect():
        began = time.monotonic()
        search.hybrid(own.filter(F.col("query_id") == r.query_id), index, depth, s).collect()
        times.append(round(time.monotonic() - began, 3))
    return out | {"secs_median": answer.percentile(times, 0.5), "secs_p90": answer.percentile(times, 0.9)}


def recall_totals(spark: SparkSession, c: settings.Config, asked: DataFrame, index: search.Index, s: search.Settings, top: int, max_usd: float, block: int = 16) -> dict:
    """Hits of the first stage and of recall; no further block of questions begins once max_usd is spent."""
    ids, spent, parts = sorted(r.query_id for r in asked.select("query_id").collect()), 0.0, []
    for a in range(0, len(ids), block):
        if spent >= max_usd:
            print(f"stopped after {a} questions: ${spent:.4f} of ${max_usd:.2f} are spent", file=sys.stderr)
            break
        own = asked.filter(F.col("query_id").isin(ids[a : a + block])).select("query_id", "q")
        hits, log = answer.recall(own, index, c, s, top, "eval", os.environ.get("LANTERN_SESSION") or None)
        parts.append((saved(search.hybrid(own, index, max(top, 10), s), "base"), hits, log))
        spent += log.agg(F.sum("usd")).first()[0] or 0.0
    if not parts:
        return {"n": 0}
    base, hits, log = parts[0]
    for b, h, o in parts[1:]:
        base, hits, log = base.unionByName(b), hits.unionByName(h), log.unionByName(o)
    gold = asked.select("query_id", F.explode("gold").alias("path"))
    return evaluate.compared(base, hits, gold, log.select("query_id", "usd", "secs"), top).first().asDict()


def run_benchmark(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    from lantern.plans import benchmark

    try:
        print(json.dumps(benchmark.run(spark, c, search_settings(c), a.data, a.out, a.n, a.seed, a.include_abstention, a.max_usd)))
    except benchmark.OtherSettings as e:
        print(e, file=sys.stderr)
        return 2
    except benchmark.NotScored as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def run_serve(a: argparse.Namespace, spark: SparkSession, c: settings.Config) -> int:
    from lantern import server

    server.serve(server.Tools(spark, c), sys.stdin, sys.stdout)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("lantern", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("status", "scorers", "serve"):
        sub.add_parser(name)
    p = sub.add_parser("init")
    p.add_argument("--root", action="append", help="a folder of notes; may be given several times")
    p.add_argument("--backend", help="the scorer")
    p.add_argument("--home", action="store_true", help="for all folders, instead of this one")
    p.add_argument("--force", action="store_true", help="even if there is one")
    p = sub.add_parser("index")
    p.add_argument("--full", action="store_true")
    p.add_argument("--allow-local", type=int, default=0, help="texts that a local model may embed while the service is down")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("recall")
    p.add_argument("query")
    p.add_argument("--top", type=int, default=5)
    p.add_argument("-k", type=int, default=0, help="files of the first stage")
    p.add_argument("--backend", help="another scorer for this call")
    p.add_argument("--no-rerank", action="store_true")
    p.add_argument("--no-passage", action="store_true")
    p.add_argument("--json", action="store_true")
    sub.add_parser("report").add_argument("--days", type=float, default=7)
    p = sub.add_parser("eval")
    p.add_argument("questions", nargs="+")
    p.add_argument("--first-stage", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--depth", type=int, default=20)
    p.add_argument("--max-usd", type=float, default=1.0)
    p = sub.add_parser("benchmark")
    p.add_argument("out")
    p.add_argument("--data", required=True)
    p.add_argument("--n", type=int, default=50)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--include-abstention", action="store_true")
    p.add_argument("--max-usd", type=float, default=1.0)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    run = globals()[f"run_{a.command}"]
    if a.command in ("init", "scorers"):
        return run(a)
    try:
        c = settings.load()
        embedders.check(c.embed_model)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return run(a, session(), c)


if __name__ == "__main__":
    sys.exit(main())
