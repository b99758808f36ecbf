"""A retrieval benchmark over chat sessions, which can be resumed.

Each question has sessions of its own, which become a small index of its own under names that say nothing about the answer. A
run's folder holds its settings, which another run must share, the finished questions and a summary."""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.config import Config
from lantern.functions.text import blind_name, content_hash, session_markdown
from lantern.operators import evaluate
from lantern.plans import answer, search, store
from lantern.scratch import saved
from lantern.sources import files

DONE = "question_id string, kind string, gold array<string>, search array<string>, recall array<string>, mode string, note string, question_kind string, pool long, widened boolean, usd double, tokens long, secs double, secs_index double"


class OtherSettings(ValueError):
    pass


class NotScored(RuntimeError):
    """A question that the scorer did not rank says nothing about it."""


def sessions(dataset: DataFrame) -> DataFrame:
    """question_id, path, title, body of every session, under its blind name."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    each = dataset.select("question_id", F.explode(zipped).alias("s"))
    name = blind_name(F.col("question_id"), F.col("s.id"))
    return each.select("question_id", F.concat(name, F.lit(".md")).alias("path"), name.alias("title"), session_markdown(name, F.col("s.date"), F.col("s.turns")).alias("body"))


def gold(dataset: DataFrame) -> DataFrame:
    """question_id, gold: the blind paths of the sessions that hold the answer."""
    names = F.transform("answer_session_ids", lambda s: F.concat(blind_name(F.col("question_id"), s), F.lit(".md")))
    return dataset.select("question_id", F.array_sort(F.array_distinct(names)).alias("gold"))


def _pinned(spark: SparkSession, path: str, settings: dict) -> None:
    """Write the settings of a new run, or refuse those of another."""
    fs, p = store._fs(spark, path)
    said = json.dumps(settings, sort_keys=True)
    if fs.exists(p):
        there = "".join(r[0] for r in spark.read.text(path).collect())
        if there != said:
            raise OtherSettings(f"{path} has other settings: {there}, not {said}; use a new folder")
        return
    out = fs.create(p, False)
    out.write(bytearray(said.encode()))
    out.close()


def run(spark: SparkSession, c: Config, s: search.Settings, data: str, out: str, n: int, seed: int = 0, include_abstention: bool = False, max_usd: float = 1.0, depth: int = 10) -> dict:
    """Ask a stratified sample of n questions, but for those that are done; the summary over all that are. No question begins
    once max_usd is spent, by earlier runs of the folder as well."""
    _pinned(spark, f"{out}/run.json", {"data": data.rsplit("/", 1)[-1], "n": n, "seed": seed, "include_abstention": include_abstention, "scorer": c.scorer, "question_kinds": c.question_kinds, "search": {k: v for k, v in asdict(s).items()}})
    dataset = saved(files.read_dataset(spark, data), "dataset")
    pool = dataset.select("question_id", F.col("question_type").alias("kind"))
    picked = saved(evaluate.stratified_sample(pool if include_abstention else evaluate.answerable(pool), n, seed), "picked")
    rows = f"{out}/rows"
    done = files.read_rows(spark, rows, DONE).join(picked.select("question_id"), "question_id", "left_semi")
    finished = {r.question_id for r in done.select("question_id").collect()}
    spent = done.agg(F.sum("usd")).first()[0] or 0.0
    for r in picked.orderBy("question_id").collect():
        if r.question_id in finished:
            continue
        if spent >= max_usd:
            break
        row = _one(spark, c, s, dataset.filter(F.col("question_id") == r.question_id), r.kind, f"{out}/haystacks/{r.question_id}", depth)
        spent += row[DONE.split(", ").index("usd double")]
        files.append_json(spark.createDataFrame([row], DONE), rows)
    return summary(files.read_rows(spark, rows, DONE).join(picked.select("question_id"), "question_id", "left_semi"))


def _one(spark: SparkSession, c: Config, s: search.Settings, question: DataFrame, kind: str, at: str, depth: int) -> tuple:
    began = time.monotonic()
    docs = sessions(question).select("path", F.lit(at).alias("root"), content_hash(F.col("body")).alias("hash"), "title", F.lit("").alias("extra"), "body")
    store.build(docs, at, s)
    index, indexed = store.load(spark, at, s.model), time.monotonic() - began
    # only what is shaped like a question is scored
    q = F.rtrim("question")
    asked = saved(question.select(F.lit(0).cast("long").alias("query_id"), F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?"))).alias("q")), "asked")
    first = [r.path for r in search.hybrid(asked, index, depth, s).orderBy("rank").collect()]
    hits, log = answer.recall(asked, index, c, s, depth, caller="eval")
    ranked, said = [r.path for r in hits.orderBy("rank").collect()], log.first()
    name, own = question.select("question_id").first()[0], gold(question).first().gold
    if not said["mode"].startswith("rerank"):
        raise NotScored(f"{name}: {said['mode']}, {said.note}")
    return (name, kind, own, first, ranked, said["mode"], said.note, said.kind, int(said.pool), said.widened, said.usd, int(said.tokens), said.secs, round(indexed, 1))


def summary(rows: DataFrame) -> dict:
    found = [r.asDict() for r in evaluate.benchmark_summary(rows).collect()]
    whole = next((r for r in found if r["kind"] is None), {"n": 0})
    return {k: v for k, v in whole.items() if k != "kind"} | {"by_kind": {r["kind"]: {k: v for k, v in r.items() if k != "kind"} for r in found if r["kind"] is not None}}
