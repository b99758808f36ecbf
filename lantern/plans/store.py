"""A stored index of immutable segments, and its incremental maintenance.

A build writes one segment with what is new or changed: its documents, terms, postings, signatures, vectors, and what it takes
away from the segments before it: paths whose rows there count no more, paths whose vectors do not, the shard and number of
documents that are dead in the postings, and the change of document frequencies, which may be negative. Frequencies are sums
over segments. A row is live if no later segment takes its path away. Small segments at the end are merged as they come to weigh
as much as the one before them, so there are few, and a document is rewritten a few times in its life, however many builds
there are; a build that leaves more dead rows than live ones rewrites the whole.

After its segment a build writes a small file that names the version's segments. Such files are only added; readers take the
newest, so there is an index at every moment, whenever a build may stop. Segments that neither of the last two versions names are
removed by the next build. Only one build of an index runs at a time."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import time
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import embedders
from lantern.functions.text import embedding_texts, fixed_chunks, plain_words
from lantern.functions.vectors import mean_vectors
from lantern.operators import grams, keyword, maintain, postings
from lantern.plans import search
from lantern.scratch import saved, scratch_path
from lantern.shipping import ship

#: Seconds after which the lock of a build on a store without file locks counts as left behind.
LEASE = 12 * 3600
DOCS = "path string, root string, hash string, title string, body string, text string, kind string, date string, words int, embedded boolean, indexed_at timestamp"


class IndexMismatch(RuntimeError):
    pass


class Locked(RuntimeError):
    pass


# --- versions ---------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the files that name versions, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("current-") and n.endswith(".json"))


def read_meta(spark: SparkSession, path: str) -> dict | None:
    names = _pointers(spark, path)
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/{names[-1]}").collect())) if names else None


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """The file gets its name when it is whole."""
    number = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    fs, part = _fs(spark, f"{path}/_{number}.tmp")
    out = fs.create(part)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    if not fs.rename(part, _fs(spark, f"{path}/current-{number}.json")[1]):
        raise OSError(f"the new version of {path} could not be named")


def _prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    names = _pointers(spark, path)
    kept = {s["id"] for n in names[-keep:] for s in json.loads("".join(r[0] for r in spark.read.text(f"{path}/{n}").collect()))["segments"]}
    for name in names[:-keep]:
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, False)
    fs, p = _fs(spark, path)
    for s in fs.listStatus(p):
        if s.isDirectory() and s.getPath().getName().startswith("s-") and s.getPath().getName() not in kept:
            fs.delete(s.getPath(), True)


@contextlib.contextmanager
def _alone(spark: SparkSession, path: str) -> Iterator[None]:
    """One build at a time: by a lock on a file beside the index, or, on a store without such locks, by a file that only one
    can create."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs, lock = _fs(spark, f"{path}/.lock")
    if fs.getScheme() == "file":
        with open(os.path.join(fs.resolvePath(p).toUri().getPath(), ".lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise Locked(f"another build of {path} is running") from e
            yield
        return
    if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > LEASE:
        fs.delete(lock, False)
    if not fs.createNewFile(lock):
        raise Locked(f"another build of {path} is running")
    try:
        yield
    finally:
        fs.delete(lock, False)


# --- segments ---------------------------------------------------------------------------------------------------

#: The tables of a segment. `removed` and `unvectored` hold paths that it takes away from the segments before it.
TABLES = {
    "docs": DOCS + ", block bigint, signature binary",
    "terms": "path string, dl bigint, terms array<string>, tf_title array<int>, tf_body array<int>, shard bigint, ord int",
    "postings": "term string, shard bigint, first int, last int, most float, shortest int, ords array<int>, counts array<float>, lengths array<int>",
    "vocabulary": "term string, n bigint",
    "doc_vectors": "path string, embedding array<double>",
    "sections": "path string, section int, embedding array<double>",
    "removed": "path string",
    "unvectored": "path string",
    "dead": "shard bigint, ord int",
}
#: Which table of paths takes rows of a table away.
LIVE_BY = {"docs": "removed", "terms": "removed", "doc_vectors": "unvectored", "sections": "unvectored"}
OPTIONS = {"docs": grams.WRITE, "postings": postings.PAGE, "vocabulary": postings.PAGE}
#: A segment joins the ones after it once they have this share of its rows together.
MERGE = 1 / 3


def _read(spark: SparkSession, path: str, segment: dict, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{segment['id']}/{name}")


def _all(spark: SparkSession, path: str, segments: list[dict], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_read(spark, path, s, name).withColumn("segment", F.lit(i)) for i, s in enumerate(segments)])


def live(spark: SparkSession, path: str, segments: list[dict], name: str) -> DataFrame:
    """The rows of a table that no later segment takes away."""
    rows, by = _all(spark, path, segments, name), LIVE_BY[name]
    if not any(s[by] for s in segments[1:]):
        return rows.drop("segment")
    taken = _all(spark, path, [s for s in segments], by).groupBy("path").agg(F.max("segment").alias("upto"))
    return rows.join(taken, "path", "left").filter(F.col("upto").isNull() | (F.col("segment") >= F.col("upto"))).drop("segment", "upto")


def _index(spark: SparkSession, path: str, meta: dict) -> search.Index:
    own = meta["segments"]
    known = _all(spark, path, own, "vocabulary").drop("segment")
    if len(own) > 1:
        known = known.groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0")
    dead = _all(spark, path, own, "dead").drop("segment") if any(s["dead"] for s in own) else None
    shards = postings.Shards(_all(spark, path, own, "postings").drop("segment"), dead, meta["docs"], meta["words"], meta["postings"])
    docs, terms, vectors, sections = (live(spark, path, own, n) for n in ("docs", "terms", "doc_vectors", "sections"))
    # of all blocks, as the row that holds a block's signature may be dead
    signatures = grams.signatures_of(_all(spark, path, own, "docs"))
    return search.Index(docs.drop("signature"), terms, known, vectors, sections, shards, signatures)


def load(spark: SparkSession, path: str, model: str | None = None) -> search.Index:
    """The newest version; `model`, if given, must be the one that it was built with."""
    meta = read_meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no index at {path}; build it first")
    if model and meta["model"] != model:
        raise IndexMismatch(f"the index was built with {meta['model']}, not {model}")
    ship(spark)
    return _index(spark, path, meta)


def _write(spark: SparkSession, path: str, tables: dict[str, DataFrame | None]) -> dict:
    """Write a segment; what the version's file says of it. postings are made of terms, as these are written."""
    name = f"s-{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"
    for table, schema in TABLES.items():
        at = f"{path}/{name}/{table}"
        rows = keyword.shard_rows(spark.read.schema(TABLES["terms"]).parquet(f"{path}/{name}/terms")) if table == "postings" else tables.get(table)
        # an empty table is written in one part, so that there is always something to read
        (spark.createDataFrame([], schema).coalesce(1) if rows is None else rows).write.options(**OPTIONS.get(table, {})).parquet(at)
    out = {"id": name}
    out["docs"], out["words"], out["postings"] = (x or 0 for x in _read(spark, path, out, "terms").agg(F.count("*"), F.sum("dl"), F.sum(F.size("terms"))).first())
    for table in ("removed", "unvectored", "dead"):
        out[table] = _read(spark, path, out, table).count()
    return out


def _version(spark: SparkSession, path: str, segments: list[dict], s: search.Settings) -> dict:
    """Merge what is to be merged, name the version's segments, and clear up."""
    first = len(segments) - 1
    rows = segments[-1]["docs"] if segments else 0
    while first > 0 and rows >= MERGE * segments[first - 1]["docs"]:
        first -= 1
        rows += segments[first]["docs"]
    dead = sum(x["dead"] for x in segments)
    if 2 * dead > sum(x["docs"] for x in segments):
        first = 0
    if len(segments) - first > 1:
        own, whole = segments[first:], first == 0
        tables: dict[str, DataFrame | None] = {n: live(spark, path, own, n) for n in LIVE_BY}
        tables["docs"] = grams.signed(tables["docs"].drop("block", "signature"))
        tables["terms"] = postings.sharded(tables["terms"])
        known = _all(spark, path, own, "vocabulary").groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0")
        tables["vocabulary"] = keyword.sorted_vocabulary(known)
        if not whole:
            for n in ("removed", "unvectored"):
                tables[n] = _all(spark, path, own, n).select("path").distinct()
            # of the shards that stay
            before = _all(spark, path, segments[:first], "terms").select("shard").distinct()
            tables["dead"] = _all(spark, path, own, "dead").drop("segment").join(before, "shard", "left_semi")
        segments = [*segments[:first], _write(spark, path, tables)]
    now = {n: 0 for n in ("docs", "words", "postings")}
    if segments:
        rows = live(spark, path, segments, "terms").agg(F.count("*"), F.sum("dl"), F.sum(F.size("terms"))).first()
        now = {n: x or 0 for n, x in zip(now, rows, strict=True)}
    meta = {"segments": segments, "model": s.model, "dim": s.dim} | now
    _write_meta(spark, path, meta)
    _prune(spark, path)
    return meta


# --- building ---------------------------------------------------------------------------------------------------


def _vectors(todo: DataFrame, s: search.Settings, at: str, allow_local: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """doc_vectors, sections, and the paths whose vectors are all there (null: of all)."""
    if embedders.hash_dim(s.model) is not None:
        return search.document_vectors(todo, s), search.section_vectors(search.section_rows(todo, s), s), None
    chunks = todo.select("path", F.lit(None).cast("int").alias("section"), F.explode(embedding_texts(F.col("title"), fixed_chunks(F.col("body"), s.chunk_words), F.col("summary"))).alias("text"))
    sections = search.section_rows(todo, s).select("path", "section", F.concat("title", F.lit(" > "), "hpath", F.lit("\n"), "text").alias("text"))
    texts = chunks.unionByName(sections)
    if allow_local:
        # smallest documents first, as far as their texts fit what the local model is allowed
        size = texts.groupBy("path").agg(F.count("*").alias("texts")).join(todo.select("path", F.length("body").alias("size")), "path")
        texts = texts.join(maintain.budgeted(size, allow_local).select("path", F.col("fits").alias("local")), "path")
    keyed = texts.withColumn("key", F.struct("path", "section"))
    embedders.embedded(keyed, "key", "text", s.model, s.embed_options).select("key.path", "key.section", "embedding").write.parquet(f"{at}/_texts")
    each = todo.sparkSession.read.parquet(f"{at}/_texts")
    done = todo.select("path").join(each.filter("embedding is null").select("path").distinct(), "path", "left_anti")
    whole = each.join(done, "path", "left_semi")
    return mean_vectors(whole.filter("section is null"), "path", "embedding"), whole.filter("section is not null"), done


def build(docs: DataFrame, path: str, s: search.Settings = search.Settings(), full: bool = False, embed: bool = True, allow_local: int = 0, listed: DataFrame | None = None) -> dict:
    """Bring the index at path up to docs (path, root, hash, title, extra, summary, body, text, kind, date): indexed, removed,
    total, pending.

    Documents that did not change are neither parsed nor written again. Without `embed`, or while the embedding service is down,
    new and changed documents can be found by words alone and wait; a changed one keeps its old vectors. `allow_local`: texts
    that a local model may embed while the service is down. `listed`: the paths that there are, if docs are some of them only."""
    ship(docs.sparkSession)
    embedders.check(s.model)
    with _alone(docs.sparkSession, path):
        return _build(docs, path, s, full, embed, allow_local, listed)


def _build(docs: DataFrame, path: str, s: search.Settings, full: bool, embed: bool, allow_local: int, listed: DataFrame | None) -> dict:
    spark = docs.sparkSession
    meta = None if full else read_meta(spark, path)
    if meta and (meta["model"], meta["dim"]) != (s.model, s.dim):
        raise IndexMismatch(f"the index was built with {meta['model']} ({meta['dim']}), not {s.model} ({s.dim})")
    segments = meta["segments"] if meta else []
    old = _index(spark, path, meta) if segments else None

    given = lambda c: F.col(c) if c in docs.columns else F.lit("")
    indexed = F.concat_ws(" ", "title", F.nullif(given("extra"), F.lit("")))
    rows = docs.select("path", "root", "hash", "title", indexed.alias("indexed"), given("summary").alias("summary"), "body", (F.col("text") if "text" in docs.columns else F.col("body")).alias("text"), given("kind").alias("kind"), given("date").alias("date"), F.size(plain_words(F.col("body"))).alias("words"))
    known = old.docs.select("path", "hash", "embedded") if old else spark.createDataFrame([], "path string, hash string, embedded boolean")
    # written, so that a lost executor doesn't read a file again that has changed since; a row's hash is that of its own text
    diff = maintain.index_diff(known, docs.select("path", "hash"))
    if listed is not None:
        diff = diff.filter("status <> 'gone'").unionByName(known.join(listed.select("path"), "path", "left_anti").select("path", F.lit("gone").alias("status")))
    diff = saved(diff, "diff")
    fresh = diff.filter("status in ('new', 'changed')").select("path")
    counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    done = None
    if counts.get("new", 0) + counts.get("changed", 0) + counts.get("gone", 0) or not meta:
        todo = saved(rows.join(fresh, "path", "left_semi"), "todo")
        scratch = scratch_path(spark, "texts")
        vectors, sections, done = _vectors(todo, s, scratch, allow_local) if embed else (None, None, spark.createDataFrame([], "path string"))
        ready = F.lit(True) if done is None else F.coalesce("ready", F.lit(False))
        stamped = todo if done is None else todo.join(done.withColumn("ready", F.lit(True)), "path", "left")
        stamped = stamped.withColumn("embedded", ready).withColumn("indexed_at", F.current_timestamp())
        names = [x.split()[0] for x in DOCS.split(", ")]
        forward = keyword.forward(todo, title="indexed")
        tables: dict[str, DataFrame | None] = {"docs": grams.signed(stamped.select(*names)), "terms": postings.sharded(forward), "doc_vectors": vectors, "sections": sections}
        each = forward.select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
        if old:
            # what waits for vectors keeps those that it had
            gone, changed = (diff.filter(F.col("status") == x).select("path") for x in ("gone", "changed"))
            tables["removed"] = gone.unionByName(changed)
            tables["unvectored"] = gone.unionByName(changed if done is None else changed.join(done, "path", "left_semi"))
            lost = saved(old.terms.join(tables["removed"], "path", "left_semi").select("shard", "ord", "terms"), "lost")
            before = _all(spark, path, segments, "dead").drop("segment")
            tables["dead"] = lost.select("shard", "ord").join(before, ["shard", "ord"], "left_anti")
            each = each.unionByName(lost.select(F.explode("terms").alias("term"), F.lit(-1).alias("n")))
        tables["vocabulary"] = keyword.sorted_vocabulary(each.groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0"))
        meta = _version(spark, path, [*segments, _write(spark, path, tables)], s)
    now = _index(spark, path, meta)
    out = {"indexed": counts.get("new", 0) + counts.get("changed", 0), "removed": counts.get("gone", 0), "total": now.docs.count(), "pending": now.docs.filter(~F.col("embedded")).count()}
    if embed and done is not None and out["pending"]:
        out["service"] = "down"
    return out
