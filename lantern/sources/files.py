"""Files as tables: notes under roots, JSON lines, question files and benchmark datasets; and the sinks for them."""

from __future__ import annotations

import warnings
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.text import body_of, content_hash, excluded, frontmatter_text, html_to_text, parse_frontmatter, session_markdown, title_of
from lantern.operators.evaluate import document_label, first_date
from lantern.shipping import ship

FILES = "path string, root string, text string"
LEDGER = "ts double, pid int, backend string, tokens bigint, usd double, caller string, session string"
LOG = "ts timestamp, q string, mode string, top array<struct<path:string,score:double>>, pool bigint, widened boolean, usd double, tokens bigint, secs double, note string, kind string, first_stage_top3 array<string>, widen_at double, caller string, session string"
QUESTION = "q string, gold array<string>, ev array<string>"
DATASET = "question_id string, question_type string, question string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"


def _status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def _under(spark: SparkSession, files: DataFrame, root: str, several: bool, extensions: list[str] | None, exclude: list[str] | None) -> DataFrame | None:
    """rel, path, root and the other columns of files (where, a URI, ...) under a root with one of the extensions; None for a
    root that is not there."""
    status = _status(spark, root)
    if status is None:
        warnings.warn(f"root not found: {root}", stacklevel=3)
        return None
    top = status.getPath().toUri().getPath().rstrip("/")
    last = top.rsplit("/", 1)[-1]
    # paths come as URIs, so they are decoded before they are cut
    where = F.expr("url_decode(replace(where, '+', '%2B'))")
    rel = F.lit(last) if status.isFile() else F.regexp_replace(where, "^.*?" + _quoted(top) + "/", "")
    shown = F.concat(F.lit(last + "/"), rel) if several and not status.isFile() else rel
    named = files.select(rel.alias("rel"), shown.alias("path"), F.lit(root).alias("root"), *[c for c in files.columns if c != "where"])
    wanted = reduce(lambda a, b: a | b, [F.endswith(F.lower("rel"), F.lit(e.lower())) for e in extensions or [".md"]])
    return named.filter(wanted if status.isFile() else wanted & ~excluded(F.col("rel"), exclude or []))


def _binary(reader, root: str):
    return reader.option("recursiveFileLookup", "true").load(root)


def shown(spark: SparkSession, files: dict[str, DataFrame], extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, root, text of files (where, content) by root; see `scan`."""
    ship(spark)
    parts = [_under(spark, rows, root, len(files) > 1, extensions, exclude) for root, rows in files.items()]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], FILES)
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.lower("rel").rlike(r"\.html?$"), html_to_text(raw)).otherwise(raw)
    return reduce(DataFrame.unionByName, parts).select("path", "root", text.alias("text"))


def _there(spark: SparkSession, roots: list[str], columns: list) -> dict[str, DataFrame]:
    none = spark.createDataFrame([], "where string, content binary")
    return {r: none if _status(spark, r) is None else _binary(spark.read.format("binaryFile"), r).select(*columns) for r in roots}


def scan(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, root, text of the files under the roots with one of the extensions, but for excluded globs.

    A path is relative to its root; with several roots the root's name comes first; a root that is a file is its own name.
    A missing root is a warning. Bytes that are not UTF-8 are replaced; .html and .htm are converted to text."""
    return shown(spark, _there(spark, roots, [F.col("_metadata.file_path").alias("where"), "content"]), extensions, exclude)


def listed(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path of the files that `scan` would give, which are not opened."""
    parts = [_under(spark, rows, root, len(roots) > 1, extensions, exclude) for root, rows in _there(spark, roots, [F.col("_metadata.file_path").alias("where")]).items()]
    parts = [p.select("path") for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string")


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the files under a root as they come: where, content, root."""
    schema = spark.read.format("binaryFile").load(root).schema
    return _binary(spark.readStream.format("binaryFile").schema(schema), root).select(F.col("_metadata.file_path").alias("where"), "content", F.lit(root).alias("root"))


def _quoted(path: str) -> str:
    return "\\Q" + path + "\\E"


def documents(files: DataFrame, labels: dict | None = None) -> DataFrame:
    """path, root, hash, title, extra, summary, body, fm, text, kind, date of files: title, body and frontmatter values apart.

    labels: `field`, the frontmatter's key of a document's kind (else "kind"); `defaults`, globs with the kind of files that name
    none; `date_fields`, keys of its date, the first there counts. Without labels, kind and date are empty."""
    parsed = files.withColumn("fm", parse_frontmatter(frontmatter_text(F.col("text")))).withColumn("body", body_of(F.col("text")))
    value = lambda k: F.try_element_at("fm", F.lit(k))
    extra = F.concat_ws(" ", *[value(k) for k in ("keywords", "tags", "summary", "description")])
    kind, date = F.lit(""), F.lit("")
    if labels:
        kind = document_label(value(labels.get("field", "kind")), F.col("path"), labels.get("defaults", {}))
        date = first_date(*[value(k) for k in labels.get("date_fields", [])])
    return parsed.select("path", "root", content_hash(F.col("text")).alias("hash"), title_of(F.col("path"), value("title"), F.col("body")).alias("title"), extra.alias("extra"), F.coalesce(value("summary"), value("description"), F.lit("")).alias("summary"), "body", "fm", "text", kind.alias("kind"), date.alias("date"))


# --- records ----------------------------------------------------------------------------------------------------
#
# Records are JSON lines in a folder of each day, and in it a folder of each batch: path/day=2024-05-01/batch=x/. A batch that is
# appended again replaces itself. A day's batches may be put together by `compact`; `_batches` then still knows them.


def _list(spark: SparkSession, path: str) -> list:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []


def read_rows(spark: SparkSession, path: str, schema: str, days: int | None = None) -> DataFrame:
    """JSON rows; malformed lines are left out, a missing path is empty. days: of so many last days only, today included; other
    days are not even listed. Files that are in no day's folder are read always."""
    there = [x for x in _list(spark, path) if not x.getName().startswith(("_", "."))]
    if days is not None:
        first = str(datetime.now(timezone.utc).date() - timedelta(days=days - 1))
        there = [x for x in there if not x.getName().startswith("day=") or x.getName()[4:] >= first]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json([x.toString() for x in there])


def read_ledger(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    return read_rows(spark, path, LEDGER, days).withColumn("ts", F.timestamp_seconds("ts"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, LOG)


def append_rows(df: DataFrame, path: str, at: Column, batch: str) -> None:
    """Append the rows of a batch to the folders of their days (`at`, a timestamp; none: of no day). A batch that is there, whole
    or in part, is written anew with the same rows, so that an append may be repeated."""
    spark = df.sparkSession
    known = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{batch}")
    fs = known.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(known):  # put together with others since
        return
    dated = df.withColumn("day", F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("none"))).withColumn("batch", F.lit(batch))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def compact(spark: SparkSession, path: str, before: str) -> int:
    """Put the batches of each day before that one (yyyy-mm-dd) together; the number of days. What readers see of a day is all of
    it before and after; a call that stops halfway is made good by the next."""
    hadoop, done = spark._jvm.org.apache.hadoop.fs.Path, 0
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in (x for x in _list(spark, path) if x.getName().startswith("_old-")):
        day = hadoop(f"{path}/{old.getName().removeprefix('_old-')}")
        if fs.exists(day):
            fs.delete(old, True)
        else:
            fs.rename(old, day)
    for day in (x for x in _list(spark, path) if x.getName().startswith("day=") and x.getName()[4:] < before):
        batches = [x.getName() for x in _list(spark, day.toString())]
        if len([b for b in batches if not b.startswith("_")]) < 2:
            continue
        fresh, old = hadoop(f"{path}/_new-{day.getName()}"), hadoop(f"{path}/_old-{day.getName()}")
        spark.read.option("recursiveFileLookup", "true").text(day.toString()).coalesce(1).write.mode("overwrite").text(f"{fresh.toString()}/batch=whole")
        for b in batches:
            if b.startswith("batch="):
                fs.mkdirs(hadoop(f"{path}/_batches/{b.removeprefix('batch=')}"))
        fs.rename(day, old)
        fs.rename(fresh, day)
        fs.delete(old, True)
        done += 1
    return done


def read_questions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """query_id, q, gold from JSON arrays or JSON lines, told apart by a file's first character."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        array = bool(first) and first[0][0].lstrip().startswith("[")
        rows = spark.read.schema(QUESTION).option("multiLine", str(array).lower()).json(path)
        rows = rows.select(F.xxhash64("q", "gold", "ev").alias("query_id"), "q", F.coalesce("gold", "ev", F.array().cast("array<string>")).alias("gold"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).option("multiLine", "true").json(path)


def dataset_sessions(dataset: DataFrame) -> DataFrame:
    """question_id, session_id, markdown of every session of a benchmark dataset."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    each = dataset.select("question_id", F.explode(zipped).alias("s"))
    return each.select("question_id", F.col("s.id").alias("session_id"), session_markdown(F.col("s.id"), F.col("s.date"), F.col("s.turns")).alias("markdown"))
