"""Postings, segments and signatures: the rows of the plain ways, for less reading."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import grams, keyword, postings, rare
from lantern.plans import search, store
from lantern.scratch import saved

SMALL = {"parquet.page.size": "8192", "parquet.block.size": "65536"}


def texts(n, seed=1, words=3000):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 10))) for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return names, [(f"d/{i:05}.md", names[i % words] if i % 3 == 0 else "title", " ".join(r.choices(names, weights, k=r.randrange(5, 80)))) for i in range(n)]


def corpus(spark, n, **given):
    names, rows = texts(n, **given)
    return names, spark.createDataFrame(rows, "path string, title string, body string").repartition(3)


def bytes_read(spark, action):
    """Bytes of files that the session's file system read in an action; reads of several ranges at once are not counted, so they
    are switched off."""
    total = lambda: spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead")
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    try:
        before = total()
        out = action()
        return total() - before, out
    finally:
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")


def ranks(df):
    return sorted((r.query_id, r["rank"], r.path, round(r.score, 6)) for r in df.collect())


def test_postings_give_the_rows_of_a_scan(spark):
    names, docs = corpus(spark, 1500)
    terms = saved(postings.sharded(keyword.forward(docs), 64), "terms")
    known = saved(keyword.vocabulary(terms), "vocabulary")
    shards = keyword.shards_of(terms, lambda rows: saved(rows, "postings"))
    assert shards.docs == 1500 and terms.select("shard").distinct().count() >= 24
    asked = [(1, f"{names[900]} {names[1200]} {names[5]}"), (2, names[2500]), (3, "none of these"), (4, f"{names[40]} {names[40]} {names[41]} {names[60]}"), (5, ""), (6, f"{names[0]} {names[2000]}")]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    for k in (3, 10, 2000):
        found = keyword.by_postings(queries, terms, known, shards, k, True)
        assert found is not None
        assert ranks(keyword.ranked(found, k)) == ranks(keyword.search(queries, terms, known, k))
    # a batch that asks for most postings is left to the scan
    common = spark.createDataFrame([(i, " ".join(names[i : i + 30])) for i in range(0, 60, 2)], "query_id long, q string")
    assert keyword.by_postings(common, terms, known, shards, 5, True) is None
    assert ranks(keyword.search(common, terms, known, 5, shards=shards)) == ranks(keyword.search(common, terms, known, 5))


def test_dead_documents_do_not_rank(spark):
    names, docs = corpus(spark, 300)
    terms = saved(postings.sharded(keyword.forward(docs), 50), "terms")
    shards = keyword.shards_of(terms, lambda rows: saved(rows, "postings"))
    gone = terms.filter("path < 'd/00150'")
    left = terms.join(gone.select("path"), "path", "left_anti")
    known = saved(keyword.vocabulary(left), "vocabulary")
    docs_, words, held = left.agg(F.count("*"), F.sum("dl"), F.sum(F.size("terms"))).first()
    shards = postings.Shards(shards.rows, gone.select("shard", "ord"), docs_, words, held)
    queries = spark.createDataFrame([(1, f"{names[300]} {names[20]}"), (2, names[77])], "query_id long, q string")
    assert ranks(keyword.ranked(keyword.by_postings(queries, left, known, shards, 20, True), 20)) == ranks(keyword.search(queries, left, known, 20))


def test_blocks_are_passed_over():
    """A common term's blocks are opened where they may lift a document among the first, and nowhere else."""
    rng = np.random.default_rng(2)
    n = 4096
    blocks = []
    for term, ords in (("rare", np.sort(rng.choice(n, 40, replace=False))), ("common", np.arange(n))):
        counts, lengths = np.ones(len(ords), np.float32), rng.integers(50, 400, len(ords)).astype(np.int32)
        for a in range(0, len(ords), 128):
            o, c, x = ords[a : a + 128], counts[a : a + 128], lengths[a : a + 128]
            blocks.append({"term": term, "shard": 1, "first": int(o[0]), "last": int(o[-1]), "most": float(c.max()), "shortest": int(x.min()), "ords": o.tolist(), "counts": c.tolist(), "lengths": x.tolist()})
    import pyarrow as pa

    table = pa.Table.from_pylist(blocks, pa.schema([("term", pa.string()), ("shard", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("most", pa.float32()), ("shortest", pa.int32()), ("ords", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32())), ("lengths", pa.list_(pa.int32()))]))
    own = postings.Shard(table, 200.0, 1.2, 0.75)
    query = [("common", 0.01), ("rare", 5.0)]
    ords, scores = own.top(query, 5)
    whole = postings.Shard(table, 200.0, 1.2, 0.75)
    every, all_scores = whole.top(query, n)
    assert whole.opened == len(blocks) and ords.tolist() == every[:5].tolist() and np.allclose(scores, all_scores[:5])
    assert own.opened <= 10 and len(blocks) > 30


def test_a_search_reads_what_its_terms_ask_for(spark):
    names, docs = corpus(spark, 6000, words=20_000)
    terms = saved(postings.sharded(keyword.forward(docs), 60), "terms", **SMALL)
    known = saved(keyword.sorted_vocabulary(keyword.vocabulary(terms)), "vocabulary", **SMALL)
    rows = saved(postings.blocks_of(terms, 5.0, 1.0), "postings", **SMALL)
    shards = keyword.shards_of(terms, lambda _: rows)
    assert rows.select("shard").distinct().count() >= 100
    one = spark.createDataFrame([(1, f"{names[9000]} {names[15000]}")], "query_id long, q string")
    whole, plain = bytes_read(spark, lambda: ranks(keyword.search(one, terms, known, 10)))
    few, pruned = bytes_read(spark, lambda: ranks(keyword.search(one, terms, known, 10, shards=shards)))
    # at this size a third of what it reads are footers and paths
    assert pruned == plain and few < 0.75 * whole
    every, _ = bytes_read(spark, lambda: rows.agg(F.sum(F.size("ords")), F.sum(F.size("counts")), F.sum(F.size("lengths"))).collect())
    own, _ = bytes_read(spark, lambda: rows.filter(postings.any_of("term", [names[9000], names[15000]])).collect())
    assert own < every / 2


DOCS = "path string, root string, hash string, title string, extra string, body string, text string"


def documents(spark, rows):
    """rows: path -> (title, body)"""
    return spark.createDataFrame([(p, "r", str(hash((t, b))), t, "", b, f"---\nkey: K-{p[2:7]}\n---\n{b}") for p, (t, b) in rows.items()], DOCS)


def test_segments(spark, tmp_path):
    names, rows = texts(400)
    now = {p: (t, b) for p, t, b in rows}
    at, s, r = str(tmp_path / "i"), search.Settings(chunk_words=30), random.Random(7)
    meta = lambda: store.read_meta(spark, at)["segments"]
    assert store.build(documents(spark, now), at, s) == {"indexed": 400, "removed": 0, "total": 400, "pending": 0} and len(meta()) == 1
    first = meta()[0]["id"]
    # one changed document is one new segment; nothing else is written
    now["d/00007.md"] = ("title", "entirely other words zebra")
    before = {p for p in (tmp_path / "i" / first).rglob("*")}
    assert store.build(documents(spark, now), at, s)["indexed"] == 1
    assert [x["docs"] for x in meta()] == [400, 1] and meta()[0]["id"] == first and {p for p in (tmp_path / "i" / first).rglob("*")} == before
    assert store.build(documents(spark, now), at, s)["indexed"] == 0 and len(meta()) == 2
    queries = spark.createDataFrame([(1, "zebra"), (2, f"{names[100]} {names[3]}"), (3, names[7]), (4, f"where is K-00007 and {names[1500]}?")], "query_id long, q string")
    for step in range(4):
        for p in r.sample(sorted(now), 5 + 40 * step):
            now[p] = ("title", " ".join(r.choices(names, k=40)))
        for p in r.sample(sorted(now), 6):
            del now[p]
        now |= {f"d/1{step}{i:03}.md": ("new", " ".join(r.choices(names, k=20))) for i in range(8)}
        store.build(documents(spark, now), at, s)
        # a small segment at the end is merged, so there are few
        assert len(meta()) <= 4 and all(a["docs"] * store.MERGE > b["docs"] for a, b in zip(meta(), meta()[1:], strict=False))
    index, plain = store.load(spark, at), search.build(documents(spark, now), s).saved()
    assert {(r.path, r.body) for r in index.docs.collect()} == {(p, b) for p, (_, b) in now.items()}
    assert {tuple(r) for r in index.vocabulary.collect()} == {tuple(r) for r in plain.vocabulary.collect()}
    assert (index.shards.docs, index.shards.words, index.shards.postings) == (plain.shards.docs, plain.shards.words, plain.shards.postings)
    for one, two in ((index.terms, plain.terms), (index.doc_vectors, plain.doc_vectors), (index.sections, plain.sections)):
        assert one.count() == two.count() and {r.path for r in one.collect()} == {r.path for r in two.collect()}
    assert keyword.by_postings(queries, index.terms, index.vocabulary, index.shards, 10, True) is not None
    for k in (5, 30):
        assert ranks(keyword.search(queries, index.terms, index.vocabulary, k, shards=index.shards)) == ranks(keyword.search(queries, plain.terms, plain.vocabulary, k))
    assert ranks(search.hybrid(queries, index, 10, s)) == ranks(search.hybrid(queries, plain, 10, s))
    pool = lambda i: sorted(map(tuple, search.pool_of(queries, i, search.hybrid(queries, i, 5, s), s).collect()))
    assert pool(index) == pool(plain)
    # a full build is one segment again; what no version names any more goes
    store.build(documents(spark, now), at, s, full=True)
    assert len(meta()) == 1 and first not in {p.name for p in (tmp_path / "i").iterdir()}
    names_ = {x["id"] for p in (tmp_path / "i").glob("current-*.json") for x in json.loads(p.read_text())["segments"]}
    assert {p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("s-")} == names_


def test_an_index_that_loses_most_is_rewritten(spark, tmp_path):
    names, rows = texts(120)
    now = {p: (t, b) for p, t, b in rows}
    at, s = str(tmp_path / "i"), search.Settings(chunk_words=30)
    store.build(documents(spark, now), at, s)
    few = dict(list(now.items())[:30])
    assert store.build(documents(spark, few), at, s) == {"indexed": 0, "removed": 90, "total": 30, "pending": 0}
    meta = store.read_meta(spark, at)
    assert [(x["docs"], x["dead"]) for x in meta["segments"]] == [(30, 0)]


def test_signatures_leave_out_nothing(spark):
    r = random.Random(4)
    rows = [(f"f{i}", " ".join(f"Wörd{r.randrange(5000)}" for _ in range(300)) + (" needle-X" if i in (70, 300) else "")) for i in range(400)] + [("none", None), ("empty", "")]
    files = spark.createDataFrame(rows, "path string, text string").repartition(2)
    signed = saved(grams.signed(files, block_bytes=8 << 10), "signed", **SMALL)
    assert signed.count() == len(rows) and signed.select("block").distinct().count() > 50
    blocks = signed.groupBy("block").agg(F.count("signature").alias("n")).collect()
    assert all(b.n == 1 for b in blocks)
    signatures, own = grams.signatures_of(signed), signed.drop("signature")
    for wanted in (["NEEDLE-x"], ["wörd77 ", "WÖRD4999"], ["absent-entirely"], ["ör"], ["needle", "zz"], [""]):
        terms = spark.createDataFrame([(t,) for t in wanted], "term string")
        plain = {(x.path, tuple(sorted(x.terms))) for x in rare.files_with(terms, files).collect()}
        assert {(x.path, tuple(sorted(x.terms))) for x in rare.files_with(terms, own, signatures=signatures).collect()} == plain
    assert grams.pruned(own, signatures, ["needle-x"]).select("block").distinct().count() <= 4
    assert grams.pruned(own, signatures, ["absent-entirely"]).count() == 0


def test_blocks_without_a_candidate_are_not_read(spark):
    r = random.Random(5)
    rows = [(f"f{i}", " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(1500)) + (" needle-X" if i == 70 else "")) for i in range(600)]
    files = spark.createDataFrame(rows, "path string, text string").repartition(2)
    signed = saved(grams.signed(files, block_bytes=32 << 10), "signed", **{"parquet.block.size": "131072", "parquet.page.size": "16384"})
    terms = spark.createDataFrame([("needle-x",)], "term string")
    whole, plain = bytes_read(spark, lambda: {x.path for x in rare.files_with(terms, signed.drop("signature")).collect()})
    few, found = bytes_read(spark, lambda: {x.path for x in rare.files_with(terms, signed.drop("signature"), signatures=grams.signatures_of(signed)).collect()})
    assert found == plain == {"f70"} and few < whole / 3


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_filters_of_many_values(spark, n):
    df = spark.range(1000)
    assert df.filter(postings.any_of("id", list(range(n)))).count() == n


def test_a_search_by_words_writes_the_keyword_part_alone(spark, monkeypatch):
    """No vectors, documents or signatures; the rows are those of the whole index, which takes the part as it is."""
    from lantern import scratch
    from lantern.plans import catalog

    names, plain = [], search.saved
    monkeypatch.setattr(search, "saved", lambda df, name, **given: (names.append(name), plain(df, name, **given))[1])
    monkeypatch.setattr(scratch, "_KEPT", {})
    d = "/root/testdata/sf0.001"
    found = ranks(catalog.queries()["keyword_postings"](spark, d))
    assert found and set(names) <= {"terms", "vocabulary", "postings"}
    index = catalog.index_of(spark, d)
    assert names.count("terms") == 1 and {"docs", "doc_vectors", "sections"} <= set(names)
    whole = keyword.search(catalog.rare_words(spark, d), index.terms, index.vocabulary, 50)
    assert found == ranks(whole)


def test_shards_in_the_pass_that_makes_the_terms(spark):
    _, docs = corpus(spark, 200)
    two, one = postings.sharded(keyword.forward(docs), 30), keyword.forward(docs, shard_docs=30)
    rows = lambda df: sorted((r.path, r.dl, sorted(zip(r.terms, r.tf_title, r.tf_body, strict=True)), r.ord) for r in df.collect())
    assert one.schema == two.schema and rows(one) == rows(two)
    late = keyword.shards_of(saved(one, "terms"), lambda _: pytest.fail("no search went by them"), late=True)
    assert late.docs == 200


def test_chunks_that_are_sections_are_hashed_once(spark):
    """With headings, odd white space, short and empty texts beside them, vectors are those of each text alone; the text is written once."""
    s = search.Settings(chunk_words=5)
    bodies = ["a b c d e f g h i j k l", "# h\nb c d e f g h", "b c\n## two\nd e f g h i j", "b\u00a0c d e f g h i j", "b c d e f\u001cg h i", "b #c d\te\x0bf g\r\nh", "", "a b c d e", "Straße ΟΔΟΣ éa b c_d e-f g ΣΑΣ.", " b c d e f g ", None, "`\n```\nb c d e f g"]
    docs = spark.createDataFrame([(f"p{i}", None if i == 5 else f"T{i} Σ", b) for i, b in enumerate(bodies)], "path string, title string, body string")
    built = search.build(docs, s)
    index = built.saved()
    words = search.with_words(docs.fillna({"body": ""}))
    rows = lambda df: sorted((r.path, r["section"] if "section" in df.columns else 0, tuple(r.embedding)) for r in df.collect())
    assert rows(index.doc_vectors) == rows(built.doc_vectors) == rows(search.document_vectors(words, s))
    plain = rows(search.section_vectors(search.section_rows(words, s), s))
    assert rows(index.sections) == rows(built.sections) == plain
    assert {r.path for r in search.apart_sections(words, s).collect()} == {"p1", "p2", "p3", "p4"}
    assert all(r.text == r.body for r in index.docs.collect()) and index.docs.count() == len(bodies)
    assert "text" not in index.docs.inputFiles()[0] and sorted(spark.read.parquet(index.docs.inputFiles()[0].rsplit("/", 1)[0]).columns) == ["block", "body", "path", "signature", "title", "words"]
