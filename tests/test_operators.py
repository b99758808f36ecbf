import contextlib
import hashlib
import json
import math
import os
import sqlite3
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lantern.functions import embedders, text
from lantern.operators import backends, evaluate, http, keyword, ledger, maintain, rare, rerank, scorers, vector
from lantern.shipping import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_bm25_like_sqlite(spark):
    rows = [("a", "garden plan", "plant the tomatoes in the garden beds"), ("b", "journal", "gardens and planning of plants, garden"), ("c", "utilities", "water and power bills"), ("d", "x", "tomato tomato tomatoes"), ("e", "y", "nothing here")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(path unindexed, title, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine")
    db.executemany("insert into t values (?, ?, ?)", rows)
    q = "garden tomatoes tomatoes planning"
    want = {p: -s for p, s in db.execute("select path, bm25(t, 0, 5.0, 1.0) from t where t match ?", (" OR ".join(f'"{w}"' for w in q.split()),))}
    docs = spark.createDataFrame(rows, "path string, title string, body string")
    terms = keyword.forward(docs)
    got = {r.path: r.score for r in keyword.search(spark.createDataFrame([(1, q)], "query_id long, q string"), terms, keyword.vocabulary(terms), 10).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_many_blocks_of_queries_give_the_same(spark, monkeypatch):
    rows = [(f"d{i:03}", f"t{i % 7}", " ".join(f"w{(i * j) % 23}" for j in range(1, 9))) for i in range(300)]
    docs = spark.createDataFrame(rows, "path string, title string, body string").repartition(3)
    terms = keyword.forward(docs)
    q = spark.createDataFrame([(i, f"w{i % 23} w{(5 * i) % 23} t{i % 7} none") for i in range(40)], "query_id long, q string")
    v = spark.createDataFrame([(i, [float(i % 11), float(i % 5)][: 1 + i % 2]) for i in range(40)], "query_id long, embedding array<double>")
    w = spark.createDataFrame([(r[0], [float(i % 13), float(i % 4)][: 1 + i % 2]) for i, r in enumerate(rows)], "path string, embedding array<double>")

    def found():
        a = keyword.search(q, terms, keyword.vocabulary(terms), 4).collect()
        b = vector.knn(v, w, 4).collect()
        return [sorted((r.query_id, r["rank"], r.path, round(r.score, 9)) for r in x) for x in (a, b)]

    whole = found()
    assert len(whole[1]) == 160
    for module in (keyword, vector):
        monkeypatch.setattr(module, "QUERY_BLOCK", 3)
        monkeypatch.setattr(module, "SCAN_BLOCKS", 4)
        monkeypatch.setattr(module, "ROWS_AT_ONCE", 17)
    assert found() == whole


def test_fusion_and_pool(spark):
    leg = lambda paths: spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(paths)], "query_id long, path string, rank int")
    fused = [r.path for r in vector.fuse([(leg(["a", "b", "c"]), 1.0), (leg(["c", "d"]), 0.5)], 60).orderBy("rank").collect()]
    assert fused == ["c", "a", "b", "d"]
    pool = [r.path for r in rerank.candidate_pool(leg(["b", "a"]), leg(["c", "a"])).orderBy("pos").collect()]
    assert pool == ["b", "a", "c"]


def test_long_documents_leave_after_the_cut(spark):
    docs = spark.createDataFrame([("long", [1.0, 0.0]), ("near", [0.9, 0.1]), ("far", [0.0, 1.0])], "path string, embedding array<double>")
    sections = spark.createDataFrame([("long", 0, [0.0, 1.0])], "path string, section int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.path for r in vector.vector_leg(q, docs, sections, 2, 5).orderBy("rank").collect()] == ["near", "long"]


def test_rare_leg(spark):
    files = spark.createDataFrame([(f"f{i}", "alpha-1 common_x" if i < 3 else "common_x other_y" if i < 6 else "other_y") for i in range(12)], "path string, text string")
    q = spark.createDataFrame([(1, "where is ALPHA-1 or common_x and other_y")], "query_id long, q string")
    got = {r.path: round(r.score, 6) for r in rare.rare_leg(q, files, 3).collect()}
    assert got == {"f0": round(1 / 3, 6), "f1": round(1 / 3, 6), "f2": round(1 / 3, 6), "f3": round(0.5 / 3, 6), "f4": round(0.5 / 3, 6), "f5": round(0.5 / 3, 6)}


def test_prefilter_keeps_the_hit(spark):
    wins = [("a", i, "", "filler words only") for i in range(10)] + [("a", 10, "", "the zebra answer"), ("b", 0, "", "zebra")]
    windows = spark.createDataFrame(wins, "path string, ord int, heading string, text string")
    q = spark.createDataFrame([(1, "where is the zebra answer?")], "query_id long, q string")
    pool = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, path string, pos int")
    scored = rerank.lexical_scores(q, pool, rerank.window_terms(windows))
    kept = {(r.path, r.ord) for r in rerank.prefilter(scored, 2).collect()}
    assert kept == {("a", 10), ("a", 0), ("b", 0)}
    best = {r.path: r.ord for r in rerank.best_windows(scored).collect()}
    assert best == {"a": 10, "b": 0}


def test_scorers(spark, tmp_path):
    script = tmp_path / "s.py"
    script.write_text("import json,sys; d=json.load(sys.stdin); print(json.dumps({'scores':[float('yes' in p['text']) for p in d['passages']],'tokens':7}))")
    pairs = spark.createDataFrame([(1, "q?", "a", 0, "", "yes"), (1, "q?", "b", 0, "", "no"), (2, "r?", "a", 0, "", "no")], "query_id long, q string, path string, ord int, heading string, text string")
    got = {(r.query_id, r.path): r for r in scorers.score_windows(pairs, {"backend": "command", "command": ["python3", str(script)], "batch": 1}).collect()}
    assert got[1, "a"].score == 1 and got[1, "b"].score == 0 and got[1, "a"].tokens == 14 and got[1, "b"].tokens is None
    bad = scorers.score_windows(pairs, {"backend": "command", "command": "false"}).collect()
    assert all(r.score is None for r in bad) and sum("ScorerError" in (r.note or "") for r in bad) == 2
    with pytest.raises(scorers.ScorerError):
        scorers.load({"backend": "no such"})
    with pytest.raises(scorers.ScorerError):
        scorers.load({"backend": "no.module:Here"})
    assert scorers.load({"backend": "lantern.operators.backends:PositionScorer"}).score("q", [1, 2]) == [1.0, 0.5]
    assert {"none", "lexical", "command", "openai", "cross-encoder", "decision"} <= set(scorers.available())
    assert backends.probability_of_yes([{"token": "maybe", "logprob": 0}]) == 0
    p = [scorers.Passage("a", "", "the zebra"), scorers.Passage("b", "", "none")]
    assert backends.LexicalScorer().score("which zebra", p) == [1.0, 0.0]
    for said, n in (([1, 2], 2), ({"scores": [0.5]}, 1)):
        assert len(backends.Reply.read(said, n).scores) == n
    for said, n in (([1], 2), ({"score": [1]}, 1), ("x", 1)):
        with pytest.raises(scorers.ScorerError):
            backends.Reply.read(said, n)
    slow = backends.CommandScorer("sleep 5", timeout=0.2)
    with pytest.raises(scorers.ScorerError):
        slow.score("q", p)
    with pytest.raises(scorers.ScorerError):
        backends.CrossEncoderScorer(model_dir="/nowhere")
    cross = backends.CrossEncoderScorer(logits=lambda q, texts: [len(t) - 5.0 for t in texts], batch_size=1)
    assert [round(x, 3) for x in cross.score("q", p)] == [round(1 / (1 + math.exp(-4)), 3), round(1 / (1 + math.exp(1)), 3)]


class Service(BaseHTTPRequestHandler):
    """Answers as the test's function does; None is status 500."""

    def do_POST(self):
        said = self.server.answer(self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        status, body = said if isinstance(said, tuple) else (200, said)
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@contextlib.contextmanager
def service(answer):
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    httpd.answer = answer
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{httpd.server_port}"
    finally:
        httpd.shutdown()
        httpd.server_close()


def test_decision_service():
    asked = []

    def answer(path, body):
        asked.append(body)
        if "kind" in body["questions"]:
            return {"answers": {"kind": {"choice": "preference"}}, "usage": {"input_tokens": 5}}
        if len(body["state"]["content"]) > 5000:
            return 422, {"error": "over context"}
        return {"answers": {"q": {"noul": 0.9 if "zebra" in body["state"]["content"] else 0.2}}, "usage": {"input_tokens": 3}}

    with service(answer) as url:
        scorer = backends.DecisionScorer(url, tries=1)
        p = [scorers.Passage("a", "", "the zebra " + "x" * 9000), scorers.Passage("b", "", "none")]
        assert scorer.score("which?", p) == [0.9, 0.2] and scorer.last_tokens == 6
        assert scorer.classify("which?") == "preference" and scorer.last_tokens == 5
        assert "preference" in scorer.for_kind("preference").ask and scorer.for_kind(None) is scorer
        # a first route that fails is left for good, for the copies as well
        other = backends.DecisionScorer("http://127.0.0.1:9", fallback_base_url=url, fallback_usd_per_mtok=2.0, tries=1, primary_timeout=0.5)
        assert other.for_kind("preference").score("q", p[1:]) == [0.2] and other.fell_back and other.usd_per_token == 2e-6
        with pytest.raises(scorers.ScorerError):
            backends.DecisionScorer("http://127.0.0.1:9", tries=1, timeout=0.5).score("q", p[1:])


def test_http_waits_and_tries_again(monkeypatch):
    waits, left = [], [429, 503]
    monkeypatch.setattr(http, "time", SimpleNamespace(sleep=waits.append))
    with service(lambda path, body: (left.pop(0), {}) if left else {"ok": 1}) as url:
        assert http.post_json(url, {}) == {"ok": 1} and len(waits) == 2 and waits[1] > waits[0] >= 0.5
    with service(lambda path, body: (400, {"error": "no"})) as url, pytest.raises(http.HttpError) as e:
        http.post_json(url, {})
    assert e.value.status == 400 and len(waits) == 2


def test_a_key_from_a_file(tmp_path, monkeypatch):
    at = tmp_path / "keys"
    at.write_text("# note=1\nexport A_KEY='abc='\nB_KEY=def\n")
    assert backends.key_of("A_KEY", str(at)) == "abc=" and backends.key_of("B_KEY", str(at)) == "def" and backends.key_of("C_KEY", str(at)) == ""
    at.write_text("# a secret alone\nxyz\n")
    assert backends.key_of("", str(at)) == "xyz" and backends.key_of("", "") == ""
    monkeypatch.setenv("A_KEY", "of the environment")
    assert backends.key_of("A_KEY", str(at)) == "of the environment"


def test_a_chain_passes_over_what_failed():
    asked = []

    def answer(path, body):
        asked.append(body["model"])
        return (400, {"error": "no"}) if body.get("bad") else {"ok": 1}

    with service(answer) as url:
        points = [http.Endpoint("http://127.0.0.1:9", "a", patience=http.Patience(1, 0.5)), http.Endpoint(url, "b"), http.Endpoint(url, "c")]
        chain = http.Chain(points)
        assert chain.ask("/x", {}) == {"ok": 1} and chain.current.model == "b" and len(chain.failures) == 1
        with pytest.raises(http.HttpError):  # a request that is refused is refused elsewhere as well
            chain.ask("/x", {"bad": 1})
        assert chain.current.model == "b" and asked == ["b", "b"]


def test_texts_are_dealt_by_length_and_requests_bounded(spark, tmp_path):
    """Batches of texts of one length over all tasks, and no more requests at once than the service is to get."""
    now, most, sizes, lock = [0], [0], [], threading.Lock()

    def answer(path, body):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            lengths = [len(t) for t in body["input"]]
            sizes.append((min(lengths), max(lengths)))
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]}

    with service(answer) as url:
        rows = spark.createDataFrame([(i, "x" * (i * 37 % 400)) for i in range(800)], "k long, t string").repartition(4)
        got = embedders.embedded(rows, "k", "t", "eg2", {"remote_url": url, "dim": 2, "full_dim": 2, "batch_size": 20, "inflight": 2}).collect()
        assert len(got) == 800 and all(r.embedding is not None for r in got)
        assert most[0] <= 2 and len(sizes) >= 40
        # a batch spans what its share of the lengths spans, not all of them
        assert max(b - a for a, b in sizes) <= 40


def test_embedders(spark):
    seen = []

    def answer(path, body):
        seen.append(body)
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0, 5.0]} for i, t in reversed(list(enumerate(body["input"])))]}

    with service(answer) as url:
        model = embedders.Service(url, dim=2, full_dim=3, batch_size=2, remote_model="m", pause=0)
        texts = ["Title\nlong body of text", "b", "Other\nx"]
        v = model.documents(texts)
        prompts = ["title: Title | text: long body of text", "title: none | text: b", "title: Other | text: x"]
        assert np.allclose(v, embedders.unit(np.array([[len(t), 1.0] for t in prompts]), 2)) and np.allclose(np.linalg.norm(v, axis=1), 1)
        assert all(b["dimensions"] == 2 and b["model"] == "m" for b in seen) and sorted(len(b["input"]) for b in seen) == [1, 2]
        assert [len(t) for b in seen for t in b["input"]] and model.queries(["q"]).shape == (1, 2) and seen[-1]["input"] == ["task: search result | query: q"]
    gone = embedders.Service("http://127.0.0.1:9", dim=2, pause=0, remote_timeout=0.5, local="test_operators:Plain")
    with pytest.raises(embedders.ServiceDown):
        gone.documents(["a"])
    assert gone.documents(["a"], local=True).shape == (1, 2) and gone.queries(["a"]).shape == (1, 2) and not gone.health.well(gone.url)
    now = [0.0]
    health = embedders.Health(120, lambda: now[0])
    health.fails("u")
    assert not health.well("u") and health.well("other")
    now[0] = 120.0
    assert health.well("u")
    assert embedders.hash_dim("hash") == 64 and embedders.hash_dim("hash:100") == 100 and embedders.hash_dim("eg2") is None
    for wrong in ("hash:x", "hash:0", "what", "no.module:Here"):
        with pytest.raises(embedders.UnknownModel):
            embedders.check(wrong)
    rows = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "k long, t string")
    got = {r.k: r.embedding for r in embedders.embedded(rows, "k", "t", "hash:100").collect()}
    want = np.zeros(100)
    for w in ("one", "two", "two"):
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        want[h % 100] += 1 if h >> 8 & 1 else -1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not any(got[2]) and not any(got[3])


class Plain:
    """Two numbers of a text, and the lengths of the batches that it was given."""

    def __init__(self, **options):
        self.model, self.given = self, []

    def documents(self, texts, local=True):
        self.given.append([len(t) for t in texts])
        return np.array([[len(t) + 1.0, 1.0] for t in texts])

    queries = documents

    def embed(self, texts):
        return self.documents(texts)


def test_model_files(spark, tmp_path):
    """Real ONNX files: an embedding model and a model of question and passage."""
    from onnx_file import write_model

    table = np.array([[0, 0], [0, 0], [1, 0], [0, 1], [3, 4]], np.float32)
    write_model(tmp_path, table, ["red", "blue", "green"])
    model = embedders.OnnxModel(str(tmp_path), batch=2)
    want = [[1, 0], [1 / math.sqrt(2)] * 2, [0.6, 0.8], [0, 0]]
    assert np.allclose(model.documents(["red", "red blue", "green green green", "unknown"]), want)
    rows = spark.createDataFrame([(0, "red"), (1, "blue red"), (2, None)], "k int, t string")
    got = {r.k: r.embedding for r in embedders.embedded(rows, "k", "t", "lantern.functions.embedders:OnnxModel", {"folder": str(tmp_path)}).collect()}
    assert np.allclose(got[0], [1, 0]) and np.allclose(got[1], [1 / math.sqrt(2)] * 2) and np.allclose(got[2], [0, 0])
    # a service without an address is the local model alone
    stands = embedders.Service(dim=2, local="lantern.functions.embedders:OnnxModel", local_options={"folder": str(tmp_path)})
    assert np.allclose(stands.queries(["green"]), [[0.6, 0.8]])
    with pytest.raises(embedders.UnknownModel):
        embedders.OnnxModel(str(tmp_path), file="none.onnx")
    other = tmp_path / "cross"
    other.mkdir()
    write_model(other, np.array([[0], [0], [2], [-3], [1]], np.float32), ["red", "blue", "green"], summed=True)
    cross = scorers.load({"backend": "cross-encoder", "model_dir": str(other), "batch_size": 2})
    found = cross.score("red", [scorers.Passage("a", "", t) for t in ("blue", "green", "nothing known", "red red")])
    assert np.allclose(found, [1 / (1 + math.exp(-x)) for x in (-1, 3, 2, 6)], atol=1e-6)


def test_batches_are_of_one_length():
    plain = Plain()
    local = embedders.LocalModel("x", batch=2, model=plain)
    texts = ["ccc", "a", "dddd", "bb", ""]
    assert np.allclose(local.documents(texts), embedders.unit(np.array([[len(t) + 1.0, 1.0] for t in texts]), 2)) and plain.given == [[0, 1], [2, 3], [4]]


def test_a_build_goes_on_while_the_service_is_down(spark, tmp_path, monkeypatch):
    from lantern.plans import search, store

    spark.sparkContext.addPyFile(__file__)
    docs = lambda rows: spark.createDataFrame([(p, "r", h, p, "", b) for p, h, b in rows], "path string, root string, hash string, title string, extra string, body string")
    down = search.Settings(model="eg2", embed_options={"remote_url": "http://127.0.0.1:9", "dim": 2, "full_dim": 2, "pause": 0, "remote_timeout": 0.5, "local": "test_operators:Plain"}, chunk_words=5)
    at = str(tmp_path / "i")
    small, large = ("a", "1", "few words"), ("b", "1", "many words " * 20)
    assert store.build(docs([small, large]), at, down) == {"indexed": 2, "removed": 0, "total": 2, "pending": 2, "service": "down"}
    # the smallest go first, as far as the budget of texts allows
    said = store.build(docs([small, large]), at, down, allow_local=3)
    assert said["pending"] == 1 and store.load(spark, at, "eg2").doc_vectors.collect()[0].path == "a"
    # an edited document keeps its old vectors
    assert store.build(docs([("a", "2", "other words"), large]), at, down)["pending"] == 2
    now = store.load(spark, at)
    assert [r.path for r in now.doc_vectors.collect()] == ["a"] and {r.path: r.hash for r in now.docs.collect()} == {"a": "2", "b": "1"}

    def answer(path, body):
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]}

    with service(answer) as url:
        up = search.Settings(model="eg2", embed_options=down.embed_options | {"remote_url": url}, chunk_words=5)
        assert store.build(docs([("a", "2", "other words"), large]), at, up) == {"indexed": 2, "removed": 0, "total": 2, "pending": 0}
        assert store.load(spark, at).sections.count() > 0
    with pytest.raises(store.Locked), store._alone(spark, at):
        store.build(docs([small]), at, down)


def test_html(spark):
    pages = {
        "<html><head><title> A &amp; B </title><style>p{x:'>'}</style></head><body><h2 class='a>b'>Head</h2><p>one<br>two &lt;b&gt;</p><script>if (a < b) { c(); }</script>three": "# A & B\n\n## Head\n\none\ntwo <b>\nthree",
        "<title>T</title><h1>Own</h1>text<!-- <p>no</p> --> <b>bold</b>": "# T\n\nT\n\n# Own\ntext bold",
        "plain <i>text": "plain text",
        "<svg><text>no</text></svg><template>no</template><noscript>no</noscript>yes": "yes",
        "<p>a</p>\n\n\n\n<p>b</p>": "a\n\nb",
        "open <script>never closed": "open",
        "": "",
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate([*pages, None])], "i int, html string").select("i", text.html_to_text(F.col("html")).alias("t"))
    got = {r.i: r.t for r in rows.collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values()) and got[len(pages)] == ""
    long = "<p " + "a='" + "x" * 200_000 + "' " + "b " * 20_000 + ">shown</p>"
    assert spark.createDataFrame([(long,)], "html string").select(text.html_to_text(F.col("html")).alias("t")).first().t == "shown"


def test_order_statistics(spark):
    import random

    r = random.Random(3)
    values = [round(r.expovariate(0.01), 2) for _ in range(3000)] + [7.5] * 900 + [-3.0, 1e9]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ranks = [0, 1, 1500, 2700, len(values) - 1]
    assert ledger.order_statistics(rows, "x", ranks, small=40, ranges=16) == [sorted(values)[k] for k in ranks]
    with pytest.raises(ValueError):
        ledger.order_statistics(rows, "x", [len(values)])


def test_knn_takes_whole_vectors_of_its_length(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0])], "path long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [])], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.path, round(r.score, 9)) for r in vector.knn(q, rows, 2).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 7, 0.0), (2, 1, 3, 1.0)]


def test_best_keeps_the_k_best():
    from lantern.operators.topk import Best

    rng = np.random.default_rng(1)
    scores = np.round(rng.random((3, 500)), 2)
    best = Best(3, 7, highest=True)
    best.most = 50
    keys = pa.array([f"p{i:03}" for i in rng.permutation(500)])
    for a in range(0, 500, 40):
        best.add(scores[:, a : a + 40], keys.slice(a, 40))
    q, s, k = best.rows()
    for i in range(3):
        want = sorted(zip(-scores[i], keys.to_pylist(), strict=True))[:7]
        assert [(-x, y) for x, y in zip(s[q == i], k.filter(pa.array(q == i)).to_pylist(), strict=True)] == want


def test_finder_without_an_automaton(monkeypatch):
    import sys

    terms = ["ab", "abc", "bcd", "d"]
    with_tree = rare._finder(terms)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    plain = rare._finder(terms)
    for t in ("", "abcd", "xabx", "dd", "bcbcd"):
        assert plain(t) == with_tree(t)


def test_budget_order():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()

    def said(est, day, caller="live", session=0.0, ceiling=1.0, daily=1.0, per_query=0.05):
        c = ledger.verdict(F.lit(est), F.lit(0.0), F.lit(day), F.lit(session), F.lit(caller), F.lit(True), per_query=per_query, daily=daily, ceiling=ceiling, session_share=0.4)
        return spark.range(1).select(c.alias("x")).first().x

    assert said(0.0, 0.0, "eval", daily=0.0) == "eval off" and said(0.0, 5.0) == "ok"
    assert said(0.06, 0.0) == "per query" and said(0.02, 0.64, ceiling=0.65) == "widen reserve" and said(0.02, 0.62, ceiling=0.65) == "ok"
    assert said(0.02, 0.99) == "daily cap" and said(0.02, 0.5, session=0.39) == "session share" and said(0.02, 0.5, "eval", session=0.39) == "ok"


def test_rolling_spend_over_stretches(spark):
    rows = [(i, f"2024-01-0{1 + i // 24} {i % 24:02d}:00:00", 1.0, "live") for i in range(72)]
    led = spark.createDataFrame(rows, "id int, t string, usd double, caller string").withColumn("ts", F.to_timestamp("t"))
    got = {r.id: r.spend for r in ledger.rolling_spend(led).collect()}
    assert got == {i: min(i + 1, 25) for i in range(72)}


def test_maintenance(spark):
    known = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("c", "1", False), ("d", "1", True)], "path string, hash string, embedded boolean")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1")], "path string, hash string")
    assert {r.path: r.status for r in maintain.index_diff(known, files).collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "gone", "e": "new"}
    todo = spark.createDataFrame([("a", 5, 9), ("b", 1, 3), ("c", 1, 2), ("d", 9, 1)], "path string, size int, texts int")
    got = {r.path: (r.before, r.fits) for r in maintain.budgeted(todo, 6).collect()}
    assert got == {"b": (0, True), "c": (3, True), "a": (5, False), "d": (14, False)}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 7), (2, "x", 1)], "query_id long, path string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y")], "query_id long, path string")
    got = {r.query_id: tuple(r)[1:] for r in evaluate.any_all(ranked, gold).collect()}
    assert got == {1: (True, True, False, True), 2: (False, False, False, False)}
    quotas = lambda sizes, n: {r.kind: r.quota for r in evaluate.quotas(spark.createDataFrame(sorted(sizes.items()), "kind string, size long"), n).collect()}
    assert quotas({"a": 60, "b": 30, "c": 10}, 10) == {"a": 6, "b": 3, "c": 1}
    for sizes, n in (({"a": 97, "b": 2, "c": 1}, 10), ({"a": 5, "b": 5, "c": 5, "d": 5}, 3), ({"a": 3, "b": 3, "c": 3}, 8), ({"a": 1, "b": 50, "c": 50}, 100)):
        got = quotas(sizes, n)
        assert sum(got.values()) == n and all(0 <= got[k] <= sizes[k] for k in sizes)
    with pytest.raises(ValueError):
        evaluate.stratified_sample(spark.createDataFrame([("1", "a")], "question_id string, kind string"), 4)
    q = spark.createDataFrame([(f"{i}", "ab"[i % 2]) for i in range(40)] + [("9_abs", "a")], "question_id string, kind string")
    one, two = (sorted(r.question_id for r in evaluate.stratified_sample(evaluate.answerable(q), 10, s).collect()) for s in (0, 0))
    assert one == two and len(one) == 10 and "9_abs" not in one
    label = lambda k, p: spark.range(1).select(evaluate.document_label(F.lit(k), F.lit(p), {"j/**": "record"}).alias("x")).first().x
    assert label("note", "j/a.md") == "note" and label("", "j/a.md") == "record" and label(None, "k/a.md") == ""


def test_session_markdown(spark):
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("bot").alias("role"), F.lit("yo").alias("content")))
    got = spark.range(1).select(text.session_markdown(F.lit("s1"), F.lit("2024"), turns).alias("x")).first().x
    assert got == "# Session s1\n\nDate: 2024\n\n**user:** hi\n\n**bot:** yo"
