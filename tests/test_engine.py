import json
import random
import time
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lantern import cli, config, server
from lantern.functions import embedders
from lantern.operators import scorers
from lantern.plans import search, store
from lantern.sources import files
from lantern.streaming import index as stream

NOTES = {
    "home/garden.md": "---\ntitle: Garden\nkeywords: [beds, soil]\n---\n# Garden\nThe tomato beds get compost in April.\n",
    "home/utilities.md": "<!-- seen -->\n---\ntitle: Utilities\nsummary: bills\n---\nThe water meter number is WM-4471.\n",
    "projects/journal.md": "# Journal\n" + "\n".join(f"## Day {i}\n" + "walk and read " * 30 for i in range(20)) + "\n## Fix\nThe ingest-sync-daemon failed on a full disk.\n",
    "projects/page.html": "<title>Page</title><h2>Head</h2><p>plain text",
    "node_modules/x.md": "left out",
}


@pytest.fixture
def notes(tmp_path):
    for name, body in NOTES.items():
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "notes/home/bad.md").write_bytes(b"broken \xff byte")
    return tmp_path


def built(spark, notes, **more):
    scanned = files.scan(spark, [str(notes / "notes")], [".md", ".html"], ["node_modules/**"])
    return store.build(files.documents(scanned), str(notes / "index"), search.Settings(chunk_words=40), **more)


def test_scan(spark, notes):
    got = {r.path: r.text for r in files.scan(spark, [str(notes / "notes")], [".md", ".html"], ["node_modules/**"]).collect()}
    assert set(got) == {"home/garden.md", "home/utilities.md", "home/bad.md", "projects/journal.md", "projects/page.html"}
    assert got["home/bad.md"] == "broken � byte" and got["projects/page.html"].startswith("# Page")
    two = files.scan(spark, [str(notes / "notes/home"), str(notes / "notes/projects/journal.md")])
    assert {r.path for r in two.collect()} == {"home/garden.md", "home/utilities.md", "home/bad.md", "journal.md"}
    with pytest.warns(UserWarning):
        assert files.scan(spark, [str(notes / "nowhere")]).count() == 0


def test_index_is_incremental(spark, notes):
    assert built(spark, notes) == {"indexed": 5, "removed": 0, "total": 5, "pending": 0}
    assert built(spark, notes)["indexed"] == 0
    (notes / "notes/home/garden.md").write_text("# Garden\nNow with zinnias.\n")
    (notes / "notes/projects/page.html").unlink()
    assert built(spark, notes, embed=False) == {"indexed": 1, "removed": 1, "total": 4, "pending": 1}
    index = store.load(spark, str(notes / "index"))
    q = spark.createDataFrame([(1, "zinnias"), (2, "water meter number")], "query_id long, q string")
    top = {r.query_id: r.path for r in search.hybrid(q, index, 3).filter("rank = 1").collect()}
    assert top[2] == "home/utilities.md"
    assert "home/garden.md" in {r.path for r in search.hybrid(q, index, 5).filter("query_id = 1").collect()}
    assert built(spark, notes) == {"indexed": 1, "removed": 0, "total": 4, "pending": 0}
    with pytest.raises(store.IndexMismatch):
        store.build(files.documents(files.scan(spark, [str(notes / "notes")])), str(notes / "index"), search.Settings(chunk_words=40, model="hash:32"))
    with pytest.raises(store.IndexMismatch):
        store.load(spark, str(notes / "index"), "hash:32")
    with pytest.raises(embedders.UnknownModel):
        store.build(files.documents(files.scan(spark, [str(notes / "notes")])), str(notes / "index"), search.Settings(model="no-such-model"))
    # versions are only added and named when they are whole; all but the last two go
    assert len([p for p in (notes / "index").iterdir() if p.name.startswith("current-") and p.suffix == ".json"]) == 2
    (notes / "index/_half.tmp").write_text("{")
    (notes / "index/v-0-half").mkdir()
    assert store.load(spark, str(notes / "index")).docs.count() == 4
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(notes / "none"))


def test_recall(spark, notes):
    built(spark, notes)
    index = store.load(spark, str(notes / "index"))
    q = spark.createDataFrame([(1, "Why did the ingest-sync-daemon fail?"), (2, "tomato beds")], "query_id long, q string")
    got = {(r.query_id, r["rank"]): r for r in search.recall(q, index, search.Settings(chunk_words=40, window_words=60)).collect()}
    assert got[1, 1].path == "projects/journal.md" and got[1, 1].score > 0.5 and got[1, 1]["mode"] == "rerank:lexical"
    assert got[2, 1]["mode"] == "keyword" and got[2, 1].score is None and got[2, 1].path == "home/garden.md"


def test_command_line(spark, notes, monkeypatch, capsys):
    conf = notes / "c.toml"
    conf.write_text(f'roots = ["{notes}/notes"]\nindex = "{notes}/cli"\nexclude = ["node_modules/**"]\n')
    monkeypatch.setenv("LANTERN_CONFIG", str(conf))
    assert cli.main(["index"]) == 0 and json.loads(capsys.readouterr().out)["indexed"] == 4
    assert cli.main(["search", "water meter number", "--json"]) == 0 and json.loads(capsys.readouterr().out)[0][0] == "home/utilities.md"
    assert cli.main(["recall", "What is the water meter number?", "--json"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["results"][0]["path"] == "home/utilities.md" and "WM-4471" in said["passage"] and said["reranked"] and not said["warning"]
    assert cli.main(["recall", "What is the water meter number?", "--backend", "command", "--top", "2"]) == 0
    said = capsys.readouterr()
    assert "NOT RERANKED" in said.out and "NOT RERANKED" in said.err and "-  home/utilities.md" in said.out
    questions = notes / "q.json"
    questions.write_text(json.dumps([{"q": "water meter number", "gold": ["home/utilities.md"]}, {"q": "x", "gold": ["no.md"]}]))
    assert cli.main(["eval", str(questions)]) == 3
    capsys.readouterr()
    assert cli.main(["eval", "--first-stage", str(questions)]) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["n"], out["skipped"], out["hit_1"]) == (1, 1, 1)
    capsys.readouterr()
    assert cli.main(["status"]) == 0 and cli.main(["scorers"]) == 0
    assert "command" in capsys.readouterr().out
    assert cli.main(["recall", "water meter number"]) == 0
    capsys.readouterr()
    assert cli.main(["report"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["queries"] == 3 and said["modes"] == {"first-stage (reranker unavailable)": 1, "keyword": 1, "rerank:lexical": 1} and said["reranked"] == 1 and said["confident_top1"] == 1
    conf.write_text(conf.read_text() + "[budget]\neval_daily_cap_usd = 1.0\n")
    assert cli.main(["eval", str(questions), "--top", "3"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert (said["n"], said["base_1"], said["recall_top"]) == (2, 1, 1)
    monkeypatch.setenv("LANTERN_CONFIG", str(notes / "empty.toml"))
    (notes / "empty.toml").write_text("")
    assert cli.main(["status"]) == 2


def test_init(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", "--root", "notes", "--root", "/more", "--backend", "none"]) == 0
    made = config.load(next(tmp_path.rglob("config.toml")))
    assert made.roots == [str(tmp_path / "notes"), "/more"] and made.scorer["backend"] == "none"
    assert cli.main(["init"]) == 1 and cli.main(["init", "--force"]) == 0 and config.load(next(tmp_path.rglob("config.toml"))).roots != made.roots


def test_records_by_day(spark, tmp_path):
    """A batch that is appended again adds nothing; a read of some days opens no others; compaction changes no row."""
    path = str(tmp_path / "ledger")
    now = time.time()
    rows = lambda *at: spark.createDataFrame([(t, 1, "b", 5, 0.5, "live", "s") for t in at], files.LEDGER)
    add = lambda df, batch: files.append_rows(df, path, F.timestamp_seconds("ts"), batch)
    for _ in range(2):
        add(rows(now, now - 10 * 86400, now - 10 * 86400 + 1), "one")
    add(rows(now - 10 * 86400), "two")
    add(rows(*[]), "none")
    assert files.read_ledger(spark, path).count() == 4 and files.read_ledger(spark, path, days=2).count() == 1
    old = [p for p in (tmp_path / "ledger").iterdir() if p.name.startswith("day=")]
    assert len(old) >= 2
    before = sorted(map(tuple, files.read_ledger(spark, path).collect()))
    cut = str(datetime.now(timezone.utc).date() - timedelta(days=2))
    assert files.compact(spark, path, cut) == 1 and files.compact(spark, path, cut) == 0
    assert sorted(map(tuple, files.read_ledger(spark, path).collect())) == before
    add(rows(now - 10 * 86400), "two")  # it is known, though its folder is gone
    assert files.read_ledger(spark, path).count() == 4
    # a compaction that stopped between its two renames is made good
    day = next(p for p in (tmp_path / "ledger").iterdir() if p.name.startswith("day=") and p.name < f"day={cut}")
    day.rename(day.with_name("_old-" + day.name))
    files.compact(spark, path, cut)
    assert files.read_ledger(spark, path).count() == 4


def test_recall_survives_records_that_cannot_be_written(engine, tmp_path):
    for name in ("index-spend", "index-log"):
        (tmp_path / name).write_text("a file, where a folder should be\n")
    rows, log, c = engine("where is alpha beta number1 ?", marker="number1 ")
    assert rows[0].path == "f01.md" and rows[0].score == 0.95 and log["mode"].startswith("rerank")
    assert "the ledger could not be written" in rows[0].note and "the recall log could not be written" in log.note


def test_admission_is_that_of_one_after_the_other(spark):
    from lantern.operators import admission

    r = random.Random(3)
    n = 10_000
    rows = [(i, r.choice([0.0, 0.001, 0.002, 0.3, r.random() / 50]), r.choice([0.0, 0.0, 0.05])) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id long, due double, before double").repartition(5)
    full = admission.Caps(0.2, 9.0, "live", "me", 0.5, 1.0, 0.25)
    for caps in (full, replace(full, ceiling=0.8), replace(full, session=None), replace(full, daily=0.0), replace(full, caller="eval", daily=0.0), replace(full, daily=1e6), admission.Caps()):
        want, now = {}, caps
        for i, due, before in rows:
            want[i] = now.refusal(due, before)
            now = now.after(due) if want[i] is None else now
        got, after = admission.admit(df, caps, range_rows=700)
        assert {x.query_id: x.why for x in got.collect()} == want
        assert abs(after.day - now.day) < 1e-9 and abs(after.session_day - now.session_day) < 1e-9


def test_a_batch_is_one_plan(spark, tmp_path):
    """Ten times as many questions make no more scans of the index's texts and words."""
    for i in range(30):
        (tmp_path / "n").mkdir(exist_ok=True)
        (tmp_path / f"n/f{i:02}.md").write_text(f"# File {i}\nalpha beta number{i} common words here\n")
    c = config.Config([str(tmp_path / "n")], str(tmp_path / "index"), scorer={"backend": "lexical"}, k=3, widen_k=6, vector_pool=3)
    cli.build_index(spark, c)

    def asked(n):
        index, sc = cli.open_index(spark, c), spark.sparkContext
        q = spark.createDataFrame([(i, f"where is number{i % 30} and beta?") for i in range(n)], "query_id long, q string")
        store_ = sc._jsc.sc().statusStore()
        stages = lambda: (sc._jsc.sc().listenerBus().waitUntilEmpty(30_000), store_.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).size())[1]
        before = stages()
        hits, log = cli.answer.recall(q, index, c, cli.search_settings(c), 1)
        assert {r.query_id: r.path for r in hits.collect()} == {i: f"f{i % 30:02}.md" for i in range(n)} and log.count() == n
        return stages() - before

    few = asked(30)
    assert asked(300) <= few * 1.3


def test_rolling_sums_of_one_busy_day(spark, monkeypatch):
    """One caller's day is spread over ranges, many rows of one moment included."""
    from lantern.operators import ledger

    monkeypatch.setattr(ledger, "RANGE_ROWS", 500)
    r = random.Random(2)
    rows = [(i, 1_700_000_000 + (7 if i % 3 == 0 else r.randrange(200_000)), r.randrange(1, 10**6) / 1e6, r.choice(["live", "live", "live", None]), None if i % 5 else "x") for i in range(900)]
    rows += [(10_000, None, 1.0, "live", None), (10_001, 1_700_000_000, None, "live", None)]
    df = spark.createDataFrame(rows, "id long, at long, usd double, caller string, session string").withColumn("ts", F.timestamp_seconds("at"))
    got = {x.id: x.spend for x in ledger.rolling_spend(df, ("caller", "session")).collect()}
    want = {i: sum(u or 0 for _, t, u, c, s in rows if t is not None and (c, s) == (caller, session) and at - 86400 <= t <= at) for i, at, _, caller, session in rows if at is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_json_sources(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.append_json(spark.createDataFrame([(1.0, 1, "b", 5, 0.5, "live", "s")], files.LEDGER), path)
    (tmp_path / "ledger/bad.json").write_text('{"ts": 2.0, "usd": 0.25}\nnot json\n')
    rows = files.read_ledger(spark, path)
    assert rows.count() == 2 and rows.agg(F.sum("usd")).first()[0] == 0.75
    assert files.read_ledger(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "q.jsonl").write_text('{"q": "a", "gold": ["x"]}\n{"q": "b", "ev": ["y"]}\n')
    assert sorted((r.q, r.gold) for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).collect()) == [("a", ["x"]), ("b", ["y"])]
    data = [{"question_id": "q1", "question_type": "t", "question": "?", "answer_session_ids": ["s1"], "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["d1", "d2"], "haystack_sessions": [[{"role": "user", "content": "hi"}], []]}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    got = {r.session_id: r.markdown for r in files.dataset_sessions(files.read_dataset(spark, str(tmp_path / "d.json"))).collect()}
    assert got["s1"] == "# Session s1\n\nDate: d1\n\n**user:** hi" and set(got) == {"s1", "s2"}


def test_config(tmp_path, monkeypatch):
    assert config.extensions("MD") == [".md"] and config.extensions([".html"]) == [".html"]
    (tmp_path / ".lantern.toml").write_text('roots = ["~/a"]\nextensions = "txt"\n[budget]\ndaily_cap_usd = 2.0\n')
    deep = tmp_path / "x/y"
    deep.mkdir(parents=True)
    monkeypatch.chdir(deep)
    monkeypatch.setenv("LANTERN_SCORER", "none")
    c = config.load()
    assert c.daily_cap_usd == 2.0 and c.extensions == [".txt"] and c.scorer["backend"] == "none" and "~" not in c.roots[0]
    with pytest.raises(ValueError):
        (tmp_path / "bad.toml").write_text('roots = ["a"]\nwrong = 1\n')
        config.load(tmp_path / "bad.toml")


def test_streams(spark, notes):
    (notes / "more").mkdir()
    (notes / "more/late.md").write_text("# Late\nfrom another root\n")
    both = [str(notes / "notes"), str(notes / "more")]
    for _ in range(2):
        stream.refresh_on_arrival(spark, both, str(notes / "both"), str(notes / "ck2"), search.Settings(chunk_words=40), None, ["node_modules/**"]).awaitTermination()
    assert store.load(spark, str(notes / "both")).docs.count() == 5
    (notes / "more/later.md").write_text("# Later\n")
    stream.refresh_on_arrival(spark, both, str(notes / "both"), str(notes / "ck2"), search.Settings(chunk_words=40), None, ["node_modules/**"]).awaitTermination()
    assert store.load(spark, str(notes / "both")).docs.count() == 6
    query = stream.refresh_on_arrival(spark, [str(notes / "notes")], str(notes / "live"), str(notes / "ck"), search.Settings(chunk_words=40), None, ["node_modules/**"])
    query.awaitTermination()
    assert store.load(spark, str(notes / "live")).docs.count() == 4
    source = notes / "spend"
    spark.createDataFrame([("2024-01-01 00:30:00", 1.0, "eval"), ("2024-01-01 01:30:00", 2.0, None), ("2024-01-04 00:00:00", 9.0, None)], "ts string, usd double, caller string").write.json(str(source))
    rows = stream.spend_by_window(spark.readStream.schema("ts string, usd double, caller string").json(str(source)), "2 hours", "2 hours")
    q = rows.writeStream.format("memory").queryName("spend_rows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.caller, r.usd) for r in spark.sql("select caller, usd from spend_rows").collect()} == {("eval", 1.0), ("live", 2.0), ("live", 9.0)}


class Marker(scorers.Scorer):
    """0.95 for a passage with the marker, else 0.1; with prices, kinds and failures to order."""

    usd_per_token, widen_at = 1e-6, 0.7

    def __init__(self, marker="", window_words=60, kind=None, kind_marker="", fail=False, price=1e-6, prefilter=0):
        self.marker, self.window_words, self.kind, self.kind_marker, self.fail, self.usd_per_token, self.prefilter_per_file = marker, window_words, kind, kind_marker, fail, price, prefilter

    def score(self, question, passages):
        if self.fail:
            raise RuntimeError("scorer is down")
        self.last_tokens = 10 * len(passages)
        return [0.95 if self.marker in p.text else 0.1 for p in passages]

    def classify(self, question):
        if self.kind == "broken":
            raise RuntimeError("no kinds")
        self.last_tokens = 7
        return self.kind

    def for_kind(self, kind):
        return Marker(self.kind_marker, self.window_words, price=self.usd_per_token) if kind and self.kind_marker else self


@pytest.fixture
def engine(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)
    for i in range(14):
        (tmp_path / "n").mkdir(exist_ok=True)
        (tmp_path / f"n/f{i:02}.md").write_text(f"---\nkind: {'record' if i % 2 else 'note'}\nas_of: 2024-05-0{i % 9 + 1}T00\n---\n# File {i}\n" + f"alpha beta number{i} common words here\n" + ("the needle answer " + " ".join(f"filler{j}" for j in range(45)) if i == 13 else ""))

    def ask(q, top=3, keep=False, caller="live", **given):
        scorer = {"backend": "test_engine:Marker"} | {k: given.pop(k) for k in list(given) if k in ("marker", "kind", "kind_marker", "fail", "price", "prefilter")}
        scorer = given.pop("scorer", scorer)
        c = config.Config([str(tmp_path / "n")], str(tmp_path / "index"), scorer=scorer, k=3, widen_k=20, vector_pool=3, **given)
        if not (tmp_path / "index").exists():
            c.labels = {"defaults": {}, "date_fields": ["as_of"]}
            cli.build_index(spark, c)
        index = cli.open_index(spark, c)
        hits, log = cli.answer.recall(cli.one_query(spark, q), index, c, cli.search_settings(c), top, caller, "me")
        return hits.orderBy("rank").collect(), log.first(), c

    return ask


def test_recall_widens_once(engine, spark):
    rows, log, c = engine("where are alpha and beta common?", marker="needle")
    assert rows[0].path == "f13.md" and rows[0].score == 0.95 and "needle" in rows[0].passage and log.widened and log.pool > 3
    assert rows[0].kind == "record" and rows[0].date == "2024-05-05" and rows[1].passage is None
    assert log["mode"] == "rerank:test_engine:Marker" and log.widen_at == 0.7 and len(log.first_stage_top3) == 3 and log.tokens > 0
    spent = files.read_ledger(spark, c.ledger).collect()
    assert len(spent) == 2 and all(r.caller == "live" and r.session == "me" for r in spent) and abs(sum(r.usd for r in spent) - log.usd) < 1e-6
    rows, log, _ = engine("where is alpha beta number1 ?", marker="number1 ")
    assert rows[0].path == "f01.md" and not log.widened
    rows, log, _ = engine("where are alpha and beta common?", marker="needle", widen_at=0.05)
    assert not log.widened and rows[0].score == 0.1


def test_recall_keeps_the_first_order_when_scoring_fails(engine):
    rows, log, _ = engine("where is alpha beta number1 ?", fail=True)
    assert log["mode"] == "first-stage (reranker unavailable)" and "scorer is down" in log.note and rows[0].score is None and len(rows) == 3
    rows, log, _ = engine("where is alpha beta number1 ?", scorer={"backend": "nowhere"})
    assert log["mode"] == "first-stage (reranker unavailable)" and "nowhere" in log.note
    rows, log, _ = engine("alpha beta number1", marker="needle")
    assert log["mode"] == "keyword" and rows[0].score is None
    rows, log, _ = engine("where is alpha beta number1 ?", scorer={"backend": "none"})
    assert log["mode"] == "first-stage"


def test_budget_refuses(engine):
    rows, log, _ = engine("where are alpha and beta common?", marker="needle", price=1e-3)
    assert log["mode"] == "first-stage (reranker unavailable)" and "would cost" in log.note and log.usd == 0
    # the reserve keeps the day's cap for first passes
    rows, log, c = engine("where are alpha and beta common?", marker="needle", daily_cap_usd=0.0008, max_usd_per_query=1.0)
    assert log["mode"].startswith("rerank") and not log.widened and "widen skipped: widen reserve" in log.note
    rows, log, c = engine("where are alpha and beta common?", marker="needle", session_share_frac=0.0001)
    assert "session share" in log.note
    rows, log, c = engine("where are alpha and beta common?", marker="needle", caller="eval")
    assert "evaluations are off" in log.note
    rows, log, c = engine("where are alpha and beta common?", marker="needle", caller="eval", eval_daily_cap_usd=1.0)
    assert log["mode"].startswith("rerank") and log.caller == "eval"


def test_question_kinds(engine):
    rows, log, _ = engine("where is alpha beta number1 ?", marker="number1 ", kind="preference", kind_marker="number2 ", question_kinds=True)
    assert log.kind == "preference" and rows[0].score in (0.1, 0.95) and log.tokens >= 17
    rows, log, _ = engine("where are alpha and beta common?", marker="number0 ", kind="aggregate", question_kinds=True)
    assert log.kind == "aggregate" and log.widened and rows[0].path == "f00.md"
    rows, log, _ = engine("where is alpha beta number1 ?", marker="number1 ", kind="broken", question_kinds=True)
    assert log.kind is None and rows[0].path == "f01.md" and log["mode"].startswith("rerank")


def test_prefilter_of_a_scorer(engine):
    rows, log, _ = engine("where is alpha beta number1 ?", marker="number1 ", prefilter=1)
    assert rows[0].path == "f01.md" and rows[0].score == 0.95


def test_rare_terms_are_sought_in_the_whole_file(spark, notes):
    (notes / "notes/home/tagged.md").write_text("---\ntitle: T\nticket: QX-77-ZZ\n---\nnothing of the sort\n")
    built(spark, notes)
    index = store.load(spark, str(notes / "index"))
    q = spark.createDataFrame([(1, "what is QX-77-ZZ about?")], "query_id long, q string")
    empty = spark.createDataFrame([], "query_id long, path string, rank int")
    assert [r.path for r in search.pool_of(q, index, empty, search.Settings()).collect()] == ["home/tagged.md"]


def test_stems_and_marks(spark, notes):
    (notes / "notes/home/cafe.md").write_text("# Cafés\nRunning the cafés of Zürich\n")
    built(spark, notes)
    index = store.load(spark, str(notes / "index"))
    from lantern.operators import keyword

    q = spark.createDataFrame([(1, "cafe runs"), (2, "zurich")], "query_id long, q string")
    got = {(r.query_id, r.path) for r in keyword.search(q, index.terms, index.vocabulary, 5).collect()}
    assert got == {(1, "home/cafe.md"), (2, "home/cafe.md")}


def test_tool_server(spark, notes, monkeypatch):
    import io

    c = config.Config([str(notes / "notes")], str(notes / "served"), exclude=["node_modules/**"])
    calls = [{"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}]
    calls += [{"id": 3 + i, "method": "tools/call", "params": {"name": n, "arguments": x}} for i, (n, x) in enumerate([("search", {"query": "water"}), ("reindex", {}), ("search", {"query": "water meter", "k": 1}), ("recall", {"question": "What is the water meter number?", "top": 1}), ("recall", {}), ("none", {})])]
    out = io.StringIO()
    server.serve(server.Tools(spark, c), io.StringIO("\n".join(map(json.dumps, calls)) + "\nnot json\n"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2, 3, 4, 5, 6, 7, 8, None] and {t["name"] for t in said[1]["result"]["tools"]} == {"recall", "search", "reindex"}
    text = lambda i: json.loads(said[i]["result"]["content"][0]["text"])
    assert said[2]["result"]["isError"] and text(3)["indexed"] == 4 and [r["path"] for r in text(4)] == ["home/utilities.md"]
    assert text(5)["results"][0]["path"] == "home/utilities.md" and "WM-4471" in text(5)["best_section_text"] and text(5)["mode"] == "rerank:lexical"
    assert said[6]["error"]["code"] == said[7]["error"]["code"] == -32602


def test_benchmark_resumes(spark, tmp_path):
    from lantern.plans import benchmark

    def question(i, kind):
        turns = lambda t: [{"role": "user", "content": t}, {"role": "assistant", "content": "noted"}]
        return {"question_id": f"q{i}", "question_type": kind, "question": f"Where did I put the item{i}", "answer": "x", "answer_session_ids": [f"answer_{i}"], "haystack_session_ids": [f"answer_{i}", f"s{i}"], "haystack_dates": ["2024", "2023"], "haystack_sessions": [turns(f"I put the item{i} in the attic"), turns("weather talk and nothing else")]}

    (tmp_path / "d.json").write_text(json.dumps([question(i, "ab"[i % 2]) for i in range(3)]))
    c = config.Config([], str(tmp_path / "unused"), scorer={"backend": "lexical"}, eval_daily_cap_usd=1.0)
    s = search.Settings()
    args = (spark, c, s, str(tmp_path / "d.json"), str(tmp_path / "out"))
    assert benchmark.run(*args, n=2, max_usd=0.0) == {"n": 0, "by_kind": {}}
    first = benchmark.run(*args, n=2)
    assert first["n"] == 2 and first["search_any_1"] == 2 and first["recall_all_5"] == 2 and first["fail_open"] == 0 and set(first["by_kind"]) <= {"a", "b"}
    assert benchmark.run(*args, n=2) == first
    with pytest.raises(benchmark.OtherSettings):
        benchmark.run(*args, n=3)
    with pytest.raises(benchmark.NotScored):
        benchmark.run(spark, config.Config([], str(tmp_path / "unused"), scorer={"backend": "command", "command": "false"}, eval_daily_cap_usd=1.0), s, str(tmp_path / "d.json"), str(tmp_path / "out2"), n=1)
