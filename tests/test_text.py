import sqlite3

import pytest
from pyspark.sql import functions as F

from lantern.functions import stem, text, vectors
from lantern.shipping import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("one")).select(column.alias("x")).first().x


def test_units_and_fences():
    body = "# A\nintro\n## B\ntext\n```\n# not a heading\n```\nmore"
    assert [u[0] for u in text.section_units(body)] == ["A", "A > B"]
    assert [u[1] for u in text.section_units(body)] == [0, 3]
    assert [u[2] for u in text.section_units("a b c d e", 2)] == ["a b", "c d", "e"]
    assert text.section_units("") == [] and text.section_units(None) == []


def test_windows():
    body = "\n".join(f"## H{i}\n" + "word " * 300 for i in range(100))
    assert len(text.rerank_windows(body, 600, 24)) <= 25
    assert text.rerank_windows("", 600) == [("", "")]
    head, win = text.rerank_windows("# A\nx\n# B\ny", 600)[0]
    assert head == "A" and win == "[A]\n# A\nx\n\n[B]\n# B\ny"


def test_query_functions(spark):
    q = 'Why did the ingest-sync-daemon fail and what is KXGDP or "Pearl Ring" in BLS data?'
    got = one(spark, text.rare_terms(F.col("q")), q=q)
    assert {"ingest-sync-daemon", "KXGDP", "Pearl Ring", "BLS"} <= set(got) and not {"Why", "data"} & set(got)
    assert one(spark, text.rare_terms(F.col("q")), q="In March Old Town Hall The New York") == ["Old Town Hall New York"]
    assert one(spark, text.fts_query(F.col("q")), q="What's AND a NEAR-miss, not?") == '"What" OR "miss" OR "not"'
    ask = lambda q: one(spark, text.is_question(F.col("q")), q=q)
    assert ask("really?  ") and ask("what did we decide") and not ask("what we decide") and not ask("garden plan for spring") and not ask("")
    assert one(spark, text.content_words(F.col("q")), q="The Foo-bar of a b2 X") == ["foo-bar", "b2"]


def test_documents(spark):
    doc = "<!-- a\nb -->\n---\ntitle: T\nn: [1, 2]\n---\nbody\n"
    assert one(spark, text.body_of(F.col("d")), d=doc) == "body\n"
    assert one(spark, text.parse_frontmatter(text.frontmatter_text(F.col("d"))), d=doc) == {"title": "T", "n": "[1, 2]"}
    assert one(spark, text.body_of(F.col("d")), d="<!-- x -->\nbody") == "<!-- x -->\nbody"
    assert one(spark, text.parse_frontmatter(text.frontmatter_text(F.col("d"))), d="---\na: [\n---\nx") == {}
    assert one(spark, text.title_of(F.lit("a/b.c.md"), F.lit(None).cast("string"), F.col("d")), d="x\n# Head \n") == "Head"
    assert one(spark, text.title_of(F.lit("a/b.c.md"), F.lit(""), F.col("d")), d="x") == "b.c"
    assert one(spark, text.fixed_chunks(F.col("d"), 2), d=" a b\nc ") == ["a b", "c"] and one(spark, text.fixed_chunks(F.col("d"), 2), d="") == [""]
    assert one(spark, text.excluded(F.col("p"), ["node_modules/**", "**/x/**", "[ab]?.md"]), p="q/x/y.md") and not one(spark, text.excluded(F.col("p"), ["**/x/**"]), p="x/y.md")
    html = "<html><head><title>My  page</title><style>p{}</style></head><body><h2>Sub</h2><p>one &amp; two<script>no()</script><div>end"
    page = lambda h: spark.createDataFrame([(h,)], "h string").select(text.html_to_text(F.col("h")).alias("t")).first().t
    assert page(html) == "# My page\n\n## Sub\n\none & two\nend"
    assert page(None) == "" and page("<h1>T</h1>").startswith("# T")


def test_prompts_and_probability(spark):
    assert one(spark, text.document_prompt(F.col("t")), t="A\nb\nc") == "title: A | text: b\nc"
    assert one(spark, text.document_prompt(F.col("t")), t="b c") == "title: none | text: b c"
    top = F.array(F.struct(F.lit(" Yes").alias("token"), F.lit(-0.1).alias("logprob")), F.struct(F.lit("no").alias("token"), F.lit(-0.1).alias("logprob")))
    assert abs(one(spark, text.p_yes(top)) - 0.5) < 1e-12


def test_vectors(spark):
    df = spark.createDataFrame([("a", "Foo foo bar"), ("b", ""), ("c", None)], "k string, t string")
    got = {r.k: r.embedding for r in vectors.hash_vectors(df, "k", "t", 64).collect()}
    import hashlib

    want = [0.0] * 64
    for w in ("foo", "foo", "bar"):
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        want[h % 64] += 1 if h >> 8 & 1 else -1
    n = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(got["a"], want, strict=True)) and set(got["b"]) == {0.0} == set(got["c"])
    with pytest.raises(ValueError):
        vectors.hash_vectors(df, "k", "t", 0)


def test_stemmer_like_the_engine_of_sqlite():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine")
    db.execute("create virtual table v using fts5vocab(t, 'row')")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators".split()
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values (?)", (w,))
        assert db.execute("select term from v").fetchone()[0] == stem.porter(w), w


def test_upper_case_keeps_lengths(spark):
    """As DuckDB's upper does, on which the questions' SQL rests."""
    import duckdb

    words = ["straße", "ŉa", "ᾳx", "ﬁn", "éa", "𐐨b", "", "ẞß"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.simple_upper(F.col("w"))).collect()]
    con = duckdb.connect()
    assert got == [con.execute("select upper(?)", [w]).fetchall()[0][0] for w in words] and got[0] == "STRAẞE"


def test_references_without_a_semicolon(spark):
    page = "<title>x &amp; y&amp</title><p>a &amp;lt; &copy;&am &#65; &#x42; &ampx; b &amp</p>"
    got = spark.createDataFrame([(page,)], "h string").select(text.html_to_text(F.col("h"), closed=True), text.html_to_text(F.col("h"))).first()
    assert got[0] == "# x & y&amp\n\nx & y&amp\na &lt; ©&am A B &ampx; b &amp"
    assert got[1] == "# x & y&\n\nx & y&\na &lt; ©&am A B &x; b &"


def test_stems_that_are_met_again_outlast_the_rest(monkeypatch):
    made, porter = [], stem.porter
    monkeypatch.setattr(stem, "porter", lambda w: (made.append(w), porter(w))[1])
    for i in range(450_000):
        if i % 40_000 == 0:
            assert stem.stemmed_form("relational") == "relat"
        stem.stemmed_form(f"w{i}")
    assert made.count("relational") == 1 and len(stem._FORMS) + len(getattr(stem, "_OLDER", ())) < 210_000
