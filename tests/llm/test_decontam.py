import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lantern.llm import decontam
from lantern.llm.common import tokens

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, got = set(), set()
        for name, u in items:
            v = words(u)
            k = min(10, len(v))
            for s in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        got.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


def case():
    r = random.Random(5)
    vocab = ["the", "of", "straße", "é", "a1", "2024", *(f"w{i}" for i in range(30))]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 9, 10, 11, 25])))) for i in range(12)]
    items += [(12, None), (13, " .. "), (None, "the of the of the of the of the of the of"), (2, items[2][1]), (10, "the the the the the the the the the the the the"), (100, items[1][1])]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([0, 1, 5, 40, 200]))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = (r.choice(items)[1] or "").upper().split()
        docs.append((i, r.choice([" ", ", ", "-\n"]).join(w)))
    docs += [(60, None), (61, ""), (62, "the " * 500), (63, "é" * 600_000 + " " + items[5][1]), (5, docs[5][1]), (None, docs[6][1])]
    return docs, items


@pytest.mark.parametrize("segment,block", [(1 << 19, 1 << 21), (100, 40)])
def test_brute_force(spark, segment, block):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, h double")
    got = decontam.decontaminate(d, b, segment_words=segment, block_words=block).drop("items").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, items)))


def test_empty(spark):
    d, b = "doc_id long, text string", "item_id long, text string"
    assert decontam.decontaminate(spark.createDataFrame([], d), spark.createDataFrame([(1, "a b")], b)).count() == 0
    row = decontam.decontaminate(spark.createDataFrame([(1, "a b")], d), spark.createDataFrame([], b)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "rare x b y a"), (2, "a b c rare"), (3, "rare " + "x " * 30 + "a b"), (4, "rare a"), (5, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b rare")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.proximity_matches(d, b, within=5).collect()) == [1, 2]


def brute_near(docs, items, within, window=10):
    """Of documents in one segment."""
    words_ = [(i, tokens(t or "")) for i, t in docs]
    count = Counter(w for _, t in words_ for w in t)
    out = set()
    for name, text in items:
        own = tokens(text or "")
        k = min(window, len(own))
        for s in range(len(own) - k + 1) if k else ():
            part = own[s : s + k]
            lead = min(range(k), key=lambda i: (count[part[i]], i))
            for doc, t in words_:
                if any(t[p] == part[lead] and all(w in t[max(0, p - within) : p + within + 1] for w in part) for p in range(len(t))):
                    out.add((doc, name))
    return out


def test_proximity_against_brute_force(spark):
    r = random.Random(9)
    names = [f"w{i}" for i in range(30)]
    items = [(f"i{j}", " ".join(r.choices(names, k=n))) for j, n in enumerate([1, 2, 3, 4, 5, 10, 13])] + [("none", None), ("empty", " "), ("i1", "w3 w4")]
    docs = [(i, " ".join(r.choices(names, k=r.randrange(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, items[6][1]), (502, items[6][1]), docs[3], (503, "x " * 50 + items[5][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").coalesce(1)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id string, text string, doc_id int")
    want = brute_near(docs, items, 6)
    got = decontam.proximity_matches(d, b, within=6).collect()
    assert len(got) == len(want) > 50 and {tuple(x) for x in got} == want
    assert decontam.proximity_matches(d.limit(0), b).count() == 0 and decontam.proximity_matches(d, b.limit(0)).count() == 0


def test_proximity_is_a_query(spark, tmp_path):
    from lantern.llm import registry

    spark.createDataFrame([(1, "rare x b y a"), (2, "a b c"), (3, "rare " + "x " * 30 + "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a b rare")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["op10_proximity"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, "7")]


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """With hashes of three values, only the comparison of words is left to decide."""
    few = decontam.word_hashes
    monkeypatch.setattr(decontam, "word_hashes", lambda *a: few(*a) % 3)
    docs, items = case()
    kinds = [list(zip(*x, strict=True)) for x in (docs[:20], items)]
    texts = [[tokens(t or "") for t in x[1]] for x in kinds]
    own = decontam.Items(["" if i is None else str(i) for i in kinds[1][0]], texts[1])
    low = [b" ".join(t) for t in texts[0]]
    offs = np.append(0, np.cumsum([len(x) for x in low]))
    data = np.frombuffer(b"".join(low), np.uint8)
    s, e, first = decontam.words(data, offs, decontam.ALNUM)
    h = decontam.word_hashes(data, s, e)
    terms, size = np.unique(h, return_counts=True)
    raw = [x.tobytes() for x in (terms.astype("<u8"), np.cumsum(size).astype("<i4"), np.argsort(h, kind="stable").astype("<i4"), data)]
    row = pa.RecordBatch.from_arrays([pa.array([list(range(20))]), pa.array([first]), *(pa.array([x], pa.binary()) for x in raw), pa.array([offs]), pa.array([1])], ["ids", "first", "terms", "ends", "postings", "low", "offs", "seg"])
    seg = decontam.Segment(row, 0)
    names = [set() for _ in range(20)]
    for k in own.windows:
        for d, i in decontam._owners(seg, own, k, *decontam.phrase_places(seg, own, k)).tolist():
            names[d].add(own.names[i])
    assert [len(x) for x in names] == [r[3] for r in brute(docs[:20], items)]


def test_segments_are_written_in_small_row_groups(spark):
    """A row of the index has megabytes; few of them are held at once."""
    from pyarrow import parquet

    docs = spark.range(60).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 100000) as text").coalesce(1)
    index = decontam.stored_index(docs, "doc_id", "text", 1)
    files = [parquet.read_metadata(p.removeprefix("file://")) for p in index.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60
    assert max(g.total_byte_size for g in groups) < 24 << 20, [(g.num_rows, g.total_byte_size) for g in groups]
