import random
import re

from lantern.llm import licenses

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def base(t):
    w, places, labels = words(t), [], set()
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    r = random.Random(2)
    parts = ["Released under the MIT License.", "apache LICENSE, version 2", "CC BY-NC 4.0", "cc by", "under the mit", "Straße é", "x", "cc-by-nc-cc by nc", "the License\nversion 2.0 ünder", "mit license under the MIT license"]
    out = [None, "", "...", "cc", "cc by", "cc by nc", "under the MIT license under the mit license"]
    return out + [r.choice([" ", "\n", ". "]).join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(60)] + ["CC BY-NC " * 3000]


def test_base_matches_brute_force(spark):
    rows = [(i, t, "mit") for i, t in enumerate(texts())] + [(None, "cc by nc", "a"), (5, "cc by nc", "b"), (7000, "CC BY-NC " * 120_000 + "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    got = licenses.scan(docs).collect()
    have = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert have == sorted(str((i, *base(t))) for i, t, _ in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_merges_neighbouring_diagonals(spark):
    broken = "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"
    whole = dict(licenses.NOTICES[:15])
    bsd = whole["bsd-2"].split()
    docs = spark.createDataFrame([(4, "x " * 40 + whole["mit"].upper() + " y"), (5, whole["isc"] + "\n" + whole["gpl-2"]), (6, " ".join(bsd[:40] + ["inserted"] + bsd[40:150])), (7, " ".join(bsd)), (1, broken), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "permission is hereby granted to go home")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and 0.8 <= got[1].score < 1
    assert got[2].labels == "gpl-3" and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score < 0.8
    assert "mit" in got[4].labels.split(",") and got[4].score == 1.0 and got[4].n_words > 160
    assert {"isc", "gpl-2"} <= set(got[5].labels.split(",")) and "mit" not in got[5].labels.split(",")
    assert got[6].labels == "bsd" and "bsd-2" in got[7].labels.split(",") and got[7].score == 1.0


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    from lantern.llm import registry

    parts = [t.split() for _, t in licenses.NOTICES]
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts())]
    for i in range(60):  # pieces of templates with words left out and put in
        w = []
        for _ in range(r.randrange(1, 4)):
            own = r.choice(parts)
            a = r.randrange(len(own))
            w += [x for x in own[a : a + r.randrange(5, 200)] if r.random() > 0.02] + ["zz"] * r.randrange(3)
        rows.append((100 + i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(str(tuple(r[c] for c in columns)) for r in registry.queries()["op6_license_scan"](spark, str(tmp_path)).collect())
    assert got == sorted(str(x) for x in db.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()['op6_license_scan']})").fetchall())
