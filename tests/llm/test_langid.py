import random
import zlib

import numpy as np

from lantern.llm import langid


def kernel(a, b):
    grams = lambda t: {t.lower()[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))


def test_kernel():
    texts = ["the quick brown fox", "der schnelle braune Fuchs", "Ünder\nthe 12", "a"]
    rows = langid.presence(texts, bits=20)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(rows[i] @ rows[j] / np.sqrt(rows[i].sum() * rows[j].sum()) - kernel(a, b)) < 0.03
    assert (langid.presence(["a\0b", "c"])[1] == langid.presence(["c"])[0]).all()


def test_held_out(spark):
    r = random.Random(6)
    words = {"en": ["the", "and", "thing", "other", "with"], "de": ["der", "und", "schön", "über", "nicht"], "fr": ["le", "être", "aux", "que", "ça"]}
    rows = []
    for i in range(500):
        lang = r.choice(list(words))
        rows.append((i, " ".join("".join(r.choice(words[lang]) for _ in range(r.randrange(1, 3))) for _ in range(r.randrange(4, 60))), lang))
    rows += [(500, None, "en"), (501, "", "de"), (502, "12² ... $$", "fr"), (503, "the other thing", None), (None, "und nicht", "de"), (1, rows[1][1], rows[1][2]), (504, "le être " * 50000, "fr")]
    d = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    got = langid.identify(d).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in rows}
    assert all(x.held_out == (zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in got)
    assert {x.doc_id: x.lang_pred for x in got if x.doc_id in (500, 501, 502)} == {500: "und", 501: "und", 502: "und"}
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in got if x.held_out and x.doc_id is not None and x.doc_id < 500]) > 0.95
    assert langid.identify(d.limit(0)).count() == 0
    assert {x.lang_pred for x in langid.identify(d.filter("lang is null")).collect()} == {"und"}


def test_varied_texts_of_several_megabytes():
    r = random.Random(7)
    parts = {"en": ["th", "ing", "wh", "and", "er"], "de": ["sch", "ung", "ei", "über", "ch"], "fr": ["eau", "ou", "tion", "qu", "é"], "es": ["ción", "ñ", "ll", "ado", "mente"]}
    rare = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xE0, 0xF6)] + list("0123456789")

    def text(lang, n):
        word = lambda: "".join(r.choice(parts[lang] if r.random() < 0.95 else rare) for _ in range(r.randrange(2, 6)))
        return " ".join(word() for _ in range(n))

    langs = [x for x in parts for _ in range(60)]
    model = langid.Model([text(x, r.randrange(60, 300)) for x in langs], langs)
    names, score = model.predict([text(x, 400_000) for x in parts])
    assert names == list(parts) and score.min() > 0.5
    short = [text(x, 100) for x in parts]
    table, model.table = model.predict(short), None
    assert table[0] == model.predict(short)[0] and np.allclose(table[1], model.predict(short)[1], atol=1e-4)


def test_more_than_two_hundred_languages(spark):
    r = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(1100)]
    rows = []
    for k in range(220):
        for _ in range(14 if k else 40):
            rows.append((len(rows), "".join(r.choice(letters[5 * k : 5 * k + 5]) for _ in range(30)), f"l{k:03}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: x for i, _, x in rows}
    assert langid.fit(d).names == sorted(set(truth.values()))
    few = langid.fit(d, sample=220)
    assert few.names == sorted(set(truth.values()))
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in langid.identify(d, few).collect() if x.held_out]) > 0.95


def test_predictions_are_those_of_the_plain_formulas():
    """Sets of n-grams, their kernels one by one, Nyström features and ridge regression as published."""
    r = random.Random(11)
    parts = {"en": ["th", "ing", "and"], "de": ["sch", "und", "über"], "fr": ["eau", "est", "où"]}
    text = lambda x, n: " ".join("".join(r.choice(parts[x]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    langs = [x for x in parts for _ in range(12)]
    texts = [text(x, r.randrange(4, 20)) for x in langs]
    model = langid.Model(texts, langs, landmarks=9)

    order = np.random.default_rng(3).permutation(len(texts))
    turns = sorted((t, x, i) for x in sorted(parts) for t, i in enumerate(i for i in order if langs[i] == x))
    marks = [texts[i] for _, _, i in turns[:9]]
    w = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(w)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    features = lambda t: np.append(np.array([kernel(t, m) for m in marks]) @ root, 1.0)
    phi = np.array([features(t) for t in texts])
    names = sorted(parts)
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    ridge = langid.RIDGE * len(texts) * np.eye(phi.shape[1]) / 10
    fit = np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    probes = [text(x, 8) for x in parts for _ in range(6)] + ["the und où", "zzz"]
    values = np.array([features(t) for t in probes]) @ fit
    e = np.exp(langid.STEEP * (values - values.max(axis=1, keepdims=True)))
    got = model.predict(probes)
    assert got[0][:-2] == [names[i] for i in values.argmax(axis=1)][:-2]
    assert np.allclose(got[1], (e / e.sum(axis=1, keepdims=True)).max(axis=1), atol=0.05)
