"""Language identification by string kernels.

A text's blended spectrum is the set of its character n-grams of 1 to 4 characters, lower-cased, hashed to 2^BITS places
(presence, not counts). The kernel of two texts is the size of the intersection over the root of the sizes' product. A
bounded sample of texts serves as Nyström landmarks: with W the landmarks' kernel matrix, K W^(-1/2) is a feature map in
which a ridge regression is fitted, one language against the rest. Since all of this is linear in a text's kernel row,
scoring is two matrix products for a batch of texts: presence rows by landmark rows (kept as bits), and kernel rows by
coefficients; for few languages the two are one product with a table.

Every language seen is learned. Landmarks and regression are fitted on a hash's draw of about FIT_ROWS texts of each, or of
fewer where the languages are so many that the sample would pass SAMPLE texts, but not under LEAST. Texts of over 32 KiB are
drawn only for languages with fewer than LEAST others. Every document is scored, by a softmax over the languages' values.

Defined results: null text and text without a letter are `und` with score 0; texts are scored whole; repeated rows give
repeated rows; without any labelled text every row is `und`; ties go to the language that sorts first; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, prepare, text_bytes
from .labelled import FIT_BYTES, remainder

#: So many places that a text of several MB leaves most of them free.
BITS = 17
GRAMS = 4
#: Texts of a language for fitting, and landmarks in all.
FIT_ROWS, LANDMARKS = 300, 192
#: Texts of the whole sample, and texts of a language below which its share isn't cut (so few that a draw might miss it).
SAMPLE, LEAST = 60_000, 12
#: Weight of the ridge, and steepness of the softmax.
RIDGE, STEEP = 1e-2, 6.0

#: Places whose landmark rows are unpacked at once, and numbers of a table of values by place and language at most.
AT_ONCE, TABLE = 8192, 1 << 23

_LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str], bits: int = BITS, grams: int = GRAMS) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    return _present(texts, bits, grams).astype(np.float32)


def _present(texts: list[str], bits: int, grams: int = GRAMS) -> np.ndarray:
    out = np.zeros((len(texts), 1 << bits), bool)
    joined = "\0".join(texts).lower()
    parts = joined.split("\0") if texts else []
    if len(parts) != len(texts):  # a text holds the separator itself
        parts = [t.lower().replace("\0", " ") for t in texts]
        joined = "\0".join(parts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(p) for p in parts], np.int64)
    row = np.repeat(np.arange(len(parts)), np.append(size[:-1] + 1, size[-1:]))
    real = code != 0
    h, shift = np.zeros(len(code), np.uint64), np.uint64(64 - bits)
    flat = out.ravel()
    for n in range(1, grams + 1):
        if n > len(code):
            break
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        ok = real[n - 1 :] if n == 1 else ok[: len(code) - n + 1] & real[n - 1 :]
        place = (mix(h + np.uint64(n)) >> shift).astype(np.int64) + (row[: len(h)] << bits)
        flat[place[ok]] = True
    return out


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, bits: int = BITS, seed: int = 3):
        self.names = sorted(set(langs))
        self.bits = bits
        if not self.names:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        by = {x: [i for i in order if langs[i] == x] for x in self.names}
        # landmarks take turns over the languages
        turns = sorted((t, x, i) for x, own in by.items() for t, i in enumerate(own))
        chosen = [i for _, _, i in turns[: max(landmarks, len(self.names))]]
        marks = [np.flatnonzero(_present([texts[i]], bits)) for i in chosen]
        self.used = np.unique(np.concatenate(marks))
        self.size = np.array([max(1, len(x)) for x in marks])
        #: bits of a landmark's row at the used places
        self.marks = np.zeros((len(marks), -(-len(self.used) // 8)), np.uint8)
        for i, own in enumerate(marks):
            row = np.zeros(len(self.used), bool)
            row[np.searchsorted(self.used, own)] = True
            self.marks[i] = np.packbits(row)
        w = np.concatenate([self.kernel(_present([texts[i] for i in chosen[a : a + 64]], bits)) for a in range(0, len(chosen), 64)]).astype(np.float64)
        value, vector = np.linalg.eigh(w)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        number = {x: j for j, x in enumerate(self.names)}
        lang = np.array([number[x] for x in langs])
        weight = 1 / np.bincount(lang)[lang]
        weight *= len(langs) / weight.sum()
        size = root.shape[1] + 1
        square, target = np.zeros((size, size)), np.zeros((len(self.names), size))
        for a in range(0, len(texts), 64):  # some texts at once, to bound memory
            phi = self.kernel(_present(texts[a : a + 64], bits)) @ root
            phi = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
            weighed = weight[a : a + 64, None] * phi
            square += phi.T @ weighed
            target -= weighed.sum(0)
            np.add.at(target, lang[a : a + 64], 2 * weighed)
        fit = np.linalg.solve(square + RIDGE * len(langs) * np.eye(size) / 10, target.T)
        self.coefficients, self.offset = (root @ fit[:-1]).astype(np.float32), fit[-1]

        self.table = None
        if len(self.used) * len(self.names) <= TABLE:
            self.table = np.concatenate([self._unpacked(a).T @ (self.coefficients / np.sqrt(self.size)[:, None]) for a in range(0, len(self.used), AT_ONCE)]).astype(np.float32)

    def _unpacked(self, a: int) -> np.ndarray:
        n = min(AT_ONCE, len(self.used) - a)
        return np.unpackbits(self.marks[:, a // 8 : (a + AT_ONCE) // 8], axis=1, count=n).astype(np.float32)

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(self.marks)), np.float32)
        for a in range(0, len(self.used), AT_ONCE):
            out += rows[:, self.used[a : a + AT_ONCE]].astype(np.float32) @ self._unpacked(a).T
        return out / np.sqrt(np.maximum(np.count_nonzero(rows, axis=1)[:, None], 1) * self.size)

    def values(self, rows: np.ndarray) -> np.ndarray:
        """Kernel rows by coefficients; by way of a table of values by place where the languages are few."""
        if self.table is None:
            return self.kernel(rows) @ self.coefficients + self.offset
        return rows[:, self.used].astype(np.float32) @ self.table / np.sqrt(np.maximum(np.count_nonzero(rows, axis=1)[:, None], 1)) + self.offset

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.names else []
        if own:
            value = self.values(_present([texts[i] for i in own], self.bits))
            e = np.exp(STEEP * (value - value.max(axis=1, keepdims=True)))
            best = e.argmax(axis=1)
            for i, b, p in zip(own, best, e.max(axis=1) / e.sum(axis=1), strict=True):
                names[i], score[i] = self.names[b], p
        return names, score


def fit(docs: DataFrame, modulus: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("id"), modulus) != held))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("long", F.octet_length("text") > FIT_BYTES)
    counts: dict[str, dict[bool, int]] = {}
    for r in rows.groupBy("lang", "long").count().collect():
        counts.setdefault(r["lang"], {})[r["long"]] = r["count"]
    if not counts:
        return Model([], [])
    # a share of each language's texts by a hash, about `each` of them; long ones only where there are too few others
    each = min(fit_rows, max(LEAST, sample // len(counts)))
    shares = [(x, long, min(1.0, each / n)) for x, of in counts.items() for long, n in of.items() if not long or of.get(False, 0) < LEAST]
    table = docs.sparkSession.createDataFrame(shares, "lang string, long boolean, share double")
    drawn = rows.join(F.broadcast(table), ["lang", "long"]).filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # a repeated text counts once; the order makes the cut, which bounds the sample, the same in each run
    drawn = drawn.select("lang", "text").distinct().orderBy(F.xxhash64("text", "lang"), "text", "lang").limit(2 * each * len(counts))
    got = sorted((r.text, r.lang) for r in drawn.collect())
    return Model([t for t, _ in got], [x for _, x in got])


def identify(docs: DataFrame, model: Model | None = None, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, modulus, held, id_col=id_col, text_col=text_col, lang_col=lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                for a in range(0, part.num_rows, 64):
                    own = part.slice(a, 64)
                    raw = own.column(1).cast(pa.binary()).to_pylist()
                    names, score = sent.value.predict([None if x is None else x.decode("utf-8", "replace") for x in raw])
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = small.mapInArrow(run, f"id {small.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (remainder(F.col("id"), modulus) == held).alias("held_out"), "lang_pred", "score")
