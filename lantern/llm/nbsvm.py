"""Quality scores by naive Bayes support vectors.

A text's features are the presence of token n-grams: words and runs of punctuation, alone and in pairs, and triples of
their shapes (case, digits, punctuation, a repeat of the token before), hashed to 2^BITS places. A place's value is the
log-count ratio of its smoothed counts in either class. A linear hinge-loss model over these values is fitted by dual
coordinate descent, and a logistic curve through margins of a part that the model has not seen gives the score.

Counts and model are fitted on at most FIT_ROWS labelled rows, in the order of a hash of their id, and of a text over 32 KiB
on so many bytes of its stretches, drawn from the whole of it; every document is scored.

Defined results: null or empty text has no features and the score of the model's offset; texts are scored whole; repeated
rows give repeated rows; ids without a label are scored alike; without labels of both classes every score is the mean of
the labels (0.5 without any); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, SPACED, Substrings, blocks, columns_of, mix, prepare, row_of, text_bytes, words
from .labelled import calibrate, remainder, sampled_texts, sigmoid

BITS = 18
FIT_ROWS = 6000
#: Smoothing of counts, cost of a margin's violation and passes of the descent.
ALPHA, COST, PASSES = 1.0, 1.0, 12

_PUNCTUATION = SPACED & ~ALNUM
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed places of each row, one row after the other, and where each row begins."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    low = LOWER[data]
    ws, we, _ = words(low, offs, ALNUM)
    ps, pe, _ = words(low, offs, _PUNCTUATION)
    starts, ends = np.concatenate([ws, ps]), np.concatenate([we, pe])
    order = np.argsort(starts, kind="stable")
    starts, ends, punct = starts[order], ends[order], (order >= len(ws))
    h = Substrings(low).hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    upper, digit = np.append(0, np.cumsum(_UPPER[data])), np.append(0, np.cumsum(_DIGIT[data]))
    up, dig = upper[ends] - upper[starts], digit[ends] - digit[starts]
    shape = np.where(dig > 0, 4, np.where(up == 0, 0, np.where(up >= 2, 2, np.where(_UPPER[data[starts]] > 0, 1, 3))))
    shape = np.where(punct, 5 + low[starts].astype(np.int64), shape)
    row = np.searchsorted(offs, starts, "right") - 1
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    code = (shape * 2 + again).astype(np.uint64) + np.uint64(1)
    two = row[1:] == row[:-1]
    three = row[2:] == row[:-2]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[two]
    tri = mix(mix(code[:-2] * np.uint64(1_000_003) + code[1:-1]) + code[2:])[three]
    shift = np.uint64(64 - bits)
    places = np.concatenate([h >> shift, pair >> shift, tri >> shift]).astype(np.int64)
    owner = np.concatenate([row, row[:-1][two], row[:-2][three]])
    both = np.unique((owner << bits) | places)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(n + 1))


def log_count_ratio(places: list[np.ndarray], y: np.ndarray, size: int, alpha: float = ALPHA) -> np.ndarray:
    counts = [np.full(size, alpha), np.full(size, alpha)]
    for x, label in zip(places, y, strict=True):
        counts[int(label)][x] += 1
    zero, one = (c / c.sum() for c in counts)
    return np.log(one / zero)


def dual_coordinate_descent(places: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and offset of the L1 hinge loss over rows of unit length; classes weigh alike in sum."""
    rng = np.random.default_rng(seed)
    values = [ratio[x] / (np.linalg.norm(ratio[x]) + 1e-12) for x in places]
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    limit = cost * 0.5 / share[y.astype(int)]
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            x, v = places[i], values[i]
            # rows have length 1, and 1 more for the offset
            step = alpha[i] - (sign[i] * (w[x] @ v + b) - 1) / 2
            step = min(max(step, 0.0), limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[x] += step * sign[i] * v
                b += step * sign[i]
    return w, b


class Model:
    def __init__(self, places: list[np.ndarray], y: np.ndarray, bits: int = BITS):
        self.bits, self.flat = bits, float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y)) == 2
        if not self.fitted:
            return
        size = 1 << bits
        fold = np.arange(len(y)) % 4 == 3
        if len(np.unique(y[~fold])) < 2 or len(np.unique(y[fold])) < 2:
            fold[:] = False
        a, b = 1.0, 0.0
        if fold.any():
            train, test = [x for x, f in zip(places, fold, strict=True) if not f], [x for x, f in zip(places, fold, strict=True) if f]
            ratio = log_count_ratio(train, y[~fold], size)
            w, off = dual_coordinate_descent(train, y[~fold], ratio)
            margin = np.array([self._margin(x, ratio, w, off) for x in test])
            a, b = calibrate(margin, y[fold])
        ratio = log_count_ratio(places, y, size)
        w, off = dual_coordinate_descent(places, y, ratio)
        self.value, self.weight, self.offset = (a * w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), a * off + b

    @staticmethod
    def _margin(x: np.ndarray, ratio: np.ndarray, w: np.ndarray, off: float) -> float:
        return float(w[x] @ ratio[x]) / (np.linalg.norm(ratio[x]) + 1e-12) + off

    def scores(self, places: np.ndarray, begin: np.ndarray) -> np.ndarray:
        n = len(begin) - 1
        if not self.fitted:
            return np.full(n, self.flat)
        top, length = (np.append(0.0, np.cumsum(t[places], dtype=np.float64)) for t in (self.value, self.weight))
        return sigmoid((top[begin[1:]] - top[begin[:-1]]) / (np.sqrt(np.maximum(length[begin[1:]] - length[begin[:-1]], 0)) + 1e-12) + self.offset)


def fit(texts: DataFrame, bits: int = BITS) -> Model:
    """The model of a bounded sample with columns text and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                places, begin = features(*text_bytes(part.column(0)), bits)
                rows = [places[a:b].astype("<u4").tobytes() for a, b in zip(begin, begin[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column(1)], ["places", "label"])

    rows = sorted((bytes(r.places), r.label) for r in texts.select("text", "label").mapInArrow(run, "places binary, label int").collect())
    order = np.random.default_rng(0).permutation(len(rows))
    return Model([np.frombuffer(rows[i][0], "<u4").astype(np.int64) for i in order], np.array([rows[i][1] for i in order], np.int64), bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in blocks(batch, "text"):
                p = model.scores(*features(*text_bytes(part.column(1)), model.bits))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return small.mapInArrow(run, f"id {small.schema['id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    model = fit(sampled_texts(docs, labels, label, fit_rows, modulus, held, id_col, text_col))
    out = score(docs, model, id_col, text_col, threshold)
    return out.select(F.col("id").alias(id_col), (remainder(F.col("id"), modulus) == held).alias("held_out"), "score", "predicted")


def keep_accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold."""
    prepare(docs.sparkSession)
    model = fit(sampled_texts(docs, labels, label, fit_rows, modulus, held, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(row_of(docs), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                p = sent.value.scores(*features(*text_bytes(part.column(1)), sent.value.bits))
                yield part.select([0]).filter(pa.array(p >= threshold))

    return whole.mapInArrow(run, whole.select("row").schema).select(*columns_of(F.col("row"), docs.columns))
