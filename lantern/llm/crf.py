"""Toxicity by a linear-chain conditional random field.

Tokens are tagged T (toxic) or O. Training tags come from labelled documents: in a document labelled toxic, the words that
such documents hold and others hardly ever do are T, and so are words with a beginning or ending that such documents hold
repeatedly; all other tokens are O. The field has hashed features of a token, its beginnings and endings of some characters
and its two neighbours, and weights of the four transitions; its conditional log-likelihood is maximised with forward-backward
expectations. Scoring runs forward-backward over whole documents: the messages are ratios, so a step is a linear
fractional map, and maps of a stretch compose, which lets numpy handle many stretches side by side without any cut in
the chain. A document's evidence is the sum of the log-odds of its tokens that are more likely T than O; its score is that
through a logistic curve, which is fitted on rows as fields score them that were not fitted on them. Offending spans are
runs of tokens with a marginal of 0.5 or more, as byte offsets; a document under the threshold may hold one.

The field is fitted on at most FIT_ROWS labelled rows, in the order of a hash of their id, of a text over 32 KiB on so many
bytes of its stretches, drawn from the whole of it, and on at most MOST_STRETCHES stretches of STRETCH tokens of them, drawn at random; every document is scored.

Defined results: null or word-less text has score 0 and no spans; texts are scored whole; repeated rows give repeated
rows; without labels of both classes all scores are 0; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BLOCK_BYTES, LOWER, Substrings, blocks, mix, prepare, text_bytes, word_hashes, words
from .labelled import calibrate, remainder, sampled_texts, sigmoid

BITS = 18
FIT_ROWS = 5000
#: A training word is toxic if it is in SEEN or more toxic documents and this share of the documents it is in are toxic.
SEEN, PURE = 4, 0.9
#: Tokens of a training stretch, most stretches, rounds and pull to zero of the fit.
STRETCH, MOST_STRETCHES, ROUNDS, PULL = 32, 8_000, 50, 0.5
#: Stretches that run side by side when scoring.
LANES = 512
#: Tokens scored at once when fitting.
CALIBRATED = 200_000
_KINDS = 3
#: Values of a token's own feature and of its neighbours' features, and of the features of its ends.
_VALUES = np.array([1.0, 0.3, 0.3])
_END_VALUE = 0.5
#: Characters of a token's beginnings and endings that are features.
PREFIXES, SUFFIXES = (4, 5, 6, 7), (5,)
#: A beginning or ending of these columns is toxic if SEEN or more toxic documents hold it twice or more and they are this
#: share of the documents that do.
STEMS, STEM_PURE = (1, 2, 3, 4), 0.75
#: Parts of the training rows whose marginals come from a field fitted without them, to weigh the document's values.
FOLDS = 2


def ends_of(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the PREFIXES and SUFFIXES of tokens (a row each); 0 where a token has fewer characters."""
    out = np.zeros((len(s), len(PREFIXES) + len(SUFFIXES)), np.uint64)
    if not len(s):
        return out
    part = Substrings(low)
    char = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
    a, b = np.searchsorted(char, s), np.searchsorted(char, e)
    for j, k in enumerate(PREFIXES):
        own = np.flatnonzero(b - a >= k)
        out[own, j] = part.hashes(s[own], char[a[own] + k])
    for j, k in enumerate(SUFFIXES, len(PREFIXES)):
        own = np.flatnonzero(b - a >= k)
        out[own, j] = part.hashes(char[b[own] - k], e[own])
    return out


def places(h: np.ndarray, first: np.ndarray, bits: int = BITS, ends: np.ndarray | None = None) -> np.ndarray:
    """Hashed features of tokens (a row each): the token, the one before, the one after, its ends. first: where documents begin."""
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    if len(h):
        before[1:], after[:-1] = h[:-1], h[1:]
        edge = first[:-1][first[:-1] < first[1:]]
        before[edge] = 0
        after[np.append(edge[1:], len(h)) - 1] = 0
    return _hashed([h, before, after, *(ends.T if ends is not None else ())], bits)


def _values(kinds: int) -> np.ndarray:
    return np.append(_VALUES, np.full(kinds - _KINDS, _END_VALUE))


def _hashed(kinds: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.empty((*kinds[0].shape, len(kinds)), np.int64)
    for j, x in enumerate(kinds):
        out[..., j] = (mix(x + np.uint64(j)) >> np.uint64(64 - bits)).astype(np.int64) + (j << bits)
    return out


# --- fitting ----------------------------------------------------------------------------------------------------


def weak_tags(h: np.ndarray, doc: np.ndarray, toxic: np.ndarray, seen: int = SEEN, pure: float = PURE) -> np.ndarray:
    """1 for tokens of toxic documents whose word is toxic by document counts."""
    vocabulary, word = np.unique(h, return_inverse=True)
    word = word.astype(np.int32)
    n, bad = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    edges = np.searchsorted(doc, np.arange(len(toxic) + 1))
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        own = np.unique(word[a:b])
        n[own] += 1
        bad[own] += int(toxic[i] > 0)
    return ((bad >= seen) & (bad >= pure * n))[word] & (toxic[doc] > 0)


def stem_tags(ends: np.ndarray, doc: np.ndarray, toxic: np.ndarray, seen: int = SEEN, pure: float = STEM_PURE) -> np.ndarray:
    """1 for tokens of toxic documents with an end that stands repeatedly in toxic documents and hardly ever so in others."""
    out = np.zeros(len(doc), bool)
    for j in STEMS:
        has = np.flatnonzero(ends[:, j])
        stem, code = np.unique(ends[has, j], return_inverse=True)
        pair, times = np.unique(doc[has] * np.int64(max(1, len(stem))) + code, return_counts=True)
        pair = pair[times > 1]
        n = np.bincount(pair % max(1, len(stem)), minlength=len(stem))
        bad = np.bincount(pair % max(1, len(stem)), weights=toxic[pair // max(1, len(stem))] > 0, minlength=len(stem))
        out[has] |= ((bad >= seen) & (bad >= pure * n))[code]
    return out & (toxic[doc] > 0)


def log_likelihood(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of stretches, and its gradients by the emission of T and by the transitions.

    emit: (stretches, tokens) score of T over O; trans: 2 x 2; tags; real: which tokens there are (a prefix of each row)."""
    n, steps = emit.shape
    e = np.stack([np.zeros_like(emit), emit], axis=2)
    t = np.exp(trans)
    top = np.maximum(emit, 0)
    scaled = np.exp(e - top[:, :, None])
    forward, scale = np.empty((n, steps, 2)), np.empty((n, steps))
    a = scaled[:, 0]
    logz = (top * real).sum(1)
    for i in range(steps):
        if i:
            a = np.where(real[:, i, None], (a @ t) * scaled[:, i], a)
        s = a[:, 0] + a[:, 1]
        a = a / s[:, None]
        logz += np.where(real[:, i], np.log(s), 0)
        forward[:, i], scale[:, i] = a, s
    backward = np.ones((n, 2))
    marginal, pair = np.empty((n, steps)), np.zeros((2, 2))
    for i in range(steps - 1, -1, -1):
        m = forward[:, i] * backward
        m /= (m[:, 0] + m[:, 1])[:, None]
        marginal[:, i] = m[:, 1]
        if i:
            w = scaled[:, i] * backward
            joint = forward[:, i - 1, :, None] * t * w[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pair += joint[real[:, i]].sum(0)
            new = w @ t.T
            backward = np.where(real[:, i, None], new / (new[:, 0] + new[:, 1])[:, None], backward)
    y = tags.astype(int)
    score = (emit * y * real).sum() + trans[y[:, :-1], y[:, 1:]][real[:, 1:]].sum()
    seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[real[:, 1:]], minlength=4).reshape(2, 2)
    total = real.sum()
    return float((score - logz.sum()) / total), (y - marginal) * real / total, (seen - pair) / total


class Field:
    def __init__(self, h: np.ndarray, first: np.ndarray, toxic: np.ndarray, bits: int = BITS, seed: int = 5, ends: np.ndarray | None = None, folds: int = FOLDS, most: int = MOST_STRETCHES):
        self.bits = bits
        ends = np.zeros((len(h), 0), np.uint64) if ends is None else ends
        self.weights, self.trans = np.zeros((_KINDS + ends.shape[1]) << bits), np.zeros((2, 2))
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0
        doc = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(first))
        tags = weak_tags(h, doc, toxic)
        if ends.shape[1]:
            tags |= stem_tags(ends, doc, toxic)
        self.fitted = bool(tags.any()) and len(np.unique(toxic)) == 2
        if not self.fitted:
            return
        self._learn(h, first, tags, ends, most, seed)
        if not folds:
            return
        # the curve sees rows as a field scores them that wasn't fitted on them
        fold = np.random.default_rng(seed).permutation(len(toxic)) % folds
        value, known = np.zeros(len(toxic)), np.zeros(len(toxic), bool)
        for k in range(folds):
            own, others = fold == k, fold != k
            a, b = own[doc], others[doc]
            field = Field(h[b], _edges(first, others), toxic[others], bits, seed, ends[b], 0, most // folds)
            if field.fitted:
                value[own], known[own] = field.all_evidence(h[a], _edges(first, own), ends[a]), True
        if len(np.unique(toxic[known])) < 2:  # too few rows to leave some out
            value, known = self.all_evidence(h, first, ends), np.ones(len(toxic), bool)
        self.slope, self.offset = calibrate(value[known], toxic[known].astype(float))

    def _learn(self, h: np.ndarray, first: np.ndarray, tags: np.ndarray, ends: np.ndarray, most: int, seed: int) -> None:
        """Weights of the features by the tags."""
        bits, kinds = self.bits, _KINDS + ends.shape[1]
        # stretches of a document's tokens: a draw of those with a T, half of all at most, and a draw of the others
        begin = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first, first[1:], strict=False)] + [np.zeros(0, np.int64)])
        end = np.minimum(begin + STRETCH, first[np.searchsorted(first, begin, "right")])
        ones = np.append(0, np.cumsum(tags))
        rng = np.random.default_rng(seed)
        with_t = np.flatnonzero(ones[end] > ones[begin])
        with_t = np.sort(rng.permutation(with_t)[: most // 2])
        without = np.flatnonzero(ones[end] == ones[begin])
        without = np.sort(rng.permutation(without)[: most - len(with_t)])
        own = np.concatenate([with_t, without])
        at = np.minimum(begin[own][:, None] + np.arange(STRETCH), len(h) - 1)
        real = begin[own][:, None] + np.arange(STRETCH) < end[own][:, None]
        edge = np.zeros(len(h) + 1, bool)
        edge[first] = True
        around = [h[at], np.where(edge[at], np.uint64(0), h[at - 1]), np.where(edge[at + 1], np.uint64(0), h[np.minimum(at + 1, len(h) - 1)]), *np.moveaxis(ends[at], 2, 0)]
        x, y = _hashed(around, bits), tags[at] & real
        used, code = np.unique(x[real], return_inverse=True)
        slots = np.zeros(x.shape, np.int64)
        slots[real] = code.reshape(-1, kinds)
        w, trans, bias = np.zeros(len(used)), np.zeros((2, 2)), -3.0
        square = [np.full(len(used), 1e-6), np.full((2, 2), 1e-6), 1e-6]
        total, scale = real.sum(), _values(kinds)
        flat = slots[real].ravel()
        for _ in range(ROUNDS):
            _, ge, gt = log_likelihood(w[slots] @ scale + bias, trans, y, real)
            grads = [total * np.bincount(flat, (ge[real][:, None] * scale).ravel(), len(used)) - PULL * w, total * gt - PULL * trans, total * ge.sum()]
            square = [s + g * g for s, g in zip(square, grads, strict=True)]
            w += 0.5 * grads[0] / np.sqrt(square[0])
            trans += 0.3 * grads[1] / np.sqrt(square[1])
            bias += 0.3 * grads[2] / np.sqrt(square[2])
        self.weights[used], self.trans, self.bias = w, trans, float(bias)

    def all_evidence(self, h: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Evidence of documents, some at once, to bound memory."""
        out, lo = np.zeros(len(first) - 1), 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CALIBRATED, "right")) - 1)
            a, b, part = first[lo], first[hi], first[lo : hi + 1] - first[lo]
            out[lo:hi] = self.evidence(self.marginals(places(h[a:b], part, self.bits, ends[a:b]), part), part)
            lo = hi
        return out

    def marginals(self, x: np.ndarray, first: np.ndarray, lanes: int = LANES) -> np.ndarray:
        """Probability of T for each token; first: where documents begin, and the end."""
        n = len(x)
        if not n:
            return np.zeros(0)
        odds = np.exp(np.clip(self.weights[x] @ _values(x.shape[1]) + self.bias, -30, 30))
        (oo, ot), (to, tt) = np.exp(self.trans)
        start = np.zeros(n, bool)
        start[first[:-1][first[:-1] < first[1:]]] = True
        # a -> e (ot + tt a) / (oo + to a), and a -> e at a document's first token
        ahead = _scan(np.where(start, odds, odds * ot), np.where(start, 0, odds * tt), np.where(start, 1, oo), np.where(start, 0, to), lanes)
        # b -> (to + tt e b) / (oo + ot e b) with the next token's e, and b -> 1 at a document's last token
        last = np.append(start[1:], True)
        e = np.append(odds[1:], 1)
        back = _scan(*(v[::-1] for v in (np.where(last, 1, to), np.where(last, 0, tt * e), np.where(last, 1, oo), np.where(last, 0, ot * e))), lanes)[::-1]
        both = ahead * back
        return both / (1 + both)

    def evidence(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of the sum of the log-odds of a document's tokens that are more likely T than O, the largest through a soft bend."""
        out = np.full(len(first) - 1, -20.0)
        some = first[:-1] < first[1:]
        if some.any():
            at, odds = first[:-1][some], _logit(p)
            top = np.maximum.reduceat(odds, at)
            out[some] = np.log(np.logaddexp(0, top) + np.add.reduceat(np.maximum(odds, 0), at) - np.maximum(top, 0))
        return out

    def scores(self, evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
        s = sigmoid(self.slope * evidence + self.offset)
        return np.where(first[:-1] < first[1:], s, 0.0) if self.fitted else np.zeros(len(evidence))


def _edges(first: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(np.diff(first)[own]))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _scan(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, lanes: int) -> np.ndarray:
    """All values of v -> (p + q v) / (r + s v), one map after the other; the first map ignores its input."""
    n = len(p)
    lanes = max(1, min(lanes, n // 16))
    steps = -(-n // lanes)
    pad = steps * lanes - n
    p, q, r, s = (np.append(x, np.full(pad, f)).reshape(lanes, steps).T.copy() for x, f in ((p, 1.0), (q, 0.0), (r, 1.0), (s, 0.0)))
    # each lane's maps composed: v -> (a + b v) / (c + d v)
    a, b, c, d = p[0], q[0], r[0], s[0]
    for i in range(1, steps):
        a, b, c, d = p[i] * c + q[i] * a, p[i] * d + q[i] * b, r[i] * c + s[i] * a, r[i] * d + s[i] * b
        if i % 8 == 0:
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
    into, v = np.ones(lanes), 1.0
    for lane in range(lanes):
        into[lane] = v
        v = (a[lane] + b[lane] * v) / (c[lane] + d[lane] * v)
    out, v = np.empty((steps, lanes)), into
    for i in range(steps):
        v = (p[i] + q[i] * v) / (r[i] + s[i] * v)
        out[i] = v
    return out.T.ravel()[:n]


#: No tokens, ends and documents.
_NOTHING = (np.zeros(0, np.uint64), np.zeros((0, len(PREFIXES) + len(SUFFIXES)), np.uint64), np.zeros(0, np.int64))


# --- Spark ------------------------------------------------------------------------------------------------------


def fit(texts: DataFrame, bits: int = BITS) -> Field:
    """The field of a bounded sample with columns text and label."""

    rows = sorted((r.text.encode("utf-8", "surrogatepass"), r.label) for r in texts.select("text", "label").collect())
    parts, lo = [], 0
    while lo < len(rows):  # some texts at once, to bound memory
        hi, size = lo, 0
        while hi < len(rows) and (hi == lo or size + len(rows[hi][0]) <= BLOCK_BYTES):
            size += len(rows[hi][0])
            hi += 1
        low = LOWER[np.frombuffer(b"".join(x for x, _ in rows[lo:hi]), np.uint8)]
        s, e, first = words(low, np.append(0, np.cumsum([len(x) for x, _ in rows[lo:hi]])), ALNUM)
        parts.append((word_hashes(low, s, e), ends_of(low, s, e), np.diff(first)))
        lo = hi
    h, ends, n = (np.concatenate([*x, y]) for x, y in zip(zip(*parts, strict=True) if parts else ((), (), ()), _NOTHING, strict=True))
    return Field(h, np.append(0, np.cumsum(n)).astype(np.int64), np.array([y for _, y in rows], np.int64), bits, ends=ends)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, spans (array of begin, end in bytes)."""
    prepare(docs.sparkSession)
    field = fit(sampled_texts(docs, labels, label, fit_rows, modulus, held, id_col, text_col))
    field.weights = field.weights.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offs = text_bytes(part.column(1))
                low = LOWER[data]
                s, e, first = words(low, offs, ALNUM)
                p = field.marginals(places(word_hashes(low, s, e), first, field.bits, ends_of(low, s, e)), first) if field.fitted else np.zeros(len(s))
                score = field.scores(field.evidence(p, first), first)
                hit = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(first, hit, "right") - 1
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (doc[1:] != doc[:-1])
                stop = np.append(np.flatnonzero(new)[1:], len(hit)) - 1 if len(hit) else np.zeros(0, np.int64)
                own = doc[new]
                begin, end = s[hit[new]] - offs[own], e[hit[stop]] - offs[own]
                spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(offs))), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), lists], ["id", "score", "predicted", "spans"])

    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = small.mapInArrow(run, f"id {small.schema['id'].dataType.simpleString()}, score double, predicted int, spans array<struct<begin:long,end:long>>")
    return out.select(F.col("id").alias(id_col), (remainder(F.col("id"), modulus) == held).alias("held_out"), "score", "predicted", "spans")
