"""Labelled rows for fitting: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; of a null id, of the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % modulus


#: Bytes of a text that is fitted on whole; of a longer one so many, in stretches of STRETCH_BYTES drawn from all of it.
FIT_BYTES, STRETCH_BYTES = 1 << 15, 1 << 10


def drawn_stretches(text: bytes, fit_bytes: int = FIT_BYTES, stretch: int = STRETCH_BYTES) -> bytes:
    """The text, or if it is longer than fit_bytes, those of its stretches whose hashes are smallest, in their order.

    Stretches end at blanks, or after twice their length where there is none; each is as likely as any other."""
    if len(text) <= fit_bytes:
        return text
    edges = [0]
    while edges[-1] < len(text):
        at = edges[-1] + stretch
        cut = min((x for x in (text.find(b, at, at + stretch) for b in (b" ", b"\n", b"\t")) if x >= 0), default=at + stretch - 1) + 1
        while cut < len(text) and text[cut] & 0xC0 == 0x80:  # not within a character
            cut += 1
        edges.append(min(cut, len(text)))
    pieces = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    order = sorted(range(len(pieces)), key=lambda i: (xxhash.xxh64_intdigest(pieces[i], i), i))
    kept, size = [], 0
    for i in order:
        if kept and size + len(pieces[i]) > fit_bytes:
            break
        kept.append(i)
        size += len(pieces[i])
    return b"\n".join(pieces[i] for i in sorted(kept))


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int, modulus: int, held: int, id_col: str, text_col: str, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """text, label (0 or 1) of at most fit_rows labelled rows outside the held-out remainder; of a text longer than fit_bytes
    so many bytes of its stretches, so that a label which only long texts have is learned like any other.

    A label and a text an id: of rows that share an id the smallest of each. The sample is in the order of a hash of the id;
    first of ids that have both, then of their texts, so that a text is only moved if its row is drawn. Labels that are null
    or neither 0 nor 1 and ids that are null are not learned from."""
    usable = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    usable = usable.filter(remainder(F.col("id"), modulus) != held).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    known = texts.select("id").filter(remainder(F.col("id"), modulus) != held).distinct()
    drawn = usable.join(known, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [drawn_stretches(t.as_buffer().to_pybytes(), fit_bytes).decode("utf-8", "ignore") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string()), batch.column(2)], ["id", "text", "label"])

    found = texts.join(F.broadcast(drawn), "id").select("id", "text", "label")
    found = found.mapInArrow(bounded, found.schema)
    return found.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * margin).sum() + 1e-2 * (a - 1), (p - y).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
