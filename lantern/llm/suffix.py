"""Exact substring dedup: bytes covered by a 200-byte string that also starts anywhere else are removed.

Which of the 200-byte windows are equal is decided by a suffix sort with bucket-pointer refinement: positions are put in
buckets by their first 8 bytes, and a bucket is refined by sorting on the bucket identifiers of later offsets; as refined
identifiers are used again, the compared depth doubles until 200 bytes are compared.

Sorting every suffix of a corpus against every other would shuffle several times its size, so the windows are first dealt
to groups without loss. A window's anchor is its leftmost 50-byte gram of smallest hash, so equal windows have equal
anchors at equal offsets. Windows of one document with the same anchor are consecutive; the run of bytes that they span is
the anchor's stretch. If all stretches of an anchor gram (at its offset) are the same string, either there is one and
nothing is removed, or all their windows repeat. Only groups with different stretches are sorted, with one copy of each.

A group of more than LARGE different stretches is dealt on before it is sorted. Its windows share the bytes from the last
start to the first end that any of them may have, and they begin at most so many bytes before the anchor. Those that begin
in the farther half of that range also share a piece to the left of those bytes, if they are equal, and those that begin in
the nearer half a piece to the right. So a stretch is cut into two, each dealt by the hash of its piece. Each time the
range is halved, until a group is small or its windows begin at one place; of equal stretches one copy is kept. Only a
range that holds an end of what the group's windows have in common stays large, so a stretch gives a few rows a round.

Texts and stretches are known by 128-bit hashes of their content, as equal ones have equal results; different stretches
that share a group are compared byte by byte by the sort.

Defined results: null text is empty (0 bytes, nothing removed); texts of any length are treated whole, the longest in
blocks whose edges do not matter; of repeated rows and copies every one is emptied, as each repeats the others; an empty
table gives an empty result; other columns are ignored, whatever their names, but for those to be carried, whose names
must not be those of results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, Substrings, blocks, content_key, list_array, mix, prepare, saved, text_bytes

LENGTH = 200
GRAM = 50
#: Different stretches of a group above which it is dealt on before it is sorted.
LARGE = 512
#: Bytes of stretches that are sorted at once, and about so many of a task.
SORT_BYTES, TASK_BYTES = 1 << 20, 4 << 20

_SEED2 = np.uint64(0x5851F42D4C957F2D)


# --- anchors ----------------------------------------------------------------------------------------------------


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(x)
    pad = -n % w
    top = np.iinfo(np.uint64).max
    rows = np.concatenate([x, np.full(pad, top, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: row, first window in the row, number of windows, the anchor's place in the
    stretch, hash of the gram, hash of the stretch and that place."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sub = Substrings(data)
    h = sub.grams(gram)
    bits = np.uint64(int(len(h)).bit_length())
    slot = np.arange(len(h), dtype=np.uint64)
    best = sliding_least(((h >> bits) << bits) | slot, length - gram + 1)
    anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    whole = start + length <= offs[row + 1]
    start, anchor, row = start[whole], anchor[whole], row[whole]
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    lo = start[new]
    n = np.diff(np.append(np.flatnonzero(new), len(start)))
    a, r = anchor[new], row[new]
    return r, lo - offs[r], n, a - lo, h[a], stretch_hashes(data, lo, lo + n + length - 1, a - lo)


def stretch_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of stretches and the anchor's place in them, by another family than that of the grams."""
    return mix(Substrings(data, 1).hashes(begin, end) ^ (place.astype(np.uint64) * _SEED2))


class Copies:
    """Which rows of a task hold a text that fewer than `most` rows before it hold."""

    def __init__(self, most: int):
        self.most, self.seen = most, {}

    def few(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = self.seen.get(key, 0)
            if n < self.most:
                self.seen[key] = n + 1
            keep.append(n < self.most)
        return batch if all(keep) else batch.filter(pa.array(keep))


def anchor_rows(docs: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """k1, k2, lo, n, p, g, e of all documents; a text longer than a block is cut into runs of windows. Of the copies of a
    text in a task two serve, as they repeat each other and more would add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(k1: np.ndarray, k2: np.ndarray, shift: int, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
            r, lo, n, p, g, e = anchors(data, offs, length, gram)
            columns = [k1[r], k2[r], (lo + shift).astype(np.int32), n.astype(np.int16), p.astype(np.int16), g.view(np.int64), e.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k1", "k2", "lo", "n", "p", "g", "e"])

        copies = Copies(2)
        for batch in map(copies.few, batches):
            data, offs = text_bytes(batch.column(2))
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + block, "right")) - 1)
                to = min(to, batch.num_rows)
                a, b = int(offs[at]), int(offs[to])
                if b - a <= block:
                    yield made(k1[at:to], k2[at:to], 0, data[a:b], offs[at : to + 1] - a)
                else:
                    for x in range(0, b - a - length + 1, block):
                        piece = data[a + x : min(b, a + x + block + length - 1)]
                        yield made(k1[at:to], k2[at:to], x, piece, np.array([0, len(piece)]))
                at = to

    small = docs.select(*content_key(F.col("text")), "text").filter(F.octet_length("text") >= length)
    return small.mapInArrow(run, "k1 long, k2 long, lo int, n short, p short, g long, e long")


# --- bucket-pointer refinement ----------------------------------------------------------------------------------


def refined_buckets(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """A bucket for each position, equal for positions whose next `length` bytes are equal; -1 where fewer are left.

    ends: for each position, the end of its string."""
    n = len(data)
    q = min(8, length)
    first = np.zeros(n, np.uint64)
    for j in range(q):
        first[: n - j] |= data[j:].astype(np.uint64) << np.uint64(8 * (7 - j))
    at = np.arange(n)
    bucket = np.full(n, -1, np.int64)
    deep = at + q <= ends
    _, bucket[deep] = np.unique(first[deep], return_inverse=True)
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        reach = depth + step
        live = np.flatnonzero((at + reach <= ends) & (bucket >= 0))
        new = np.full(n, -1, np.int64)
        if len(live):
            mine = bucket[live]
            shared = np.bincount(mine)[mine] > 1
            # a bucket of one stays one; the others are sorted on the bucket `step` bytes further on
            new[live[~shared]] = mine[~shared]
            rest = live[shared]
            pair = mine[shared] * (n + 1) + bucket[rest + step]
            _, fresh = np.unique(pair, return_inverse=True)
            new[rest] = fresh + n * 2
            live_new = new[live]
            _, new[live] = np.unique(live_new, return_inverse=True)
        bucket, depth = new, reach
    return bucket


def repeats(strings: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window in it) of the windows that also stand elsewhere; a string with copies counts as two."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(strings)), size)
    bucket = refined_buckets(data, ends[owner], length)
    ok = np.flatnonzero(bucket >= 0)
    weight = np.bincount(bucket[ok], weights=np.minimum(copies, 2)[owner[ok]])
    hit = ok[weight[bucket[ok]] > 1]
    return owner[hit], hit - (ends - size)[owner[hit]]


def _ranges(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (owner, first, last) of ascending positions."""
    if not len(owner):
        return owner, at, at
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:], len(owner)) - 1
    return owner[new], at[new], at[last]


# --- dealing large groups on --------------------------------------------------------------------------------------

#: A run of windows: its group and content; the stretch it is cut from and its first window there; copies; the anchor's place
#: in it and its number of windows; from how many to how many bytes before the anchor the group's windows begin; its bytes.
_RUN = "g long, e long, g0 long, e0 long, off int, c long, p int, n int, near int, far int, string binary"


def halves(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The runs of windows of _RUN, each as two that are dealt by a piece that their half of the windows holds."""
    g, e, g0, e0, off, c, p, n, near, far = (batch.column(i).to_numpy().astype(np.int64) for i in range(10))
    data, offs = text_bytes(batch.column(10))
    begin, middle, sub = offs[:-1], (near + far + 1) // 2, Substrings(data)
    least = p - n + 1
    parts = []
    for left in (True, False):
        a, z = (np.maximum(least, middle), p) if left else (least, np.minimum(p, middle - 1))
        own = np.flatnonzero(a <= z)
        a, z, m, at = a[own], z[own], middle[own], (begin + p)[own]
        lo, count = begin[own] + p[own] - z, z - a + 1
        piece = (at - m, at - near[own]) if left else (at - far[own] + length, at - m + 1 + length)
        group = mix(mix(g[own].view(np.uint64) ^ sub.hashes(*piece)) + np.uint64(left))
        hi = lo + count + length - 1
        run = [group.view(np.int64), stretch_hashes(data, lo, hi, z).view(np.int64), g0[own], e0[own], off[own] + p[own] - z, c[own], z, count]
        run += [m, far[own]] if left else [near[own], m - 1]
        parts.append((run, lo, hi))
    runs = [np.concatenate([x[0][i] for x in parts]) for i in range(10)]
    raw = data.tobytes()
    strings = [raw[x:y] for _, lo, hi in parts for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()] + [pa.int32()] * 4
    names = [x.split()[0] for x in _RUN.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array(x).cast(t) for x, t in zip(runs, kinds, strict=True)), pa.array(strings, pa.binary())], names)


# --- plan -------------------------------------------------------------------------------------------------------


def ahead_of(places: str, by: Column) -> Column:
    return F.transform(places, lambda x: x + by)


def _group_sizes(classes: DataFrame, length: int) -> DataFrame:
    """g, many (different stretches), c (all of them), bytes. classes: g, e, c, n."""
    return classes.groupBy("g").agg(F.count("*").alias("many"), F.sum("c").alias("c"), F.sum(F.col("n") + F.lit(length - 1)).cast("long").alias("bytes"))


def repeated_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE, block: int = BLOCK_BYTES) -> DataFrame:
    """k1, k2, s, e: first bytes and ends of stretches that are covered by repeated strings, a list each; they may overlap. docs has
    text only."""
    spark = docs.sparkSession
    rows = saved(anchor_rows(docs, length, gram, block), "anchors")
    # one gram at one place of its windows is a group; the offset is in the stretch's hash
    grams = rows.groupBy("g").agg(F.count("*").alias("c"), (F.min("e") != F.max("e")).alias("mixed")).filter("c > 1").select("g", "mixed")
    # tables are written before their joins, so that the joins deal the rows by themselves and a frequent key's can be split
    grams = saved(grams, "grams")
    # a row a place of a text, whatever the number of tasks that held a copy of it
    shared = rows.join(grams, "g").groupBy("k1", "k2", "lo", "n", "p", "g", "e", "mixed").agg(F.count("*").alias("c"))
    shared = saved(shared, "shared")
    full = shared.filter("not mixed").select("k1", "k2", F.array("lo").alias("s"), F.array(F.col("lo") + F.col("n") + F.lit(length - 1)).alias("e"))

    mixed = shared.filter("mixed")
    classes = mixed.groupBy("g", "e").agg(F.sum("c").alias("c"), F.min(F.struct("k1", "k2", "lo", "n", "p")).alias("at"))
    classes = saved(classes.select("g", "e", "c", "at.*"), "classes")
    sizes = saved(_group_sizes(classes, length), "sizes")
    wanted = classes.join(sizes.select("g", "many"), "g")
    asked = saved(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "e", "c", "many", "lo", "n", "p")).alias("asked")), "asked")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(Copies(1).few, batches)

    texts = docs.select(*content_key(F.col("text")), "text").filter(F.octet_length("text") >= length).mapInArrow(first, "k1 long, k2 long, text string")
    served = texts.join(asked, ["k1", "k2"]).select(F.inline("asked"), F.encode("text", "UTF-8").alias("bytes"))
    served = served.select("g", "e", "c", "many", "p", "n", F.expr(f"substring(bytes, lo + 1, n + {length - 1})").alias("string")).dropDuplicates(["g", "e"])
    served = saved(served, "stretches")
    total = sizes.filter(F.col("many") <= large).agg(F.sum("bytes")).first()[0] or 0
    to_sort = served.filter(F.col("many") <= large).select("g", "e", "c", "string")

    # large groups, dealt on round by round until none is large or its windows begin at one place
    cut, whole = [], []
    runs = served.filter(F.col("many") > large).select("g", "e", F.col("g").alias("g0"), F.col("e").alias("e0"), F.lit(0).alias("off"), "c", F.col("p").cast("int"), F.col("n").cast("int"), F.lit(0).alias("near"), F.lit(length - gram).alias("far"), "string")
    open_ = not sizes.filter(F.col("many") > large).isEmpty()
    rounds = (length - gram).bit_length()
    for k in range(rounds if open_ else 0):
        runs = saved(runs.mapInArrow(lambda batches: (halves(part, length) for x in batches for part in blocks(x, 10)), _RUN), "runs")
        equal = runs.groupBy("g", "e").agg(F.sum("c").alias("c"), F.min("n").alias("n"))
        sizes = saved(_group_sizes(equal, length).filter("c > 1"), "sizes")
        last = k == rounds - 1
        dealt = saved(runs.join(sizes.select("g", "many", F.col("c").alias("all")), "g"), "dealt")
        whole.append(dealt.filter("many = 1"))
        small = dealt.filter("many > 1" if last else f"many > 1 and many <= {large}")
        cut.append(small)
        total += sizes.filter("many > 1").agg(F.sum("bytes")).first()[0] or 0
        to_sort = to_sort.unionByName(small.groupBy("g", "e").agg(F.sum("c").alias("c"), F.min("string").alias("string")))
        if last or sizes.filter(F.col("many") > large).isEmpty():
            break
        runs = dealt.filter(F.col("many") > large).drop("many", "all").select(*runs.columns)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        total, last = 0, None

        def flush() -> pa.RecordBatch:
            owner, at = repeats([x[3] for x in kept], np.array([x[2] for x in kept]), length)
            owner, a, b = _ranges(owner, at)
            g, e = np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64)
            own, head = np.unique(owner, return_index=True)
            edge = np.append(head, len(owner))
            return pa.RecordBatch.from_arrays([pa.array(g[own]), pa.array(e[own]), *(list_array(pa.array(x.astype(np.int32)), edge) for x in (a, b))], ["g", "e", "a", "b"])

        for batch in batches:
            for g, e, c, string in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if total >= SORT_BYTES and g != last:
                    yield flush()
                    kept, total = [], 0
                kept.append((g, e, c, string))
                total += len(string)
                last = g
        if kept:
            yield flush()

    # the dearest stage: its number of tasks follows the counted bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    dup = to_sort.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(sort, "g long, e long, a array<int>, b array<int>")
    if cut:
        dup = saved(dup, "sorted")
        # lists travel as they are, so that a join gives a row for a row
        back = [x.select("g", "e", "g0", "e0", "off").join(dup, ["g", "e"]).select(F.col("g0").alias("g"), F.col("e0").alias("e"), ahead_of("a", F.col("off")).alias("a"), ahead_of("b", F.col("off")).alias("b")) for x in cut]
        back += [x.select(F.col("g0").alias("g"), F.col("e0").alias("e"), F.array("off").alias("a"), F.array(F.col("off") + F.col("n") - 1).alias("b")) for x in whole]
        # what was found of the groups that were not dealt on meets the anchors by itself; other groups' names meet none
        for x in back:
            dup = dup.unionByName(x)
        # a window is in one run at most, so these lists are no longer than a stretch has windows
        dup = dup.groupBy("g", "e").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
        dup = saved(dup, "found")
    part = mixed.join(dup, ["g", "e"])
    part = part.select("k1", "k2", ahead_of("a", F.col("lo")).alias("s"), ahead_of("b", F.col("lo") + F.lit(length)).alias("e"))
    return full.unionByName(part)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE, block: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), kept_text (the same as
    text, without what is left of cut characters) and the columns in `carry`."""
    prepare(docs.sparkSession)
    small = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[id_col].alias("id"), *[docs[c].alias(f"own_{i}") for i, c in enumerate(carry)])
    found = repeated_stretches(small.select("text"), length, gram, large, block)
    spans = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("begins"), F.flatten(F.collect_list("e")).alias("stops"))
    # written before the join, which then deals the texts by itself, so that a frequent text's rows can be split
    spans = saved(spans, "spans")
    joined = small.select(*content_key(F.col("text")), "id", "text", *[f"own_{i}" for i in range(len(carry))]).join(spans, ["k1", "k2"], "left").drop("k1", "k2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(2 + i) for i in range(len(carry))]
            removed, runs, digest, left, size = [], [], [], [], []
            begins, stops = batch.column(2 + len(carry)), batch.column(3 + len(carry))
            data, offs = text_bytes(batch.column(1))
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]]
                kept = text
                if begins[i].is_valid:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, begins[i].values.to_numpy(), 1)
                    np.add.at(edge, stops[i].values.to_numpy(), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    runs.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                    kept = text[~gone]
                else:
                    runs.append(0)
                raw = kept.tobytes()
                size.append(len(text))
                removed.append(len(text) - len(raw))
                digest.append(hashlib.sha256(raw).hexdigest())
                left.append(raw)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(digest, pa.string()), pa.array(left, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()), *own]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", *(f"own_{i}" for i in range(len(carry)))])

    schema = T.StructType([T.StructField("id", small.schema["id"].dataType)])
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType()), ("kept_text", T.StringType())):
        schema = schema.add(name, kind)
    for i in range(len(carry)):
        schema = schema.add(small.schema[f"own_{i}"])
    out = joined.mapInArrow(cut, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", *[F.col(f"own_{i}").alias(c) for i, c in enumerate(carry)])
