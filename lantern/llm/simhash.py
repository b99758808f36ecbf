"""SimHash near-duplicates by BK-trees.

Fingerprints link at 3 or fewer differing bits. Two such fingerprints agree in at least one of four blocks of bits, so
each distinct fingerprint goes to the four shards named by its blocks' values. A shard holds a BK-tree, whose children
are keyed by their integer Hamming distance to the parent; a search follows only edges within the radius of the query's
distance to the node. A shard with more fingerprints than HOT is split without loss: its members also agree in one of
four groups of the bits left over, and so on. Shards give stars (fingerprint, smallest member it reaches in the shard),
never all pairs, and alternating large-star and small-star rounds join them into components.

The trees go to the tasks that search them by a shuffle on the shard's key. Broadcasting them from the driver would pass
the fingerprints of all documents through it.

Defined results: null or word-less text has fingerprint zero and links like any other; texts of any length are hashed whole;
null ids are never a component's id unless it has no other; repeated rows are separate rows with equal results; an empty table
gives an empty result; other columns are ignored or, where rows are kept, returned as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import LOWER, SPACED, blocks, columns_of, content_key, prepare, row_of, saved, text_bytes, words

RADIUS = 3
#: Fingerprints in a shard above which it is split further.
HOT = 4096
#: Queries that walk the trees at once.
AT_ONCE = 2048
SEED = 42


# --- fingerprints -----------------------------------------------------------------------------------------------


def fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each row of a block."""
    low = LOWER[data]
    starts, ends, first = words(low, offs, SPACED)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(starts):
        return out
    keep = SPACED[low]
    low = np.where(keep, low, np.uint8(32))
    keep[ends[ends < len(low)]] = True
    at = np.cumsum(keep) - keep
    text = low[keep].tobytes()
    begins, stops = at[starts].tolist(), (at[ends - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    for row in range(len(out)):
        lo, hi = int(first[row]), int(first[row + 1])
        n = hi - lo
        if not n:
            continue
        k = min(shingle, n)
        step = 1 << 17
        ones = np.zeros(64, np.int64)
        total = n - k + 1
        for a in range(lo, lo + total, step):
            b = min(a + step, lo + total)
            h = np.array([digest(text[x:y], SEED) for x, y in zip(begins[a:b], stops[a + k - 1 : b + k - 1], strict=True)], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                fp = fingerprints(*text_bytes(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    small = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return small.mapInArrow(run, f"id {small.schema['id'].dataType.simpleString()}, fp long")


# --- BK-trees ---------------------------------------------------------------------------------------------------


class Forest:
    """One BK-tree for each shard, built level by level: the first member of a set is its node, the others go to the child
    keyed by their distance to it."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        order = np.argsort(shard, kind="stable")
        group, members = shard[order], values[order]
        self.roots: np.ndarray | None = None
        nodes, edges, parents = [], [], []
        parent_of = np.full(len(members), -1, np.int64)
        edge_of = np.zeros(len(members), np.int64)
        made = 0
        while len(members):
            head = np.ones(len(group), bool)
            head[1:] = group[1:] != group[:-1]
            index = np.cumsum(head) - 1
            nodes.append(members[head])
            parents.append(parent_of[head])
            edges.append(edge_of[head])
            d = np.bitwise_count(members ^ members[head][index]).astype(np.int64)
            rest = ~head
            sort = np.argsort(index[rest] * 65 + d[rest], kind="stable")
            members, parent_of, edge_of = members[rest][sort], (index[rest] + made)[sort], d[rest][sort]
            group = parent_of * 65 + edge_of
            made += int(head.sum())
        self.nodes, self.edges, up = np.concatenate(nodes), np.concatenate(edges), np.concatenate(parents)
        roots = up < 0
        self.n_roots = int(roots.sum())
        # children of a node are consecutive, as levels are made in the order of (parent, edge)
        self.begin = np.searchsorted(up[self.n_roots :], np.arange(made)) + self.n_roots
        self.end = np.searchsorted(up[self.n_roots :], np.arange(made), "right") + self.n_roots

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) of all nodes within the radius in each query's tree."""
        q, node = np.arange(len(queries)), roots
        found_q, found_n = [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.nodes[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            n = self.end[node] - self.begin[node]
            total = np.cumsum(n)
            inner = np.arange(total[-1]) - np.repeat(total - n, n)
            child = np.repeat(self.begin[node], n) + inner
            q, d = np.repeat(q, n), np.repeat(d, n)
            near = np.abs(self.edges[child] - d) <= radius
            q, node = q[near], child[near]
        return np.concatenate(found_q), np.concatenate(found_n)


def stars(shard: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member that it reaches within its shard), without members alone; values are distinct in a shard."""
    order = np.argsort(shard, kind="stable")
    shard, values = shard[order], values[order]
    forest = Forest(shard, values)
    head = np.ones(len(shard), bool)
    head[1:] = shard[1:] != shard[:-1]
    tree = np.cumsum(head) - 1
    # where each node's value stands among the members
    place = np.lexsort((values, tree))
    tree_of = np.empty(len(forest.nodes), np.int64)
    tree_of[: forest.n_roots] = np.arange(forest.n_roots)
    level = np.arange(forest.n_roots)
    while len(level):
        n = forest.end[level] - forest.begin[level]
        if not n.sum():
            break
        total = np.cumsum(n)
        child = np.repeat(forest.begin[level], n) + np.arange(total[-1]) - np.repeat(total - n, n)
        tree_of[child] = np.repeat(tree_of[level], n)
        level = child
    node_member = np.empty(len(forest.nodes), np.int64)
    node_member[np.lexsort((forest.nodes, tree_of))] = place
    label = np.arange(len(values))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            y = label[x]
            if np.array_equal(y, x):
                return x
            x = y

    for a in range(0, len(values), AT_ONCE):
        q, node = forest.search(values[a : a + AT_ONCE], tree[a : a + AT_ONCE], radius)
        u, v = q + a, node_member[node]
        keep = u != v
        u, v = u[keep], v[keep]
        while len(u):
            u, v = root(u), root(v)
            open_ = u != v
            u, v = u[open_], v[open_]
            if len(u):
                np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
    top = root(np.arange(len(values)))
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, top, values.view(np.int64))
    found = least[top] != values.view(np.int64)
    return values[found].view(np.int64), least[top][found]


def _groups(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 groups of the bits outside it."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Stars (fp, to) over the shards of distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    masks = _groups(0, radius)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
    ready = None
    for _ in range(3):
        large = saved(rows.groupBy("mask", "bits").count().filter(F.col("count") > hot).select("mask", "bits"), "hot")
        if large.isEmpty():
            break
        calm = rows.join(large, ["mask", "bits"], "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        split = {m: _groups(m, radius) for m in masks}
        masks = sorted({x for v in split.values() for x in v})
        more = F.create_map(*[x for m, v in split.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in v]))])
        rows = rows.join(large, ["mask", "bits"], "left_semi").select("fp", F.explode(more[F.col("mask")]).alias("mask"))
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
    rows = rows if ready is None else ready.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        n = 0

        def flush(part: np.ndarray) -> pa.RecordBatch:
            key = np.ones(len(part), bool)
            key[1:] = (part[1:, :2] != part[:-1, :2]).any(axis=1)
            shard = np.cumsum(key)
            size = np.bincount(shard)
            big = size[shard] > 1
            a, b = stars(shard[big], part[big, 2].view(np.uint64), radius) if big.any() else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp", "to"])

        for batch in batches:
            kept.append(np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1))
            n += batch.num_rows
            if n < 1 << 16:
                continue
            part = np.concatenate(kept)
            last = (part[:, :2] == part[-1, :2]).all(axis=1)
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield flush(part[:cut])
            kept, n = [part[cut:]], (len(part) - cut) // 2
        if kept and sum(map(len, kept)):
            yield flush(np.concatenate(kept))

    dealt = rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits").select("mask", "bits", "fp")
    return dealt.mapInArrow(run, "fp long, to long")


# --- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the graph with edges (fp, to): root is the smallest node of the component.

    Rounds of large-star and small-star, each written to a table, until the edges stay as they are. What is found of each node is
    written before it meets the edges, so that the edges of a component's centre are dealt by the join alone and can be split.
    """
    now = saved(edges.select(F.greatest("fp", "to").alias("u"), F.least("fp", "to").alias("v")).filter("u <> v").distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, "large")
        small = saved(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        joined = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(joined.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def _rooted(each: DataFrame, least: Column, radius: int, hot: int) -> DataFrame:
    """fp, root, least (by the expression) of the distinct fingerprints in `each`."""
    distinct = saved(each.groupBy("fp").agg(least.alias("least")), "distinct")
    to = components(links(distinct.select("fp"), radius, hot))
    return saved(distinct.join(to, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    each = saved(fingerprint_documents(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text", shingle), "fingerprints")
    rooted = _rooted(each, F.min("id"), radius, hot)
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = saved(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return each.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component: that of the smallest id (nulls last);
    of several texts with that id, the one of the smallest fingerprint and content key; of rows equal in both, the first in the
    order of all their columns, so that only rows equal in every column are alike to it."""
    keys = content_key(docs[id_col], docs[text_col].cast("string"))
    tagged = docs.select(F.struct(docs[id_col].alias("id"), *keys).alias("id"), docs[text_col].alias("text"))
    each = saved(fingerprint_documents(tagged, "id", "text", shingle), "fingerprints")
    rooted = _rooted(each, F.min(F.struct(F.col("id.id").isNull().alias("none"), F.col("id.id").alias("id"), "fp", F.col("id.k1").alias("k1"), F.col("id.k2").alias("k2"))), radius, hot)
    kept = saved(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.k1", "least.k2"), "kept")
    whole = docs.select(*keys, row_of(docs))
    row = F.col("row")
    first = Window.partitionBy("k1", "k2").orderBy(*[F.to_json(F.struct(row[f.name])) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else row[f.name] for f in docs.schema.fields])
    # a task keeps the first of its copies before they are dealt, so that a frequent text is one row a task
    firsts = whole.withColumn("copy", F.row_number().over(first)).filter("copy = 1")
    joined = firsts.join(kept, ["k1", "k2"], "left_semi")
    return joined.select(*columns_of(row, docs.columns))
