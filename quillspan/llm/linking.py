"""From candidate keys to linked groups: the frame of the similarity joins of this subpackage.

A join gives every item keys such that linked items share one. Keys travel packed,
six bytes each, to buckets; items that share a key are tied into candidate
clusters by star edges, whose number is linear in the items; each item's content then travels once, to its cluster, where the join
itself runs. A cluster too large for one task is cut into blocks by a hash of the
item, and every pair of blocks is a task, so nothing is dropped and no task is
unbounded. Nothing here is collected to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel, store

#: Bytes of content of one block of a cluster, about.
BLOCK_BYTES = 8 << 20


#: Keys that a task holds before it deals them out.
HELD = 500_000
#: Keys of one bucket, about.
BUCKET = 500_000
#: Edges that a task contracts, about, once their number is known.
SOME = 50_000
#: Bytes kept of a key; the bucket holds the rest. Keys that agree by chance only add candidates.
KEY_BYTES = 6


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node, node) that tie what the edges (a, b) tie, one for each other node."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(names))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if np.array_equal(low, high):
            break
        np.minimum.at(up, high, low)
        while not np.array_equal(up, top := up[up]):
            up = top
    other = np.flatnonzero(up != np.arange(len(names)))
    return names[up[other]], names[other]


def raw(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All bytes of a binary column, end to end."""
    whole = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = whole.buffers()
    if data is None:
        return np.zeros(0, dtype)
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype)


class Keys:
    """Collects (key, node) pairs of a task and deals them out, packed, to buckets of keys.

    A key goes out once, with its first node here; further nodes of the key are
    tied to that one here. So a key that many nodes share costs one entry a batch,
    whatever its group's size.
    """

    schema = "bucket int, keys binary, nodes binary, ties binary"

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.keys: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        self.keys.append(keys)
        self.nodes.append(nodes)
        self.held += len(keys)

    def dealt(self) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        nodes = np.concatenate([np.zeros(0, np.int64), *self.nodes])
        self.keys, self.nodes, self.held = [], [], 0
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        x, y = nodes[order[:-1][same]], nodes[order[1:][same]]
        apart = x != y
        low, high = stars(x[apart], y[apart])
        first = order[np.concatenate([[True], ~same])] if len(order) else order
        keys, nodes = keys[first], nodes[first]
        bucket = (keys % np.uint64(self.buckets)).astype(np.int32)
        shift = np.uint64(64 - self.buckets.bit_length())
        order = np.argsort((bucket.astype(np.uint64) << shift) | (nodes.view(np.uint64) >> (np.uint64(64) - shift)))  # a node's entries side by side compress well
        keys, nodes, bucket = keys[order] // np.uint64(self.buckets), nodes[order], bucket[order]
        packed = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
        cut = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]]).tolist()
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        raw = nodes.tobytes()
        ties = np.stack([low, high], 1).tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array([*bucket[cut[:-1]].tolist(), *([int(low[0] % self.buckets)] if len(low) else [])], pa.int32()),
            pa.array([*(packed[KEY_BYTES * i : KEY_BYTES * j] for i, j in spans), *([None] if len(low) else [])], pa.binary()),
            pa.array([*(raw[8 * i : 8 * j] for i, j in spans), *([None] if len(low) else [])], pa.binary()),
            pa.array([*([None] * len(spans)), *([ties] if len(low) else [])], pa.binary()),
        ], ["bucket", "keys", "nodes", "ties"])


def candidate_edges(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], n_keys: int) -> DataFrame:
    """Edges (a, b) that tie all nodes that share a key, directly or over others.

    ``keys_of`` gives arrays of 64-bit keys and of their nodes for a batch of rows.
    ``n_keys``, about how many keys there are, sets the number of buckets.
    """
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Keys(buckets)
        for batch in batches:
            for keys, nodes in keys_of(batch):
                held.add(keys, nodes)
                if held.held > HELD:
                    yield held.dealt()
        yield held.dealt()

    return tied(rows.mapInArrow(deal, Keys.schema))


def tied(dealt: DataFrame) -> DataFrame:
    """Edges (a, b) that tie all nodes of each key, from the rows of ``Keys``."""

    def tie(group: pa.Table) -> pa.Table:
        nodes, ties = raw(group["nodes"], np.int64), raw(group["ties"], np.int64).reshape(-1, 2)
        keys = np.zeros((len(nodes), 8), np.uint8)
        keys[:, :KEY_BYTES] = raw(group["keys"], np.uint8).reshape(-1, KEY_BYTES)
        keys = keys.view("<u8").ravel()
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        a, b = stars(np.concatenate([nodes[order[:-1][same]], ties[:, 0]]), np.concatenate([nodes[order[1:][same]], ties[:, 1]]))
        del nodes, ties, keys, order, same
        kernel.release()
        return pa.table({"a": a, "b": b})

    # The distinct also parts this step from the next one's Python workers, which would run beside its own.
    return dealt.groupBy("bucket").applyInArrow(tie, "a long, b long").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) that tie the same nodes: each task turns what it holds into stars."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            held += len(batch)
            if held > HELD:
                low, high = stars(np.concatenate(a), np.concatenate(b))
                if 2 * len(low) > HELD:  # it would not get much smaller
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])
                    low, high = low[:0], high[:0]
                a, b, held = [low], [high], len(low)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(np.concatenate(a), np.concatenate(b))], ["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its least node.

    Alternating large-star and small-star steps, each contracted task by task and
    written to the shared folder, where it replaces the step before; they end when
    a step changes nothing. A step groups by node with map-side partial minima, so
    that a node with many neighbours meets no limit.
    """
    edges = store.staged(contracted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "edges")
    before, n = None, edges.count()
    while True:
        tasks = max(4, n // SOME + 1)  # few edges need few tasks, which then contract more of them
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low.hint("merge"), "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        last, edges = edges, store.staged(contracted(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(tasks)), "edges")
        store.drop(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    members = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def in_clusters(items: DataFrame, join: Callable[[list, list], Iterator[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) found by ``join`` in each cluster of ``items`` (cluster, node, content binary).

    ``join(first, second)`` takes lists of (node, content) and yields links within
    the first, or, if the second is not empty, between the two; it may leave out a
    link between nodes that the links it has yielded already connect.
    """
    size = items.groupBy("cluster").agg(F.sum(F.length("content") + 64).alias("bytes"))
    cut = size.where(F.col("bytes") > BLOCK_BYTES).select("cluster", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("n"))
    rows = items.join(cut, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "content")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        rows = sorted(zip(group["own"].to_pylist(), group["node"].to_pylist(), group["content"].to_pylist(), strict=True))
        first = [(n, c) for o, n, c in rows if o == i]
        links = list(join(first, [(n, c) for o, n, c in rows if o != i])) if i == j or len(first) < len(rows) else []
        if len(rows) > 1000:
            del rows, first
            kernel.release()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


#: Bits of a sieve: 4 MB, whatever the number of ids.
SIEVE_BITS = 1 << 25


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as set it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    lead = "_"
    while any(lead + x in taken for x in names):
        lead += "_"
    return [lead + x for x in names]


def sieved(docs: DataFrame, key: str, ids: DataFrame, maybe: str = "_maybe") -> DataFrame:
    """``docs`` with the column ``maybe``: false only for keys that are surely not among ``ids`` (one column of that name).

    The ids' hashes are marked in one bitmap of fixed size, in pieces of 4 KB, which
    is broadcast. Joins with whole texts then shuffle only the rows it lets pass.
    With very many ids all rows pass, which costs nothing but the test.
    """
    at, piece, bits = spare([*docs.columns, maybe], "at", "piece", "bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    marks = ids.select(place(key).alias("p")).groupBy(F.shiftright("p", 15).alias(piece)).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias(bits))
    rows = docs.withColumn(at, place(key)).withColumn(piece, F.shiftright(at, 15))
    rows = rows.join(F.broadcast(store.staged(marks, "sieve")), piece, "left")
    bit = F.col(at).bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn(maybe, F.coalesce(hit, F.lit(False))).drop(at, piece, bits)


def matching(docs: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """The inner join of texts with ``other``, which grows with the corpus: always by shuffle, sieved first."""
    (maybe,) = spare([*docs.columns, *other.columns], "maybe")
    rows = sieved(docs, key, other.select(key), maybe)
    return rows.where(maybe).drop(maybe).join(other.hint("merge"), key)


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among ``gone`` (one column); those the sieve clears are not shuffled."""
    (maybe,) = spare(docs.columns, "maybe")
    rows = sieved(docs, key, gone, maybe)
    clear = rows.where(~F.col(maybe)).drop(maybe)
    return clear.unionByName(rows.where(maybe).drop(maybe).join(gone.hint("merge"), key, "left_anti"))


def one_row_each(docs: DataFrame, key: str) -> DataFrame:
    """Of the rows that share a key, that with the least hash of all its columns; rows with a null key all stay."""
    again = store.staged(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    maybe, row = spare(docs.columns, "maybe", "row")
    rows = sieved(docs, key, again, maybe)
    several = rows.where(maybe).drop(maybe)
    picked = several.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)).select(f"{row}.*")
    return rows.where(~F.col(maybe)).drop(maybe).select(*docs.columns).unionByName(picked)


class Forest:
    """Disjoint sets of the nodes of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def tie(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)
