"""N-gram Jaccard join: globally ordered sets in a prefix tree, traversed with shared partial overlaps.

Documents are sets of distinct word n-grams; equal sets are one node from the
start. Candidates come in three steps, each of which keeps every link:

1. A linked set shares at least percent of its members with one other set. A pass
   over all members counts, for each set, those that occur in another set too;
   only sets with enough of them go on.
2. The members of those sets are ordered by rarity, then hash. In one global order
   linked sets share one of the first n - (least overlap) + 1 members of each; the
   members no other set has, which come first, need not be looked up.
3. Sets that share such a member are tied into candidate clusters.

In each cluster the sets go into a trie; a probe walks down it carrying the
overlap so far, so documents with a common beginning share its count, and leaves
a subtree when the overlap plus what can still follow on either side misses the
least overlap needed there, or when all below it is linked to the probe already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel, linking, store

U64 = np.uint64
#: Members of the sets that travel and are looked up together, about.
TOGETHER = 500_000
#: Tasks over which the documents of one set are dealt.
SALTS = 16
#: Stands for several sets of one task in the lists of who has a member.
MANY = np.int64(-1)


def document_sets(column: pa.Array, k: int, lower: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By chunk: the first document and each one's sorted distinct n-gram hashes."""
    for w in kernel.words(column, lower=lower):
        hashes, at = kernel.shingle_hashes(w, k)
        yield w.lo, [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection i with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def shared_by_all(n: int, percent: int) -> int:
    """How many members a set of n shares with any linked set, at least."""
    return -(-percent * n // 100)


def _split(values: np.ndarray, *more: np.ndarray, buckets: int) -> Iterator[tuple]:
    """For each bucket of ``values``: its number, the values' other digits (4 bytes), and the parts of ``more``.

    A bucket holds about as many values at any size of the corpus, so four bytes tell them apart; a mistake
    makes a member look more common, never less.
    """
    bucket = (values % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rest = ((values // U64(buckets)) & U64(0xFFFFFFFF)).astype("<u4")[order]
    more = [x[order] for x in more]
    cut = np.concatenate([np.flatnonzero(np.diff(bucket[order], prepend=-1)), [len(order)]])
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[order[i]]), rest[i:j].tobytes(), *(x[i:j].tobytes() for x in more)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending values: where each run of equal ones begins, and its length."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(values)))


def repeated_members(texts: DataFrame, sets_of: Callable, buckets: int, parts: int) -> DataFrame:
    """node and ``again``: how many members of each set another set has too, or more.

    ``sets_of`` gives lists of nodes and of their sets for a batch of rows. A member that several sets of a task
    have is counted there and travels once, so a member that very many sets have is no burden. Copies of a set in
    several tasks may count a member twice. Members are dealt to ``buckets``, counts to ``parts`` of the sets.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, U64), *sets])
            of = np.concatenate([np.zeros(0, np.int64), *nodes])
            order = np.lexsort((of, flat))
            flat, of = flat[order], of[order]
            new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])])[: len(flat)]
            flat, of = flat[new], of[new]
            begin, size = _runs(flat)
            several = np.repeat(size > 1, size)
            names, count = np.unique(of[several], return_counts=True)
            one = np.where(size > 1, MANY, of[begin]) if len(begin) else of
            by = np.argsort(one, kind="stable")  # a set's members side by side compress well
            rows = list(_split(flat[begin][by], one[by], buckets=buckets))
            rows = [(k, r, w, None, None) for k, r, w in rows] + ([(int(names[0] % buckets), None, None, names.tobytes(), count.tobytes())] if len(names) else [])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES], ["bucket", "members", "sets", "names", "counts"])

        for batch in batches:
            for own, found in sets_of(batch):
                nodes += [np.full(len(s), k, np.int64) for k, s in zip(own, found, strict=True)]
                sets += found
                held += sum(map(len, found))
                if held > TOGETHER:
                    yield out()
                    nodes, sets, held = [], [], 0
        yield out()

    TYPES = (pa.int32(), *[pa.binary()] * 4)

    def count(group: pa.Table) -> pa.Table:
        """What a bucket knows of its sets, packed by parts of the sets."""
        member, of = linking.raw(group["members"], "<u4"), linking.raw(group["sets"], np.int64)
        order = np.lexsort((of, member))
        member, of = member[order], of[order]
        new = np.concatenate([[True], (member[1:] != member[:-1]) | (of[1:] != of[:-1])])[: len(member)]
        member, of = member[new], of[new]
        begin, size = _runs(member)
        several = np.repeat((size > 1) | (of[begin] == MANY), size) & (of != MANY)
        names, counts = np.unique(of[several], return_counts=True)
        names, counts = np.concatenate([names, linking.raw(group["names"], np.int64)]), np.concatenate([counts, linking.raw(group["counts"], np.int64)])
        part = names % parts
        order = np.argsort(part, kind="stable")
        names, counts, part = names[order], counts[order].astype("<u4"), part[order]
        begin, size = _runs(part)
        spans = list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
        out = pa.table({"part": pa.array(part[begin].astype(np.int32)), "names": pa.array([names[i:j].tobytes() for i, j in spans], pa.binary()), "counts": pa.array([counts[i:j].tobytes() for i, j in spans], pa.binary())})
        del member, of, new, several, order, names, counts, part
        kernel.release()
        return out

    def add_up(group: pa.Table) -> pa.Table:
        names, at = np.unique(linking.raw(group["names"], np.int64), return_inverse=True)
        return pa.table({"node": names, "again": np.bincount(at, linking.raw(group["counts"], "<u4"), len(names)).astype(np.int64)})

    dealt = texts.mapInArrow(deal, "bucket int, members binary, sets binary, names binary, counts binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "part int, names binary, counts binary")
    return counted.groupBy("part").applyInArrow(add_up, "node long, again long")


def prefix_ties(packs: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (a, b) that tie sets whose prefixes share a member. packs: (pack, nodes, sizes, members), all but the first packed.

    Each pack asks once for each of its members, with how often it has it, and is told of those that occur twice or
    more in all; so a member that very many sets have costs one entry a pack.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                member, n = np.unique(np.frombuffer(data, U64), return_counts=True)
                rows = [(k, pack, r, c) for k, r, c in _split(member, n.astype("<u4"), buckets=buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "pack", "members", "counts"])

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        member, n = linking.raw(group["members"], "<u4"), linking.raw(group["counts"], "<u4")
        length = pc.binary_length(group["members"]).to_numpy() // 4
        row = np.repeat(np.arange(len(length)), length)
        order = np.argsort(member, kind="stable")
        begin, size = _runs(member[order])
        total = np.repeat(np.add.reduceat(n[order].astype(np.int64), begin), size) if len(begin) else n[order]
        often = np.empty(len(member), np.int64)
        often[order] = total
        keep = often > 1
        cut = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(length)))]).tolist()
        rest, often = member[keep], np.minimum(often[keep], 0xFFFFFFFF).astype("<u4")
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        del member, n, row, order, total, keep
        kernel.release()
        return pa.table({"pack": group["pack"], "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()), "members": pa.array([rest[i:j].tobytes() for i, j in parts], pa.binary()), "often": pa.array([often[i:j].tobytes() for i, j in parts], pa.binary())})

    def choose(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        """Deals out the prefixes of a pack's sets."""
        held = linking.Keys(buckets)
        bucket = np.repeat(told["bucket"].to_numpy(), pc.binary_length(told["members"]).to_numpy() // 4).astype(U64)
        name = (bucket << U64(32)) | linking.raw(told["members"], "<u4").astype(U64)
        often = linking.raw(told["often"], "<u4")
        order = np.argsort(name)
        name, often = name[order], often[order]
        for nodes, sizes, members in zip(own["nodes"].to_pylist(), own["sizes"].to_pylist(), own["members"].to_pylist(), strict=True):
            flat, sizes, nodes = np.frombuffer(members, U64), np.frombuffer(sizes, np.int64), np.frombuffer(nodes, np.int64)
            asked = ((flat % U64(buckets)) << U64(32)) | ((flat // U64(buckets)) & U64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(name, asked), max(0, len(name) - 1))
            count = np.where(name[at] == asked, often[at], 1) if len(name) else np.ones(len(flat), np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, count, of))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            reach = sizes + (-percent * sizes // 100) + 1
            chosen = order[(rank < reach[of]) & (count[order] > 1)]
            held.add(flat[chosen], nodes[of[chosen]])
        out = pa.Table.from_batches([held.dealt()])
        kernel.release()
        return out

    asked = packs.mapInArrow(ask, "bucket int, pack long, members binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "pack long, bucket int, members binary, often binary")
    dealt = packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(choose, linking.Keys.schema)
    return linking.tied(dealt)


class Trie:
    """A radix tree of ordered sets. A node holds a run of hashes, children by first hash,
    the sets that end in it, and the greatest and least size of the sets below."""

    __slots__ = ("run", "last", "kids", "ends", "most", "least", "tied")

    def __init__(self, run: np.ndarray, ends: list[int], most: int, least: int, tied: int | None):
        self.kids: dict[int, Trie] = {}
        self.ends, self.most, self.least = ends, most, least
        self.tied = tied  # a node of the one group that all sets below were last seen in
        self.cut(run)

    def cut(self, run: np.ndarray) -> None:
        self.run, self.last = run, int(run[-1]) if len(run) else -1

    def insert(self, values: np.ndarray, node: int, forest: linking.Forest) -> None:
        at, size, here, own = 0, len(values), self, forest.root(node)
        while True:
            here.most, here.least = max(here.most, size), min(here.least, size)
            if here.tied is not None and forest.root(here.tied) != own:
                here.tied = None
            if at == size:
                here.ends.append(node)
                return
            kid = here.kids.get(int(values[at]))
            if kid is None:
                here.kids[int(values[at])] = Trie(values[at:], [node], size, size, node)
                return
            m = min(len(kid.run), size - at)
            differ = np.flatnonzero(kid.run[:m] != values[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.run):
                top = Trie(kid.run[:same], [], kid.most, kid.least, kid.tied)
                kid.cut(kid.run[same:])
                top.kids[int(kid.run[0])] = kid
                here.kids[int(values[at])] = top
                kid = top
            at, here = at + same, kid


#: 64-bit words of a sketch: one parity bit for each n-gram's place.
SKETCH = 32


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the members' places. Two sets differ in at least as many members as their sketches do in bits."""
    odd = np.bincount((kernel.mix(values) % U64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(U64)


def links(root: Trie, values: np.ndarray, node: int, forest: linking.Forest, percent: int, begins: set[int]) -> Iterator[int]:
    """Sets of the trie linked with ``values`` that begin with one of ``begins``, but for those that the forest
    already ties to ``node``."""
    n = len(values)
    stack = [(root.kids[x], 0, 0, True) for x in begins]
    while stack:
        here, depth, overlap, down = stack.pop()
        if not down:  # all below was seen: is it one group now?
            groups = {forest.root(x) for x in here.ends} | {None if k.tied is None else forest.root(k.tied) for k in here.kids.values()}
            here.tied = groups.pop() if len(groups) == 1 else None
            continue
        if here.tied is not None and forest.root(here.tied) == forest.root(node):
            continue
        if here.most * 100 < n * percent or here.least * percent > n * 100:
            continue
        overlap += int(np.count_nonzero(values[np.minimum(np.searchsorted(values, here.run), n - 1)] == here.run))
        depth += len(here.run)
        ahead = n - int(np.searchsorted(values, U64(here.last), "right"))
        if overlap + min(ahead, here.most - depth) < least_overlap(n, max(here.least, n * percent // 100), percent):
            continue
        if overlap >= least_overlap(n, depth, percent):
            for other in here.ends:
                if forest.root(other) != forest.root(node):
                    yield other
        stack.append((here, depth, overlap, False))
        stack += [(kid, depth, overlap, True) for kid in here.kids.values()]


def trie_join(percent: int):
    """The join of ``linking.in_clusters`` on contents of sorted 64-bit hashes.

    A probe is first held against the sketches and sizes of all sets in the trie
    at once: it enters only branches that begin with a set that may link and is
    not tied to it already.
    """

    def join(first: list, second: list) -> Iterator[tuple[int, int]]:
        forest, root = linking.Forest(), Trie(np.zeros(0, U64), [], 0, 1 << 62, None)
        marks, sizes = np.zeros((len(first), SKETCH), U64), np.zeros(len(first), np.int64)
        names, heads = [node for node, _ in first], []
        for k, (node, content) in enumerate([*first, *second]):
            values = np.frombuffer(content, U64)
            mark, held = sketch(values), min(k, len(first))
            apart = np.bitwise_count(marks[:held] ^ mark).sum(1, dtype=np.int64)
            near = np.flatnonzero(apart * (100 + percent) <= (sizes[:held] + len(values)) * (100 - percent))
            mine = forest.root(node)
            begins = {heads[i] for i in near.tolist() if forest.root(names[i]) != mine}
            if begins:
                for other in links(root, values, node, forest, percent, begins):
                    if forest.root(other) != forest.root(node):
                        forest.tie(other, node)
                        yield other, node
            if k < len(first):
                root.insert(values, node, forest)
                marks[k], sizes[k] = mark, len(values)
                heads.append(int(values[0]))

    return join


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id: the least key that links reach.

    Two documents link when 100 * intersection >= percent * union of their sets of
    distinct n-grams of words (runs outside ASCII white space, A-Z in lower case);
    a document of fewer words, but not none, has its whole sequence as its one
    n-gram. Null, empty or blank texts have no n-grams, link with nothing and are
    their own component. Rows of one key count as one document whose texts link.
    A null key is linked with nothing and has a null component. Other columns are
    not read. n-grams are compared by 64-bit hashes of 64-bit word hashes, equal
    sets by 63 bits.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = own.where("doc_id is not null")

    def signed(column: pa.Array) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
        for lo, sets in document_sets(column, n, lower):
            yield lo, [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1 for s in sets], sets

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, node, sets in signed(batch.column(1)):
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array(size), pa.array(node, pa.int64(), mask=size == 0)], ["doc_id", "n_shingles", "node"])

    def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        for _, node, sets in signed(batch.column(1)):
            some = [(k, s) for k, s in zip(node, sets, strict=True) if len(s)]
            yield [k for k, _ in some], [s for _, s in some]

    def pack(group: pa.Table) -> pa.Table:
        """The wanted sets of a pack's texts; a key may have several texts."""
        wanted, nodes, sets = set(group["node"].to_pylist()), [], []
        for _, node, found in signed(group["text"].combine_chunks()):
            for k, s in zip(node, found, strict=True):
                if k in wanted:
                    wanted.remove(k)
                    nodes.append(k)
                    sets.append(s)
        blob = lambda x: pa.array([x], pa.binary())
        return pa.table({"pack": group["pack"][:1], "nodes": blob(np.array(nodes, np.int64).tobytes()), "sizes": blob(np.array([len(s) for s in sets], np.int64).tobytes()), "members": blob(b"".join(s.tobytes() for s in sets))})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, members in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                at = 8 * np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes, np.int64)), pa.array([members[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["node", "content"])

    described = store.staged(own.mapInArrow(describe, "doc_id long, n_shingles long, node long"), "sets")
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = repeated_members(keyed, sets_of, max(least, -(-total // TOGETHER)), least)
    known = described.where("doc_id is not null and node is not null")
    sets = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    wanted = sets.join(again.hint("merge"), "node").where(F.col("again") * 100 >= F.col("n") * percent)
    wanted = store.staged(wanted.select("node", "doc_id", "n"), "wanted")
    size = wanted.agg(F.sum("n")).first()[0] or 0
    packs = max(least, -(-size // TOGETHER))
    wanted = wanted.select("doc_id", "node", F.pmod(F.xxhash64("node"), F.lit(packs)).alias("pack"))
    packed = linking.matching(keyed, "doc_id", wanted).groupBy("pack").applyInArrow(pack, "pack long, nodes binary, sizes binary, members binary")
    packed = store.staged(packed, "packs")
    ties = store.staged(prefix_ties(packed, percent, max(least, -(-size // TOGETHER))), "candidates")
    clusters = linking.components(ties).select("node", F.col("component").alias("cluster"))
    items = packed.mapInArrow(contents, "node long, content binary").join(clusters.hint("merge"), "node").select("cluster", "node", "content")
    found = store.staged(linking.in_clusters(items, trie_join(percent)), "links")
    # A key with several texts links them.
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    several = known.join(several.hint("merge"), "doc_id").select("a", F.col("node").alias("b"))
    groups = linking.components(found.unionByName(several)).withColumnRenamed("component", "group")
    linked = sets.select("node", "doc_id").join(groups.hint("merge"), "node")
    lead = linked.groupBy("group").agg(F.min("doc_id").alias("lead"))
    linked = linked.select("node", "group").join(lead.hint("merge"), "group").select("node", "lead")
    # Only sets that are not one document's alone, or that have another lead; a set of very many copies is dealt out by a salt.
    lead = sets.join(linked.hint("merge"), "node", "left").where("copies > 1 or lead <> doc_id").select("node", F.coalesce("lead", "doc_id").alias("lead"))
    lead = lead.select("node", "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = described.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(lead.hint("merge"), ["node", "salt"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("lead", "doc_id")).alias("component_id"))
