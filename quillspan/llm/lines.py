"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

Lines within ``most`` edits share a segment: cut the shorter line into most + 1
segments and one of them stands unchanged in the other line, at an offset that
the edits before and after it and the difference in length bound. A line is
indexed by its own segments and probes, for each length it may meet, the
substrings at the offsets that matter. Shared keys make candidate clusters; in
each, the same index and sketches of the lines narrow the pairs and a banded
bit-parallel edit distance decides. Short lines share segments by chance, so with the corpus
most of them grow into one cluster; a cluster of many lines is taken apart again, and
only lines of one key meet there. The threshold follows the shorter line's length: one edit for each
``per`` bytes, up to ``most``, so that short lines are not linked by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel, linking, store

U64 = np.uint64
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: Keys of a line, about.
KEYS = 12
#: Lines from which a cluster is taken apart by its keys, lines of a key from which its pairs are dealt over tasks, rows of a bucket of keys, about.
LARGE, HOT, BUCKET = 1000, 30_000, 50_000
#: Lines of a key from which they go in one by one, and pairs of smaller keys compared at once.
MANY, PAIRS = 48, 200_000


def permitted(length, most: int, per: int):
    """Edits within which lines are linked, the shorter of which has ``length`` bytes."""
    return np.minimum(most, length // per)


def segments(length: int, most: int) -> list[tuple[int, int]]:
    """Start and size of each of most + 1 segments, as even as can be, the longer ones last."""
    n = most + 1
    sizes = [(length + i) // n for i in range(n)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(n)]


def offsets(i: int, shift: int, most: int) -> range:
    """Offsets from segment i's start at which it may stand in a line longer by ``shift``:
    edits before it move it by i at most, edits behind it by most - i."""
    return range(max(-i, shift - (most - i)), min(i, shift + (most - i)) + 1)


def distance_within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is ``most`` at most.

    States lie on the 2 * most + 1 diagonals about the main one. Bit d + most of
    row[k] says that the bytes of a read so far match those of b up to d places
    further, with k edits or fewer.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    places: dict[int, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + most)
    full = (1 << (2 * most + 1)) - 1
    room = ((1 << (len(b) + 1)) - 1) << most  # ends of b's prefixes
    row = [full & room & ((1 << (most + k + 1)) - 1) & ~((1 << most) - 1) for k in range(most + 1)]
    for i, c in enumerate(a):
        match, fits = places.get(c, 0) >> i & full, room >> (i + 1) & full
        new = [row[0] & match & fits]
        for k in range(1, most + 1):
            new.append((row[k] & match | row[k - 1] | row[k - 1] >> 1 | new[k - 1] << 1) & fits)
        row = new
        if not row[most]:
            return False
    return bool(row[most] >> (len(b) - len(a) + most) & 1)


#: 64-bit words of a sketch of a line.
SKETCH = 8


def sketches(lines: list[bytes]) -> np.ndarray:
    """Parities of how often a line has the byte pairs of each place: a column a line. One edit turns four at most."""
    out = np.empty((SKETCH, len(lines)), U64)
    for k, line in enumerate(lines):
        x = np.frombuffer(line, np.uint8).astype(U64)
        place = kernel.mix((x[:-1] << U64(8)) | x[1:]) % U64(64 * SKETCH)
        out[:, k] = np.packbits((np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1).astype(bool)).view(U64)
    return out


def edit_join(most: int, per: int):
    """The join of ``linking.in_clusters`` on lines.

    Lines go in by length. A line meets those of fitting length whose sketch is near
    its own, or of them, where these are much fewer, those that share a segment with
    it; the distance is computed to the ones that are not tied to it already.
    """
    bound = lambda length: min(most, length // per)
    probes: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def places(length: int, shift: int) -> list[tuple[int, int, int]]:
        """Segment, offset and size of what a line longer by ``shift`` looks up among lines of ``length``."""
        if (length, shift) not in probes:
            probes[length, shift] = [(i, at + d, size) for i, (at, size) in enumerate(segments(length, bound(length))) for d in offsets(i, shift, bound(length))
                                     if at + d >= 0 and at + d + size <= length + shift]
        return probes[length, shift]

    def join(first: list, second: list) -> Iterator[tuple[int, int]]:
        held = sorted([(len(line), 0, node, line) for node, line in first] + [(len(line), 1, node, line) for node, line in second])
        marks = sketches([line for *_, line in held])
        side = np.array([x for _, x, *_ in held], np.int8)
        group = np.arange(len(held))  # lines of one number are tied
        index: dict[tuple[int, int, bytes], list[int]] = {}
        begin: dict[int, int] = {}  # the first line of each length
        for k, (size, own, node, line) in enumerate(held):
            begin.setdefault(size, k)
            fit = [x for x in range(max(0, size - most), size + 1) if x in begin and size - x <= bound(x) > 0]
            shared = [index.get((x, i, line[at : at + n]), ()) for x in fit for i, at, n in places(x, size - x)]
            if 4 * sum(map(len, shared)) < k - (begin[fit[0]] if fit else k):
                near = np.unique(np.fromiter(chain.from_iterable(shared), np.int64))
            else:
                near = np.arange(begin[fit[0]] if fit else k, k)
            if second:
                near = near[side[near] != own]
            near = near[group[near] != group[k]]
            if len(near):
                apart = sum(np.bitwise_count(mark[near] ^ mark[k]).astype(np.int64) for mark in marks)
                near = near[apart <= 4 * most]
            while len(near):
                j, near = int(near[0]), near[1:]
                length, _, other, text = held[j]
                if size - length <= bound(length) and distance_within(text, line, bound(length)):
                    group[group == group[j]] = group[k]
                    near = near[group[near] != group[k]]
                    yield other, node
            for i, (at, n) in enumerate(segments(size, bound(size))):
                index.setdefault((size, i, line[at : at + n]), []).append(k)

    return join


def sketched(lines: list[bytes]) -> np.ndarray:
    """``sketches`` of many short lines, a row a line."""
    out = []
    for lo in range(0, len(lines), 4096):
        some = lines[lo : lo + 4096]
        data = np.frombuffer(b"".join(some), np.uint8).astype(U64)
        of = np.repeat(np.arange(len(some)), [len(x) for x in some])
        place = kernel.mix((data[:-1] << U64(8)) | data[1:]) % U64(64 * SKETCH)
        inside = of[1:] == of[:-1]
        odd = np.bincount(of[1:][inside] * (64 * SKETCH) + place[inside].astype(np.int64), minlength=len(some) * 64 * SKETCH) & 1
        out.append(np.packbits(odd.astype(bool).reshape(len(some), -1), axis=1).view(U64))
    return np.concatenate(out) if out else np.zeros((0, SKETCH), U64)


def key_join(keys: np.ndarray, nodes: np.ndarray, lines: list[bytes], most: int, per: int) -> Iterator[tuple[int, int]]:
    """Links of lines that share a key, all rows (key, node, line) of some keys given; those that others tie already may be left out."""
    order = np.lexsort((nodes, keys))
    keys, nodes, lines = keys[order], nodes[order], [lines[i] for i in order.tolist()]
    size = np.array([len(x) for x in lines], np.int64)
    cut = np.concatenate([np.flatnonzero(np.diff(keys, prepend=keys[:1] + 1)), [len(keys)]]).astype(np.int64) if len(keys) else np.zeros(1, np.int64)
    count = np.diff(cut)
    marks = sketched(lines)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may be linked, as lengths and sketches have it."""
        bound = permitted(np.minimum(size[i], size[j]), most, per)
        ok = (np.abs(size[i] - size[j]) <= bound) & (nodes[i] != nodes[j])
        ok[ok] = np.bitwise_count(marks[i[ok]] ^ marks[j[ok]]).sum(axis=1, dtype=np.int64) <= 4 * bound[ok]
        return ok

    def linked(i: int, j: int) -> bool:
        a, b = sorted((lines[i], lines[j]), key=len)
        return distance_within(a, b, min(most, len(a) // per))

    few = np.flatnonzero((count > 1) & (count < MANY))
    row = np.repeat(few, count[few])  # a row meets those behind it in its key
    at = cut[row] + np.arange(len(row)) - np.repeat(np.cumsum(count[few]) - count[few], count[few])
    rest = cut[row + 1] - at - 1
    ends, lo = np.cumsum(rest), 0
    seen: set[tuple[int, int]] = set()
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - rest[lo] + PAIRS, "right")))
        i = np.repeat(at[lo:hi], rest[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[lo:hi] - rest[lo:hi] - (ends[lo] - rest[lo]), rest[lo:hi])
        ok = near(i, j)
        for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            pair = int(nodes[x]), int(nodes[y])
            if pair not in seen:
                seen.add(pair)
                if linked(x, y):
                    yield pair
        lo = hi
    for k in np.flatnonzero(count >= MANY).tolist():
        first = int(cut[k])
        group = np.arange(count[k])  # lines of one number are tied
        for x in range(1, int(count[k])):
            others = np.flatnonzero(group[:x] != group[x])
            others = others[near(first + others, np.full(len(others), first + x))]
            while len(others):
                y, others = int(others[0]), others[1:]
                if linked(first + x, first + y):
                    group[group == group[y]] = group[x]
                    others = others[group[others] != group[x]]
                    yield int(nodes[first + y]), int(nodes[first + x])


def linked_lines(items: DataFrame, most: int, per: int) -> DataFrame:
    """Links (a, b) of the lines ``items`` (cluster, node, content): within small clusters, and within the keys of large ones."""
    large = store.staged(items.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE), "large")
    links = linking.in_clusters(items.join(large.select("cluster"), "cluster", "left_anti"), edit_join(most, per))
    n_lines = large.agg(F.sum("n")).first()[0]
    if not n_lines:
        return links

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, content = batch.column(0), batch.column(1)
            for w in kernel.words(content.cast(pa.string()), space=NEWLINE):  # a line is a word of its own
                for k, which in line_keys(w, np.arange(len(w.start)), most, per):
                    rows = pa.array(w.lo + which)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), nodes.take(rows), content.take(rows)], ["cluster", "node", "content"])

    rows = items.join(large.select("cluster"), "cluster", "left_semi").select("node", "content").mapInArrow(keyed, "cluster long, node long, content binary").distinct()
    rows = store.staged(rows, "keyed")
    hot = store.staged(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("cluster"), "hot")
    buckets = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_lines * KEYS // BUCKET)

    def run(group: pa.Table) -> pa.Table:
        links = list(key_join(group["cluster"].to_numpy(), group["node"].to_numpy(), group["content"].to_pylist(), most, per))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    some = rows.join(hot, "cluster", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
    return links.unionByName(some.groupBy("bucket").applyInArrow(run, "a long, b long")).unionByName(linking.in_clusters(rows.join(hot, "cluster", "left_semi"), edit_join(most, per)))


def line_keys(w: kernel.Words, pick: np.ndarray, most: int, per: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the lines ``pick`` and the index into ``pick`` of each: a line's own segments, and what it probes."""
    start, size = w.start[pick], w.end[pick] - w.start[pick]
    data = kernel._bytes_table(1)[w.data]
    sums = kernel.prefix_sums(data)
    for shift in range(most + 1):
        edits = permitted(size - shift, most, per)
        for t in range(max(1, shift), most + 1):
            own = np.flatnonzero(edits == t)
            if not len(own):
                continue
            length = size[own] - shift
            at = np.zeros_like(length)
            for i in range(t + 1):
                span = (length + i) // (t + 1)
                for d in offsets(i, shift, t):
                    ok = np.flatnonzero((at + d >= 0) & (at + d + span <= length + shift))
                    s = start[own[ok]] + at[ok] + d
                    h = kernel.span_hashes(data, s, s + span[ok], sums=sums)
                    yield kernel.mix(h ^ kernel.mix((length[ok] * 16 + i).astype(U64))), own[ok]
                at = at + span


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2, per: int = 8) -> DataFrame:
    """One row a document: doc_id, n_lines, and removed, the numbers from 0 of the lines to go, ascending.

    Lines are split at line feeds. Equal lines are linked, and lines within one edit
    for each ``per`` bytes of the shorter one, ``most`` edits at most, over UTF-8
    bytes. Of the lines that links
    tie together all but the first go, by key and then line number. Lines without
    any character but ASCII white space are kept and linked with nothing. Null
    texts have no line; an empty text has one. Rows of one key are one document:
    lines of equal number compete as one. Null keys lose nothing and remove
    nothing. Other columns are not read. Equal lines are found by 64-bit hashes.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = own.where("doc_id is not null and text is not null")

    def lines(column: pa.Array) -> Iterator[tuple[kernel.Words, np.ndarray, np.ndarray]]:
        """Words made of whole lines, those with a visible character, and each one's number in its document."""
        for w in kernel.words(column, space=NEWLINE):
            solid = np.concatenate([[0], np.cumsum(~kernel.SPACE[w.data])])
            feeds = np.concatenate([[0], np.cumsum(w.data == 0x0A)])
            seen = solid[w.end] > solid[w.start]
            doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
            yield w, np.flatnonzero(seen), feeds[w.start] - feeds[w.bounds[doc]]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w, seen, number in lines(batch.column(1)):
                doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))[seen]
                yield pa.RecordBatch.from_arrays([
                    pa.array(w.hashes()[seen].view(np.int64)), pa.array(ids[w.lo + doc]), pa.array(number[seen].astype(np.int32))], ["h", "doc_id", "line"])

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for w, seen, _ in lines(batch.column(1)):
            hashes = w.hashes()[seen]
            _, at = np.unique(hashes, return_index=True)
            for k, which in line_keys(w, seen[at], most, per):
                yield k, hashes[at][which].view(np.int64)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                split = t.encode().split(b"\n")
                rows = [r for r in rows if r["line"] < len(split)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["cluster"] for r in rows], pa.int64()), pa.array([r["h"] for r in rows], pa.int64()),
                    pa.array([split[r["line"]] for r in rows], pa.binary())], ["cluster", "node", "content"])

    rows = store.staged(keyed.mapInArrow(occurrences, "h long, doc_id long, line int"), "lines")
    distinct = store.staged(rows.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = linking.candidate_edges(keyed, keys_of, distinct.count() * KEYS)
    clusters = linking.components(edges).select(F.col("node").alias("h"), F.col("component").alias("cluster"))
    where = distinct.join(clusters.hint("merge"), "h").select(F.col("first.doc_id").alias("doc_id"), F.struct(F.col("first.line").alias("line"), "h", "cluster").alias("r"))
    held = store.staged(where.groupBy("doc_id").agg(F.collect_list("r").alias("rows")), "held")
    items = linking.matching(keyed, "doc_id", held).select("doc_id", "text", "rows").mapInArrow(contents, "cluster long, node long, content binary")
    # Two lines of one hash would be one node; texts that differ in a document of several rows are left to their hash.
    items = store.staged(items.dropDuplicates(["node"]), "items")
    links = store.staged(linked_lines(items, most, per), "links")
    store.drop(items)
    groups = store.staged(linking.components(links).withColumnRenamed("node", "h"), "groups")
    tied = distinct.join(groups.hint("merge"), "h", "left").select("h", "n", "first", "component")
    leads = tied.where("component is not null").groupBy("component").agg(F.min("first").alias("lead"))
    lead = tied.join(leads.hint("merge"), "component").select("h", "lead")
    lead = lead.unionByName(tied.where("component is null and n > 1").select("h", F.col("first").alias("lead")))
    gone = rows.join(lead.hint("merge"), "h").where(F.struct("doc_id", "line") != F.col("lead"))
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return own.select("doc_id", n_lines.alias("n_lines")).join(gone.hint("merge"), "doc_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
