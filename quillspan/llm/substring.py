"""Substring dedup: documents joined on winnowed anchors, matches extended both ways to the threshold.

Of every ``length`` consecutive words, the k-word piece with the least hash is
the anchor (the rightmost on ties); equal windows pick equal anchors, so repeats
of at least ``length`` words always share one. An anchor serves a run of windows.
Seeds join on the anchor's hash. Occurrences whose whole surroundings agree are
settled by one comparison, the hash of all words the run's windows span. Where
surroundings differ, each occurrence is extended left and right to every window
around its anchor, and windows are compared by 128 bits. Work is linear in the
occurrences: a window's first document is a minimum, never a list of pairs.
Overlapping windows merge into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel, store

U64 = np.uint64
#: Words of an anchor.
PIECE = 16


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least value of each run of ``width`` values, the last on ties."""
    at = np.arange(len(values))
    best, span = at, 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        span += step
    return best


def runs(w: kernel.Words, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: its document, first and last window start, anchor's word
    (positions within the chunk), the anchor's hash, and the words' two hashes."""
    one, two = w.hashes(0), w.hashes(1)
    n = len(one)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64), one, two
    at = np.arange(n - piece + 1)
    anchors = kernel.span_hashes(one, at, at + piece)
    best = sliding_min(anchors, length - piece + 1)  # for the window at each word, across documents
    doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
    starts = np.arange(n - length + 1)
    own = doc[starts] == doc[starts + length - 1]
    starts, best = starts[own], best[own]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64), one, two
    head = np.ones(len(starts), bool)
    head[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
    spot = np.flatnonzero(head)
    last = np.append(spot[1:], len(starts)) - 1
    return doc[starts[spot]], starts[spot], starts[last], best[spot], anchors[best[spot]], one, two


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, piece: int = PIECE) -> DataFrame:
    """One row a document: doc_id, spans (from, to: removed word ranges, merged) and, from
    them, n_words, n_removed and kept (the words that stay, joined by one space).

    Words are runs outside ASCII white space. A word is removed if a window of
    ``length`` words of its document covers it whose words also start somewhere in
    a document with a smaller key; windows are judged on the input. Null texts are
    empty; shorter documents lose nothing; repeats within one document stay. Rows
    with one key are one document for the comparison, each with its own spans
    only where their windows agree with a smaller key. A null key is never smaller
    than another and its row loses nothing. Other columns are not read. Words are
    compared by two independent 64-bit hashes.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in kernel.words(batch.column(1)):
                doc, lo, hi, at, anchor, one, two = runs(w, length, piece)
                around = kernel.span_hashes(one, lo, hi + length) + U64(3) * kernel.span_hashes(two, lo, hi + length, 1)
                around = kernel.mix(around ^ kernel.mix((at - lo).astype(U64) + U64(7)))
                first = w.first[:-1][doc]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[w.lo + doc]), pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32)),
                    pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64))], ["doc_id", "lo", "hi", "anchor", "around"])

    occurrences = store.staged(own.where("doc_id is not null").mapInArrow(seeds, "doc_id long, lo int, hi int, anchor long, around long"), "seeds")
    # The first document of each surrounding, and how many surroundings an anchor has.
    settled = occurrences.groupBy("anchor", "around").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = settled.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1").select("anchor", "kinds")
    told = settled.join(many, "anchor").select("anchor", "around", "first", "kinds")
    marked = occurrences.join(told, ["anchor", "around"]).where("doc_id > first or kinds > 1")
    marked = store.staged(marked.select("doc_id", "lo", "hi", (F.col("doc_id") > F.col("first")).alias("whole")), "marked")

    span = F.struct("lo", "hi")
    open_ = marked.where("not whole").groupBy("doc_id").agg(F.collect_set(span).alias("runs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in kernel.words(batch.column(1)):
                one, two = w.hashes(0), w.hashes(1)
                flat = batch.column(2).slice(w.lo, w.hi - w.lo).flatten()
                lo, hi = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                count = np.array([len(x) for x in batch.column(2).slice(w.lo, w.hi - w.lo)], np.int64)
                doc = np.repeat(np.arange(w.hi - w.lo), count)
                size = hi - lo + 1
                begin = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])
                doc = np.repeat(doc, size)
                start = w.first[:-1][doc] + at
                fits = start + length <= w.first[1:][doc]  # a row of this key with another, shorter text
                doc, at, start = doc[fits], at[fits], start[fits]
                a, b = kernel.span_hashes(one, start, start + length), kernel.span_hashes(two, start, start + length, 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + doc]), pa.array(at.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "at", "a", "b"])

    opened = own.join(open_.hint("merge"), "doc_id").mapInArrow(extend, "doc_id long, at int, a long, b long")
    opened = store.staged(opened, "windows")
    least = opened.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = opened.join(least, ["a", "b"]).where("doc_id > first").select("doc_id", F.struct(F.col("at").alias("lo"), F.col("at").alias("hi")).alias("r"))
    removed = marked.where("whole").select("doc_id", span.alias("r")).unionByName(later)
    removed = removed.groupBy("doc_id").agg(F.collect_set("r").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for w in kernel.words(texts):
                raw, rows = w.data.tobytes(), batch.column(2).slice(w.lo, w.hi - w.lo)
                kept, spans, n = [], [], np.diff(w.first)
                for d, got in enumerate(rows.to_pylist()):
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    out: list[dict] = []
                    for r in sorted((x["lo"], min(x["hi"] + length, z - a)) for x in got or []):
                        if out and r[0] <= out[-1]["to"]:
                            out[-1]["to"] = max(out[-1]["to"], r[1])
                        else:
                            out.append({"from": r[0], "to": r[1]})
                    stay = np.ones(z - a, bool)
                    for s in out:
                        stay[s["from"] : s["to"]] = False
                    spots = a + np.flatnonzero(stay)
                    kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[spots].tolist(), w.end[spots].tolist(), strict=True)]))
                    spans.append(out)
                gone = [sum(s["to"] - s["from"] for s in x) for x in spans]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.lo, len(n)), pa.array(spans, SPANS),
                    pa.array(n), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept])], NAMES)

    return own.join(removed.hint("merge"), "doc_id", "left").mapInArrow(cut, OUT)


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
NAMES = ["doc_id", "spans", "n_words", "n_removed", "kept"]
OUT = "doc_id long, spans array<struct<`from`: long, `to`: long>>, n_words long, n_removed long, kept string"
