"""Language-model scoring of whole documents.

Counts of all training words are gathered by a distributed group-by. A recurrent
model over the commonest words is trained on the executors: the training documents
are dealt over the rounds, each document to one of them, and in a round over shards;
shards go through truncated backpropagation from the same start, and their parameters
are averaged, weighted by tokens. Shards have a fixed size, so their number grows with
the corpus, and the vocabulary grows with the distinct words. A word outside it has
the model's probability of any such word times its smoothed share among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import gru, kernel, store

U64 = np.uint64
#: Tokens that go through the network side by side, about.
AT_ONCE = 1_000_000
#: Parameters that are averaged together.
BLOCK = 8192


@dataclass(frozen=True)
class Settings:
    """vocabulary, classes: words the network predicts and their classes, at least; they grow to ``growth`` times the
    square root of the distinct words, and the square root of the vocabulary; head: commonest words whose counts travel
    with each task, at most (rarer words are joined); rounds: averages, each of its own part of the training documents;
    shard: documents of one shard, about."""

    vocabulary: int = 2000
    growth: int = 3
    head: int = 400_000
    hidden: int = 16
    classes: int = 32
    rounds: int = 2
    shard: int = 3000


def word_counts(docs: DataFrame) -> DataFrame:
    """h (64-bit hash of the word) and c, over all texts of ``docs`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_c, held = [], [], 0

        def out() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate(held_h), return_inverse=True)
            c = np.bincount(at, np.concatenate(held_c), len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for w in kernel.words(batch.column(0), lower=True):
                h, c = np.unique(w.hashes(), return_counts=True)
                held_h.append(h)
                held_c.append(c)
                held += len(h)
                if held > 600_000:
                    yield out()
                    held_h, held_c, held = [], [], 0
        if held_h:
            yield out()

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def token_ids(column: pa.Array, words: np.ndarray, ids: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: first document; for each token its place in the sorted ``words`` (-1: absent; the end: -2), its
    model id, its hash, and each document's tokens, its end included."""
    for w in kernel.words(column, lower=True):
        hashes = w.hashes()
        at, inverse = kernel.distinct(hashes)
        spot = np.minimum(np.searchsorted(words, hashes[at]), max(0, len(words) - 1))
        place = np.where(words[spot] == hashes[at], spot, -1) if len(words) else np.full(len(at), -1)
        model = np.where(place >= 0, ids[spot], 0) if len(words) else np.zeros(len(at), np.int64)
        n = np.diff(w.first)
        close = np.cumsum(n)
        yield w.lo, np.insert(place[inverse], close, -2), np.insert(model[inverse], close, end), np.insert(hashes, close, 0), n + 1


def coder(known: Broadcast):
    """Turns (doc_id, text, shard) into (shard, doc_id, ids): model ids as 32-bit integers, the end included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.value
        for batch in batches:
            for lo, place, model_id, _, n in token_ids(batch.column(1), k["h"], k["id"], k["end"]):
                ids = np.where(place == -1, k["other"], model_id).astype("<i4").tobytes()
                at = 4 * np.concatenate([[0], np.cumsum(n)])
                data = pa.array([ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, len(n)), batch.column(0).slice(lo, len(n)), data], ["shard", "doc_id", "ids"])

    return encode


def learner(known: Broadcast, start: Broadcast):
    """Trains from ``start`` on the documents (shard, doc_id, ids) of a shard; gives the tokens seen and blocks of parameters."""

    def learn_shard(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("doc_id", "ascending"), ("ids", "ascending")])["ids"].to_pylist()
        sizes = np.array([len(x) // 4 for x in rows], np.int64)
        got = gru.train(start.value, np.frombuffer(b"".join(rows), "<i4"), sizes, known.value["end"])
        values = np.concatenate([got[x].ravel() for x in gru.TRAINED]).astype(np.float32)
        blocks = [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]
        return pa.table({"i": np.arange(len(blocks)), "weight": np.full(len(blocks), float(sizes.sum())), "values": pa.array(blocks, pa.list_(pa.float32()))})

    return learn_shard


def average(shards: DataFrame, model: dict) -> dict:
    """Parameters averaged over shards (i, weight, values), weighted, block by block; the model itself without shards."""

    def mean(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0.0
        for batch in batches:
            w = batch.column("weight").to_numpy()
            total = total + w @ batch.column("values").flatten().to_numpy().reshape(len(w), -1).astype(np.float64)
            weight += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([(total / weight).astype(np.float32)], pa.list_(pa.float32()))], ["i", "values"])

    got = shards.groupBy("i").applyInArrow(mean, "i long, values array<float>").toArrow().sort_by("i")
    if not got.num_rows:
        return model
    flat = got["values"].combine_chunks().flatten().to_numpy()
    out, at = dict(model), 0
    for k in gru.TRAINED:
        out[k] = flat[at : at + model[k].size].reshape(model[k].shape)
        at += model[k].size
    return out


def lm_score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Words are runs outside ASCII white space, A-Z in lower case, told apart by a
    64-bit hash; each document ends in one more token. Null and empty texts are
    that token alone. ``learn`` says which rows are learned from; with none, every
    word is unknown and the network stays as it starts. Repeated rows count each;
    a null key is carried along, and learned from where ``learn`` says so; other
    columns are not read. base_score: log10 of (c + 1) / (N + V + 1), summed. The state runs
    through a document from its first word to its end.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), learn.alias("learn"))
    training = own.where("learn")
    counts = store.staged(word_counts(training), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = training.count()
    tokens, kinds = total[0] + n_docs, total[1] + (n_docs > 0)
    head = counts.orderBy(F.desc("c"), "h").limit(s.head).toArrow()
    h, c = head["h"].to_numpy().view(U64), head["c"].to_numpy()
    top = min(max(s.vocabulary, s.growth * math.isqrt(total[1])), len(h))
    rare_n, rare_v = total[0] - int(c[:top].sum()), total[1] - top
    # Model ids from the commonest: the words of the vocabulary, the end, and one for all other words.
    mass = np.concatenate([c[:top] + 1, [n_docs + 1, rare_n + rare_v + 1]]).astype(np.float64)  # the base model's shares
    rank = np.empty(len(mass), np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(len(mass))
    end, other = int(rank[top]), int(rank[top + 1])
    order = np.argsort(h)
    known = {
        "h": h[order], "c": c[order], "id": np.where(order < top, rank[np.minimum(order, top)], other),
        "end": end, "other": other, "n_docs": n_docs,
        "base": float(np.log10(tokens + kinds + 1)), "rare": float(np.log10(rare_n + rare_v + 1)),
    }
    model = gru.start(-np.sort(-mass), s.hidden, max(s.classes, math.isqrt(top)))
    pieces = max(1, math.ceil(n_docs / (s.rounds * s.shard)))
    shared = spark.sparkContext.broadcast(known)
    kind = own.schema["doc_id"].dataType.simpleString()

    for turn in range(s.rounds if n_docs else 0):
        dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.rounds * pieces))
        part = training.where(dealt % s.rounds == turn).select("doc_id", "text", F.floor(dealt / s.rounds).alias("shard"))
        part = part.mapInArrow(coder(shared), f"shard long, doc_id {kind}, ids binary")
        shards = part.groupBy("shard").applyInArrow(learner(shared, spark.sparkContext.broadcast(model)), "i long, weight double, values array<float>")
        model = average(shards, model)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m, serial = shared.value, final.value, TaskContext.get().partitionId() << 36
        def flush(ids: list, sizes: list, rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            run, at = gru.score(m, np.concatenate(ids), np.concatenate(sizes), k["end"]), 0
            for doc_id, n, count, base, spell, tail in rows:
                uid = serial + np.arange(len(n))
                serial += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(uid), doc_id, pa.array(n), pa.array(count), pa.array(base), pa.array(run[at : at + len(n)] + spell), tail], NAMES)
                at += len(n)

        for batch in batches:
            ids, sizes, rows, held = [], [], [], 0
            for lo, place, model_id, hashes, n in token_ids(batch.column(1), k["h"], k["id"], k["end"]):
                doc = np.repeat(np.arange(len(n)), n)
                absent = place == -1
                ids.append(np.where(absent, k["other"], model_id).astype(np.int32))
                sizes.append(n)
                seen = np.where(place >= 0, k["c"][place], np.where(absent, 0, k["n_docs"])) if len(k["c"]) else np.where(absent, 0, k["n_docs"])
                logs = np.log10(seen + 1.0)
                base = np.bincount(doc, logs - k["base"], len(n))
                spell = np.bincount(doc, np.where(ids[-1] == k["other"], logs - k["rare"], 0.0), len(n))
                count = np.bincount(doc, ~absent & (seen > 0), len(n)).astype(np.int64)
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, absent, len(n)))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[absent].view(np.int64)))
                rows.append((batch.column(0).slice(lo, len(n)), n, count, base, spell, tail))
                held += len(ids[-1])
                if held > AT_ONCE:
                    yield from flush(ids, sizes, rows)
                    ids, sizes, rows, held = [], [], [], 0
            if ids:
                yield from flush(ids, sizes, rows)

    first = store.staged(own.select("doc_id", "text").mapInArrow(score, f"uid long, doc_id {kind}, n_tokens long, n_known long, base double, score double, tail array<long>"), "scored")
    # Words beyond the head: their counts come by a join; none of them is frequent.
    tail = first.select("uid", F.explode("tail").alias("h")).groupBy("uid", "h").agg(F.count(F.lit(1)).alias("n")).join(counts, "h")
    tail = tail.groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    out = first.drop("tail").join(tail, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


NAMES = ["uid", "doc_id", "n_tokens", "n_known", "base", "score", "tail"]
