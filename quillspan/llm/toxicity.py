"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of the whole
word, so that an unseen misspelling shares most of its vectors with the word it
distorts. A document is the mean of its words. N-grams seen in hardly any training
document have no vector, so that what is new adds nothing rather than noise. Only
the sample that the model is fitted on is bounded; every document is scored over
its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import kernel, sample

SIZES = (2, 3, 4)


@dataclass(frozen=True)
class Settings:
    """max_train, max_bytes: labelled rows that the model is fitted on at most, and the bytes of all their texts; buckets: of
    hashed n-grams; least: training documents that a bucket must occur in to have a vector; steps: batches in all, over as
    many epochs as they fill."""

    max_train: int = 6000
    max_bytes: int = 48 << 20
    buckets: int = 1 << 17
    dim: int = 4
    least: int = 4
    steps: int = 600
    batch: int = 64
    rate: float = 1.0
    seed: int = 7


def bags(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of documents lo..hi: subword ids, the distinct word of each, that word's share per subword,
    the distinct word of each token, and each document's first token."""
    for w in kernel.words(column, lower=True, space=kernel.PUNCT):
        hashes = w.hashes()
        at, token = kernel.distinct(hashes)
        ids, of = [hashes[at] % kernel.U64(buckets)], [np.arange(len(at))]
        for _, grams, word in kernel.char_grams(w, at, SIZES):
            ids.append(grams % kernel.U64(buckets))
            of.append(word)
        yield w.lo, w.hi, np.concatenate(ids).astype(np.int64), np.concatenate(of), token, w.first


def fit(texts: pa.Array, toxic: np.ndarray, settings: Settings = Settings()) -> dict:
    """Trains embeddings and softmax together by Adagrad; returns the weight of each bucket and the bias.

    The softmax is linear in the averaged embeddings, so for two classes a
    bucket acts through one number: its embedding times the difference of the
    class vectors.
    """
    rng = np.random.default_rng(settings.seed)
    docs: list[tuple[int, int, int]] = []  # per document: its chunk, and where its words lie there
    chunks: list[tuple[np.ndarray, ...]] = []  # distinct words of documents, their counts, subword ids by word, where a word's begin, how many
    for lo, hi, ids, of, token, first in bags(texts, settings.buckets):
        per = np.bincount(of, minlength=(of.max() + 1) if len(of) else 0)
        kinds = len(per) + 1
        pairs, n = np.unique(np.repeat(np.arange(hi - lo), np.diff(first)) * kinds + token, return_counts=True)
        cut = np.searchsorted(pairs, np.arange(hi - lo + 1) * kinds).tolist()
        docs += [(len(chunks), x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        sub = ids[np.argsort(of, kind="stable")].astype(np.int32)
        chunks.append(((pairs % kinds).astype(np.int32), n.astype(np.float32), sub, np.concatenate([[0], np.cumsum(per)]), per))

    def expanded(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of a document and their coefficients in its mean."""
        chunk, x, y = docs[i]
        words, counts, sub, begin, per = chunks[chunk]
        words, n = words[x:y], counts[x:y]
        k = per[words]
        spot = np.repeat(begin[words] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        return sub[spot], np.repeat(n / k / max(1, n.sum()), k).astype(np.float32)

    held_by = np.zeros(settings.buckets, np.int64)
    for i in range(len(docs)):
        held_by[np.unique(expanded(i)[0])] += 1
    seen = held_by >= settings.least
    emb = np.zeros((settings.buckets, settings.dim), np.float32)  # the class vectors start at random, which sets them apart
    out = rng.normal(0, 0.3, (2, settings.dim)).astype(np.float32)
    rate = float(np.clip(np.mean(toxic), 1e-3, 1 - 1e-3)) if len(toxic) else 1e-3
    bias = np.log(np.array([1 - rate, rate])).astype(np.float32)
    g_emb, g_out, g_bias = np.full_like(emb, 1e-4), np.full_like(out, 1e-2), np.full_like(bias, 1e-2)
    epochs = -(-settings.steps * settings.batch // len(docs)) if len(set(toxic.tolist())) == 2 else 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(docs), settings.batch):
            pick = order[lo : lo + settings.batch]
            bag = [expanded(i) for i in pick]
            n = np.array([len(x) for x, _ in bag])
            ids, coef = np.concatenate([x for x, _ in bag]), np.concatenate([x for _, x in bag])
            coef *= seen[ids]
            row = np.repeat(np.arange(len(pick)), n)
            mean = np.stack([np.bincount(row, coef * emb[ids, j], len(pick)) for j in range(settings.dim)], 1)
            logits = mean @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), toxic[pick]] -= 1
            back = (p @ out).astype(np.float32)
            grad = np.stack([np.bincount(ids, coef * back[row, j], settings.buckets) for j in range(settings.dim)], 1).astype(np.float32)
            for theta, total, g in ((emb, g_emb, grad), (out, g_out, p.T @ mean), (bias, g_bias, p.sum(0))):
                total += g * g
                theta -= settings.rate * g / np.sqrt(total)
    return {"weight": (emb @ (out[1] - out[0])).astype(np.float32), "bias": float(bias[1] - bias[0]), "buckets": settings.buckets}


def score(column: pa.Array, model: dict) -> np.ndarray:
    """The softmax probability of the toxic class for each text; a text without words gets the prior's."""
    scores = np.empty(len(column))
    for lo, hi, ids, of, token, first in bags(column, model["buckets"]):
        words = np.bincount(of, model["weight"][ids]) / np.maximum(1, np.bincount(of)) if len(of) else np.zeros(0)
        kinds = len(words) + 1
        pairs, n = np.unique(np.repeat(np.arange(hi - lo), np.diff(first)) * kinds + token, return_counts=True)
        mean = np.bincount(pairs // kinds, n * words[pairs % kinds], hi - lo) / np.maximum(1, np.bincount(pairs // kinds, n, hi - lo))
        scores[lo:hi] = 1 / (1 + np.exp(-np.clip(mean + model["bias"], -60, 60)))
    return scores


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Fits on at most ``max_train`` labelled rows of at most ``max_bytes`` of text, the first by a hash of the key.

    Labels other than 0 and 1 and null keys are left out; repeated rows count once; rows of one key with several
    texts or labels count each, within the same bounds.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull()).distinct()
    picked = known.withColumn("at", F.xxhash64("k")).orderBy("at", "k", "y").limit(settings.max_train)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    rows = sample.bounded(rows, "t", ["at", "k", "y"], settings.max_train, settings.max_bytes)
    model = fit(rows["t"].combine_chunks(), rows["y"].to_numpy().astype(np.int64), settings)
    del rows
    kernel.release()  # the driver lives on, with what it needs for later stages
    return model


def toxicity(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5, score_as: str = "toxic_score", flag_as: str = "is_toxic") -> DataFrame:
    """``docs`` with the score and, at ``threshold``, the flag.

    Null and empty texts have no words and get the class prior, as do all texts
    under a model fitted on one class or on no rows. Extra columns are kept; one
    named as an output column is replaced. The model has a fixed size (one float
    per bucket) and travels with the task.
    """
    kept = [c for c in docs.columns if c not in (score_as, flag_as)]
    own = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(kept.index(text)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= threshold)], [*kept, score_as, flag_as])

    schema = T.StructType([*own.schema, T.StructField(score_as, T.DoubleType()), T.StructField(flag_as, T.BooleanType())])
    return own.mapInArrow(run, schema)
