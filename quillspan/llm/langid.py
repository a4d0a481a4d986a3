"""Language ID by word-first backoff.

A word known from training scores each language by its log frequency there. An
unseen word falls back to its 5-character pieces, then to shorter ones, and takes
the mean of those known at the first length where any is. A text's score is the
sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import kernel, sample

SIZES = (5, 4, 3, 2, 1)


@dataclass(frozen=True)
class Settings:
    """max_train, max_bytes: rows that are learned from at most, an equal share a language, and the bytes of all their
    texts; max_known: words, and pieces of each size, kept at most, the commonest; smooth: added to each count."""

    max_train: int = 8000
    max_bytes: int = 64 << 20
    max_known: int = 150_000
    smooth: float = 0.5


def _log_rates(hashes: list[np.ndarray], counts: list[np.ndarray], langs: list[np.ndarray], n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest entries and their log frequency in each language."""
    h, c, of = np.concatenate(hashes), np.concatenate(counts), np.concatenate(langs)
    known, at = np.unique(h, return_inverse=True)
    table = np.zeros((len(known), n))
    np.add.at(table, (at, of), c)
    if len(known) > s.max_known:
        best = np.sort(np.argsort(-table.sum(1), kind="stable")[: s.max_known])
        known, table = known[best], table[best]
    rates = np.log((table + s.smooth) / (table.sum(0) + s.smooth * (len(known) + 1)))
    return known, (rates - rates.mean(1, keepdims=True)).astype(np.float32)


def fit(texts: pa.Array, langs: list[str], s: Settings = Settings()) -> dict:
    """Log frequencies of words and of their pieces; each word type's pieces count as often as it occurs."""
    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs], np.int64)
    found: dict[int, tuple[list, list, list]] = {n: ([], [], []) for n in (0, *SIZES)}

    def add(n: int, hashes: np.ndarray, counts: np.ndarray, of: np.ndarray) -> None:
        for held, x in zip(found[n], (hashes, counts, of), strict=True):
            held.append(x)

    for w in kernel.words(texts, lower=True, space=kernel.PUNCT):
        hashes = w.hashes()
        lang = np.repeat(code[w.lo : w.hi], np.diff(w.first))
        for x in np.unique(lang):
            own = np.flatnonzero(lang == x)
            _, at, counts = np.unique(hashes[own], return_index=True, return_counts=True)
            which = own[at]
            add(0, hashes[which], counts, np.full(len(which), x))
            for n, grams, word in kernel.char_grams(w, which, SIZES):
                known, at = np.unique(grams, return_inverse=True)
                add(n, known, np.bincount(at, counts[word], len(known)), np.full(len(known), x))
    model = {n: _log_rates(*held, len(names), s) if held[0] else (np.zeros(0, kernel.U64), np.zeros((0, len(names)), np.float32)) for n, held in found.items()}
    return {"langs": names, "tables": model}


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def score(column: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its softmax share; `und` and 0 where there is no letter or nothing was learned."""
    names, tables = model["langs"], model["tables"]
    langs, shares = ["und"] * len(column), np.zeros(len(column))
    for w in kernel.words(column, lower=True, space=kernel.PUNCT) if names else ():
        hashes = w.hashes()
        at, token = kernel.distinct(hashes)
        spot = _find(tables[0][0], hashes[at])
        vectors = np.zeros((len(at), len(names)), np.float32)
        vectors[spot >= 0] = tables[0][1][spot[spot >= 0]]
        open_ = np.flatnonzero(spot < 0)
        for n in SIZES:
            if not len(open_):
                break
            for _, grams, word in kernel.char_grams(w, at[open_], (n,)):
                spot = _find(tables[n][0], grams)
                hit = spot >= 0
                count = np.bincount(word[hit], minlength=len(open_))
                for j in range(len(names)):
                    vectors[open_, j] = np.bincount(word[hit], tables[n][1][spot[hit], j], len(open_)) / np.maximum(1, count)
                open_ = open_[count == 0]
        sums = np.zeros((len(token) + 1, len(names)))
        np.cumsum(vectors[token], axis=0, out=sums[1:])
        total = sums[w.first[1:]] - sums[w.first[:-1]]
        p = np.exp(total - total.max(1, keepdims=True))
        best, share = total.argmax(1), (p / p.sum(1, keepdims=True)).max(1)
        ascii_letter = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum((w.data >= 97) & (w.data <= 122), out=ascii_letter[1:])
        n_words = np.diff(w.first)
        for d in range(w.hi - w.lo):
            if n_words[d] and _has_letter(column, w, d, ascii_letter):
                langs[w.lo + d], shares[w.lo + d] = names[best[d]], share[d]
    return langs, shares


def _has_letter(column: pa.Array, w: kernel.Words, d: int, counted: np.ndarray) -> bool:
    a, z = int(w.start[w.first[d]]), int(w.end[w.first[d + 1] - 1])
    return counted[z] > counted[a] or any(c.isalpha() for c in column[w.lo + d].as_py())


def train(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Learns from at most ``max_train`` rows with a text and a language, and ``max_bytes`` of text.

    Each language gives an equal share of the rows, the first by a hash of the key. Rows of a language that has
    many are thinned out by that hash before they are ranked, so no task ranks much more than a share. Repeated
    rows count once; with more languages than rows, the first languages by name get one each.
    """
    own = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = own.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    n = counts.count()
    if not n:
        return fit(pa.array([], pa.string()), [], s)
    share = max(1, s.max_train // n)
    u = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / float(1 << 40)
    # Only the first ``max_train`` languages can give a row; a shuffled join would send all rows of one to one task.
    sized = F.broadcast(counts.orderBy("l").limit(s.max_train))
    near = own.select("k", "l", u.alias("u")).join(sized, "l").where(F.col("u") * F.col("n") <= 2 * share + 100).select("k", "l", "u").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("u", "k"))).where(F.col("r") <= share).select("r", "l", "k")
    picked = ranked.orderBy("r", "l", "k").limit(s.max_train).select("r", F.col("l").alias("pl"), F.col("k").alias("pk"))
    rows = own.join(F.broadcast(picked), F.col("k").eqNullSafe(F.col("pk")) & (F.col("l") == F.col("pl"))).select("r", "l", "k", "t")
    rows = sample.bounded(rows, "t", ["r", "l", "k"], s.max_train, s.max_bytes)
    return fit(rows["t"].combine_chunks(), rows["l"].to_pylist(), s)


def identify(docs: DataFrame, model: dict, text: str = "text", lang_as: str = "lang_pred", score_as: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its share.

    Null texts, empty ones and those without a letter are `und` with share 0; ties
    go to the first language by name. Extra columns are kept; one named as an output
    column is replaced. The model's size is bounded by its settings.
    """
    kept = [c for c in docs.columns if c not in (lang_as, score_as)]
    own = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, shares = score(batch.column(kept.index(text)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(shares)], [*kept, lang_as, score_as])

    return own.mapInArrow(run, T.StructType([*own.schema, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())]))
