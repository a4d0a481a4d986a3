"""Model-backed operators with injectable providers; the defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import without_thinking


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SparseEncoder(Protocol):
    def encode(self, texts: list[str]) -> list[dict[str, float]]: ...


class Completer(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Signed feature hashing of words, of unit length: equal texts embed alike, anywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


class CountEncoder:
    """A sparse encoder that weighs words by 1 + ln of their count."""

    def encode(self, texts: list[str]) -> list[dict[str, float]]:
        import math
        from collections import Counter

        return [{w: 1 + math.log(n) for w, n in Counter((t or "").lower().split()).items()} for t in texts]


class EchoCompleter:
    """Answers with the prompt's last line that is not blank."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((x.strip() for x in reversed(p.split("\n")) if x.strip()), "") for p in prompts]


def retried(call: Callable[[list], list], items: list, tries: int = 3, most_wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """``call`` with up to ``tries`` retries after failures, waiting 2 ** n seconds, ``most_wait`` at most."""
    for n in range(tries):
        try:
            return call(items)
        except Exception:
            sleep(min(most_wait, 2.0**n))
    return call(items)


_MADE: dict = {}


def provider(factory: Callable):
    """One provider per process, whatever the number of batches."""
    if factory not in _MADE:
        _MADE[factory] = factory()
    return _MADE[factory]


def embedding(factory: Callable[[], Embedder] = HashEmbedder, batch: int = 128, query_task: str | None = None):
    """A column function text -> array<float>; ``query_task`` wraps queries for instruction-tuned models."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider(factory)
        for texts in batches:
            items = [t or "" if query_task is None else f"Instruct: {query_task}\nQuery:{t or ''}" for t in texts]
            out: list = []
            for i in range(0, len(items), batch):
                out += retried(model.embed, items[i : i + batch])
            yield pd.Series(out)

    return run


def sparse_vectors(df: DataFrame, key: str, text: str, factory: Callable[[], SparseEncoder] = CountEncoder) -> DataFrame:
    """(key, term, weight) from a sparse encoder."""

    @F.pandas_udf("map<string,double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider(factory)
        for texts in batches:
            yield pd.Series(model.encode(list(texts)))

    return df.select(key, F.explode(run(F.col(text))).alias("term", "weight"))


def completion(factory: Callable[[], Completer] = EchoCompleter, fallback: str | None = None, tries: int = 3):
    """A column function prompt -> answer without thinking. A failure gives ``fallback``, or `ERROR: ...` as a value."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider(factory)
        for prompts in batches:
            out = []
            for p in prompts:
                try:
                    out.append(retried(model.complete, [p], tries)[0])
                except Exception as e:
                    out.append(fallback if fallback is not None else f"ERROR: {e}")
            yield pd.Series(out)

    return lambda prompt: F.trim(without_thinking(run(prompt)))


EXPAND = "Give up to 5 further search terms for the question below, separated by spaces.\n"
PASSAGE = "Write a short passage that would answer the question below.\n"


def expanded(query: Column, complete=None) -> Column:
    """The query with a model's further terms; without a model, or if it fails or says nothing, the query."""
    if complete is None:
        return query
    more = complete(F.concat(F.lit(EXPAND), query))
    return F.when(more.startswith("ERROR:") | (more == ""), query).otherwise(F.concat_ws(" ", query, more))


def hypothetical(query: Column, complete=None) -> Column:
    """A passage that a model imagines as the answer, for dense search; the query if there is none."""
    if complete is None:
        return query
    text = complete(F.concat(F.lit(PASSAGE), query))
    return F.when(text.startswith("ERROR:") | (text == ""), query).otherwise(text)


def available(factory: Callable[[], object]) -> bool:
    """Whether a provider can be made here: asked on the driver before a job starts."""
    try:
        provider(factory)
        return True
    except Exception:
        return False
