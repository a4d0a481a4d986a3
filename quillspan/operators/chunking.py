"""Cutting texts into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import strip


def pack_paragraphs(text: Column, size: int, separator: str = "\n\n") -> Column:
    """Paragraphs, stripped and not blank, packed in order: one joins the chunk while the chunk, its trailing
    separator and two characters more stay within ``size``. A longer paragraph is a chunk of its own, never cut."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(p) + 2 <= size
        flushed = F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], p, F.lit("\n\n")).alias("cur"))).otherwise(
            F.struct(flushed.alias("done"), F.concat(p, F.lit("\n\n")).alias("cur")))

    def end(acc: Column) -> Column:
        return F.transform(F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])), strip)

    return F.aggregate(paragraphs, start, step, end)


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first is preceded by the end of the one before, as it was without its own prefix."""
    if overlap <= 0:
        return chunks
    return F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.right(F.get(chunks, i - 1), F.lit(overlap)), F.lit("\n\n"), c)).otherwise(c))


def slices(text: Column, size: int, step: int | None = None) -> Column:
    """Pieces of ``size`` characters, every ``step`` characters (``size`` by default)."""
    t, step = F.coalesce(text, F.lit("")), step or size
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t), F.lit(step)), lambda i: F.substring(t, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cuts at the first separator that occurs; pieces still too long are cut at the next ones.

    Neighbouring pieces are merged up to ``size`` characters; a new chunk begins
    with the last pieces of the one before, up to ``overlap`` characters. A
    separator stays at the head of the piece behind it. Chunks are stripped, and
    blank ones go.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    text = text or ""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in (head, *(mark + p for p in tail)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        chunk = "".join(held).strip()
        if chunk:
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size and rest:
            flush()
            held, length = [], 0
            out += split_recursive(piece, size, overlap, rest)
            continue
        if length + len(piece) > size and held:
            flush()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    flush()
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, position, chunk) by ``split_recursive``, batch by batch."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap))

    return docs.select(key, F.posexplode(cut(F.col(text))).alias("position", "chunk"))
