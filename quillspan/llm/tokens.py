"""Token ids in directly addressable codes, and the encoder that feeds them.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds one byte for
every id; a bitmap tells which ids go on in level 1, whose bytes stand densely,
and so on. A rank directory over each bitmap (a count every 512 bits) finds an
id's byte on the next level, so any token is read without decoding another.

A shard file, all numbers little-endian:

    magic "QSDAC01\\n", uint64 documents, uint64 ids, uint64 levels
    int64 document keys, uint8 flags of null keys, uint64 first ids (documents + 1)
    for each level: uint64 bytes, then those bytes; for each but the last also
    the bitmap (one bit an id, lowest bit first) and uint32 ranks every 512 bits
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import kernel, store

MAGIC = b"QSDAC01\n"
BLOCK = 512
#: Ids of one shard at most, but for one longer document.
SHARD_IDS = 4_000_000


def pack(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A shard's bytes."""
    flat = np.concatenate(ids).astype(np.uint64) if ids else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    levels, rest = [], flat
    while True:
        low, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        last = not more.any()
        part = [np.uint64(len(low)).astype("<u8").tobytes(), low.tobytes()]
        if not last:
            bits = np.packbits(more, bitorder="little")
            per = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
            part += [bits.tobytes(), np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4").tobytes()]
        levels.append(b"".join(part))
        if last:
            break
        rest = rest[more]
    head = np.array([len(keys), len(flat), len(levels)], "<u8").tobytes()
    names = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    nulls = np.array([k is None for k in keys], np.uint8).tobytes()
    return b"".join([MAGIC, head, names, nulls, first.tobytes(), *levels])


class Shard:
    """Random access to the ids of a shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of this format")
        docs, self.n_ids, levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at = 32
        self.keys = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
        self.first = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        at += 9 * docs + 8 * (docs + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for level in range(levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            low = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level < levels - 1:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(data, "<u4", -(-n // BLOCK), at + len(bits))
                at += len(bits) + 4 * len(ranks)
            self.levels.append((low, bits, ranks))

    def token(self, i: int) -> int:
        """Id number i, touching one byte a level and at most one block of each bitmap."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = bits[(i // BLOCK) * BLOCK // 8 : (i >> 3) + 1].copy()
            block[-1] &= (1 << (i & 7)) - 1
            i, shift = int(ranks[i // BLOCK]) + int(np.bitwise_count(block).sum()), shift + 8
        return value

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids lo..hi."""
        value, shift, spot = np.zeros(hi - lo, np.uint64), 0, np.arange(hi - lo)
        for low, bits, ranks in self.levels:
            value[spot] |= low[lo:hi].astype(np.uint64) << np.uint64(shift)
            if bits is None or lo == hi:
                break
            base = lo // BLOCK * BLOCK
            own = np.unpackbits(bits[base // 8 : -(-hi // 8)], bitorder="little")[: hi - base].astype(bool)
            before = int(ranks[lo // BLOCK]) + int(own[: lo - base].sum())
            more = own[lo - base :]
            spot = spot[more]
            lo, hi, shift = before, before + len(spot), shift + 8
        return value


#: Bytes that may be cut off behind a word's last ASCII letter without changing its tokens: none of them
#: begins a contraction, composes with the letter or belongs to a special token's name.
TAIL = np.zeros(256, bool)
TAIL[[ord(c) for c in ".,!?*#$%&;:"]] = True


#: New words that go to the library at once.
AT_ONCE = 4096


class Encoder:
    """Ids of whole texts from a tokenizer that never joins across ASCII white space.

    Each distinct word is encoded by the library and then looked up by the 64-bit
    hash of its bytes, in flat arrays of about 30 bytes a word. Words are cut at
    white space, and punctuation is cut off behind a final letter.
    """

    #: Words remembered at most; beyond it the less used half goes.
    REMEMBER = 600_000

    def __init__(self, path: str, lower: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already; threads cost memory each
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0  # ids of all words remembered, end to end
        self.main, self.fresh = Memory.empty(), Memory.empty()

    def places(self, hashes: np.ndarray, name) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``flat``, and how many they are; ``name(i)`` is the text of word i of ``hashes`` (ascending)."""
        begin, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        lack = self.main.find(hashes, np.arange(len(hashes)), begin, size)
        lack = self.fresh.find(hashes, lack, begin, size)
        if len(lack):
            n = np.zeros(len(lack), np.int64)
            for lo in range(0, len(lack), AT_ONCE):  # the library's results are large beside the ids in them
                ids = [x.ids for x in self.tokenizer.encode_batch_fast([name(i) for i in lack[lo : lo + AT_ONCE].tolist()], add_special_tokens=False)]
                n[lo : lo + AT_ONCE] = [len(x) for x in ids]
                end = self.filled + sum(map(len, ids))
                if end > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(max(end, len(self.flat) * 3 // 2) - len(self.flat), np.uint32)])
                self.flat[self.filled : end] = np.fromiter((i for x in ids for i in x), np.uint32, end - self.filled)
                self.filled = end
            size[lack] = n
            begin[lack] = self.filled - np.cumsum(n[::-1])[::-1]
            self.fresh = self.fresh.merged(Memory(hashes[lack], begin[lack], n, np.ones(len(lack), np.uint32)))
        return begin, size

    def settle(self) -> None:
        """Merges the fresh words into the main memory, and forgets when it is too large."""
        if len(self.fresh.h) * 8 > len(self.main.h):
            self.main, self.fresh = self.main.merged(self.fresh), Memory.empty()
        if len(self.main.h) > self.REMEMBER:
            keep = np.sort(np.argsort(self.main.used, kind="stable")[len(self.main.h) // 2 :])
            m = self.main
            n = m.size[keep].astype(np.int64)
            out = np.cumsum(n) - n
            flat = self.flat[np.repeat(m.begin[keep] - out, n) + np.arange(n.sum())]
            self.flat, self.filled = flat, len(flat)
            self.main, self.fresh = Memory(m.h[keep], out, n, m.used[keep] // 2), Memory.empty()

    def batch(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By chunk: the first document, the ids of its documents, and where each document's begin."""
        for w in kernel.words(column):
            if self.lower and b"<|" not in w.data.tobytes():
                w.data = kernel.LOWER[w.data]
            solid = np.maximum.accumulate(np.where(TAIL[w.data], np.int32(-1), np.arange(len(w.data), dtype=np.int32))) if len(w.data) else w.start
            core = solid[w.end - 1] + 1
            letter = (core > w.start) & (core < w.end) & _letters(w.data, core)
            core = np.where(letter, core, w.end)
            start = np.stack([w.start, core], 1).ravel()
            end = np.stack([core, w.end], 1).ravel()
            keep = start < end
            start, end = start[keep], end[keep]
            piece = np.concatenate([[0], np.cumsum(keep)])[2 * w.first]
            hashes = kernel.span_hashes(kernel._bytes_table(1)[w.data], start, end)
            at, inverse = kernel.distinct(hashes)
            begin, size = self.places(hashes[at], lambda i: w.data[start[at[i]] : end[at[i]]].tobytes().decode())
            n = size[inverse]
            out = np.concatenate([[0], np.cumsum(n)])
            yield w.lo, self.flat[np.repeat(begin[inverse] - out[:-1], n) + np.arange(out[-1])], out[piece]
            self.settle()


class Memory:
    """Words by the hash of their bytes, ascending: where their ids begin, how many they are, and how often they were asked for."""

    def __init__(self, h: np.ndarray, begin: np.ndarray, size: np.ndarray, used: np.ndarray):
        self.h, self.begin, self.size, self.used = h, begin.astype(np.uint32), size.astype(np.uint32), used

    @classmethod
    def empty(cls) -> Memory:
        return cls(np.zeros(0, np.uint64), *(np.zeros(0, np.uint32) for _ in range(3)))

    def find(self, hashes: np.ndarray, which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Fills in what is known of the words ``which``; returns the others."""
        if not len(self.h):
            return which
        at = np.minimum(np.searchsorted(self.h, hashes[which]), len(self.h) - 1)
        hit = self.h[at] == hashes[which]
        own, at = which[hit], at[hit]
        begin[own], size[own] = self.begin[at], self.size[at]
        self.used[at] += 1
        return which[~hit]

    def merged(self, other: Memory) -> Memory:
        at = np.searchsorted(self.h, other.h)
        return Memory(*(np.insert(getattr(self, x), at, getattr(other, x)) for x in ("h", "begin", "size", "used")))


def _letters(data: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Whether the byte before each position is an ASCII letter."""
    before = data[np.maximum(core - 1, 0)] | 32
    return (before >= 97) & (before <= 122)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lower: bool = True) -> Encoder:
    """One encoder for each process."""
    key = (path, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, lower)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None, lower: bool = True) -> DataFrame:
    """Writes the ids of ``docs`` in ascending key order to shard files; returns the manifest.

    tokenizer: path of a tokenizers file that lies on every executor; it must drop
    white space and, with ``lower``, be blind to the case of A-Z. Null texts are
    empty: their only id is ``end_id``. Null keys come first; equal keys stand
    side by side, ordered by content. Other columns are not read. A shard's name
    depends only on its place, and it is moved into place when complete, so a task
    that runs again replaces what its first run wrote. ``folder``: in the shared
    folder unless given; any file system that Arrow opens.

    Manifest: part, seq, path, n_docs, n_ids, and start, the ids of all shards before.
    """
    spark = docs.sparkSession
    folder = folder or store.new_path(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    bounds = sorted(set(docs.select(F.col(key).cast("long").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, lower)
        for batch in batches:
            for lo, ids, at in enc.batch(batch.column(1)):
                k = batch.column(0).slice(lo, len(at) - 1)
                part = np.where(k.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, k.fill_null(0).to_numpy(), "right"))
                data = pa.array([ids[a:b].astype("<u2" if not b - a or ids[a:b].max() < 65536 else "<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([k, pa.array(part.astype(np.int32)), pa.array((at[1:] - at[:-1]).astype(np.int64)), data], ["k", "p", "n", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/shard-{part:07d}-{seq:07d}.dac"
            files, at = pa.fs.FileSystem.from_uri(name)
            files.create_dir(at.rpartition("/")[0], recursive=True)
            own = f"{at}.{TaskContext.get().taskAttemptId()}.part"
            with files.open_output_stream(own) as out:
                out.write(pack(keys, ids))
            files.move(own, at)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": name, "n_docs": len(keys), "n_ids": held}], schema=MANIFEST)

        for batch in batches:
            for k, size, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held and held + size + 1 > SHARD_IDS:
                    yield flush()
                    keys, ids, held, seq = [], [], 0, seq + 1
                keys.append(k)
                ids.append(np.append(np.frombuffer(data, "<u2" if len(data) == 2 * size else "<u4").astype(np.uint32), np.uint32(end_id)))
                held += size + 1
        if keys:
            yield flush()

    spread = own.mapInArrow(encode, "k long, p int, n long, ids binary").repartitionById(len(bounds) + 1, F.col("p"))
    shards = spread.sortWithinPartitions(F.col("k").asc_nulls_first(), "n", "ids").mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long")
    kept = store.staged(shards, "manifest")
    parts = kept.groupBy("part").agg(F.sum("n_ids").alias("m"))
    before = parts.select("part", (F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("b"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    return kept.withColumn("i", inner).join(before, "part").select("part", "seq", "path", "n_docs", "n_ids", (F.col("b") + F.col("i")).alias("start"))


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Each document of the shards: doc_id, start (ids of all documents before), n_tokens and the crc32 of its ids as uint32."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                files, at = pa.fs.FileSystem.from_uri(row.path)
                with files.open_input_file(at) as f:
                    shard = Shard(f.read())
                flat = shard.ids(0, shard.n_ids).astype("<u4")
                first = shard.first
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(shard.keys, "Int64"), "start": row.start + first[:-1], "n_tokens": np.diff(first), "ids_crc32": np.array(crc, np.int64)}).assign(doc_id=lambda x, s=shard: x.doc_id.mask(s.nulls))

    spark = manifest.sparkSession
    spread = manifest.select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
