import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspan.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello, World!!", "don't we'll 'S x's,", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b", "é É Ñandú ﬁ Ⅷ", "tre*** *** a.b.c... 3.14% $5", "á̸ ≠ x,́ ñ,", "日本語 テスト。x",
    "no break　wide", "İI ß ΣΑΣ", "x" * 5000, "the " * 3000, "tab\x0bvt\x0cff\x00nul", "&amp; #*#* word###", "‘quote’ — dash's", "😀 a😀b 😀,", "U.S.A. e.g., i.e.;", "K Kelvin",
]


def want(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_matches_the_library():
    enc, got = tokens.Encoder(PATH), []
    for _, ids, at in enc.batch(pa.array(TEXTS)):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids == want(text), text
    enc.REMEMBER = 3
    again = [ids[a:b].tolist() for _, ids, at in enc.batch(pa.array(TEXTS)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert again == got


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 1 << 32])
def test_codes(top):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, top, n).astype(np.uint64) for n in (0, 1, 700, 0, 5000, 513)]
    shard = tokens.Shard(tokens.pack([5, None, 7, 8, 9, -1], ids))
    flat = np.concatenate(ids)
    assert np.array_equal(shard.ids(0, shard.n_ids), flat) and shard.first.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])]).tolist()
    for lo, hi in ((0, 0), (3, 700), (511, 513), (1000, 6000), (6000, 6000)):
        assert np.array_equal(shard.ids(lo, hi), flat[lo:hi])
    for i in (0, 1, 511, 512, 513, 4096, len(flat) - 1):
        assert shard.token(i) == flat[i]
    assert shard.nulls.tolist() == [False, True, False, False, False, False]
    with pytest.raises(IndexError):
        shard.token(len(flat))
    with pytest.raises(ValueError):
        tokens.Shard(b"something else entirely")
    assert tokens.Shard(tokens.pack([], [])).n_ids == 0


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 900)
    rows = [(i * 3 % 61, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "null key", "x"), (7, "again", "x"), (7, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    manifest = tokens.write_tokens(df, PATH, end_id=1)
    got = sorted(map(tuple, tokens.read_tokens(manifest).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    code = lambda t: (len(want(t)) + 1, zlib.crc32(np.array([*want(t), 1], "<u4").tobytes()))
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, *code(r[1])) for r in rows)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(tokens.write_tokens(df, PATH, end_id=1)).count() == 0


def test_memory_of_a_chunk():
    """Beside its text, a task holds arrays of a small chunk only, and equal words are told apart as by ``unique``."""
    import tracemalloc

    from quillspan.llm import kernel

    column = pa.array([" ".join(f"word{i * k % 997}" for i in range(500)) for k in range(1000)])
    for w in kernel.words(column):  # tables of powers stay, so they do not count
        w.hashes()
    tracemalloc.start()
    for w in kernel.words(column):
        at, inverse = kernel.distinct(values := w.hashes())
        assert np.array_equal(values[at], np.unique(values)) and np.array_equal(values[at][inverse], values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
