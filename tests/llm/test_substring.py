import random
import re

import numpy as np
import pytest

from quillspan.llm import substring


def brute(rows, length):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - length + 1):
            first.setdefault(tuple(words[k][i : i + length]), k)
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < k for j in range(i, i + length)}
        out[k] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("length, piece, seed", [(50, 16, 1), (8, 3, 2), (12, 12, 3)])
def test_against_brute_force(spark, length, piece, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh")
    shared = [[word() for _ in range(rng.randint(length - 2, 3 * length))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(shared) if rng.random() < 0.6 else [word() + word() for _ in range(rng.randint(0, length))]
        if rng.random() < 0.3 and w:
            w[rng.randrange(len(w))] = "EDIT"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, "a " * (3 * length)), (104, "a " * (2 * length))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(df, length=length, piece=piece).collect()}
    assert got == brute(rows, length)


def test_null_keys_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(df).collect()} == {None: 0, 1: 0, 2: 60}
    assert substring.dedup_substrings(df.where("false")).count() == 0


def test_sliding_min():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 9, 60).astype(np.uint64)
    for width in (1, 2, 5, 31):
        got = substring.sliding_min(v, width)
        assert got.tolist() == [max(range(i, i + width), key=lambda j: (-int(v[j]), j)) for i in range(len(v) - width + 1)]
