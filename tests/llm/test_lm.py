import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import gru, lm_score


def start():
    return gru.start(np.array([40.0, 30, 20, 10, 6, 5, 4, 3, 2, 1, 1]), hidden=4, classes=4)


def one_by_one(m, words, end):
    """Log10 probability of one document, step by step."""
    hidden, h, prev, total = len(m["U"]), np.zeros(len(m["U"])), end, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    for w in words:
        a, u = m["I"][prev] + m["b"], h @ m["U"]
        r, z = sig(a[:hidden] + u[:hidden]), sig(a[hidden : 2 * hidden] + u[hidden : 2 * hidden])
        n = np.tanh(a[2 * hidden :] + r * u[2 * hidden :])
        h = (1 - z) * n + z * h
        c = m["of"][w]
        lo, hi = m["edge"][c], m["edge"][c + 1]
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        total += math.log10(soft(h @ m["C"] + m["c"])[c] * soft(h @ m["O"][:, lo:hi] + m["o"][lo:hi])[w - lo])
        prev = w
    return total


def test_score_carries_state_through_whole_documents():
    rng, m = np.random.default_rng(0), start()
    sizes = np.array([5, 1, 70, 33, 2, 120])
    words = rng.integers(0, 11, sizes.sum()).astype(np.int32)
    m = gru.train(m, words, sizes, end=3, epochs=2)
    got, at = gru.score(m, words, sizes, end=3, width=2), 0
    for s, x in zip(sizes, got, strict=True):
        assert abs(one_by_one(m, words[at : at + s], 3) - x) < 1e-3
        at += s
    pairs = np.array([[w, 3] for w in range(11)], np.int32).ravel()
    first = [one_by_one(m, [w], 3) for w in range(11)]
    assert abs(sum(10**x for x in first) - 1) < 1e-5 and len(gru.score(m, pairs, np.full(11, 2), 3)) == 11


def test_gradient():
    """One step of training moves every parameter against its numerical gradient."""
    rng, m = np.random.default_rng(1), start()
    words, sizes = rng.integers(0, 11, 12).astype(np.int32), np.array([7, 5])
    for k in gru.TRAINED:
        m[k] = m[k].astype(np.float64)
    loss = lambda m: -gru.score(m, words, sizes, 3).sum() * math.log(10)
    moved = gru.train(m, words, sizes, 3, rate=1e-6)
    for k in gru.TRAINED:
        step = (moved[k] - m[k]).ravel()
        for i in np.argsort(-np.abs(m[k].ravel()))[:3]:
            up, down = ({**m, k: m[k].copy()} for _ in range(2))
            up[k].ravel()[i] += 1e-4
            down[k].ravel()[i] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            if abs(slope) > 1e-2:
                assert np.sign(step[i]) == -np.sign(slope), (k, i, slope)


def test_training_beats_the_unigram_start():
    words = np.tile(np.array([0, 1, 2, 3], np.int32), 400)
    sizes = np.full(100, 16)
    m = start()
    assert gru.score(gru.train(m, words, sizes, 3, epochs=4), words, sizes, 3).sum() > 0.5 * gru.score(m, words, sizes, 3).sum()


def test_frame_against_brute_force(spark):
    texts = ["The cat sat", "the dog  sat\tdown", None, "", "unseen ÄÖ words here", "the the the"] * 8 + ["rare" + str(i) for i in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the cat", "x")], "doc_id long, text string, score string")
    learn = F.coalesce(F.col("doc_id") % 5 != 4, F.lit(True))
    s = lm_score.Settings(vocabulary=4, head=6, hidden=4, classes=2)
    got = {r.doc_id: r for r in lm_score.lm_score(df, learn, s=s).collect()}
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), "</s>"]
    rows = [*enumerate(texts), (None, "the cat")]
    c = Counter(w for i, t in rows if i is None or i % 5 != 4 for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = tok(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(got[i].base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-9
        assert got[i].score < 0
    none = lm_score.lm_score(df, F.lit(False), s=s).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}
    assert lm_score.lm_score(df.where("false"), F.lit(True), s=s).count() == 0


def test_network_learns_from_every_training_document(spark, monkeypatch):
    """Documents over all rounds and shards are the training ones, null keys too, once each."""
    rows = [(None if i % 100 == 0 else i, f"a b c{i % 7} d") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, shards_, average = [], [], lm_score.average

    def spy(shards, model):
        got = {(r.shard, r.weight) for r in shards.select(F.spark_partition_id().alias("shard"), "weight").collect()}
        seen.append(sum(w for _, w in got))
        shards_.append(len(got))
        return average(shards, model)

    monkeypatch.setattr(lm_score, "average", spy)
    learn = F.coalesce(F.col("doc_id") % 5 != 4, F.lit(True))
    lm_score.lm_score(df, learn, s=lm_score.Settings(hidden=4, classes=2)).count()
    n = sum(i is None or i % 5 != 4 for i, _ in rows)
    assert sum(seen) == 5 * n and len(shards_) == 2


def test_vocabulary_grows_with_the_distinct_words(spark, monkeypatch):
    made, start = [], gru.start
    monkeypatch.setattr(gru, "start", lambda counts, *a: made.append(len(counts)) or start(counts, *a))
    for n in (100, 10_000):
        df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 100, i * 100 + 100))) for i in range(n // 100)], "doc_id long, text string")
        lm_score.lm_score(df, F.lit(True), s=lm_score.Settings(vocabulary=20, hidden=4, classes=2)).count()
    assert made == [30 + 2, 300 + 2]


def test_training_reads_the_embeddings_it_has_learned():
    """Later windows of a pass start from the inputs that earlier ones have moved."""
    words, sizes = np.tile(np.array([0, 1, 2, 3], np.int32), 60), np.array([240])
    m = start() | {"U": np.zeros((4, 12), np.float32)}
    windows = gru._steps(m, words, *gru.lanes(sizes, 1), 3)
    next(windows)
    m["I"] = m["I"] + 1
    moved = next(windows)[4][0]
    still = list(gru._steps(start() | {"U": m["U"]}, words, *gru.lanes(sizes, 1), 3))[1][4][0]
    assert not np.allclose(moved, still)
