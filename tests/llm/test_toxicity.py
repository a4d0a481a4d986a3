import random

import pyarrow as pa

from quillspan.llm import toxicity


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioutnshr") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblefy", "zoggish", "blatherskite"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_unseen_misspellings_share_pieces(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.3) for i, t, _ in rows] + [(900, None, 0.3), (901, "", 0.3), (902, "!?", 0.3), (None, rows[0][1], 0.3)], "doc_id long, text string, toxic_score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None), (901, 0), (901, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.Settings(buckets=1 << 14, steps=200))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert sum(got[i].is_toxic == bool(y) for i, _, y in rows) > 0.97 * len(rows)
    assert got[900].toxic_score == got[901].toxic_score == got[902].toxic_score and 0 < got[900].toxic_score < 0.5
    plain = " ".join(rows[1][1].split()[:15])
    odd = toxicity.score(pa.array([plain + " grumblefyy grumbelfy zoggishh zogggish", plain]), model)
    assert odd[0] > odd[1] and odd[0] > 0.5


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert all(not r.is_toxic for r in toxicity.toxicity(docs, model).collect())
    assert toxicity.toxicity(docs.where("false"), model).count() == 0


def test_bounds_hold(spark):
    """Repeated keys, many texts of one key, and long texts: never more rows or bytes than the settings say."""
    rows = [(1, f"text number {i} " + "word " * 50) for i in range(40)] + [(2, "same")] * 30 + [(3, "other " * 3000), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    seen = []

    def fit(texts, toxic, settings):
        seen.append(texts.to_pylist())
        return {"weight": None, "bias": 0.0, "buckets": 1}

    whole, toxicity.fit = toxicity.fit, fit
    try:
        for most, size in ((2, 1 << 20), (1000, 1 << 20), (1000, 400)):
            toxicity.train(docs, labels, toxicity.Settings(max_train=most, max_bytes=size))
    finally:
        toxicity.fit = whole
    assert len(seen[0]) <= 2 and len(seen[1]) == 80 + 1 + 1 + 1 and sum(map(len, seen[2])) <= 400


def test_scores_by_brute_force():
    """The score is the logistic of the mean over words of the mean weight of their pieces."""
    import numpy as np

    rng = np.random.default_rng(5)
    model = {"weight": rng.normal(0, 3, 64).astype(np.float32), "bias": -0.4, "buckets": 64}
    texts = ["Bad bad word", "", None, "ünï word" * 300, "a", "tie tie TIE"]
    got = toxicity.score(pa.array(texts), model)
    for text, s in zip(texts, got, strict=True):
        mean, n = 0.0, 0
        for _, _, ids, of, token, _ in toxicity.bags(pa.array([text], pa.string()), 64):
            for t in token:
                own = ids[of == t]
                mean, n = mean + float(np.mean(model["weight"][own])), n + 1
        want = 1 / (1 + np.exp(-(mean / max(1, n) + model["bias"])))
        assert abs(s - want) < 1e-4


def test_memory_of_fitting_is_given_back(spark, monkeypatch):
    """The driver keeps the model only: what fitting took is freed, then released, before ``train`` returns."""
    docs = spark.createDataFrame([(i, f"good text {i}" if i % 2 else f"vile text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, toxic int")
    steps, fit, release = [], toxicity.fit, toxicity.kernel.release
    monkeypatch.setattr(toxicity, "fit", lambda *a: (fit(*a), steps.append("fitted"))[0])
    monkeypatch.setattr(toxicity.kernel, "release", lambda: (release(), steps.append("released"))[0])
    toxicity.train(docs, labels)
    assert steps[-2:] == ["fitted", "released"]
