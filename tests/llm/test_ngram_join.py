import random
import re
from collections import Counter

import pytest

from quillspan.llm import linking, ngram_join


def brute(rows, n, percent):
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
        sets[key] = grams
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed, docs=140):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz")
    line = " ".join(word() for _ in range(14))
    base = [[word() for _ in range(rng.choice([1, 2, 4, 8, 20, 60, 200]))] for _ in range(20)]
    rows = []
    for i in range(docs):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w) + rng.choice(["", "", "\n" + line, " " + " ".join(word() for _ in range(3))])))
    return [*rows, (500, None), (501, ""), (502, " \t\n"), (503, rows[0][1].upper()), (504, "É é"), (505, "é É"), (506, "xx"), (507, "XX")]


@pytest.mark.parametrize("seed, n, percent", [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_against_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], "x")], "doc_id long, text string, a string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, n=n, percent=percent).collect()}
    assert got.pop(None)[1] is None
    assert got == brute(rows, n, percent)


def test_no_rows(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_are_tied(spark, percent, monkeypatch):
    """Sets at the very threshold, of every size, in many small packs: no step loses a link."""
    monkeypatch.setattr(ngram_join, "TOGETHER", 3000)
    rng, rows = random.Random(percent), []
    for n in [*range(1, 40), 150, 400]:
        for _ in range(2):
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            b = list(a)
            while True:  # words added as long as the two still link
                b.append(f"w{rng.randrange(10**9)}")
                if 100 * n < percent * len(b):
                    break
                rows.append((len(rows), " ".join(b)))
            rows.append((len(rows), " ".join(a)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{t} {passage}" if i % 3 else t) for i, t in rows]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 1, percent)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK_BYTES", 20_000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = "z"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 2, 90)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)] + [(7, i) for i in range(400, 430)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want and not Counter(got) - Counter(want)


def test_sieve(spark):
    docs = spark.range(5000).selectExpr("if(id = 17, null, id) as k", "cast(id as string) as t")
    ids = spark.range(0, 9000, 7).withColumnRenamed("id", "k")
    passed = {r.k for r in linking.sieved(docs, "k", ids).where("_maybe").collect()}
    assert {x for x in range(0, 5000, 7)} <= passed and len(passed) < 800
    assert linking.matching(docs, "k", ids).count() == 715
    left = [r.k for r in linking.without(docs, "k", ids).collect()]
    assert len(left) == 5000 - 715 and None in left and not {x for x in left if x is not None and x % 7 == 0}
    assert linking.without(docs, "k", ids.where("false")).count() == 5000


def test_all_texts_of_a_repeated_key_link(spark):
    """Key 5 copies document 3, and another of its texts is nearly that of 7: all three are one component."""
    x, y = ([f"{p}{i}" for i in range(60)] for p in "xy")
    rows = [(3, " ".join(x)), (5, " ".join(x)), (5, " ".join(y)), (7, " ".join([*y[:-1], "other"])), (9, " ".join(f"z{i}" for i in range(60)))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 7: 3, 9: 9} and len(got) == 5
