import math
from hashlib import md5

from quillspan.llm import mixing


def water(sizes, weights):
    """Targets by repeated resharing."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {k: w for k, w in weights.items() if k not in capped}
        left = total - sum(capped.values())
        share = {k: left * w / sum(rest.values()) for k, w in rest.items()}
        over = {k: 3.0 * sizes[k] for k in rest if share[k] > 3 * sizes[k]}
        if not over:
            return capped | share
        capped |= over


def brute(rows):
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    words = lambda t: len((t or "").split())
    sizes = {s: sum(words(r[1]) for r in rows if r[2] == s) for s in names}
    goal = water(sizes, {s: float(i % 3 + 1) for i, s in enumerate(names)})
    out = {}
    for s in names:
        key = lambda r: -math.log((int(md5(f"{'null' if r[0] is None else r[0]}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, before = goal[s] - epochs * sizes[s], 0
        for r in sorted((r for r in rows if r[2] == s), key=key):
            n = words(r[1])
            out[r[0]] = (n, sizes[s], round(goal[s], 6), (epochs + (n > 0 and before + n / 2 <= rest)) * n)
            before += n
    return out


def test_mix_against_brute_force(spark):
    sources = ["a"] * 60 + ["b"] * 5 + ["c"] * 3 + ["d"] * 2 + [None] * 4 + ["é"] * 6
    rows = [(i, "w " * (i * 7 % 40), s, "x") for i, s in enumerate(sources)] + [(900, None, "a", "x"), (None, "one two", "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()}
    assert got == brute(rows)
    taken = sum(v[3] for v in got.values())
    assert abs(taken - sum(v[0] for v in got.values())) < 40 * len(set(sources))
    assert all(v[3] <= 3 * v[0] for v in got.values())
    copies = mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies if got[r.doc_id][0]} == {k: v[3] // v[0] for k, v in got.items() if v[3]}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
