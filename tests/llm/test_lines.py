import random

from quillspan.llm import lines


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance():
    rng = random.Random(1)
    text = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
    for _ in range(5000):
        a, b = text(), text()
        for most in (1, 2, 3):
            assert lines.distance_within(a, b, most) == (lev(a, b) <= most), (a, b, most)


def brute(docs, most=2, per=8):
    occ = [(i, n, x.encode()) for i, t in docs if t is not None and i is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    first = {}
    for i, n, x in occ:
        first.setdefault(x, (i, n))
        first[x] = min(first[x], (i, n))
    kinds, up = list(first), {x: x for x in first}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, x in enumerate(kinds):
        for y in kinds[:k]:
            bound = min(most, min(len(x), len(y)) // per)
            if abs(len(x) - len(y)) <= bound and lev(x, y) <= bound:
                up[root(x)] = root(y)
    lead = {}
    for x in kinds:
        lead[root(x)] = min(lead.get(root(x), (9e9, 0)), first[x])
    out = {i: (0 if t is None else len(t.split("\n")), []) for i, t in docs}
    for i, n, x in occ:
        if (i, n) != lead[root(x)]:
            out[i][1].append(n)
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(22, 60))) for _ in range(25)]
    docs = []
    for i in range(90):
        own = []
        for _ in range(rng.randint(0, 4)):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.insert(k, rng.choice("xyzé")), lambda: x.pop(k), lambda: x.__setitem__(k, "z")])()
            own.append("".join(x))
        docs.append((i, "\n".join(["  "] * (rng.random() < 0.3) + own + ["short"] * (rng.random() < 0.3))))
    docs += [(None, base[0]), (1000, None), (1001, ""), (1002, "\n".join([base[1]] * 40)), (1003, "q" * 700), (1004, "q" * 699 + "x")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, removed string")
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in lines.dedup_lines(df).collect()}
    assert got == brute(docs)
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_short_lines(spark):
    """Lines of every length from 1 to 40 bytes, zero to three edits apart."""
    rng = random.Random(11)
    docs = []
    for i in range(160):
        x = "".join(rng.choice("abcd") for _ in range(1 + i % 40))
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(y)) if y else 0
            rng.choice([lambda: y.insert(k, "z"), lambda: y and y.pop(k), lambda: y and y.__setitem__(k, "y")])()
        docs += [(2 * i, x), (2 * i + 1, "".join(y) + "\n" + x[:3])]
    docs += [(900, docs[80][1]), (900, docs[81][1])]  # one key, two rows
    got = lines.dedup_lines(spark.createDataFrame(docs[:-2], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in got} == brute(docs[:-2])
    assert len(lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 900").collect()) == 2


def test_large_cluster(monkeypatch):
    """Many versions of one line share segments; few pairs of them are worth a distance, and no link is lost."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aehinorst") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w).encode())
    texts += [x[:-2] + b"z" + x[-1:] for x in texts[:40]]
    held = list(enumerate(dict.fromkeys(texts)))
    linked = lambda x, y: abs(len(x) - len(y)) <= 2 and lev(x, y) <= 2
    calls, real = [], lines.distance_within
    monkeypatch.setattr(lines, "distance_within", lambda *a: calls.append(a) or real(*a))

    def groups(links):
        up = {i: i for i, _ in held}
        for a, b in links:
            x, y = sorted((up[a], up[b]))
            up = {k: x if v == y else v for k, v in up.items()}
        return up

    want = groups((i, j) for i, x in held for j, y in held[:i] if linked(x, y))
    assert len(set(want.values())) < len(held) - 30
    assert groups(lines.edit_join(2, 8)(held, [])) == want
    assert len(calls) < 2 * len(held)
    join, half = lines.edit_join(2, 8), len(held) // 2
    assert groups([*join(held[:half], []), *join(held[half:], []), *join(held[:half], held[half:])]) == want


def test_keys_share_prefix_sums(monkeypatch):
    """One pass over the bytes serves all segments and offsets."""
    calls, real = [], lines.kernel.prefix_sums
    monkeypatch.setattr(lines.kernel, "prefix_sums", lambda *a: calls.append(a) or real(*a))
    (w,) = lines.kernel.words(lines.pa.array(["a line of some length\nand another one"]), space=lines.NEWLINE)
    assert sum(len(k) for k, _ in lines.line_keys(w, lines.np.arange(2), 2, 8)) == 16
    assert len(calls) == 1


def test_large_clusters_are_taken_apart_by_keys(spark, monkeypatch):
    rng = random.Random(11)
    short = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 19))) for _ in range(260)]
    docs = [(i, "\n".join(rng.choice(short) + rng.choice(["", "", "x", "é"]) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {k: v for k, v in brute(docs).items()}
    met = []
    for large, hot, many, pairs in ((0, 10**6, 48, 10**6), (0, 10**6, 2, 10), (5, 4, 4, 10)):
        for name, value in (("LARGE", large), ("HOT", hot), ("MANY", many), ("PAIRS", pairs)):
            monkeypatch.setattr(lines, name, value)
        got = {r.doc_id: (r.n_lines, list(r.removed)) for r in lines.dedup_lines(df).collect()}
        assert got == {k: (n, sorted(gone)) for k, (n, gone) in want.items()}
    # Lines of a chain of segments meet no line that they share no segment with.
    rows = [(k, i, b"%08d%08d" % (k, k + d)) for k in range(300) for i, d in ((k, 0), (k + 1, 7))]
    monkeypatch.setattr(lines, "MANY", 48)
    monkeypatch.setattr(lines, "distance_within", lambda a, b, most: met.append(1))
    import numpy as np

    assert list(lines.key_join(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], 2, 8)) == [] and len(met) <= 300
