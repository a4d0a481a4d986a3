import re

from quillspan.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=8):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                ids = wins.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((key, len(w), len(hit), len(found), sorted(found), len(found) >= 2))
    return out


def results(df):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in df.collect()]


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


PASSAGE = "the quick brown fox jumps over the lazy dog and runs away"
ITEMS = [(1, PASSAGE), (2, "Over the lazy dog and runs away home again today"), (10, "Été zzz"), (11, "solo"), (12, None), (13, "  ..."), (14, "solo"), (None, "null item words")]


def test_against_brute_force(spark):
    docs = [
        (0, f"x {PASSAGE.upper()}! y"), (1, "over, the; lazy dog and runs away home"), (2, "été zzz"), (3, "Été ZZZ solo"), (4, None), (5, ""), (6, PASSAGE + " " + PASSAGE),
        (7, " ".join(["the quick brown fox"] * 50)), (8, "a " * 5000 + PASSAGE), (9, "solo"), (9, "solo"), (None, PASSAGE), (11, "-solo-\n"), (12, "quick brown fox jumps over the lazy"), (13, "null item words"),
    ]
    df = spark.createDataFrame([(*r, "n") for r in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    want = brute(docs, [x for x in ITEMS if x[0] is not None])
    got = results(d.decontaminate(df, bench))
    assert same([g for g in got if g[0] != 13], [w for w in want if w[0] != 13])
    assert next(g for g in got if g[0] == 13)[2:4] == (3, 0)  # an item without an id is hit but not counted


def test_shuffled_join_agrees(spark, monkeypatch):
    docs = [(i, f"w{i} {PASSAGE if i % 3 else 'none'} tail") for i in range(30)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    monkeypatch.setattr(d, "MAX_BROADCAST", 0)
    assert same(results(d.decontaminate(df, bench)), brute(docs, ITEMS[:2]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert results(d.decontaminate(docs, none)) == [(1, 2, 0, 0, [], False)]
    assert d.decontaminate(docs.where("false"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
