import random
import re
from collections import Counter

from quillspan.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def corpus():
    rng = random.Random(2)
    word = lambda n=60: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) if n > 9 else f"w{rng.randrange(n)}"
    good = [" ".join(word() for _ in range(120)) for _ in range(60)]
    junk = [" ".join(word() + "###" for _ in range(100)) for _ in range(4)] + ["same old line\n" * 30, "a b c d " * 40]
    odd = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "é " * 9 + "\n\x0b", "x\ny\nx\n y\n", " ".join(word(5) for _ in range(400)), " ".join(word() for _ in range(30_000))]
    return good, junk, odd


def test_measures_and_verdicts(spark):
    good, junk, odd = corpus()
    rows = [*good, *junk, *odd]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)] + [(None, good[0], 1)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got.pop(None).good
    for i, t in enumerate(rows):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == brute(t), (i, t)
    assert all(got[i].good for i in range(60))
    assert not any(got[i].good for i in range(60, 66))


def test_no_rows(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_noisy_rule_is_outvoted(spark):
    """Many documents in capitals, else plain: their peers overrule the vote on capitals, but not on junk with it."""
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    plain = [" ".join(words(120)) for _ in range(300)]
    capitals = [" ".join(words(120)).upper() for _ in range(120)]
    junk = [" ".join(w + "###" for w in words(100)) for _ in range(40)]
    loud = [" ".join(w.upper() + "###" for w in words(100)) for _ in range(10)]
    rows = [*plain, *capitals, *junk, *loud]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i].upper == 0 for i in range(300, 420))
    assert all(got[i].good for i in range(420))
    assert not any(got[i].good for i in range(420, 470))
