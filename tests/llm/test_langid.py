import pyarrow as pa

from quillspan.llm import langid

EN = ["the cat sat on the mat and the dog ran", "this is the house that we built with the men", "they were reading the paper in the morning"] * 4
DE = ["der hund und die katze sind in dem haus", "das ist nicht richtig und wir gehen nach hause", "ich habe keine zeit für schöne bücher"] * 4


def model():
    return langid.fit(pa.array(EN + DE), ["en"] * len(EN) + ["de"] * len(DE))


def test_words_then_pieces():
    texts = ["the dog and the cat", "und die bücher", "reader houses", "hunden gehend", None, "", "12 34 --", "Ω", "THE DOG", "für " * 3000]
    langs, shares = langid.score(pa.array(texts), model())
    assert langs[:4] == ["en", "de", "en", "de"] and langs[4:7] == ["und"] * 3 and langs[7] in ("en", "de") and langs[8:] == ["en", "de"]
    assert all(0 <= s <= 1 for s in shares) and list(shares[4:7]) == [0, 0, 0]


def test_frame_and_empty_training(spark):
    rows = [(i, t, "en" if t in EN else "de") for i, t in enumerate(EN + DE)] + [(99, None, "en"), (100, "no label", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, lang_score double")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}
    assert all(got[r[0]] == r[2] for r in rows[:-2]) and got[99] == "und"
    nothing = langid.train(df.where("false"))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.where("false"), nothing).count() == 0


def test_bound_on_known_words():
    small = langid.fit(pa.array(EN + DE), ["en"] * len(EN) + ["de"] * len(DE), langid.Settings(max_known=5))
    assert all(len(t[0]) <= 5 for t in small["tables"].values())


def test_bounds_hold(spark):
    """A language with most rows gives no more than its share; repeated keys and long texts stay within the bounds."""
    rows = [(i, f"w{i} " * (i % 7), "big") for i in range(3000)] + [(5000 + i, "x", "small") for i in range(3)] + [(1, f"again {i}", "big") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, whole = [], langid.fit
    langid.fit = lambda texts, langs, s: seen.append((texts.to_pylist(), langs)) or {"langs": [], "tables": {}}
    try:
        for s in (langid.Settings(max_train=40), langid.Settings(max_train=1), langid.Settings(max_train=40, max_bytes=50)):
            langid.train(df, s)
    finally:
        langid.fit = whole
    assert len(seen[0][0]) <= 40 and seen[0][1].count("small") == 3 and seen[0][1].count("big") >= 20
    assert len(seen[1][0]) <= 1 and sum(map(len, seen[2][0])) <= 50


def test_scores_by_brute_force():
    """A text's scores are sums over its words: their log rates, or the mean of the longest pieces with any known."""
    import re

    import numpy as np

    from quillspan.llm import kernel

    m = model()
    one = lambda text: next(kernel.words(pa.array([text]), lower=True, space=kernel.PUNCT))
    rate = lambda n, h: next((m["tables"][n][1][i] for i in np.flatnonzero(m["tables"][n][0] == h)), None)
    texts = ["the dog und katze", "reader houses zz", "qqq ΩΩ the", "tie", "für " * 40]
    langs, shares = langid.score(pa.array(texts), m)
    for text, lang, share in zip(texts, langs, shares, strict=True):
        total = np.zeros(2)
        for word in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
            w = one(word)
            known = rate(0, w.hashes()[0])
            for n in langid.SIZES if known is None else ():
                pieces = [rate(n, h) for _, grams, _ in kernel.char_grams(w, np.array([0]), (n,)) for h in grams]
                pieces = [x for x in pieces if x is not None]
                if pieces:
                    known = np.mean(pieces, axis=0)
                    break
            total += 0 if known is None else known
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert lang == m["langs"][int(total.argmax())] and abs(share - p.max()) < 1e-3
