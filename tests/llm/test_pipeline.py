"""The corpus stages on a small corpus in which every stage has its case."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioutnshrlm") for _ in range(rng.randint(3, 8)))
    text = lambda n=60: [word() for _ in range(n)]
    passage = text(20)
    rows, toxic = [], set()
    for i in range(200):
        w = text()
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["zoggish", "blatherskite"]))
        rows.append((i, " ".join(w)))
    copied = rows[1][1].split()
    rows += [(300, rows[1][1]), (301, " ".join([*copied[:-1], "other"])), (302, " ".join([*text(10), *passage, *text(10)])), (303, None), (304, "")]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in p.STAGES:
        frame = p.store.staged(stage(spark, frame, str(tmp_path)), name)
        kept.append(frame.collect())
    ids = [{r.doc_id for r in x} for x in kept]
    everyone = {i for i, _ in rows}
    assert len(toxic - ids[0]) >= 0.7 * len(toxic) and len((everyone - toxic) - ids[0]) <= 3
    assert ids[0] - ids[1] == {300, 301} & ids[0] and ids[1] - ids[2] == {302} & ids[1]
    assert kept[2][0].asDict().keys() == kept[3][0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    size = lambda x: sum(len((r.text or "").split()) for r in x)
    assert abs(size(kept[3]) - size(kept[2])) < 300
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in kept[3])
    assert sorted((r.doc_id, r.ids_crc32) for r in kept[4]) == want
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_edge_cases(spark, tmp_path):
    """Clashing names, null keys, repeated rows, very long and empty texts, ties, a null source."""
    rng = random.Random(5)
    text = lambda n=40: " ".join("".join(rng.choice("aeioutnshr") for _ in range(5)) for _ in range(n))
    x, long_, short = text(), text(30_000), "tiny item"
    rows = [
        (1, x, "a"), (1, x, "a"), (2, x, "a"), (3, text(), None), (3, text(), "b"), (None, text(), "b"), (None, None, "b"), (4, None, "b"), (5, "", "b"),
        (6, long_, "c"), (7, long_, "c"), (8, f"{text()} {short} {text()}", "c"),
    ]
    names = "_piece long, _maybe string, _at long, _bits string, _turn int, _times int, _key string, _hash long, is_toxic string, toxic_score string, _row int, _again int"
    extra = (1, "m", 2, "b", 3, 4, "k", 5, "kept", "too", 6, 7)
    spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, {names}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, short), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in p.STAGES:
        docs = p.store.staged(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs.collect())
    assert len(kept[0]) == len(rows) and {r.is_toxic for r in kept[0]} == {"kept"}
    ids = lambda rows: sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    left = ids([type("R", (), {"doc_id": i}) for i in (None, None, 1, 3, 4, 5, 6, 8)])
    assert ids(kept[1]) == left and ids(kept[2]) == left  # one short item leaves document 8 alone
    assert all(r._turn == 3 and r._maybe == "m" for r in kept[3])
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
