"""Parsing, chunks, lists, fusion and metrics on hand-made rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.functions import parsing, similarity
from quillspan.operators import chunking, dense, evalset, fusion, metrics, models, ocr, scoring, sparse
from quillspan.plans import retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("response, loose, strict", [
    ("[3, 0, 2]", [3, 0, 2], [3, 0, 2]), ("x [1] then [\"2\", '1', 9]", [2, 1], [1, 2]), ("none", [0, 1, 2], [0, 1, 2]), ("[01, 2]", [0, 1, 2], [1, 2]),
    ("[8, 9]", [], [0, 1, 2]), ("[4,4,4,4]", [4, 4, 4], [4]), ('{"ids": [1, 1]}', [1, 1], [1]), (None, [0, 1, 2], [0, 1, 2]), ("99999999999", [0, 1, 2], [0, 1, 2]),
])
def test_critiques(spark, response, loose, strict):
    r = F.lit(response).cast("string")
    assert one(spark, parsing.critique_ids(r, F.lit(5), 3)) == loose
    assert one(spark, parsing.critique_ids_strict(r, F.lit(5), 3)) == strict
    assert one(spark, parsing.critique_ids(F.lit("none"), F.lit(0), 3)) == []


def test_json(spark):
    assert one(spark, parsing.json_object(F.lit("a ```JSON {\"x\": {\"y\": 1}} ``` b"))) == '{"x": {"y": 1}}'
    assert one(spark, parsing.json_object(F.lit("none"))) is None
    assert len(one(spark, parsing.json_array(F.lit("```json\n[{\"q\": \"a\"}, {\"q\": \"b\"}]\n```"), "array<struct<q:string>>"))) == 2
    assert one(spark, parsing.json_array(F.lit("{}"), "array<struct<q:string>>")) == []


def test_packing_loses_no_paragraph(spark):
    rng = random.Random(5)
    for _ in range(6):
        parts = ["x" * rng.randint(0, 30) for _ in range(rng.randint(0, 12))]
        got = one(spark, chunking.pack_paragraphs(F.lit("\n\n".join(parts)), 40))
        assert "\n\n".join(got) == "\n\n".join(p for p in parts if p)
        assert all(len(c) <= 40 or "\n\n" not in c for c in got)
    packed = F.array(F.lit("abcdef"), F.lit("gh"), F.lit("ij"))
    assert one(spark, chunking.with_overlap(packed, 3)) == ["abcdef", "def\n\ngh", "gh\n\nij"]


def test_recursive_split():
    text = "para one is here.\n\npara two, much longer than the first one, goes on.\nline\n\n" + "y" * 70
    for size, overlap in ((20, 5), (40, 0), (64, 30)):
        got = chunking.split_recursive(text, size, overlap)
        assert all(len(c) <= size for c in got)
        words = [w for w in text.split() if len(w) <= size]
        assert all(any(w in c for c in got) for w in words)
    assert chunking.split_recursive(None, 10, 2) == []


def okapi(docs, query):
    toks = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    return {k: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if w in t) for k, t in toks.items()}


def test_bm25_and_scan(spark):
    docs = {0: "a b c", 1: "a a d", 2: "a e", 3: "f", 4: "g g g g"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame([(0, "a d d z"), (1, "nothing")], "query_id long, query string")
    scores = sparse.sparse_scores(sparse.query_terms(q, "query_id", "query"), sparse.bm25_index(df, "doc_id", "text"))
    want = okapi(docs, "a d d z")
    got = {r.chunk_id: r.score for r in scores.collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items() if "a" in docs[k] or "d" in docs[k]}
    top = sparse.scan_top_k(scores, q, df.select(F.col("doc_id").alias("chunk_id")), 4).collect()
    assert Counter(r.query_id for r in top) == {0: 4, 1: 4}
    assert [r.chunk_id for r in sorted(top, key=lambda r: r.rank) if r.query_id == 1] == [0, 1, 2, 3]


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i), 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0])], "chunk_id long, vector array<float>")
    got = dense.dense_top_k(v.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id"), v, 5).collect()
    pairs = v.alias("a").join(v.alias("b"), F.col("a.chunk_id") < 3).select(F.col("a.chunk_id").alias("query_id"), F.col("b.chunk_id").alias("chunk_id"), F.round(similarity.cosine(F.col("a.vector"), F.col("b.vector")), 6).alias("score"))
    assert sorted(map(tuple, got)) == sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in sparse.top_k(pairs, 5).collect())
    assert dense.dense_top_k(v.where("false").withColumnRenamed("chunk_id", "query_id"), v, 5).count() == 0


LISTS = [
    (1, "dense", 0, 10, "alpha beta gamma"), (1, "dense", 1, 11, "one two three four"), (1, "dense", 2, 12, "!!!"),
    (1, "sparse", 0, 20, "alpha beta gamma"), (1, "sparse", 1, 21, "five six"), (1, "sparse", 2, 22, "one two nine ten"), (1, "sparse", 3, 23, "!!!"),
]


def lists(spark):
    return spark.createDataFrame(LISTS, "query_id long, source string, rank int, chunk_id long, text string")


def test_dedup(spark):
    once = fusion.dedup_ranked(lists(spark))
    kept = sorted((r.source, r.rank, r.chunk_id) for r in once.collect())
    assert kept == [("dense", 0, 10), ("dense", 1, 11), ("dense", 2, 12), ("sparse", 0, 21), ("sparse", 1, 23)]
    assert sorted((r.source, r.rank, r.chunk_id) for r in fusion.dedup_ranked(once).collect()) == kept


def test_fusion(spark):
    got = [(r.chunk_id, round(r.score, 6)) for r in fusion.fuse(lists(spark)).orderBy("rank").collect()]
    assert got[:2] == [(10, round(2 / 61, 6)), (12, round(1 / 63 + 1 / 64, 6))]
    heavy = [r.chunk_id for r in fusion.fuse(lists(spark), {"dense": 0.7, "sparse": 0.3}).orderBy("rank").collect()]
    assert heavy == [10, 12, 11, 21, 22]
    with pytest.raises(ValueError):
        fusion.fuse(lists(spark), {"dense": 1.0})


def test_relevance(spark):
    df = lists(spark).withColumn("score", F.when(F.col("source") == "dense", 0.1).otherwise(F.col("rank") * 0.2))
    got = sorted((r.source, r.rank, r.chunk_id) for r in fusion.filter_relevant(df, 0.3).collect())
    assert got == [("dense", 0, 10), ("sparse", 0, 22), ("sparse", 1, 23)]


def test_hits(spark):
    def h(gold, chunk, **kw):
        return one(spark, metrics.hit(F.lit(gold).cast("string"), F.lit(chunk), **kw))

    assert h("", "anything") and not h("", "anything", symmetric=True)
    assert h("A b.", "x a B y") and not h("a b c d e", "a b") and h("a b c d e", "a b", symmetric=True)
    assert not h("a b", "", symmetric=True) and not h("a b", "c d")


def test_rates_and_ranks(spark):
    gold = spark.createDataFrame([(1, "alpha beta"), (2, "zzz"), (3, "alpha")], "query_id long, gold string")
    ranked = spark.createDataFrame([(1, "dense", "alpha beta x"), (1, "hybrid", "alpha beta"), (1, "final", "q"), (2, "dense", "q")], "query_id long, stage string, text string")
    hits = metrics.stage_hits(gold, ranked)
    row = metrics.hit_rates(hits).first()
    assert (row.questions, row.dense_hits, row.hybrid_hits, row.final_hits, row.dense_rate) == (3, 1, 1, 0, 0.333333)
    assert [r.dropped_by_critique for r in hits.orderBy("query_id").collect()] == [True, False, False]
    assert metrics.hit_rates(hits.where("false")).first().final_rate == 0.0
    assert "Questions: 3" in metrics.console_summary(metrics.hit_rates(hits)).first().summary
    expected = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "query_id long, chunk_id long")
    found = spark.createDataFrame([(1, 5, 1), (2, 6, 30), (3, 7, 12)], "query_id long, chunk_id long, rank int")
    got = metrics.reciprocal_ranks(expected, found).first()
    assert (got.questions, got.mrr, got.recall) == (3, round((1 / 2 + 1 / 13) / 3, 6), round(1 / 3, 6))


def test_token_f1_is_symmetric(spark):
    df = spark.createDataFrame([(1, "a a b", "a b b c"), (2, "", "x"), (3, "q", "r")], "k long, x string, y string")
    ab = {r.k: r.f1 for r in metrics.token_f1(df, "k", "x", "y").collect()}
    assert ab == {r.k: r.f1 for r in metrics.token_f1(df, "k", "y", "x").collect()} == {1: round(4 / 7, 6), 2: 0.0, 3: 0.0}


def test_ocr_review(spark):
    docs = spark.createDataFrame([(1, "Teh cat met Porbandar. Teh dog, teh end. xqz"), (2, None)], "k long, t string")
    words = spark.createDataFrame([("the", 9), ("ten", 3), ("cat", 2), ("met", 2), ("dog", 2), ("end", 2)], "term string, frequency int")
    unknown = ocr.unknown_words(ocr.review_tokens(docs, "k", "t"), words)
    assert {r.word: r.n for r in unknown.collect()} == {"Teh": 2, "teh": 1, "xqz": 1}
    fixes = ocr.corrections(unknown, words)
    assert [(r.word, r.correction) for r in fixes.collect()] == [("Teh", "ten")]
    assert ocr.auto_correct(docs, fixes, "k", "t").orderBy("k").first().t.startswith("ten cat met Porbandar. ten dog, teh")
    assert ocr.review_report(unknown).first().line.startswith("[  2x] 'Teh'")


def test_evaluation_sets(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in evalset.sample_rows(df, 5, "k", 3).collect()) for _ in range(2))
    assert a == b and len(a) == 5 and evalset.sample_rows(df, 99, "k").count() == 30
    assert evalset.remaining(df, df.where("k < 28"), "k").count() == 2
    assert [r.id for r in evalset.numbered(df.where("k > 27"), "k").collect()] == ["q0001", "q0002"]


def test_models(spark):
    class Broken:
        def complete(self, prompts):
            raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "b a"), (2, "")], "k long, t string")
    same = models.HashEmbedder().embed(["b a", ""])
    assert [list(map(lambda x: round(x, 5), r.e)) for r in df.select("k", models.embedding()("t").alias("e")).orderBy("k").collect()] == [[round(x, 5) for x in v] for v in same]
    assert {(r.term, r.weight) for r in models.sparse_vectors(df, "k", "t").collect()} == {("a", 1.0), ("b", 1.0)}
    failing = models.completion(Broken, tries=1)
    assert {r.x for r in df.select(failing(F.col("t")).alias("x")).collect()} == {"ERROR: no model"}
    assert [r.x for r in df.select("k", models.expanded(F.col("t"), failing).alias("x")).orderBy("k").collect()] == ["b a", ""]


def test_response_end_to_end(spark):
    chunks = spark.createDataFrame([(i, f"word{i} common text") for i in range(8)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "word3 common")], "query_id long, query string")
    embed = models.embedding()
    vectors = chunks.select("chunk_id", embed("text").alias("vector"))
    asked = q.select("query_id", embed("query").alias("vector"))
    index = sparse.bm25_index(chunks, "chunk_id", "text")
    got = retrieval.respond(q, chunks, index, vectors, asked, models.completion(), final_k=2).first()
    assert "word3 common text" in got.context and got.answer == "Question: word3 common"


def test_short_lists_do_not_meet_the_critic(spark):
    from pyspark.sql import functions as F

    from quillspan.plans.retrieval import criticised

    fused = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "b", 11)], "query_id long, rank int, text string, chunk_id long")
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    got = criticised(fused, queries, lambda prompt: F.raise_error("asked").cast("string"), k=6).collect()
    assert sorted((r["rank"], r.chunk_id) for r in got) == [(0, 10), (1, 11)]


def test_keyword_top_k_makes_no_row_for_a_pair(spark):
    rng = random.Random(3)
    words = [*"abcdefgh", "été", "ß", "日本", "naïve_1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))).replace(" ", rng.choice([" ", "—", "\n"]))) for i in range(120)] + [(120, None), (121, "A Éte a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = df.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    for method, index in (("bm25", sparse.bm25_index), ("tfidf", sparse.tfidf_index)):
        scores = sparse.sparse_scores(sparse.query_terms(q, "query_id", "query"), index(df, "doc_id", "text"), 6)
        want = sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in sparse.top_k(scores, 7).collect())
        top = scoring.keyword_top_k(q, df, 7, method=method, digits=6)
        assert sorted(map(tuple, top.collect())) == want
        plan = top._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
    terms = sparse.term_counts(df, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)), F.sum("tf"))
    assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, scoring.term_statistics(df, "doc_id", "text").collect()))
    assert scoring.keyword_top_k(q.where("false"), df, 3).count() == 0


def test_keyword_scores_of_zero_and_below_and_repeated_rows(spark):
    rows = [(0, "a b"), (1, "a b"), (2, "a c"), (3, "b c"), (3, "b c"), (3, "b"), (None, "a"), (5, "")]
    for n in (4, len(rows)):  # with two of four texts an idf is 0, so pairs that share a term score 0
        df = spark.createDataFrame(rows[:n], "doc_id long, text string")
        q = spark.createDataFrame([(0, "a"), (1, "b c c"), (2, "z")], "query_id long, query string")
        tf = df.groupBy("doc_id", "text").count().select("doc_id", F.explode(F.split("text", " ")).alias("term"), F.size(F.split("text", " ")).alias("dl"), "text", "count")
        tf = tf.where("term <> ''").groupBy("doc_id", "text", "dl", "term").agg((F.count(F.lit(1)) * F.first("count")).alias("tf")).collect()
        seen = Counter(r.term for r in tf)
        idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in seen.items()}
        mean, avg = sum(idf.values()) / len(idf), sum(len(t.split()) for _, t in rows[:n]) / n
        idf = {t: x if x >= 0 else 0.25 * mean for t, x in idf.items()}
        want = Counter()
        for i, query in ((0, "a"), (1, "b c c")):
            for r in tf:
                if r.term in query.split():
                    want[i, r.doc_id] += query.split().count(r.term) * idf[r.term] * r.tf * 2.5 / (r.tf + 1.5 * (0.25 + 0.75 * r.dl / avg))
        got = {(r.query_id, r.chunk_id): r.score for r in scoring.keyword_top_k(q, df, 9).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_dense_holds_few_scores(spark, monkeypatch):
    shapes = []
    add = scoring.Best.add
    monkeypatch.setattr(scoring.Best, "add", lambda self, lo, scores, *rest: (shapes.append(scores.shape), add(self, lo, scores, *rest))[1])
    best = scoring.Best(2, 3)
    for lo in range(0, 40, 8):
        best.add(0, scoring.np.array([[x % 7.0 for x in range(lo, lo + 8)], [-1.0] * 8]), scoring.np.arange(lo, lo + 8), True, 6)
    assert list(zip(best.query.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 6.0, 6), (0, 6.0, 13), (0, 6.0, 20), (1, -1.0, 0), (1, -1.0, 1), (1, -1.0, 2)]
    v = spark.createDataFrame([(i, [float(i % 13), float(i % 7) + 1]) for i in range(3000)], "chunk_id long, vector array<float>").repartition(2)
    top = dense.dense_top_k(v.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id"), v, 5)
    assert "mapinarrow" in top._jdf.queryExecution().optimizedPlan().toString().lower() and top.count() == 15
    from quillspan.plans import catalog

    plan = catalog.mrr_recall(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # relevant pairs are not listed


def test_reciprocal_rank_of_rank_below_zero(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = spark.createDataFrame([(1, -1), (2, 1)], "query_id long, rank int")
    assert tuple(metrics.first_ranks(asked, found).first())[:2] == (2, math.inf)


def test_unknown_words_are_counted_in_the_task(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["cat", "Dog.", "it's", "xq", "Abc", "ab\nc", "zzz"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i if i % 20 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, None)], "k long, t string").repartition(3)
    known = spark.createDataFrame([("cat",)], "term string")
    want = sorted(map(repr, ocr.unknown_words(ocr.review_tokens(docs, "k", "t"), known).collect()))
    monkeypatch.setattr(ocr, "HELD", 2)
    assert sorted(map(repr, ocr.unknown_in(docs, known, "k", "t").collect())) == want
    monkeypatch.setattr(ocr, "ROWS", 3)
    assert sorted(map(repr, ocr.unknown_words(ocr.review_tokens(docs, "k", "t"), known).collect())) == want
    from quillspan.plans import catalog

    plan = catalog.unknown_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate [word")  # words are counted before the join
