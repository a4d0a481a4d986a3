"""Readers, writers and streamed runs."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.sources import readers, writers
from quillspan.streaming.runs import evaluate_stream


def test_records_and_blocks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"title": "A", "contents": "x {1}", "footnotes": {"1": "n"}}))
    (tmp_path / "two.json").write_text(json.dumps([{"title": "B"}, {"title": "C", "volume": "3"}]))
    got = readers.read_records(spark, str(tmp_path / "*.json")).orderBy("title").collect()
    assert [r.title for r in got] == ["A", "B", "C"] and got[0].footnotes == {"1": "n"} and got[2].volume == "3"
    body = "y" * 60
    corpus = f"{'=' * 40}\nTitle: T one\nVolume: 4 | Section: 9\n{body}\n{'=' * 40}\nshort\n{'=' * 40}\n{body}"
    (tmp_path / "corpus.txt").write_text(corpus)
    blocks = readers.corpus_blocks(readers.read_corpus(spark, str(tmp_path / "corpus.txt"))).orderBy("idx").collect()
    assert [(b.doc_id, b.title) for b in blocks] == [("doc_v4_s9", "T one"), ("doc_v0_s4", "Document 4")]


@pytest.mark.parametrize("wrap", [None, "data", "questions", "items"])
def test_questions(spark, tmp_path, wrap):
    rows = [{"question": "a?", "context": "c"}, {"question": "", "context": "c"}, {"id": "z", "question": "b?", "context": ["", "d", " "]}, {"question": "x", "context": " "}]
    (tmp_path / "q.json").write_text(json.dumps(rows if wrap is None else {wrap: rows}))
    got = readers.read_questions(spark, str(tmp_path / "q.json")).collect()
    assert sorted((r.id, r.question, r.context) for r in got) == [("q0001", "a?", ["c"]), ("z", "b?", ["d"])]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,question,truth\n1,"a ""b""\nc",x\n', encoding="utf-8")
    got = readers.read_table(spark, str(tmp_path / "t.csv"), "id int, question string, truth string", ("id", "question")).collect()
    assert [tuple(r) for r in got] == [(1, 'a "b"\nc', "x")]
    with pytest.raises(ValueError, match="other"):
        readers.read_table(spark, str(tmp_path / "t.csv"), "id int", ("other",))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k int, t string")
    writers.write_text(df, "t", str(tmp_path / "text"))
    writers.write_text(df, "t", str(tmp_path / "text"), append=True)
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "text"), wholetext=True).collect()) == "a\n\na\n\n"
    writers.write_summary(df, ["t", "missing"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["t", "missing"]
    writers.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert [r.part for r in writers.concatenate(df, df.limit(1), "k").collect()] == [0, 0, 0, 1]


def test_streamed_run_resumes(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    answer = lambda df: df.withColumn("answer", F.upper("q"))

    def go(checkpoint):
        stream = spark.readStream.schema("id int, q string").json(str(source))
        evaluate_stream(stream, answer, out, str(tmp_path / checkpoint)).awaitTermination(120)
        return sorted((r.id, r.answer) for r in spark.read.json(f"{out}/results").collect())

    (source / "a.json").write_text('{"id": 1, "q": "a"}\n{"id": 2, "q": "b"}\n')
    assert go("c1") == [(1, "A"), (2, "B")]
    (source / "b.json").write_text('{"id": 3, "q": "c"}\n')
    assert go("c1") == [(1, "A"), (2, "B"), (3, "C")]
    assert go("c2") == [(1, "A"), (2, "B"), (3, "C")]  # a run begun afresh leaves out what is answered


def test_table_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffquestion,extra,id\nwhat,x,7\nwhy,y,not a number\n")
    got = readers.read_table(spark, str(tmp_path / "t.csv"), "id int, question string, ground_truth string", ("id",)).collect()
    assert [tuple(r) for r in got] == [(7, "what", None), (None, "why", None)]


def test_questions_after_blank_lines(spark, tmp_path):
    (tmp_path / "q.json").write_text('\n\t[{"question": "a?", "context": "c"}, {"question": "\\n\\t", "context": "c"}]\n')
    assert [r.question for r in readers.read_questions(spark, str(tmp_path / "q.json")).collect()] == ["a?"]
