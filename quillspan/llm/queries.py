"""The registered query of each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, langid, lines, lm_score, mixing, ngram_join, quality, substring, tokens
from quillspan.llm import toxicity as tox


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = tox.toxicity(docs, tox.train(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("is_toxic").cast("int").alias("predicted"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.read_tokens(tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = lm_score.lm_score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), 256)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), digest.alias("removed_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_quality": op2_quality, "op3_ngram_join": op3_ngram_join, "op4_language_id": op4_language_id, "op5_token_ids": op5_token_ids, "op6_substring_dedup": op6_substring_dedup, "op7_lm_score": op7_lm_score, "op8_line_dedup": op8_line_dedup, "op9_mixing": op9_mixing, "op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {
    "op1_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
          FROM documents),
        b AS (
          SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
          FROM benchmark),
        win AS (
          SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 7), ' ') AS w, least(len(ws), 8) AS n
          FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 7, 1))) AS i FROM b WHERE len(ws) > 0)),
        pos AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
        occ AS (
          SELECT pos.doc_id, pos.i, win.n, win.item_id
          FROM pos CROSS JOIN (SELECT DISTINCT n FROM win) z
          JOIN win ON win.n = z.n AND win.w = array_to_string(list_slice(pos.ws, pos.i, pos.i + z.n - 1), ' ')
          WHERE pos.i + z.n - 1 <= len(pos.ws)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH d AS (
          SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
                FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d)),
        later AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS f FROM win GROUP BY h) USING (h) WHERE doc_id > f),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM later),
        word AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS w FROM d),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(text, '') AS t,
                 len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
          FROM documents),
        k AS (
          SELECT doc_id, source, size,
                 -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
                 / greatest(0.1, 1.0 - 4.0 * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(length(t), 1)) AS es
          FROM d),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size,
                 ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
          FROM k GROUP BY source),
        l AS (
          SELECT *, 3.0 * source_size AS c,
                 (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER p, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0.0)) AS level
          FROM s WINDOW p AS (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (
          SELECT source, source_size,
                 CASE WHEN c / w <= level THEN c ELSE max(CASE WHEN c / w > level THEN level END) OVER () * w END AS target
          FROM l),
        e AS (
          SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
        b AS (
          SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
                 coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY es, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, round(target, 3) AS target,
               ((epochs + CASE WHEN size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
        FROM b""",
}
