"""Parsing of model responses, as Column expressions that never fail on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import strip, without_thinking


def _first(n: Column, k: int) -> Column:
    """Ids 0, 1, ... of the first k of n candidates."""
    return F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(k)) - 1)).otherwise(F.array().cast("array<int>"))


def critique_ids(response: Column, n: Column, k: int) -> Column:
    """The ids of the last bracketed list of whole numbers, quoted or not, in their order, repeats kept;
    ids outside 0..n-1 go, and k stay. Without a list that reads as JSON: the first k."""
    bracketed = F.regexp_extract_all(without_thinking(response), F.lit(r"\[[^\[\]]*\]"), F.lit(0))
    lists = F.transform(bracketed, lambda x: F.from_json(F.translate(x, "\"'", ""), "array<int>"))
    whole = F.filter(lists, lambda x: (F.size(x) > 0) & F.forall(x, lambda i: i.isNotNull()))
    ids = F.try_element_at(whole, F.lit(-1))
    chosen = F.slice(F.filter(ids, lambda i: (i >= 0) & (i < n)), 1, k)
    return F.coalesce(chosen, _first(n, k))


def critique_ids_strict(response: Column, n: Column, k: int) -> Column:
    """Ids of a response that is JSON: a list, or an object's `selected_ids` or else `ids`; otherwise every
    number in it. Repeats and ids outside 0..n-1 go; if none is left, the first k."""
    t = strip(without_thinking(response))
    shaped = F.coalesce(
        F.from_json(F.when(t.startswith("["), t), "array<int>"),
        F.coalesce(F.from_json(F.when(t.startswith("{"), F.get_json_object(t, "$.selected_ids")), "array<int>"), F.from_json(F.when(t.startswith("{"), F.get_json_object(t, "$.ids")), "array<int>")))
    loose = F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    valid = F.array_distinct(F.filter(F.coalesce(shaped, loose), lambda i: (i >= 0) & (i < n)))
    return F.when(F.size(valid) > 0, F.slice(valid, 1, k)).otherwise(_first(n, k))


def json_object(response: Column) -> Column:
    """The text from the first { to the last } outside Markdown fences; null if there is none."""
    bare = F.regexp_replace(response, r"(?i)```(json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(response: Column, schema: str) -> Column:
    """A list of objects from a response, fences aside; empty if it is not one."""
    bare = strip(F.regexp_replace(F.regexp_replace(response, r"```json\s*", ""), r"```\s*", ""))
    return F.coalesce(F.from_json(F.when(bare.startswith("["), bare), schema), F.array().cast(schema))


def qa_pairs(response: Column) -> Column:
    """Question-answer pairs of an object's `questions` list; empty if there is none."""
    kind = "array<struct<question:string,answer:string>>"
    return F.coalesce(F.from_json(F.get_json_object(json_object(response), "$.questions"), kind), F.array().cast(kind))


def valid_pair(question: Column, answer: Column) -> Column:
    """A question of 10 characters or more and an answer of 2 or more, stripped."""
    return F.coalesce((F.length(strip(question)) >= 10) & (F.length(strip(answer)) >= 2), F.lit(False))
