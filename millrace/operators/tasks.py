"""Multiple-choice requests from task rows, with what makes a row unusable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def multiple_choice(question: Column, choices: Column, gold: Column, labels: Column | None = None) -> Column:
    """struct<prompt, choices, gold, error>: a question's prompt, its choices and the 0-based right one.

    With `labels`, `gold` is the right one's label, else its place. Prompt, choices and gold
    are null if there is an error: labels that repeat or aren't as many as the choices, an
    empty or missing question, fewer than two choices, an empty or missing choice, or a gold
    that names none of them.
    """
    place = gold.cast("int") if labels is None else F.array_position(labels, gold.cast("string")).cast("int") - 1
    error = F.lit(None).cast("string")
    if labels is not None:
        error = F.when((F.size(labels) != F.size(choices)) | (F.size(F.array_distinct(labels)) != F.size(labels)), "labels")
    blank = F.coalesce(question, F.lit("")) == ""
    hollow = F.exists(choices, lambda c: c.isNull() | (c == ""))
    error = F.coalesce(
        error,
        F.when(blank, "question"),
        F.when(choices.isNull() | (F.size(choices) < 2) | F.coalesce(hollow, F.lit(False)), "choices"),
        F.when(place.isNull() | (place < 0) | (place >= F.size(choices)), "gold"),
    )
    fine = error.isNull()
    prompt = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return F.struct(F.when(fine, prompt).alias("prompt"), F.when(fine, choices).alias("choices"), F.when(fine, place).alias("gold"), error.alias("error"))


def exact_answer(expected: Column, answer: Column) -> Column:
    """struct<passes, extra, missing>: whether an answer is the expected value, holds it as a word of its own with
    other text, or lacks it."""
    quoted = F.regexp_replace(expected, r"([^\p{L}\p{N}_ ])", r"\\$1")
    inside = F.regexp_like(answer, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))
    exact = F.coalesce(answer == expected, F.lit(False))
    inside = F.coalesce(inside, F.lit(False))
    return F.struct(exact.alias("passes"), (inside & ~exact).alias("extra"), (~inside).alias("missing"))


def membership_answer(items: Column, target: Column, present: Column, absent: Column, answer: Column) -> Column:
    """struct<passes, actual, predicted>: whether the answer is the label that says if `target` is among `items`."""
    there = F.coalesce(F.array_contains(items, target), F.lit(False))
    predicted = F.when(answer == present, "positive").when(answer == absent, "negative").otherwise("invalid")
    actual = F.when(there, "positive").otherwise("negative")
    return F.struct((predicted == actual).alias("passes"), actual.alias("actual"), predicted.alias("predicted"))


def json_answer(keys: Column, values: Column, answer: Column) -> Column:
    """struct<passes, valid, duplicate_keys, exact_keys, right_values>: an answer that should be an object of these strings.

    Keys are the strings before a colon at the object's top level; an answer with repeated keys is valid, but doesn't pass.
    """
    # braces and text of one level: nested objects are dropped before keys are read
    flat = F.regexp_replace(answer, r"(?<=:)\s*(\{[^{}]*\}|\[[^\[\]]*\])", "0")
    named = F.regexp_extract_all(flat, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    duplicate = F.size(F.array_distinct(named)) < F.size(named)
    once = F.when(duplicate, F.lit("{}")).otherwise(answer)  # the parser takes no repeated keys
    is_object = answer.rlike(r"^\s*\{") & answer.rlike(r"\}\s*$")
    valid = F.coalesce(F.try_parse_json(once).isNotNull(), F.lit(False))
    wanted = F.map_from_arrays(keys, values)
    parsed = F.from_json(answer, "map<string,string>")
    exact = is_object & valid & ~duplicate & (F.size(F.array_except(named, keys)) == 0) & (F.size(F.array_except(keys, named)) == 0)
    right = is_object & valid & F.forall(keys, lambda k: F.coalesce(F.try_element_at(parsed, k) == F.try_element_at(wanted, k), F.lit(False)))
    fields = {"passes": exact & right, "valid": valid, "duplicate_keys": duplicate, "exact_keys": exact, "right_values": right}
    return F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in fields.items()])
