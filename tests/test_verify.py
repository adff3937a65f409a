import pytest
from pyspark.sql import functions as F

from millrace.operators import chat as C
from millrace.operators import verify as V

from .test_text import ev

GOLDEN = [
    ("keywords:existence", {"keywords": ["apple", "banana"]}, "apple banana", "apple"),
    ("keywords:frequency", {"keyword": "apple", "relation": "at least", "frequency": 2}, "apple apple", "apple"),
    ("keywords:forbidden_words", {"forbidden_words": ["bad"]}, "badly good", "a bad one"),
    ("keywords:letter_frequency", {"letter": "z", "relation": "at least", "frequency": 2}, "zZ", "z"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a\n***\nb", "a"),
    ("length_constraints:number_words", {"relation": "at least", "num_words": 3}, "one two three", "one two"),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "then"}, "first\n\n\"Then, second", "first\n\nsecond"),
    ("detectable_content:number_placeholders", {"num_placeholders": 1}, "to [name]", "to name"),
    ("detectable_content:postscript", {"marker": "P.S."}, "text\nP.S. more", "text"),
    ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* first\n* second", "first and second"),
    ("detectable_format:constrained_response", {}, "My answer is yes.", "yes"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b*", "*a*"),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "Section 1\na\nSection 2\nb", "Section 1\na"),
    ("detectable_format:json_format", {}, "```json\n{\"a\": 1}\n```", "not json"),
    ("detectable_format:title", {}, "<<title>>\ntext", "title"),
    ("combination:two_responses", {}, "one\n******\ntwo", "one\n******\none"),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "say it. Yes", "Yes"),
    ("startend:end_checker", {"end_phrase": "the end"}, "This is The End", "more"),
    ("startend:quotation", {}, '"quoted"', "quoted"),
    ("punctuation:no_comma", {}, "no comma", "a, b"),
]


@pytest.mark.parametrize("kind, options, good, bad", GOLDEN)
def test_instructions(spark, kind, options, good, bad):
    assert ev(spark, lambda c: V.followed(kind, c, **options), good) is True
    assert ev(spark, lambda c: V.followed(kind, c, **options), bad) is False
    assert ev(spark, lambda c: V.followed(kind, c, **options), None) is False
    assert ev(spark, lambda c: V.followed(kind, c, **options), " ") is False


def test_loose_forgives_the_first_line(spark):
    text = "Sure, here:\nplain"
    assert ev(spark, lambda c: V.followed("punctuation:no_comma", c), text) is False
    assert ev(spark, lambda c: V.followed_loosely("punctuation:no_comma", c), text) is True


def test_answers(spark):
    reasons = ev(spark, lambda a, p: V.hard_fails(a, p), "Here is [name] import os", "Who?")
    assert reasons == ["code_pollution", "placeholder", "meta_prefix"]
    assert ev(spark, V.family, "Please rewrite this email") == "rewrite_style"
    assert ev(spark, V.subfamily, "Summarize in one sentence") == "summary_1_sentence"
    assert ev(spark, V.subfamily, "Say hi") is None
    mail = "Dear Ann,\nThanks a lot. See you.\nBest regards\nBo"
    assert ev(spark, lambda a: V.email_reasons(a, F.lit(5), F.lit(50), F.lit(1), F.lit(4), F.lit(True)), mail) == []
    assert ev(spark, lambda a: V.summary_reasons(a, F.lit(2), F.lit(60)), "- a\n- b\nc") == ["extra_text"]


@pytest.mark.parametrize(
    "roles, error",
    [
        ("user assistant", None),
        ("system user assistant user assistant", None),
        ("user user assistant", "role_order"),
        ("system", "no_user"),
        ("user", "end_not_assistant"),
        ("user tool", "unknown_role"),
        ("assistant", "role_order"),
    ],
)
def test_chat_state_machine(spark, roles, error):
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(roles.split())]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert C.messages(df).select(C.chat_error(F.col("messages")).alias("e")).first()["e"] == error


def test_empty_content(spark):
    df = spark.createDataFrame([(1, 0, "user", " "), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert C.messages(df).select(C.chat_error(F.col("messages")).alias("e")).first()["e"] == "empty_content"


def test_truncation(spark):
    rows = [(1, 0, "system", "ss"), (1, 1, "user", "aaaa"), (1, 2, "assistant", "bbbb"), (1, 3, "user", "cc"), (1, 4, "assistant", "dd"), (2, 0, "user", "x" * 50), (2, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = C.truncate(df, F.length("text"), 8).select("conv_id", "turn").collect()
    assert sorted(map(tuple, kept)) == [(1, 0), (1, 3), (1, 4)]


@pytest.mark.parametrize(
    "kind, options, good, bad",
    [
        ("change_case:english_capital", {}, "ALL 3 LOUD WORDS!", "ALL but one"),
        ("change_case:english_capital", {}, "É", "123"),
        ("change_case:english_lowercase", {}, "quiet, 2 of them", "Quiet"),
        ("change_case:capital_word_frequency", {"capital_relation": "at least", "capital_frequency": 2}, "NASA and the EU met", "NASA met Bob 12"),
        ("change_case:capital_word_frequency", {"capital_relation": "less than", "capital_frequency": 1}, "none here 4", "ONE here"),
    ],
)
def test_case_checks(spark, kind, options, good, bad):
    assert ev(spark, lambda c: V.followed(kind, c, **options), good) is True
    assert ev(spark, lambda c: V.followed(kind, c, **options), bad) is False
