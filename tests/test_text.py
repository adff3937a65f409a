import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity as I
from millrace.functions import text as T
from millrace.functions.code import structure


def ev(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.normalise, "a\r\nb\rc\x00\x07​﻿\td", "a\nb\nc\td"),
        (T.normalise, None, None),
        (T.squeeze, "  a \n　 b\x1f", "a b"),
        (T.has_filler, "_" * 19, False),
        (T.has_filler, "_" * 20, True),
        (T.has_repeats, "ab" + "x" * 49, False),
        (T.has_repeats, "ab" + "x" * 50, True),
        (T.has_repeats, "\n" * 60, False),
        (T.ascii_share, "", 0.0),
        (T.ascii_share, "aé", 0.5),
        (T.strip_metadata, "<a>1\n<b>2\n\nx", "x"),
        (T.strip_metadata, "x\n<a>1", "x\n<a>1"),
        (T.trim_wiki_tail, "body \n  References\t\nrest", "body"),
        (T.trim_wiki_tail, "References\nrest", "References\nrest"),
        (T.head_label, "\n  # A title", "md_heading"),
        (T.head_label, "#!shebang", "other_symbol"),
        (T.head_label, "- item", "dash_list"),
        (T.head_label, "```py", "fence"),
        (T.head_label, "| a |", "pipes_table"),
        (T.head_label, "7 up", "digit"),
        (T.head_label, "été", "alpha"),
        (T.head_label, "  \n ", "empty"),
        (T.word_count, "it's well-known, -- yes", 3),
        (T.sentence_count, "One. Two!  Three?\nFour", 4),
        (T.looks_python, "def f(x):\n    return x", True),
        (T.looks_python, "public class A { }", False),
        (T.prompt_key, "  Hello, WORLD! it's-ok ", "hello world it's-ok"),
        (T.numeric_token, " 1,200.50% ", "1200.5"),
        (T.numeric_token, "abc", "abc"),
        (T.longest_quote, 'a "b" "c  d" e', "c d"),
        (T.first_code_block, "x\n```python\nprint(1)\n```", "print(1)"),
        (lambda c: T.contract_clean(c, "space"), "\n﻿ <!-- x -->a_b’\n", "a b'"),
        (lambda c: T.contract_clean(c, min_chars=5), "abc", None),
        (lambda c: T.truncate_lines(c, 4), "1\n2\n3\n4\n5\n6", "1\n2\n# ... truncated ...\n5\n6"),
        (lambda c: T.document_reason(c), "word " * 100, None),
        (lambda c: T.document_reason(c), "short", "too_short"),
        (lambda c: T.document_reason(c), "http://a.b/c " * 30, "url_spam"),
    ],
)
def test_columns(spark, f, given, expected):
    assert ev(spark, f, given) == expected


def test_cut_keeps_first_and_last_lines(spark):
    assert ev(spark, lambda c: T.truncate_lines(c, 5), "1\n2\n3\n4\n5\n6") == "1\n2\n# ... truncated ...\n4\n5\n6"


def test_identities(spark):
    t = "naïve"
    raw = t.encode()
    assert ev(spark, I.fingerprint, t) == hashlib.sha256(I.DOMAIN.encode() + b"\0" + len(raw).to_bytes(8, "big") + raw).hexdigest()
    assert ev(spark, I.blake2b_rank, t) == hashlib.blake2b(raw, digest_size=16, person=b"millrace-rank-v1").hexdigest()
    assert ev(spark, I.nfc_folded, " Straße  é") == "strasse é"
    assert ev(spark, I.tail_key, "x" * 5000) == hashlib.sha1(b"x" * 3000).hexdigest()


@pytest.mark.parametrize(
    "code, reasons",
    [
        ("def f(x):\n    return x", []),
        ("import os", ["top_level_function_count", "extra_top_level_code", "banned_node"]),
        ("def f(x):\n    return f(x)", ["recursion"]),
        ("def g(x):\n    return eval(x)", ["wrong_function_name", "banned_call"]),
        ("def f(x):\n    return x.open()", ["banned_call"]),
        ("def f(:", ["syntax_error"]),
        (None, ["syntax_error"]),
        ("def f(x):\n    raise x", ["banned_node"]),
        ("def f(x):\n    yield x", ["banned_node"]),
        ("def f(x):\n    return vars(x)", []),
        ("def f(x):\n    return x\nf(1)", ["extra_top_level_code", "recursion"]),
        ("def f(x):\n" + "    x = x\n" * 30, ["too_many_lines", "too_many_ast_nodes"]),
        ("def f(x):\n    return " + "(" * 1 + "-" * 20 + "x)", ["too_deep_ast"]),
    ],
)
def test_code_structure(code, reasons):
    assert structure(code, "f")[0] == reasons
