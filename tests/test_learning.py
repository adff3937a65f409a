"""Preference pairs, reward specs and loss masks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import learning as L


def test_dialogue_turns(spark):
    texts = ["", None, "no marks", "\n\nHuman: a", "lead\n\nHuman: a b \r\n\r\nAssistant:  c\n\nd\n\nAssistant: ", "\n\nHuman: x\nAssistant: y\n\nAssistant: z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.dialogue_turns(F.col("t")).alias("x")).collect()
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in rows}
    assert got[0] == got[1] == got[2] == []
    assert got[3] == [("user", "a")]
    assert got[4] == [("user", "a b"), ("assistant", "c\n\nd"), ("assistant", "")]
    assert got[5] == [("user", "x\nAssistant: y"), ("assistant", "z")]


def test_preference_pairs(spark):
    d = lambda *turns: "".join(f"\n\n{who}: {x}" for who, x in zip(["Human", "Assistant"] * 9, turns))
    rows = {
        "good": (d("ask me", "the one answer"), d("ask me", "another answer here")),
        "no_answer": (d("ask me"), d("ask me", "x")),
        "nothing": (None, ""),
        "no_prompt": ("\n\nAssistant: alone as an answer", "\n\nAssistant: alone too as an answer"),
        "prefix_differs": (d("ask me", "the one answer"), d("ask you", "another answer")),
        "longer_prefix": (d("a", "b", "c", "some answer that is long"), d("a", "some answer that is long")),
        "empty_turn": (d("a", "", "c", "the one answer"), d("a", "", "c", "another answer")),
        "same_answer": (d("ask me", "the one answer"), d("ask me", " the one answer ")),
        "short_answer": (d("ask me", "no"), d("ask me", "another answer")),
        "long_prompt": (d("w " * 21, "the one answer"), d("w " * 21, "another answer")),
        "few_tokens": (d("ask me", "onelongword"), d("ask me", "another answer")),
        "too_long": (d("w " * 20, "the one answer"), d("w " * 20, "x " * 20)),
    }
    frame = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, chosen string, rejected string")
    got = {r["id"]: r for r in L.preference_pairs(frame, lambda c: F.regexp_count(c, F.lit(r"\w+")), 20, 5, 3, 30).collect()}
    expected = {k: k for k in rows} | {"good": None, "nothing": "no_answer", "longer_prefix": "prefix_differs"}
    assert {k: r["reject"] for k, r in got.items()} == expected
    assert [tuple(m) for m in got["good"]["messages"]] == [("user", "ask me")] and got["good"]["chosen"] == "the one answer"


def test_rewards(spark):
    assert L.parse_rewards(" nonempty + no_repeat:0.5 ") == [("nonempty", 1.0), ("no_repeat", 0.5)]
    for faulty in ("", "+", "code_run", "length:x"):
        with pytest.raises(ValueError):
            L.parse_rewards(faulty)
    rows = [("a b c a b c", "A  B c a b c"), ("", None), (None, "x"), ("one two", "two"), ("x x x x x", "")]
    frame = spark.createDataFrame(rows, "c string, r string")
    one = lambda spec: [round(r[0], 9) for r in frame.select(L.reward(spec, F.col("c"), F.col("r"), F.lit(6))).collect()]
    assert one("nonempty") == [1, 0, 0, 1, 1]
    assert one("no_repeat") == [0.75, 1, 1, 1, round(1 / 3, 9)]
    assert one("reference_exact:2") == [2, 0, 0, 0, 0]
    assert one("reference_contains") == [1, 0, 0, 1, 0]
    assert one("length")[:3] == [1, 0, 0]
    assert one("nonempty+no_repeat:0.5+reference_exact:2") == [3.375, 0.5, 0.5, 1.5, round(1 + 0.5 / 3, 9)]


@pytest.mark.parametrize("size", [1, 4, 7])
@pytest.mark.parametrize("last", [False, True])
def test_masked_blocks(spark, size, last):
    rnd = random.Random(size)
    docs = [[1] + [rnd.randint(3, 9) for _ in range(rnd.randint(0, 9))] + [2] * rnd.randint(1, 3) for _ in range(12)]
    rows, at = [("s", 0, None), ("s", 0, [])], 0
    for ids in docs:
        rows.append(("s", at, ids))
        at += len(ids)
    stream = [x for ids in docs for x in ids]
    got = {r["block"]: r for r in L.masked_blocks(spark.createDataFrame(rows, "split string, start long, ids array<int>").repartition(4), size, 1, 2, last).collect()}
    assert sorted(got) == list(range((len(stream) - 1) // size))
    for b, r in got.items():
        ids, labels = stream[b * size : b * size + size], stream[b * size + 1 : b * size + size + 1]
        mask = [0 if x == 1 or (i and x == 2 == labels[i - 1]) or (last and i == size - 1) else 1 for i, x in enumerate(labels)]
        assert (r["ids"], r["labels"], r["mask"]) == (ids, labels, mask)


def test_census(spark):
    """Records and counters of a bound input; anything that isn't as bound raises."""
    import hashlib
    import json

    from millrace.operators import census as C

    lines = ['{"text": " Hello world ", "a.b": 3, "s": -0.0}', '{"text": ""}', '{"text": "  "}', '{"text": "gone"}', '{"text": "again", "a.b": null, "s": 2, "x": [1]}', '{"text": "again", "a.b": null, "s": 2, "x": [1]}']
    frame = lambda ls: spark.createDataFrame(list(enumerate(ls)), "row_index long, raw string")
    out = spark.createDataFrame([(3,), (3,)], "row_index long")
    digest = lambda ls: C.multiset_digest(frame(ls).repartition(3), "raw").first()["digest"]
    assert digest(lines) == digest(lines[::-1]) != digest(lines[:5])
    run = lambda ls, excluded=out, bound=None: C.census(frame(ls), excluded, bound or C.Binding(len(ls), 1, digest(ls)), F.trim, F.length, lambda c: F.md5(c), "text", "a.b", "s")
    records, counters = run(lines)
    assert {r["counter"]: r["n"] for r in counters.collect()} == {"physical_rows": 6, "excluded_rows": 1, "empty_text": 1, "empty_after_cleaning": 1, "eligible_rows": 3}
    got = {r["row_index"]: r for r in records.collect()}
    assert sorted(got) == [0, 4, 5] and (got[0]["int_score"], str(got[0]["score"]), got[0]["tokens"]) == (3, "0.0", 13)
    assert (got[4]["int_score"], got[4]["score"]) == (None, 2.0) and got[0]["record_sha256"] == hashlib.sha256(lines[0].encode()).hexdigest()
    for bound in (C.Binding(5, 1, digest(lines)), C.Binding(6, 1, "x"), C.Binding(6, 0, digest(lines))):
        with pytest.raises(C.CensusError):
            run(lines, bound=bound)
    with pytest.raises(C.CensusError):  # an exclusion that isn't a row
        run(lines, spark.createDataFrame([(77,)], "row_index long"))
    for bad in ("not json", "[1]", '{"a.b": 1}', '{"text": 5}', '{"text": "x", "selection": {}}', '{"text": "x", "a.b": 1.5}', '{"text": "x", "a.b": true}', '{"text": "x", "s": "1"}', '{"text": "x", "text": "y"}'):
        with pytest.raises(Exception):
            run([*lines, bad])[0].collect()


def test_asserts_and_entry_points(spark):
    from millrace.functions import code as K

    rows = [
        ("def f(a):\n    return a", '{"inputs": [[1, "x\'y"], 2, [[3]]], "outputs": [true, null, {"a": [1.5]}]}', "f"),
        ("def f():\n    pass\ndef g():\n    pass", '{"inputs": [[1]], "outputs": []}', "h"),
        ("class A:\n    def f(self):\n        pass", "{broken", "h"),
        ("x = 1", json_of(20), "h"),
        (None, None, None),
    ]
    frame = spark.createDataFrame(rows, "code string, io string, name string").withColumn("tests", K.asserts_from_pairs(F.col("io"), F.col("name")))
    got = frame.select("tests", K.entry_from_code(F.col("code")).alias("own"), K.entry_point(F.col("code"), F.col("tests")).alias("entry")).collect()
    assert got[0]["tests"] == ['assert f(1, "x\'y") == True', "assert f(2) == None", "assert f([3]) == {'a': [1.5]}"]
    assert [r["own"] for r in got] == ["f", None, None, None, None] and [r["entry"] for r in got] == ["f", None, None, "h", None]
    assert got[1]["tests"] == got[2]["tests"] == got[4]["tests"] == [] and len(got[3]["tests"]) == 8


def json_of(n):
    import json

    return json.dumps({"inputs": [[i] for i in range(n)], "outputs": list(range(n))})
