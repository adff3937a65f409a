import random

from pyspark.sql import functions as F

from millrace.operators import dedup as D
from millrace.operators import relational as R
from millrace.operators import select as S
from millrace.sources import jsonl, shards


def test_quota_edges(spark):
    rows = [("a", "r1", 1, 5), ("a", "r2", 2, 5), ("a", "r3", 3, 5), ("b", "r1", 4, 3)]
    df = spark.createDataFrame(rows, "g string, r string, id long, n long")
    for target, expected in ((10, [1, 2, 4]), (11, [1, 2, 3, 4]), (100, [1, 2, 3, 4]), (0, [])):
        d = df.withColumn("t", F.lit(target))
        assert sorted(x["id"] for x in S.prefix_by_quota(d, "g", ["r", "id"], "n", "t").collect()) == expected
        assert sorted(x["id"] for x in S.prefix_by_quota(d, "g", ["r", "id"], "n", "t").collect()) == expected


def test_apportion(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert {r["k"]: r["share"] for r in S.apportion(df, "w", 10, "k").collect()} == {"a": 3, "b": 3, "c": 4}


def test_components_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 51)], "a long, b long")
    got = {r["id"]: r["component"] for r in D.components(pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, 50: 50, 51: 50}


def test_greedy_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r["id"] for r in D.greedy_keep(nodes, pairs, "id").collect()) == [1, 3]


def test_overlap_and_as_of(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 25, 26), (3, 9, 31)], "id long, a long, b long")
    right = spark.createDataFrame([(k, k * 10, k * 10 + 10) for k in range(4)], "k long, s long, e long")
    got = sorted((r["id"], r["k"]) for r in R.overlap(left, right, [], ("a", "b"), ("s", "e"), 7).collect())
    assert got == [(1, 0), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3)]
    l = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9)], "k string, t long")
    r = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y")], "k string, t long, v string")
    got = {(x["k"], x["t"]): x["v"] for x in R.as_of(l, r, ["k"], "t", "t", ["v"]).collect()}
    assert got == {("u", 5): "y", ("u", 1): None, ("v", 9): None}


def test_lenient_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n\nnot json\n[1]\n{"n": 2}\n{"text": 5}\n{"text": null}\n')
    rows = jsonl.read_lenient(spark, str(tmp_path / "a.jsonl"), {"text": "string", "n": "int"}).collect()
    bad = sorted(str(r["bad"]) for r in rows)
    assert len(rows) == 6 and bad.count("None") == 1 and bad.count("malformed") == 1 and bad.count("no_object") == 1 and "no_field" in bad and "wrong_type" in bad


def test_shards(spark):
    tokens = spark.createDataFrame([(i, i % 7) for i in range(10)], "pos long, token long")
    s = shards.to_shards(tokens, 4)
    assert sorted((r["shard"], r["n"]) for r in s.collect()) == [(0, 4), (1, 4), (2, 2)]
    assert sorted(map(tuple, shards.from_shards(s, 4).collect())) == [(i, i % 7) for i in range(10)]
    m = shards.manifest(s, 4).first()
    assert (m["shards"], m["tokens"], m["whole"]) == (3, 10, True)


def test_prefix_search(spark, tmp_path):
    """Against the same search over whole arrays, and against all exchanges of one row; groups of uneven size and lengths."""
    from millrace.plans import select_queries as Q

    d = str(tmp_path)
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(1, {"en": 90, "de": 20, "fr": 40}[g])), g, "s", 0) for i, g in enumerate(["en"] * 700 + ["de"] * 400 + ["fr"] * 300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    sums = {}
    for r in sorted(Q.candidates(spark, d).collect(), key=lambda r: (r["rank"], r["doc_id"])):
        s = sums.setdefault(r["lang"], [0])
        s.append(s[-1] + r["tokens"])
    got = {r["lang"]: (r["docs"], r["tokens"]) for r in Q.QUERIES["sel24_prefix_search"](spark, d).collect()}
    assert all(sums[g][n] == t for g, (n, t) in got.items()) and sum(n for n, _ in got.values()) == 700

    def loss(ns):
        amounts = [sums[g][n] for g, n in ns.items()]
        return sum((a / sum(amounts) - 1 / 3) ** 2 for a in amounts)

    # the search over whole arrays
    counts = {"fr": 233, "de": 233, "en": 234}
    for stride in (128, 32, 8, 1):
        for _ in range(400):
            trials = [counts | {i: counts[i] - stride, j: counts[j] + stride} for i in sorted(sums) for j in sorted(sums) if i != j and counts[i] >= stride and counts[j] + stride < len(sums[j])]
            best = min(trials, key=loss, default=counts)
            if loss(best) >= loss(counts) - 1e-16:
                break
            counts = best
    assert {g: n for g, (n, _) in got.items()} == counts


def test_token_mix(spark, tmp_path):
    """All four languages, against elimination by fractions and prefixes cut one row at a time; no mix raises."""
    from fractions import Fraction

    import numpy as np
    import pytest

    from millrace.plans import select_queries as Q

    d = str(tmp_path)
    rnd = random.Random(9)
    langs = ["de", "en", "es", "fr"]
    rows = [(i, " ".join(["w"] * rnd.randint(1, 30 + 60 * (i % 3))), rnd.choice(langs), "s", 0) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    buckets = {g: [] for g in langs}
    for r in sorted(Q.candidates(spark, d).collect(), key=lambda r: (r["rank"], r["doc_id"])):
        buckets[r["lang"]].append((r["doc_id"], r["tokens"]))
    a = [[Fraction(0)] * 4 + [Fraction(1, 4)] for _ in langs]
    for i, g in enumerate(langs):
        for doc, n in buckets[g]:
            a[(i + (doc % 4 == 0)) % 4][i] += Fraction(n, sum(n for _, n in buckets[g]))
    for i in range(4):
        a[i] = [x / a[i][i] for x in a[i]]
        for j in range(4):
            if j != i:
                a[j] = [x - a[j][i] * y for x, y in zip(a[j], a[i])]
    weight = [r[-1] for r in a]
    total = min([Fraction(20000), *(sum(n for _, n in buckets[g]) / x for g, x in zip(langs, weight))])
    expected = {}
    for g, x in zip(langs, weight):
        used = docs = 0
        for _, n in buckets[g]:
            over = used + n > total * x
            if over and abs(used + n - total * x) >= abs(used - total * x):
                break
            used, docs = used + n, docs + 1
            if over:
                break
        expected[g] = (docs, used)
    assert {r["lang"]: (r["docs"], r["tokens"]) for r in Q.QUERIES["sel16_token_mix"](spark, d).collect()} == expected
    for share in ([[0.5, 0.5], [0.5, 0.5]], [[0.9, 0.8], [0.1, 0.2]]):
        with pytest.raises(ValueError):
            Q.mix_weights(np.array(share), np.array([0.5, 0.5]))


def test_math_format_reads_whole_texts(spark, tmp_path):
    from millrace.plans import chat_queries as Q

    rows = [(1, 0, "user", "x " * 500 + "\nFinal answer: 1,234.50\nmore"), (1, 1, "assistant", "no answer in " + "this text " * 500)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, Q.QUERIES["vrf6_math_format"](spark, str(tmp_path)).select("conv_id", "turn", "answer", "has_steps").collect()))
    assert got == [(1, 0, "1234.5", True), (1, 1, "7", False)]


def test_encode_chat(spark):
    """Ids and labels against a plain loop with the same tokenizer file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.operators.chat import BEGIN_ID, END_ID, IGNORED, ROLE_IDS, encode_chat

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    talks = {1: [("user", "Say hello."), ("assistant", "Hello.")], 2: [("system", "Be brief."), ("user", "Why?"), ("assistant", "So."), ("user", "And?"), ("assistant", "No.")], 3: [("user", ""), ("assistant", "x")], 4: [("tool", "x")]}
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["ids"], r["labels"]) for r in encode_chat(df).collect()}
    for c in (1, 2):
        ids, labels = [BEGIN_ID], [IGNORED]
        for role, text in talks[c]:
            own = tok.encode(text, add_special_tokens=False).ids + [END_ID] * (role == "assistant")
            ids += [ROLE_IDS[role], *own]
            labels += [IGNORED, *(own if role == "assistant" else [IGNORED] * len(own))]
        assert got[c] == (ids, labels)
    assert got[3] == got[4] == (None, None)
