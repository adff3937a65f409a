"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs_frame(spark, rows, extra=True):
    """Rows (doc_id, text) with columns whose names operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    full = [(i, t, "x", 1, "k", 7) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, id string, key int, bucket string, h int")


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        out.append((i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120)))))
    base = [rnd.choice(vocabulary) for _ in range(200)]
    for k in range(25):  # near copies of one base, more and less alike
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append((n + k, " ".join(w)))
    out += [(n + 30, out[3][1]), (n + 31, out[3][1]), (n + 32, ""), (n + 33, None), (n + 34, "two words"), (n + 35, "Two Words"), (n + 36, " \n\t"), (n + 37, "word " * 5000), (None, "has no id at all")]
    return out


# ---- 1


def test_decontamination(spark):
    from millrace.llm.decontaminate import contaminated_pairs, drop_contaminated

    rnd = random.Random(1)
    words = lambda n, k: [f"{k}{rnd.randrange(10**6)}" for _ in range(n)]
    item = words(20, "b")
    swapped = list(item)
    for at in (3, 8, 15):
        swapped[at] = "other"
    far = [w if i % 2 else "other" for i, w in enumerate(item)]
    docs = [(1, " ".join(words(30, "x") + item + words(5, "y"))), (2, "A " + " ".join(words(9, "x") + swapped)), (3, " ".join(far)), (4, " ".join(item[:9] + words(30, "x"))), (5, None), (6, ""), (7, " ".join(w.upper() + "," for w in item)), (None, " ".join(item))]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short")], "item_id long, text string")
    got = {r["doc_id"] for r in contaminated_pairs(docs_frame(spark, docs), bench).collect()}
    assert got == {1, 2, 7, None}
    kept = drop_contaminated(docs_frame(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6} and "bucket" in kept.columns
    empty = docs_frame(spark, [])
    assert contaminated_pairs(empty, bench).count() == 0 and contaminated_pairs(docs_frame(spark, docs), bench.limit(0)).count() == 0


def test_masks_meet_every_pattern():
    """Of any 5 to 13 aligned words with the allowed number of substitutions, some mask meets words that all agree."""
    import itertools

    from millrace.llm.decontaminate import LEAST_WORDS, MASKS

    for w in range(LEAST_WORDS, 14):
        for bad in itertools.combinations(range(w), w - math.ceil(0.75 * w)):
            assert any(all(at + j not in bad for j, c in enumerate(m) if c == "1") for m in MASKS for at in range(w - len(m) + 1)), (w, bad)


def test_decontamination_edges(spark):
    """Short items with substitutions, repeated ids and items, very long texts, and a column named like the helper's."""
    from millrace.llm.decontaminate import contaminated_pairs, drop_contaminated

    rnd = random.Random(12)
    words = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    short, tiny = words(6), words(5)
    near = [*short[:2], "other", *short[3:]]
    rows = [(1, " ".join(words(20) + near)), (2, " ".join(words(30000) + short + words(30000))), (3, " ".join(tiny)), (3, "clean"), (4, "clean"), (5, " ".join(short[:4]))]
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, bad string, item long")
    bench = spark.createDataFrame([(1, " ".join(short)), (1, " ".join(short)), (2, " ".join(tiny)), (3, "four words are not")], "item_id long, text string")
    assert sorted(map(tuple, contaminated_pairs(docs, bench).collect())) == [(1, 1, 20), (2, 1, 30000), (3, 2, 0)]
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == [4, 5]


# ---- 2


def brute_lines(rows, similarity=0.8):
    """Rows (id, text) -> the text without lines of whose component an earlier line is kept; links by all pairs."""
    places, lines = [], {}
    for row, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        for pos, piece in enumerate((t if t is not None else "").split("\n")):
            if line := piece.strip(" \t\r\x0b\x0c"):
                places.append((row, pos, line))
                lines.setdefault(line, frozenset(line[k : k + 8] for k in range(max(1, len(line) - 7))))
    names = list(lines)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            x, y = lines[names[a]], lines[names[b]]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                parent[find(names[a])] = find(names[b])
    seen, gone = set(), collections.defaultdict(set)
    for row, pos, line in places:
        if find(line) in seen:
            gone[row].add(pos)
        seen.add(find(line))
    return [t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[row]) for row, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("crowd", [1, 32])
def test_line_dedup_brute_force(spark, monkeypatch, crowd):
    """Against all pairs of lines: nothing is removed without a link, and nearly all links are found, whichever way crowded buckets go."""
    from millrace.llm import components
    from millrace.llm.line_dedup import dedup_lines

    monkeypatch.setattr(components, "CROWD", crowd)
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    bases = [line(rnd.randint(8, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [line(rnd.randint(1, 30)) for _ in range(rnd.randint(0, 4))]
        for _ in range(rnd.randint(1, 5)):
            w = rnd.choice(bases).split(" ")
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            parts.append(" ".join(w))
        rnd.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(70, None), (71, ""), (72, " \n\t"), (None, bases[0] + "\nnull id"), (73, line(6000)), (74, "x\nx\n x "), (75, rows[3][1])]
    df = spark.createDataFrame([(*r, "k", "d", 3, 4) for r in rows], "doc_id long, text string, key string, drop string, _key int, _drop int")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = {(r["doc_id"], r["key"], r["_drop"]): r["text"] for r in out.collect()}
    expected = dict(zip((i for i, _ in rows), brute_lines(rows)))
    lost = extra = every = 0
    for (i, key, drop), text in got.items():
        assert (key, drop) == ("k", 4) and (text is None) == (expected[i] is None)
        a, b = collections.Counter((text or "").split("\n")), collections.Counter((expected[i] or "").split("\n"))
        every += sum((collections.Counter((dict(rows)[i] or "").split("\n")) - b).values())
        lost, extra = lost + sum((a - b).values()), extra + sum((b - a).values())
    assert every > 60 and extra == 0 and lost <= 0.02 * every
    twice = dedup_lines(spark.createDataFrame([(1, "same line\nother"), (1, "same line\nother"), (2, "same line")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in twice.collect()) == [(1, "same line\nother"), (1, "same line\nother"), (2, "")]


def test_line_dedup(spark):
    from millrace.llm.line_dedup import dedup_lines

    long_line = "the quick brown fox jumps over the lazy dog and runs away from every single hunter in the wide forest"
    near = long_line.replace("every", "evory")
    docs = [(1, f"first line only here\n{long_line}\n\nshort"), (2, f"{near}\nshort\nanother line of its own kind"), (3, None), (4, ""), (5, "short\n \nshort"), (6, "unrelated text without any copies at all")]
    got = {r["doc_id"]: r for r in dedup_lines(docs_frame(spark, docs)).collect()}
    assert got[1]["text"] == docs[0][1] and got[1]["n_removed"] == 0 and got[1]["n_lines"] == 3
    assert got[2]["text"] == "another line of its own kind" and got[2]["n_removed"] == 2
    assert got[3]["text"] is None and got[3]["n_lines"] == 0
    assert got[4]["text"] == "" and got[5]["text"] == " " and got[6]["n_removed"] == 0
    assert dedup_lines(docs_frame(spark, [])).count() == 0


# ---- 3


def test_warc(spark, tmp_path):
    from millrace.llm.warc import assemble_transactions, parse_records, read_warc, write_warc

    big = "é" * 80
    rows = [(1, "http://a.b/c?x", "tiny"), (2, "http://a.b/", "tiny"), (5, None, big), (3, "http://a.b/\r\nX: y", big), (9, "u", None), (None, "v", big), (4, "w", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "warc")
    write_warc(pages, path)
    back = {r["metadata"]["fields"].get("pageId"): r for r in assemble_transactions(read_warc(spark, path)).collect()}
    assert len(back) == len(rows)
    assert back["3"]["principal"]["type"] == "response" and bytes(back["3"]["principal"]["payload"]).decode() == big
    assert back["5"]["principal"]["type"] == "revisit" and back["5"]["metadata"]["fields"]["refersToPage"] == "3"
    assert back["5"]["principal"]["refers_to"] == back["3"]["principal"]["record_id"] and back["5"]["principal"]["payload"] is None
    assert back[None]["principal"]["type"] == "revisit"
    assert {back["1"]["principal"]["type"], back["2"]["principal"]["type"], back["9"]["principal"]["type"]} == {"response"}
    assert bytes(back["4"]["principal"]["payload"]).decode() == rows[-1][2]
    assert back["9"]["metadata"]["fields"]["payloadLength"] == "0"
    files = list((tmp_path / "warc").glob("*.gz"))
    assert sum(len(list(parse_records(gzip.open(f).read()))) for f in files) == 3 * len(rows)
    with pytest.raises(ValueError):
        list(parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


# ---- 4


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids} | {i: (len(sets[i]), None) for i in sets if i is None}


@pytest.mark.parametrize("n, percent, crowd", [(3, 90, 32), (5, 80, 32), (3, 90, 1), (5, 80, 1)])
def test_ngram_join(spark, monkeypatch, n, percent, crowd):
    from millrace.llm import components
    from millrace.llm.ngram_join import ngram_components

    monkeypatch.setattr(components, "CROWD", crowd)
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs_frame(spark, rows), n=n, percent=percent).collect()}
    assert got == brute_components(rows, n, percent)
    assert len({c for _, c in got.values()}) < len(rows) - 4


def test_ngram_join_empty(spark):
    from millrace.llm.ngram_join import ngram_components

    assert ngram_components(docs_frame(spark, [])).count() == 0


def test_chain_of_near_copies(spark):
    """a ~ b and b ~ c but not a ~ c: one component, found without comparing all pairs."""
    from millrace.llm.ngram_join import ngram_components

    words = [f"w{i}" for i in range(202)]
    rows = []
    for k in range(6):
        rows.append((k, " ".join(f"s{i}" if i < 7 * k else w for i, w in enumerate(words))))
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(docs_frame(spark, rows, False)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 90).items()} and set(got.values()) == {0}


# ---- 5


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        hit = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                hit[p] += 1
                hit[p + length] -= 1
        m = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~m]) if b else b""
        out.append((i, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [1024, 2])
def test_suffix_dedup(spark, monkeypatch, crowd):
    from millrace.llm import suffix

    monkeypatch.setattr(suffix, "CROWD", crowd)
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(700)
    rows = [(i, noise(rnd.randint(0, 900))) for i in range(12)]
    rows += [(20 + i, noise(100) + passage[i * 5 : 650 + i] + noise(120)) for i in range(6)]
    rows += [(40, "ab" * 600), (41, rows[1][1] * 2), (42, None), (43, ""), (44, passage), (44, passage), (None, noise(500) + "é" * 450), (46, "x" * 399), (47, "x" * 399)]
    got = suffix.remove_repeats(docs_frame(spark, rows))
    found = sorted([tuple(r)[:5] for r in got.collect()], key=repr)
    assert found == brute_repeats(rows, 400)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert suffix.remove_repeats(docs_frame(spark, [])).count() == 0


def test_suffix_array():
    from millrace.llm.suffix import suffix_array

    rnd = random.Random(3)
    for _ in range(200):
        a = np.array([rnd.randint(0, 2) for _ in range(rnd.randint(0, 40))], np.int64)
        assert suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


# ---- 6


def test_brown_scores(spark):
    from millrace.llm.lm import brown_scores

    rnd = random.Random(4)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(a if i % 2 else b) for _ in range(60))) for i in range(200)] + [(500, None), (501, ""), (502, "NEW a1 A1"), (7, "again a1"), (None, "no id")]
    for table in (1 << 17, 20):
        got = brown_scores(docs_frame(spark, rows), table=table, frequent=63, tails=64, classes=8).collect()
        count = collections.Counter()
        for i, t in rows:
            if zlib.crc32((str(i) if i is not None else "").encode()) % 10:
                count.update([*WORD.findall((t or "").translate(LOWER)), "\0end"])
        n, v = sum(count.values()), len(count)
        expected = collections.Counter()
        for i, t in rows:
            w = [*WORD.findall((t or "").translate(LOWER)), "\0end"]
            held = zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0
            base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            expected[(i, held, len(w), sum(count[x] > 0 for x in w), n, round(base, 6))] += 1
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
        held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert brown_scores(docs_frame(spark, []), frequent=15, tails=16).count() == 0


def test_rare_words_have_classes_of_their_own(spark):
    """Words beyond the core that end alike are told apart by their contexts, whether sent to the tasks or joined."""
    from millrace.llm.lm import best_classes, brown_scores

    rnd = random.Random(6)
    some = lambda k: f"c{k}" if rnd.random() < 0.2 else f"{k}{rnd.randrange(30)}zz"
    pair = lambda: f"{some('a')} x {some('b')} y"
    rows = [(i, " ".join(pair() for _ in range(20))) for i in range(150)]
    scores = []
    for table in (1 << 17, 20):
        got = brown_scores(docs_frame(spark, rows), table=table, frequent=4, tails=64, classes=6).collect()
        scores.append(sorted((r["doc_id"], round(r["score"], 6)) for r in got))
    assert scores[0] == scores[1]
    held = [r for r in got if r["held_out"]]
    # after x and y the class is certain, and its words are half as many
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -0.9

    # each move against the whole likelihood, counted anew
    k = 4
    stream = np.array([0] + [rnd.randrange(1, 9) for _ in range(400)])
    stream[50] = stream[51] = stream[52] = 8
    label = np.array([0, 1, 2, 3, 1, 2, 3, 1, 2])
    f = lambda x: sum(v * math.log(v) for v in x.ravel() if v)

    def tables(label):
        t = np.zeros((k, k))
        np.add.at(t, (label[stream[:-1]], label[stream[1:]]), 1)
        return t

    def value(label):
        t = tables(label)
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    for w in range(1, 9):
        seen = collections.Counter()
        for a, b in zip(stream[:-1], stream[1:]):
            if a == b == w:
                seen[2 * k] += 1
            elif a == w:
                seen[int(label[b])] += 1
            elif b == w:
                seen[k + int(label[a])] += 1
        code, n = map(np.array, zip(*sorted(seen.items())))
        best = best_classes(np.zeros(len(code), np.int64), code, n, label[w : w + 1], tables(label))[0]
        moved = [value(np.where(np.arange(9) == w, b, label)) for b in range(1, k)]
        assert abs(moved[best - 1] - max(moved)) < 1e-6


def test_probabilities_sum_to_one():
    from millrace.llm.lm import BrownModel, exchange_clustering

    rnd = np.random.default_rng(0)
    bigrams = rnd.integers(0, 5, (12, 12)).astype(float)
    label = exchange_clustering(bigrams, 4)
    assert label[0] == 0 and (label[1:] > 0).all()
    m = BrownModel(None, label, np.full((4, 4), 0.25), np.array([5.0, 10, 20, 30]), np.array([1.0, 2, 3, 4]), None, None, 65, 10, 0, 0)
    n = [[5], [4, 6], [5, 5, 10], [1, 9, 10, 10]]
    total = sum(m.probability(x, 0.25, c) for c, xs in enumerate(n) for x in xs) + sum(m.mix * 0.25 * (0.1 / (m.class_n[c] + 0.1 * (m.class_v[c] + 1))) for c in range(4)) + (1 - m.mix) * m.base(0)
    assert abs(total - 1) < 1e-9


# ---- 7


def test_toxicity(spark):
    from millrace.llm.toxicity import toxicity_scores, train_toxicity

    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [f"w{rnd.randrange(400)}" for _ in range(50)]
        if toxic:
            w[rnd.randrange(50)] = rnd.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(i % 7 > 0), int(toxic)))
    labels += [(None, 1, 1), (3, None, 1), (9999, 1, 0)]
    rows += [(700, None), (701, ""), (None, "vile " * 3 + "words"), (702, "w1 " * 20000 + "vile")]
    docs = docs_frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, train_toxicity(docs, table)).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["is_toxic"] == (i % 5 == 0) for i in range(400, 600)) >= 196
    assert not got[700]["is_toxic"] and not got[701]["is_toxic"] and got[702]["is_toxic"] and got[None]["is_toxic"]
    nobody = train_toxicity(docs, table.limit(0))
    assert not any(r["is_toxic"] for r in toxicity_scores(docs, nobody).collect())
    assert toxicity_scores(docs_frame(spark, []), nobody).count() == 0


# ---- 8


def test_top_k(spark):
    from millrace.llm.topk import exact_top_k

    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 420)]
    bad = [(500, None), (520, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (540, [float("nan")] * 6), (560, [1.0]), (None, [0.1] * 6), (580, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_top_k(df, k=20, pivots=8, block=32).collect())
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows}
    expected = []
    for q in x:
        if q % 20 == 0:
            best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:20]
            expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(expected)
    assert exact_top_k(df.limit(0)).count() == 0


def test_top_k_repeated_ids(spark):
    """Rows that repeat an id are queries and candidates of their own."""
    from millrace.llm.topk import exact_top_k

    rnd = np.random.default_rng(2)
    ids = [20, 20, 20, 40, 40, *range(1, 30)]
    x = np.floor(64 * rnd.normal(size=(len(ids), 4)).astype(np.float32).astype(float))
    x[1] = x[0]
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    expected = []
    for q, i in enumerate(ids):
        if i % 20 == 0:
            best = sorted((-int(x[q] @ x[c]), ids[c]) for c in range(len(ids)) if c != q)[:20]
            expected += [(i, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    got = [tuple(r) for r in exact_top_k(df, pivots=4, block=4, data_block=8).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(expected)


def test_bounds_prune():
    """Far clusters are left out, and what is needed never is."""
    from millrace.llm.topk import cell_bounds

    pivots = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    needed = cell_bounds(pivots, np.array([1.0, 0, 0]), np.array([3, 0, 0]), np.array([1.0, 1, 1]), [np.full(5, 0.5)] * 3, 2)
    assert needed[0].tolist() == [True, False, False]


# ---- 9


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["a", "über", "it's", "12", "日本", "<|endoftext|>", "\n\n"]) for _ in range(rnd.randint(0, 400))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "word " * 9000), (5, "same id"), (None, "no id"), (104, "a <|endoftext|> b"), (103, "\x00 'tis  ")]
    pieces = pack_documents(docs_frame(spark, rows), path, group_docs=16, keep_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"]) <= 2048
    for i, t in rows:
        if i == 5:
            continue
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        found = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in found for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in found)
        assert [r["start"] for r in found] == [sum(len(q["ids"]) for q in found[:k]) for k in range(len(found))]
    assert len(by_doc[5]) == 2
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(docs_frame(spark, []), path).count() == 0


def test_first_fit_decreasing():
    from millrace.llm.packing import first_fit_decreasing

    rnd = random.Random(9)
    for _ in range(50):
        sizes = np.array([rnd.randint(1, 20) for _ in range(rnd.randint(0, 40))], np.int64)
        bins, offsets = first_fit_decreasing(sizes, 20)
        room, expected = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((j for j, r in enumerate(room) if r >= sizes[i]), None)
            if k is None:
                room.append(20)
                k = len(room) - 1
            expected[i] = (k, 20 - room[k])
            room[k] -= sizes[i]
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist()))} == expected


# ---- 10


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
<div id="cookie-notice">We use cookies</div><header><p>Site</p></header><nav><ul><li>Home<li>About</ul></nav>
<div class="sidebar">Side</div><article><header><h1>A &amp; B</h1></header><p>One <b>two</b>&nbsp;three
 four<br>five<p>Six &lt;7&gt; caf&eacute; &#8212; x<!-- <p>hidden</p> --><div class="ad-box">Buy</div><form><input value=">">Name</form>
<ul><li>i<li>ii</ul><section class="comments"><p>First!</p></section></article><aside>more</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    from millrace.llm.html import main_text

    rows = [(1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, ""), (4, "http://a/4", "<article><p>cut off &am"), (5, "http://a/5", "<main><p>x</main><p>y"), (5, "http://a/5", "<article>twice<script>var")]
    body = "<div>menu of this site and all its many pages here</div><div>own words of page %s and no other page at all %s</div><div>end</div>"
    rows += [(10 + i, f"https://B.c:80/{i}", body % (f"p{i}", f"q{i}")) for i in range(4)]
    got = sorted([(r["page_id"], r["text"], r["n_chars"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()])
    texts = collections.defaultdict(list)
    for i, t, n in got:
        texts[i].append(t)
        assert n == len(t)
    assert texts[1] == ["A & B\nOne two three four five\nSix <7> café — x\ni\nii"]
    assert texts[2] == [""] and texts[3] == [""] and texts[4] == ["cut off &am"] and texts[5] == ["twice", "x"]
    assert texts[10] == ["own words of page p0 and no other page at all q0"]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_doubtful_names(spark):
    """In an article, a name with a word for boilerplate among others goes only where its text repeats on the host."""
    from millrace.llm.html import main_text

    page = (
        "<article><p>lead %s</p><div class='social-science'>about society %s</div><section id=related-work>earlier work %s</section><p class='notice-of-death'>he died %s</p>"
        "<div class='share-this-story'>pass this on to all your friends and tell them of us</div><div class='ad-box related'>buy</div><p>copied end</p></article>"
    )
    rows = [(i, f"http://h.com/{i}", page % ((f"x{i}",) * 4)) for i in range(3)] + [(3, "http://h.com/3", page % (("x0",) * 4)), (None, "http://other.com/", page % (("x9",) * 4))]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, blocks string, row int")
    for group_pages in (1, 256):
        got = {r["page_id"]: r["text"] for r in main_text(df, group_pages=group_pages).collect()}
        full = lambda k: f"lead {k}\nabout society {k}\nearlier work {k}\nhe died {k}"
        assert got[1] == full("x1") + "\ncopied end" and got[2] == full("x2") + "\ncopied end"
        assert got[None] == full("x9") + "\npass this on to all your friends and tell them of us\ncopied end"
        assert got[3] == got[0] == "lead x0\ncopied end"


def test_html_large_host(spark):
    """What repeats on few pages of a host goes, whether its pages are solved together or compared by hash."""
    from millrace.llm.html import main_text, unique_runs

    rnd = random.Random(3)
    pages = []
    for i in range(400):
        blocks = [" ".join(f"{k}{i}x{rnd.randrange(1000)}" for k in range(rnd.randint(2, 20))), f"own{i} Home"]
        blocks += ["rare banner that only five pages of this big site do show at all"] * (i % 80 == 7) + ["Home"] * (i % 100 == 1) + ["Back Home", "Home"] * (i % 100 == 2)
        blocks += ["said twice here and nowhere else on the whole wide site"] * (2 * (i == 9)) + [f"lead{i} rare banner that only five pages of this tail{i}"] * (i == 50)
        pages.append(blocks)
    seen, expected = collections.defaultdict(set), []
    runs = lambda w: [(j, tuple(w[j : j + 8])) for j in range(max(1, len(w) - 7))]
    for i, blocks in enumerate(pages):
        for b in blocks:
            for _, r in runs(b.split(" ")):
                seen[r].add(i)
    for blocks in pages:
        kept = []
        for b in blocks:
            w = b.split(" ")
            gone = {j + k for j, r in runs(w) if len(seen[r]) > 1 for k in range(8)}
            kept.append(" ".join(x for j, x in enumerate(w) if j not in gone))
        expected.append([x for x in kept if x])
    assert [[x for x in p if x] for p in unique_runs(pages, 8)] == expected
    assert not any("rare" in x or x in ("Home", "Back Home") for p in expected for x in p)
    rows = [(i, f"http://{h}/{i}", "".join(f"<div>{b}</div>" for b in blocks)) for h in ("big", "other") for i, blocks in enumerate(pages)]
    rows.append((0, "http://third/", "<div>Home</div>"))
    for group_pages in (256, 1000):
        got = collections.Counter((r["url"], r["text"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=group_pages).collect())
        assert got == collections.Counter([(f"http://{h}/{i}", "\n".join(e)) for h in ("big", "other") for i, e in enumerate(expected)] + [("http://third/", "Home")])


# ---- pipeline


def test_pipeline_edges(spark, tmp_path):
    """Each stage on an empty table, and on null ids and texts, repeated rows and extra columns."""
    import corpus_pipeline as P

    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, bad long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "an item of seven words or so here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(1, "first text of its own kind", None, None, 1, "k", 2), (None, "no id here", "en", "s", None, None, None), (2, None, "en", "s", 0, "k", 1), (3, "", "en", "s", 0, "k", 1)]
    rows += [(4, "a text that is here twice over", "en", "s", 0, "k", 1)] * 2
    for name, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), d).count() == 0, name
        found = [r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, schema), d).collect()]
        assert set(found) == {1, 2, 3, 4, None} and found.count(4) == (1 if name.startswith("n-gram") else 2), name


def test_pipeline(spark, tmp_path):
    """Each stage on planted rows: what should go goes, clean rows stay, and the last stage packs the rest."""
    import corpus_pipeline as P

    rnd = random.Random(11)
    text = lambda k, n=80: " ".join(f"{k}{rnd.randrange(10**5)}" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text("w")
        if i % 6 == 0:
            t += " vile vile"
        rows.append((i, t, "en", "s", len(t)))
        if i < 200:
            labels.append((i, 1, int(i % 6 == 0)))
    item = text("b", 30)
    base = text("n", 200).split(" ")
    near = list(base)
    near[50] = "changed"
    rows += [(400, text("x") + " " + item, "en", "s", 0), (401, " ".join(base), "en", "s", 0), (402, " ".join(near[:100]) + "\n" + " ".join(near[100:]), "en", "s", 0), (403, "only line", "en", "s", 9), (404, "only line", "en", "s", 9), (405, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left, frames = docs, []
    for name, stage in P.STAGES[:-1]:
        left = stage(spark, left, d)
        assert left.columns == P.COLUMNS, name
        frames.append({r["doc_id"] for r in left.collect()})
    assert 6 not in frames[0] and 1 in frames[0] and 404 in frames[0]
    assert 404 not in frames[1] and 403 in frames[1] and 405 in frames[1]
    assert 402 not in frames[2] and 401 in frames[2]
    assert 400 not in frames[3] and {1, 2, 401, 403, 405} <= frames[3]
    packed = P.run(spark, d)
    assert {r["doc_id"] for r in packed.collect()} == frames[3]
