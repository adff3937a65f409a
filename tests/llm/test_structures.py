"""Conversation repair, Merkle manifest and byte-level BPE against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACES = " \t\n\x0b\f\r"

# ---- 11


def faults(rows):
    """(role, text, fault) of a conversation's rows by turn, by the contract's words."""
    key = lambda r: (r[0] is not None, r[0] or 0, H(f"{len(r[1])}:{r[1]}{r[2]}"))
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=key):
        visible = text.rstrip(SPACES)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_repair(rows):
    """All edit sequences of every conversation in breadth, kept by state: the least (cost, audit) and its lines."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    added = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    best = {0: (0, "", ())}

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                to, role = added[state]
                put(table, to, (cost + 3, audit + "I", (*lines, role + ":")))
        return table

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in inserts(best).items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                to, name = added[state]
                put(after, to, (cost + 3 + more, audit + "R", (*lines, f"{name}:{text}")))
                if (state, role[:1]) in follow:
                    put(after, follow[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        best = after
    cost, audit, lines = min(v for s, v in inserts(best).items() if s in (0, 3))
    return cost, audit, "\n".join(lines)


def conversations(seed, sizes):
    rnd, out = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["", " \n", "Yes.", "No", "Well?\n", "x" * rnd.randint(1, 5) + ".", "tail\x85", None, f"{turn}!", f"{turn}"])
            out.append((conv if conv else None, None if rnd.random() < 0.05 else turn + (turn > 3), role, text))
            if rnd.random() < 0.2:
                out.append(out[-1])
    return out


@pytest.mark.parametrize("bits", [14, 1, 2])
def test_conversation_repair(spark, monkeypatch, bits):
    """Nulls, blanks, copies, unknown roles, long conversations in one segment and in many; clashing columns."""
    from millrace.llm import repair

    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = conversations(bits, [5, 1, 2, 3, 40, 200, *[8] * 30])
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, h string")
    ids = spark.createDataFrame([(i,) for i in [*range(40), None, 3]], "conv_id long")
    got = {r["conv_id"]: r for r in repair.repair_conversations(frame.repartition(5), ids, keep_text=True).collect()}
    assert len(got) == 41
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv in [*range(40), None]:
        told = faults(by[conv])
        cost, audit, text = brute_repair(told)
        r = got[conv]
        turns = {t for t, _, _ in by[conv]} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        kinds = collections.Counter(f for _, _, f in told)
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        assert (r["cost"], r["audit"], r["repaired"]) == (cost, audit, text)
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], bad)
        assert r["repaired_sha256"] == H(text)


def test_repair_of_nothing(spark):
    from millrace.llm.repair import repair_conversations

    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(none).collect() == []
    (only,) = repair_conversations(none, spark.createDataFrame([(7,)], "conv_id long")).collect()
    assert (only["conv_id"], only["cost"], only["audit"], only["repaired_sha256"]) == (7, 0, "", H(""))


def test_distances_by_relaxation():
    """Dial's queue against Bellman-Ford on random rows and ends."""
    from millrace.llm import repair as R

    rnd = random.Random(3)
    for _ in range(60):
        codes = "".join(chr(65 + rnd.randrange(12)) for _ in range(rnd.randrange(9)))
        ends = [rnd.choice([0, 1, 5, 30, R._FAR]) for _ in range(4)]
        arcs = [(4 * i + s, 4 * i + R._ADDED[s], 3) for i in range(len(codes) + 1) for s in range(4)]
        arcs += [(4 * i + s, 4 * i + 4 + to, cost) for i, c in enumerate(codes) for s in range(4) for cost, to in R._MOVES[c][s].values()]
        found = [R._FAR] * (4 * len(codes)) + ends
        for _ in range(len(found)):
            for a, b, cost in arcs:
                found[a] = min(found[a], found[b] + cost)
        assert [min(x, R._FAR) for x in found] == R.distances(codes, ends)


# ---- 12


def brute_tree(leaves):
    """Root, and the siblings of each leaf as (side, digest), level by level."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for j, at in enumerate(place):
            if at ^ 1 < len(level):
                paths[j].append(("L" if at & 1 else "R", level[at ^ 1]))
            else:
                paths[j].append(("N", ""))
        level = [H("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        place = [at >> 1 for at in place]
    return level[0], paths


@pytest.mark.parametrize("layer", [1, 2, 3])
def test_fractal_paths(layer):
    from millrace.llm.merkle import fold, fractal_paths

    for n in [*range(1, 18), 31, 33, 64]:
        leaves = [H(str(i)) for i in range(n)]
        root, paths = brute_tree(leaves)
        got = [[x.decode() for x in steps] for steps in fractal_paths([x.encode() for x in leaves], (n - 1).bit_length(), layer)]
        assert got == [[side + h for side, h in path] for path in paths]
        for x, steps in zip(leaves, got):
            assert fold(x.encode(), [s.encode() for s in steps]).decode() == root


@pytest.mark.parametrize("bits", [12, 2, 1])
def test_merkle_manifest(spark, bits):
    """Groups of 1 to 70 leaves and more groups than a block has; nulls, repeated rows, clashing columns."""
    from millrace.llm.merkle import merkle_manifest

    rnd = random.Random(bits)
    sizes = {"en": 70, "dé": 5, None: 9, "": 1, "zh": 16, "x": 17, "y": 2}
    rows = [(None if rnd.random() < 0.02 else rnd.randrange(10**6), rnd.choice(["ä text", "", None, "x" * 3000]), lang, rnd.choice(["s", None]), rnd.choice([3, None, -1])) for lang, n in sizes.items() for _ in range(n)]
    rows += [rows[0], rows[0]]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, width int")
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle_manifest(frame.repartition(5), audited={"n_chars": changed}, block_levels=bits).collect()

    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H("".join(map(field, (r[0], r[3], r[2], n, r[1]))))
    groups = collections.defaultdict(list)
    for r in rows:
        now = r[4] + 1 if r[0] is not None and r[0] % 3 == 0 and r[4] is not None else r[4]
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, now)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, upper = brute_tree([trees[g][0] for g in names])
    expected = []
    for g, above in zip(names, upper):
        for (known, doc, own, now), path in zip(sorted(groups[g]), trees[g][1]):
            at = now
            for side, h in path + above:
                at = H(h + at if side == "L" else at + h)
            expected.append((doc if known else None, own, trees[g][0], root, H("".join(h for _, h in path + above)), at, at == root))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(([r[c] for c in columns] for r in got), key=str) == sorted(map(list, expected), key=str)
    assert {len(r["proof"]) > 0 for r in got} == {True}


def test_manifest_of_nothing_and_of_one(spark):
    from millrace.llm.merkle import merkle_manifest

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle_manifest(spark.createDataFrame([], schema)).collect() == []
    (one,) = merkle_manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == H("1:1----") and one["verified"] and one["proof_sha256"] == H("")


# ---- 13


def test_byte_bpe(spark):
    """Ids as tiktoken's; nulls, empty and long texts, repeated rows, null ids, clashing columns; and the way back."""
    import public_tokenizers as P
    import tiktoken

    from millrace.llm.piece_bpe import encode_decode, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rnd = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "é", "中文", "123", "'s", "'ll", "'", "!?", "\U0001f600", "\x00", "\x1c", "\x85", "ing", " ", "<|endoftext|>", "½", "ٳ", "Straße"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "a" * 50000, " " * 5000, "é中 word " * 200000, "plain words of latin " * 70000, texts[0], texts[0]]
    rows = [(i if i % 50 else None, t, 1, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = encode_decode(frame, path, P.PATTERN, keep_ids=True).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    expected = []
    for doc, text, _, _ in rows:
        ids = own.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), H(text or "")))
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(expected, key=key)
    assert all(bytes(r["decoded"]) == own.decode_bytes(r["ids"]) for r in got if r["n_tokens"] < 1000)
    assert encode_decode(frame.limit(0), path, P.PATTERN).collect() == []


def test_every_character_is_cut_as_by_tiktoken():
    import public_tokenizers as P
    import tiktoken

    from millrace.llm import piece_bpe as B

    ranks = B.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = B.Codec(B.serialise_model(ranks), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"a {chr(c)}{chr(c)} b{chr(c)}1" for c in itertools.chain(range(0x3500), range(0xA000, 0xD800), range(0xE000, 0x11000), range(0x1D000, 0x1F000), range(0x11000, 0x110000, 97))]
    got = dict(codec.encode(texts))
    assert [np.frombuffer(got[i], "<u4").tolist() for i in range(len(texts))] == own.encode_ordinary_batch(texts)
    assert all(codec.decode(got[i]).decode() == t for i, t in enumerate(texts))


def test_tokens_by_merges_and_faulty_vocabularies():
    """A token that no merges reach is still found as a whole; ranks with holes or without a byte raise."""
    import tiktoken

    from millrace.llm import piece_bpe as B

    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"ab": 257, b"abc": 258}
    codec = B.Codec(B.serialise_model(ranks), r"\S+|\s+")
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzx xyz", "abcab abc", "aabcc"):
        assert [x for _, ids in codec.encode([text]) for x in np.frombuffer(ids, "<u4").tolist()] == own.encode_ordinary(text)
    for faulty in ({b"a": 0}, {bytes([b]): b + 1 for b in range(256)}):
        with pytest.raises(ValueError):
            B.serialise_model(faulty)


# ---- whole tables against SQL


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest"])
def test_oracle(spark, name):
    import os

    from millrace.llm.queries import ORACLE_SQL, QUERIES

    from ..compare import connect, same

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])
