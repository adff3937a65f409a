"""Groups of near copies: the pairs that are compared, and that no link is lost."""

import random

from pyspark.sql import functions as F

from millrace.llm.components import components_from_buckets


def test_near_copies_that_differ_too_much_make_few_pairs(spark):
    rng, sets, new = random.Random(5), {}, 1000
    for i in range(200):
        grams = set(range(200))
        for at in rng.sample(range(20), rng.choice((1, 1, 1, 2, 3, 3))):  # edits of six n-grams, and one with those beside it
            grams -= set(range(10 * at, 10 * at + 6))
            grams |= set(range(new, new + 6))
            new += 6
        sets[i] = grams
    sets[200] = sets[7] - set(range(0, 200, 50)) | {1, 2}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and linked(a, b) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {i: low if c == high else c for i, c in want.items()}
    grams = spark.createDataFrame([(i, g) for i, s in sets.items() for g in sorted(s)], "id long, gram long")
    arrays = grams.groupBy("id").agg(F.collect_list("gram").alias("g")).cache()
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        both = pairs.join(arrays.toDF("a", "ga"), "a").join(arrays.toDF("b", "gb"), "b")
        return both.select("a", "b", (100 * F.size(F.array_intersect("ga", "gb")) >= 90 * F.size(F.array_union("ga", "gb"))).alias("linked"))

    shared = spark.createDataFrame([(b, i, 2) for i in sets for b in (1, 2)], "bucket long, id long, k int")
    out = components_from_buckets(shared, lambda rows: grams.join(rows, "id", "left_semi"), verify, 90).collect()
    got = {i: i for i in sets} | {r["id"]: r["component"] for r in out}
    assert got == want
    assert len(set(want.values())) > 50  # many stay alone
    assert sum(asked) < 4 * len(sets), asked


def test_only_places_that_can_meet_are_listed(spark, monkeypatch):
    """Unrelated sets of one crowded bucket: most of their n-grams lie behind the last place at which a link could show. Before, each was a row."""
    from millrace.llm import components as C

    rng = random.Random(6)
    sets = {i: frozenset(rng.sample(range(400), 50)) for i in range(60)}
    sets[60], sets[61] = sets[3] - {min(sets[3])}, sets[5] | {1000, 1001}
    grams = spark.createDataFrame([(i, g) for i, s in sets.items() for g in sorted(s)], "id long, gram long")
    arrays = grams.groupBy("id").agg(F.collect_list("gram").alias("g")).cache()

    def verify(pairs):
        both = pairs.join(arrays.toDF("a", "ga"), "a").join(arrays.toDF("b", "gb"), "b")
        return both.select("a", "b", (100 * F.size(F.array_intersect("ga", "gb")) >= 80 * F.size(F.array_union("ga", "gb"))).alias("linked"))

    listed, plain = [], C.materialise

    def counted(df, name):
        out = plain(df, name)
        if name == "places":
            listed.append(out.count())
        return out

    monkeypatch.setattr(C, "materialise", counted)
    shared = spark.createDataFrame([(1, i, 1) for i in sets], "bucket long, id long, k int")
    out = C.components_from_buckets(shared, lambda rows: grams.join(rows, "id", "left_semi"), verify, 80).collect()
    got = {r["id"]: r["component"] for r in out}
    assert {i: c for i, c in got.items() if c != i} == {60: 3, 61: 5}
    assert 0 < listed[0] < len(sets) * 50 // 3, listed


def test_unrelated_sets_share_no_fragments_and_linked_ones_several():
    """Before, a tenth of the sets at a band's lower end signed their empty fragments, which they all shared."""
    import numpy as np

    from millrace.llm.components import KIND, SINGLE
    from millrace.llm.ngram_join import AGREE, fragment_signatures

    rng = np.random.default_rng(7)

    def signed(sets, percent):
        grams = [np.sort(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        who, signature = fragment_signatures(np.concatenate(grams), owner, np.array([len(s) for s in sets]), percent)
        return [set(signature[who == i].tolist()) for i in range(len(sets))]

    new = lambda n: rng.integers(0, 2**64, n, np.uint64)
    alone = signed([new(n) for n in range(100, 160) for _ in range(5)], 80)
    seen = {}
    for i, found in enumerate(alone):
        for x in found:
            seen.setdefault(x, set()).add(i)
    assert sum(len(x) > 1 for x in seen.values()) < 5
    for percent in (80, 90):
        for n in (1, 2, 3, 5, 8, 13, 22, 23, 24, 29, 47, 73, 128, 146, 300, 1000):
            for _ in range(12):
                a = new(n)
                d = (2 * n * (100 - percent) // (100 + percent)) if n > 4 else 0
                keep = n - int(rng.integers(0, d // 2 + 1))  # the differences on either side, or all on one
                b = np.append(a[:keep], new(n - keep))
                if rng.random() < 0.5:
                    b = a[: -(-n * percent // 100)]
                both = len(set(a.tolist()) & set(b.tolist()))
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                x, y = signed([a, b], percent)
                common = x & y
                kinds = [sum(not c & SINGLE and c & KIND == k for c in common) for k in (0, KIND)]
                assert max(kinds) >= AGREE or any(c & SINGLE for c in common), (percent, n, kinds)


def test_crowds_that_share_one_bucket_make_no_pairs(spark):
    """Ids of crowded buckets: linked ones meet in three, others in one or two. Before, all n-grams of the crowd were listed."""
    rng, sets, rows = random.Random(9), {}, []
    for i in range(120):
        sets[i] = frozenset(rng.sample(range(100_000), 40))
    for i, base in ((120, 3), (121, 3), (122, 8), (123, 9), (124, 10)):
        sets[i] = sets[base] - {min(sets[base])}
    alike = {120: 3, 121: 3, 122: 8, 123: 9, 124: 10}
    crowds = [4 * b for b in range(1, 9)]  # of one kind
    of = {i: set(rng.sample(crowds, 2)) for i in range(120)}
    of[3], of[8], of[9] = set(crowds[:3]), set(crowds[1:4]), {crowds[0], crowds[1], 4000}  # small ones count too
    of[10] = {crowds[0], 4001}  # SINGLE
    for i, base in alike.items():
        of[i] = of[base]
    rows = [(b, i) for i in of for b in of[i]]
    of_many = [(4 * b, 7) for b in range(2000, 2020)] + [(4 * b, 11) for b in range(2000, 2020)]
    rows = sorted({*rows, *of_many})
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    grams = spark.createDataFrame([(i, g) for i, s in sets.items() for g in sorted(s)], "id long, gram long")
    arrays = grams.groupBy("id").agg(F.collect_list("gram").alias("g")).cache()
    asked, listed = [], []

    def verify(pairs):
        asked.append(pairs.count())
        both = pairs.join(arrays.toDF("a", "ga"), "a").join(arrays.toDF("b", "gb"), "b")
        return both.select("a", "b", (100 * F.size(F.array_intersect("ga", "gb")) >= 80 * F.size(F.array_union("ga", "gb"))).alias("linked"))

    def grams_of(some):
        out = grams.join(some, "id", "left_semi")
        listed.append(out.count())
        return out

    shared = spark.createDataFrame(rows, "bucket long, id long")
    held = shared.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    out = components_from_buckets(shared.join(held, "id"), grams_of, verify, 80, 3).collect()
    assert linked(120, 3) and linked(124, 10) and not linked(3, 8)
    assert {r["id"]: r["component"] for r in out if r["component"] != r["id"]} == alike
    assert sum(asked) < 40 and sum(listed) < 500, (asked, listed)
