"""What is written on the way: narrow rows for similar texts, no shuffle files left behind."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup as D
from millrace.sources import tables

SCHEMA = "id long, text string, source string"


def shuffled(spark):
    """Bytes of shuffle written by the session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(x.shuffleWriteBytes() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def brute(rows, n, threshold):
    sets = {}
    for i, text, source in rows:
        words = (text or "").split()
        if i is not None:
            sets.setdefault(i, set()).update((source if source is not None else (i,), *words[k : k + n]) for k in range(len(words) - n + 1))
    ids = sorted(i for i in sets if sets[i])
    found = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b}
    return {p: round(s, 9) for p, s in found.items() if s >= threshold}


def cases(seed):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        words = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))]
        for _ in range(8):
            copy = [w if rng.random() > 0.06 else "x" + str(rng.randrange(99)) for w in words]
            rows.append((len(rows), " ".join(copy), rng.choice(["s", "s", "t", None])))
    rows += [(i + 100, t, s) for i, t, s in rows[::5]]  # equal sets
    rows += [(i, t, "s") for i, t, _ in rows[3:12:4]]  # ids that repeat with other texts
    rows += [(None, rows[0][1], "s"), (900, None, "s"), (901, "", "s"), (902, "a b", "s"), (903, "a b c", "s"), (904, "a b c", "s")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("threshold", "large"), [(0.2, True), (0.6, False), (0.95, True)])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, large):
    if large:
        monkeypatch.setattr(D, "BLOCK_ROWS", 3)
        monkeypatch.setattr(D, "MOST_LIVE", 0)
    rows = cases(threshold)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = D.jaccard_pairs(df, "id", "text", "source", 3, threshold).collect()
    expected = brute(rows, 3, threshold)
    assert len(found) == len(expected)
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in found} == expected
    kept = set()
    for i in sorted({r[0] for r in rows if r[0] is not None}):
        if not any((k, i) in expected for k in kept):
            kept.add(i)
    got = [r["id"] for r in D.greedy_similar(df, "id", "text", "source", 3, threshold).collect()]
    assert sorted(i for i in got if i is not None) == sorted(kept) and got.count(None) == 1


def test_overlaps_of_common_and_rare_shingles():
    rng = random.Random(5)
    sets = [sorted({0, 1, *rng.sample(range(2, 60), 12)}) for _ in range(40)]
    table = lambda left, i, j: pa.table({"id": list(range(40)), "i": [i] * 40, "j": [j] * 40, "left": left, "s": pa.array(sets, pa.list_(pa.int64()))})
    like = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    whole = D._overlaps(0.3)(table([True] * 40, 1, 1)).to_pylist()
    assert {(r["a"], r["b"]): r["similarity"] for r in whole} == {(a, b): like(a, b) for a in range(40) for b in range(a + 1, 40) if like(a, b) >= 0.3}
    across = D._overlaps(0.3)(table([k % 2 == 1 for k in range(40)], 1, 2)).to_pylist()
    assert {(r["a"], r["b"]): r["similarity"] for r in across} == {(a, b): like(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 2 and like(a, b) >= 0.3}


def test_texts_without_a_partner_make_no_shingle_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(1500)), "s") for i in range(200)]
    df = tables.written(spark.createDataFrame(rows, SCHEMA), "texts")
    before = shuffled(spark)
    assert D.jaccard_pairs(df, "id", "text", "source", 3, 0.6).count() == 0
    assert shuffled(spark) - before < sum(len(r[1]) for r in rows)  # some 2 MB; a row for each shingle takes several times the texts


def test_near_copies_are_not_sent_for_each_pair(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in base), "s") for i in range(150)]
    df = tables.written(spark.createDataFrame(rows, SCHEMA), "texts")
    before = shuffled(spark)
    assert D.jaccard_pairs(df, "id", "text", "source", 3, 0.6).count() > 10_000
    assert shuffled(spark) - before < 6 * sum(len(r[1]) for r in rows)  # two sets of 398 hashes for each of 11,000 pairs are 100 times as much


def test_written_tables_leave_no_shuffle_files(spark):
    materialise = pytest.importorskip("millrace.llm.runtime").materialise

    df = spark.range(20_000).repartition(4).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    for write in (tables.written, materialise):
        before = shuffle_files(spark)
        assert write(df, "rows").count() == 7
        # the count's own files may stay
        write(df, "rows")
        assert len([f for f in shuffle_files(spark) - before if f.endswith(".data")]) <= 1
    assert spark.conf.get(tables.CLEANUP, None) is None
