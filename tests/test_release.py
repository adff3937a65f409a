"""Releases: whole and checked, or not there; every planted fault is named."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import select as S
from millrace.sources import release as R


def runs(spark, sizes=(5, 1, 9, 4, 13), split="train", base=0):
    rows, at = [], 0
    for n in sizes:
        rows.append((split, at, [(base + at + i) % 65536 for i in range(n)]))
        at += n
    return spark.createDataFrame(rows, "split string, start long, ids array<int>")


def left(tmp_path):
    return sorted(x for x in os.listdir(tmp_path) if not x.startswith("."))


@pytest.mark.parametrize("wide", [False, True])
def test_release_round_trip(spark, tmp_path, wide):
    path = f"file://{tmp_path}/r1"
    both = runs(spark).unionByName(runs(spark, (8, 8), "val", 70 if not wide else 0)).unionByName(spark.createDataFrame([("val", 3, []), ("val", 4, None)], "split string, start long, ids array<int>"))
    R.write_release(spark, both.repartition(3), path, 8, wide, {"train": 32, "val": 16})
    assert left(tmp_path) == ["r1"] and R.release_faults(spark, path).count() == 0
    records = {(r["split"], r["shard"]): r for r in R.read_manifest(spark, path).collect()}
    assert sorted(records) == [("train", 0), ("train", 1), ("train", 2), ("train", 3), ("val", 0), ("val", 1)]
    r = records["train", 1]
    assert r["token_count"] == 8 and r["size_bytes"] == (32 if wide else 16) and r["sha256"] == hashlib.sha256(np.arange(8, 16).astype("<u4" if wide else "<u2").tobytes()).hexdigest()
    got = sorted((r["split"], r["start"], r["ids"]) for r in R.release_ids(spark, path).collect())
    assert [x for s, _, ids in got for x in ids if s == "train"] == list(range(32))
    with pytest.raises(FileExistsError):
        R.write_release(spark, both, path, 8, wide)
    assert left(tmp_path) == ["r1"]


def test_refused_releases_leave_nothing(spark, tmp_path):
    """Gaps, overlaps, ids that don't fit, and a source that is exhausted."""
    good = runs(spark)
    cases = {
        "gap": (good.where("start <> 5"), {}),
        "overlap": (good.withColumn("start", F.when(F.col("start") == 6, 5).otherwise(F.col("start"))), {}),
        "range": (runs(spark, base=0).withColumn("ids", F.transform("ids", lambda x: x + 65530)), {}),
        "negative": (good.withColumn("ids", F.transform("ids", lambda x: x - 1)), {}),
        "short": (good, {"train": 33}),
        "absent": (good, {"val": 1}),
    }
    for name, (frame, targets) in cases.items():
        with pytest.raises(Exception) as error:
            R.write_release(spark, frame, f"file://{tmp_path}/{name}", 8, False, targets)
        if targets:
            assert isinstance(error.value, R.SourceExhaustedError)
        (audit,) = [x for x in left(tmp_path) if x.startswith(name)]
        assert audit.startswith(f"{name}.failed-")
        said = spark.read.json(f"file://{tmp_path}/{audit}").first()
        assert said["published"] is False and said["requested"].endswith(name)
    assert all(".failed-" in x for x in left(tmp_path))


def test_a_shard_that_changes_while_staged_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    found = []

    def harmed(session, staging):
        shards = session.read.parquet(f"{staging}/shards").withColumn("data", F.when(F.col("shard") == 1, F.unhex(F.lit("00" * 16))).otherwise(F.col("data")))
        shards.write.parquet(f"{staging}/other")
        fs, at = R._fs(session, staging)
        fs.delete(at(f"{staging}/shards"), True)
        fs.rename(at(f"{staging}/other"), at(f"{staging}/shards"))
        found.extend(R.release_faults(session, staging).collect())
        return check(session, staging)

    check = R.require_release
    monkeypatch.setattr(R, "require_release", harmed)
    with pytest.raises(R.ReleaseError, match="sha256 in train, shard 1"):
        R.write_release(spark, runs(spark), path, 8)
    assert [tuple(r) for r in found] == [("sha256", "train", 1)] and left(tmp_path) and all(".failed-" in x for x in left(tmp_path))


def test_faults_of_manifest_and_meta(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    R.write_release(spark, runs(spark), path, 8)

    def copy(name, manifest=None, meta=None):
        out = f"file://{tmp_path}/{name}"
        spark.read.parquet(f"{path}/shards").write.parquet(f"{out}/shards")
        (manifest(R.read_manifest(spark, path)) if manifest else R.read_manifest(spark, path)).write.json(f"{out}/manifest")
        lines = spark.read.schema(R.META).json(f"{path}/meta")
        (meta(lines) if meta else lines).write.json(f"{out}/meta")
        return out

    kinds = lambda out: {(r["kind"], r["shard"]) for r in R.release_faults(spark, out).collect()}
    assert kinds(copy("same")) == set()
    assert kinds(copy("gone", lambda m: m.where("shard <> 2"))) == {("extra", 2), ("sequence", None), ("totals", None), ("digest", None)}
    assert kinds(copy("count", lambda m: m.withColumn("token_count", F.when(F.col("shard") == 1, 7).otherwise(F.col("token_count"))))) == {("record", 1), ("totals", None)}
    assert kinds(copy("hash", lambda m: m.withColumn("sha256", F.when(F.col("shard") == 1, "x").otherwise(F.col("sha256"))))) == {("sha256", 1), ("digest", None)}
    assert kinds(copy("order", lambda m: m.withColumn("shard", F.when(F.col("shard") == 3, 9).otherwise(F.col("shard"))))) >= {("missing", 9), ("extra", 3), ("sequence", None)}
    for name, meta in (("failed", lambda m: m.withColumn("status", F.lit("failed"))), ("dtype", lambda m: m.withColumn("dtype", F.lit("int8"))), ("two", lambda m: m.union(m))):
        with pytest.raises(R.ReleaseError):
            R.release_faults(spark, copy(name, meta=meta))
    with pytest.raises(R.ReleaseError, match="no complete"):
        R.release_ids(spark, f"file://{tmp_path}/nowhere")


@pytest.mark.parametrize("n", [1, 3, 4, 5, 16, 17, 70])
def test_tree_digest(spark, n):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = digests
    while True:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        if len(level) == 1:
            break
    frame = spark.createDataFrame([("a", i, d) for i, d in enumerate(digests)], "g string, i long, d string").repartition(3)
    assert [tuple(r) for r in R.tree_digest(frame, ["g"], "i", "d", n - 1, 4).collect()] == [("a", level[0])]


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_running_total_bins(spark, digits):
    rows = [(i % 3 or None, hashlib.sha256(str(i // 2).encode()).hexdigest(), i, i % 7) for i in range(300)]
    frame = spark.createDataFrame(rows, "g long, h string, id long, n long")
    got = {r["id"]: r["running"] for r in S.running_total(frame, ["g"], ["h", "id"], "n", digits=digits).collect()}
    totals, expected = {}, {}
    for g, h, i, n in sorted(rows, key=lambda r: r[1:3]):
        totals[g] = expected[i] = totals.get(g, 0) + n
    assert got == expected
    assert S.rank_digits(spark.range(10)) == 0
