"""Releases of token shards: built beside their place, read back and checked, then published by one rename, or refused.

A release is a folder with `shards` (a row for each shard, its ids as little-endian bytes), `manifest` (a JSON line
for each shard: split, shard, token_count, size_bytes, sha256) and `meta` (one JSON line: geometry, totals and a
digest for each split). Nothing about single shards comes to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "split string, shard long, token_count long, size_bytes long, sha256 string"
META = "schema_version int, status string, dtype string, shard_tokens long, splits array<struct<split string, tokens long, shards long, digest string>>"
_FAULT = "kind string, split string, shard long"


class ReleaseError(RuntimeError):
    """A release that may not be published or used."""


class SourceExhaustedError(ReleaseError):
    """A split has fewer tokens than were asked for."""


def tree_digest(rows: DataFrame, groups: list[str], index: str, digest: str, most: int, fan: int = 1024) -> DataFrame:
    """(groups, digest): SHA-256 over `fan` digests at a time in order of `index` (0, 1, ...), level by level, up to one a group.

    `most` is the largest index; a group of one row is hashed once too. No task gets more than `fan` rows of a group.
    """
    level = rows.select(*groups, F.col(index).alias("_i"), F.col(digest).alias("_d"))
    while True:
        runs = level.groupBy(*groups, F.expr(f"_i div {fan}").alias("_j")).agg(F.array_sort(F.collect_list(F.struct("_i", "_d"))).alias("_x"))
        level = runs.select(*groups, F.col("_j").alias("_i"), F.sha2(F.array_join(F.transform("_x", lambda x: x["_d"]), ""), 256).alias("_d"))
        most //= fan
        if most <= 0:
            return level.select(*groups, F.col("_d").alias("digest"))


def pack_runs(runs: DataFrame, shard_tokens: int, wide: bool = False) -> DataFrame:
    """(split, shard, token_count, size_bytes, sha256, data) from runs (split, start, ids) of a split's stream of ids.

    A run is cut at the shards' edges, so a task holds the ids of one shard. Ids are 16-bit, or 32-bit if `wide`.
    Runs that overlap or leave a gap raise, and so does an id that doesn't fit. Empty and null runs are nothing.
    """
    kind, limit = ("<u4", 1 << 32) if wide else ("<u2", 1 << 16)
    full = runs.select("split", "start", "ids").where("size(ids) > 0")
    cut = full.select("split", "start", "ids", F.explode(F.expr(f"sequence(start div {shard_tokens}L, (start + size(ids) - 1) div {shard_tokens}L)")).alias("shard"))
    low = F.greatest(F.col("shard") * shard_tokens, F.col("start"))
    high = F.least((F.col("shard") + 1) * shard_tokens, F.col("start") + F.size("ids"))
    pieces = cut.select("split", "shard", low.alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))

    def pack(key, table):
        table = table.sort_by("at")
        lists = table["ids"].combine_chunks()
        at, sizes = table["at"].to_numpy(), lists.value_lengths().to_numpy()
        split, shard = key[0].as_py(), key[1].as_py()
        if at[0] != shard * shard_tokens or (at[1:] != at[:-1] + sizes[:-1]).any():
            raise ValueError(f"runs of shard {shard} of {split} overlap or leave a gap")
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if ids.min() < 0 or ids.max() >= limit:
            raise ValueError(f"token id out of range in shard {shard} of {split}")
        data = ids.astype(kind).tobytes()
        return pa.table({"split": pa.array([split], pa.string()), "shard": [shard], "token_count": [len(ids)], "size_bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "data": pa.array([data], pa.binary())})

    return pieces.groupBy("split", "shard").applyInArrow(pack, RECORD + ", data binary")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _summary(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(split, tokens, shards, digest) of manifest rows."""
    most = records.agg(F.max("shard")).first()[0] or 0
    totals = records.groupBy("split").agg(F.sum("token_count").alias("tokens"), F.count(F.lit(1)).alias("shards"))
    return totals.join(tree_digest(records, ["split"], "shard", "sha256", most), "split")


def write_release(spark: SparkSession, runs: DataFrame, path: str, shard_tokens: int, wide: bool = False, targets: dict[str, int] | None = None) -> None:
    """Publish `runs` as a release at `path`: whole and checked, or not at all.

    An existing `path` is refused. Shards, manifest and meta are written to a folder beside it and read back;
    a shard that isn't what its record says, a total that differs from that of the runs, and a
    split with fewer tokens than its target raise. Then one rename publishes the folder. After a failure there is
    neither `path` nor the folder beside it, only `<path>.failed-<id>` with a line that says why.
    """
    fs, at = _fs(spark, path)
    path = path.rstrip("/")
    if fs.exists(at(path)):
        raise FileExistsError(f"refusing to mix with what is at {path}")
    parent, name = path.rsplit("/", 1)
    staging = f"{parent}/_{name}.building-{uuid.uuid4().hex}"
    try:
        pack_runs(runs, shard_tokens, wide).write.parquet(f"{staging}/shards")
        spark.read.parquet(f"{staging}/shards").drop("data").write.json(f"{staging}/manifest")
        splits = _summary(spark, spark.read.schema(RECORD).json(f"{staging}/manifest")).collect()  # a row for each split
        have = {r["split"]: r["tokens"] for r in splits}
        given = {r["split"]: r["n"] for r in runs.groupBy("split").agg(F.sum(F.greatest(F.size("ids"), F.lit(0))).alias("n")).where("n > 0").collect()}
        if have != given:
            raise ReleaseError(f"shards hold {have} tokens, the runs {given}")
        short = {s: (given.get(s, 0), t) for s, t in (targets or {}).items() if given.get(s, 0) < t}
        if short:
            raise SourceExhaustedError(f"exhausted before the target: {short}")
        rows = [(1, "complete", "uint32" if wide else "uint16", shard_tokens, [tuple(r) for r in splits])]
        spark.createDataFrame(rows, META).coalesce(1).write.json(f"{staging}/meta")
        require_release(spark, staging)
        if fs.exists(at(path)):
            raise FileExistsError(f"{path} appeared meanwhile")
        if not fs.rename(at(staging), at(path)):
            raise ReleaseError(f"{staging} couldn't be renamed to {path}")
    except BaseException as error:
        fs.delete(at(staging), True)
        said = spark.createDataFrame([(type(error).__name__, str(error)[:2000], path, False)], "error_type string, error string, requested string, published boolean")
        said.coalesce(1).write.json(f"{path}.failed-{uuid.uuid4().hex}")
        raise


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(f"{path}/manifest")


def release_faults(spark: SparkSession, path: str) -> DataFrame:
    """(kind, split, shard): what is wrong with a release, nothing if it is whole. ReleaseError without manifest or meta.

    Kinds: missing (recorded, not there), extra (there, not recorded), repeated, record (its counts don't
    fit the geometry), size and sha256 (the bytes aren't the recorded ones), sequence (a split's records aren't 0 to
    n - 1), totals and digest (a split's records don't add up to the meta line; shard null).
    """
    fs, at = _fs(spark, path)
    for part in ("meta", "manifest", "shards"):
        if not fs.exists(at(f"{path}/{part}/_SUCCESS")):
            raise ReleaseError(f"{path} has no complete {part}")
    metas = spark.read.schema(META).json(f"{path}/meta").collect()
    if len(metas) != 1 or metas[0]["status"] != "complete" or metas[0]["schema_version"] != 1 or metas[0]["dtype"] not in ("uint16", "uint32") or not metas[0]["shard_tokens"] or metas[0]["shard_tokens"] < 1:
        raise ReleaseError(f"{path} has no valid meta line")
    meta = metas[0]
    width, tokens = 2 if meta["dtype"] == "uint16" else 4, meta["shard_tokens"]
    splits = spark.createDataFrame([tuple(x) for x in meta["splits"] or []], "split string, tokens long, shards long, digest string")
    records = read_manifest(spark, path)
    found = spark.read.parquet(f"{path}/shards").select("split", "shard", F.length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha"))
    found = found.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("files"), F.min("bytes").alias("bytes"), F.min("sha").alias("sha"))
    both = records.withColumn("recorded", F.lit(True)).join(found, ["split", "shard"], "full").join(F.broadcast(splits.select("split", "tokens", "shards")), "split", "left")
    due = F.when(F.col("shard") == F.col("shards") - 1, F.col("tokens") - F.lit(tokens) * (F.col("shards") - 1)).otherwise(F.lit(tokens))
    there = F.col("recorded") & F.col("files").isNotNull()
    fits = F.coalesce((F.col("token_count") == due) & (F.col("size_bytes") == F.col("token_count") * width), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(F.col("files").isNull(), "missing"),
        F.when(F.col("recorded").isNull(), "extra"),
        F.when(F.col("files") > 1, "repeated"),
        F.when(F.col("recorded") & ~fits, "record"),
        F.when(there & ~F.col("bytes").eqNullSafe(F.col("size_bytes")), "size"),
        F.when(there & ~F.col("sha").eqNullSafe(F.col("sha256")), "sha256"),
    ))
    shards = both.select(F.explode(kinds).alias("kind"), "split", "shard")
    own = _summary(spark, records.dropDuplicates(["split", "shard"]))
    ends = records.groupBy("split").agg(F.min("shard").alias("least"), F.max("shard").alias("most"), F.count(F.lit(1)).alias("n"))
    compared = own.select("split", *[F.col(c).alias(f"_{c}") for c in ("tokens", "shards", "digest")]).join(ends, "split").join(splits, "split", "full")
    wrong = F.array_compact(F.array(
        F.when(~F.coalesce((F.col("least") == 0) & (F.col("most") == F.col("n") - 1), F.lit(False)), "sequence"),
        F.when(~F.col("_tokens").eqNullSafe(F.col("tokens")) | ~F.col("_shards").eqNullSafe(F.col("shards")), "totals"),
        F.when(~F.col("_digest").eqNullSafe(F.col("digest")), "digest"),
    ))
    return reduce(DataFrame.unionByName, [shards, compared.select(F.explode(wrong).alias("kind"), "split", F.lit(None).cast("long").alias("shard"))])


def require_release(spark: SparkSession, path: str) -> None:
    """ReleaseError that names the first faults, unless the release is whole."""
    faults = release_faults(spark, path).limit(5).collect()
    if faults:
        raise ReleaseError(f"{path}: " + "; ".join(f"{r['kind']} in {r['split']}" + (f", shard {r['shard']}" if r["shard"] is not None else "") for r in faults))


def unpack_shards(batches, kind: str, step: int):
    """(split, start, ids) of shards (split, shard, data), one at a time: besides the batch a task holds the ids of one shard."""
    for b in batches:
        for row in range(b.num_rows):
            split, shard, data = (b.column(k)[row] for k in range(3))
            ids = np.frombuffer(data.as_buffer(), kind).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array([split.as_py()], pa.string()), pa.array([shard.as_py() * step]), runs], ["split", "start", "ids"])


def release_ids(spark: SparkSession, path: str) -> DataFrame:
    """(split, start, ids) of a release that `require_release` accepts: a run for each shard."""
    require_release(spark, path)
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    kind, step = "<u2" if meta["dtype"] == "uint16" else "<u4", meta["shard_tokens"]
    shards = spark.read.parquet(f"{path}/shards").select("split", "shard", "data")
    return shards.mapInArrow(lambda batches: unpack_shards(batches, kind, step), "split string, start long, ids array<int>")
