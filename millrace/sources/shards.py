"""Token shards: fixed numbers of little-endian ids in headerless files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_shards(tokens: DataFrame, shard_tokens: int, wide: bool = False) -> DataFrame:
    """(shard, n, sha256, data) from rows (pos, token): `shard_tokens` ids a shard, the last one shorter.

    Ids are 16-bit, or 32-bit if `wide`; an id that doesn't fit raises. Shards are
    made one per group, so a group holds at most `shard_tokens` rows.
    """
    kind, limit = ("<u4", 1 << 32) if wide else ("<u2", 1 << 16)

    def pack(key, table):
        import hashlib

        order = np.argsort(table["pos"].to_numpy(), kind="stable")
        ids = table["token"].to_numpy()[order]
        if len(ids) and (ids.min() < 0 or ids.max() >= limit):
            raise ValueError(f"token id out of range in shard {key[0].as_py()}")
        data = ids.astype(kind).tobytes()
        return pa.table({"shard": [key[0].as_py()], "n": [len(ids)], "sha256": [hashlib.sha256(data).hexdigest()], "data": [data]})

    rows = tokens.select(F.floor(F.col("pos") / shard_tokens).alias("shard"), "pos", "token")
    return rows.groupBy("shard").applyInArrow(pack, "shard long, n long, sha256 string, data binary")


def manifest(shards: DataFrame, shard_tokens: int) -> DataFrame:
    """One row: shards, ids, whether all but the last are full, and the tree digest of their digests in order."""
    from .release import tree_digest

    records = shards.select(F.lit(0).alias("all"), "shard", "n", "sha256")
    g = records.groupBy("all").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("tokens"), F.max("shard").alias("last"), F.count_if(F.col("n") == shard_tokens).alias("full"))
    most = records.agg(F.max("shard")).first()[0] or 0
    g = g.join(tree_digest(records, ["all"], "shard", "sha256", most), "all")
    return g.select("shards", "tokens", ((F.col("last") + 1 == F.col("shards")) & (F.col("full") >= F.col("shards") - 1)).alias("whole"), "digest")


def from_shards(shards: DataFrame, shard_tokens: int, wide: bool = False) -> DataFrame:
    """(pos, token) of shards: the inverse of `to_shards`."""
    kind = "<u4" if wide else "<u2"

    def unpack(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(data, kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard * shard_tokens + np.arange(len(ids))), pa.array(ids)], ["pos", "token"])

    return shards.select("shard", "data").mapInArrow(unpack, "pos long, token long")


def write_release(spark: SparkSession, shards: DataFrame, path: str) -> None:
    """Shards as a new Parquet folder; an existing one isn't touched."""
    shards.write.mode("errorifexists").parquet(path)
