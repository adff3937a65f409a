"""Resumable extraction of blobs: a content-addressed store, strict decoding, and batches that can be run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("kept", "fetch_failed", "decode_failed", "empty_rejected", "length_rejected")
_STORE = "digest string, raw binary"
_ROWS = "blob_id string, status string, text string, cached boolean"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _batches(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, folder)
    if not fs.exists(at(folder)):
        return []
    return sorted(int(n.removeprefix("batch=")) for n in (x.getPath().getName() for x in fs.listStatus(at(folder))) if n.removeprefix("batch=").isdigit())


def _read(spark: SparkSession, folder: str, schema: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/batch={b}" for b in batches])


def blob_digest(blob_id):
    """Where a blob is kept: the digest of its id."""
    return F.sha2(blob_id, 256)


def _bound_to(spark: SparkSession, out: str, config: dict) -> None:
    """An output belongs to one configuration; going on with another one is refused."""
    fs, at = _fs(spark, out)
    own = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    if not fs.exists(at(f"{out}/config/_SUCCESS")):
        spark.createDataFrame([(own,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{out}/config")
    elif spark.read.schema("fingerprint string").json(f"{out}/config").first()["fingerprint"] != own:
        raise ValueError(f"{out} was begun with another configuration")


def extract(spark: SparkSession, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], store: str, out: str, least: int, most: int) -> None:
    """Take what has arrived of a stream of requests (blob_id), fetch what the store lacks, decode, and write texts that are kept.

    `fetch` gets (blob_id) without repeats and returns (blob_id, raw), raw null where it failed; failures aren't stored and are
    tried again when they are asked for again. Bytes that aren't valid UTF-8 reject a blob, they are never replaced.
    Every batch writes folders named by its number, overwriting what a run that broke off has left; which batches are
    done is in the checkpoint, and only those are read. So a run that stops anywhere and is started again
    gives what one run gives.
    """
    _bound_to(spark, out, {"least": least, "most": most, "version": 1})

    def settle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        asked = batch.select("blob_id", blob_digest(F.col("blob_id")).alias("digest"))
        stored = _read(session, store, _STORE, [b for b in _batches(session, store) if b < number])
        lacking = asked.dropDuplicates(["digest"]).join(stored.select("digest"), "digest", "left_anti")
        got = fetch(lacking.select("blob_id")).select(blob_digest(F.col("blob_id")).alias("digest"), "raw")
        got.where("raw is not null").write.mode("overwrite").parquet(f"{store}/batch={number}")
        had = asked.join(stored.select("digest").withColumn("had", F.lit(True)), "digest", "left")
        rows = had.join(_read(session, store, _STORE, [b for b in _batches(session, store) if b <= number]), "digest", "left")
        text = F.col("raw").cast("string")
        status = (
            F.when(F.col("raw").isNull(), "fetch_failed")
            .when(~F.is_valid_utf8(text), "decode_failed")
            .when(F.trim(text, F.lit(" \t\n\x0b\f\r")) == "", "empty_rejected")
            .when(~F.length(text).between(least, most), "length_rejected")
            .otherwise("kept")
        )
        done = rows.select("blob_id", status.alias("status"), F.when(status == "kept", text).alias("text"), F.coalesce("had", F.lit(False)).alias("cached"))
        done.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    requests.writeStream.foreachBatch(settle).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def extracted(spark: SparkSession, out: str) -> DataFrame:
    """(blob_id, status, text, cached) of the batches that are committed."""
    return _read(spark, f"{out}/rows", _ROWS, _batches(spark, f"{out}/checkpoint/commits"))
