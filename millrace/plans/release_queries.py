"""Queries: releases of token shards, published, checked and refused."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import select as S
from ..sources import release as R
from ..sources.tables import shared_folder, table
from .select_queries import _R, _hold

QUERIES: dict = {}
SQL: dict[str, str] = {}
SHARD = 4096


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def streams(spark: SparkSession, d: str) -> DataFrame:
    """(split, start, ids): each document's 16-bit word ids between ids 1 and 2, in hash order within train and val."""
    docs = table(spark, d, "documents")
    count = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+")) + 2).cast("long")
    split = F.when(I.holdout(F.col("text"), (95, 5)), "val").otherwise("train")
    # narrow rows are put in order, then texts meet their starts
    narrow = docs.select(split.alias("split"), "doc_id", count.alias("n"), I.rank(7, "stage_a", F.col("source"), I.fingerprint(F.col("text"))).alias("rank"))
    path = scratch(spark, "narrow")
    narrow.write.parquet(path)  # read twice: texts are counted and hashed once
    starts = S.running_total(spark.read.parquet(path), ["split"], ["rank", "doc_id"], "n").select("split", "doc_id", (F.col("running") - F.col("n")).alias("start"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}\p{N}]+)"))
    ids = F.transform(words, lambda w: F.conv(F.left(F.md5(w), F.lit(4)), 16, 10).cast("int"))
    return docs.select("doc_id", "text").join(starts, "doc_id").select("split", "start", F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2))).alias("ids"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """The streams, written once: a release reads them to pack and to count."""
    path = scratch(spark, "streams")
    streams(spark, d).write.parquet(path)
    return spark.read.parquet(path)


_stream_sql = f"""c AS (SELECT d.doc_id, CASE WHEN {_hold} THEN 'val' ELSE 'train' END AS split, {_R} AS rank, list_transform(regexp_extract_all(coalesce(d.text, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: left(md5(w), 4)) AS w FROM documents d),
    i AS (SELECT split, rank, doc_id, ['0001'] || w || ['0002'] AS w FROM c),
    p AS (SELECT split, unnest(w) AS w, unnest(range(len(w))) AS k, sum(len(w)) OVER (PARTITION BY split ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) - len(w) AS start FROM i),
    s AS (SELECT split, CAST((start + k) // {SHARD} AS BIGINT) AS shard, count(*) AS token_count, sha256(unhex(string_agg(concat(w[3:4], w[1:2]), '' ORDER BY start + k))) AS sha256 FROM p GROUP BY ALL)"""


@query("snk5_release", f"WITH {_stream_sql} SELECT split, shard, token_count, 2 * token_count AS size_bytes, sha256 FROM s")
def snk5(spark, d):
    """Documents as a release: staged, read back, renamed; then the manifest of what was published."""
    path = scratch(spark, "release")
    R.write_release(spark, _written(spark, d), path, SHARD)
    R.require_release(spark, path)
    return R.read_manifest(spark, path)


@query("snk5_round_trip", f"WITH {_stream_sql} SELECT split, w, count(*) AS n FROM (SELECT split, CAST(concat('0x', w) AS BIGINT) AS w FROM p) GROUP BY ALL")
def snk5_back(spark, d):
    """Counts of the ids that a published release holds."""
    path = scratch(spark, "release")
    R.write_release(spark, _written(spark, d), path, SHARD)
    ids = R.release_ids(spark, path).select("split", F.explode("ids").alias("w"))
    return ids.groupBy("split", F.col("w").cast("long").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def damaged_release(spark: SparkSession, path: str) -> str:
    """A copy of a release in which shards are lost (3 of 11), changed (5 of 11), cut short (7 of 11) and doubled (9 of 11), and one more is there in each split."""
    bad = scratch(spark, "damaged")
    spark.read.text(f"{path}/manifest").write.text(f"{bad}/manifest")
    spark.read.text(f"{path}/meta").write.text(f"{bad}/meta")
    shards = spark.read.parquet(f"{path}/shards")
    kind = F.col("shard") % 11
    hexed = F.hex("data")
    data = F.when(kind == 5, F.unhex(F.concat(F.when(F.left(hexed, F.lit(2)) == "00", "01").otherwise("00"), F.expr("substring(hex(data), 3)")))).when(kind == 7, F.unhex(F.expr("substring(hex(data), 5)"))).otherwise(F.col("data"))
    kept = shards.where(kind != 3).withColumn("data", data)
    twice = kept.withColumn("copy", F.explode(F.when(kind == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    more = shards.where("shard = 0").withColumn("shard", F.lit(1 << 40))
    twice.unionByName(more).write.parquet(f"{bad}/shards")
    return bad


@query(
    "aud5_release_faults",
    f"""WITH {_stream_sql} SELECT unnest(CASE shard % 11 WHEN 3 THEN ['missing'] WHEN 5 THEN ['sha256'] WHEN 7 THEN ['size', 'sha256'] WHEN 9 THEN ['repeated'] ELSE [] END) AS kind, split, shard FROM s
    UNION ALL SELECT DISTINCT 'extra', split, 1099511627776 FROM s""",
)
def aud5_release(spark, d):
    """What the check finds in a release with planted faults; using that release is refused."""
    path = scratch(spark, "release")
    R.write_release(spark, _written(spark, d), path, SHARD)
    bad = damaged_release(spark, path)
    return R.release_faults(spark, bad)
