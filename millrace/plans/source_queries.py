"""Queries: sources, sinks and streams, by round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jsonl, shards
from ..sources.tables import shared_folder, table
from ..streaming import events as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src1_lenient_jsonl", "SELECT CASE WHEN doc_id % 50 = 0 THEN 'malformed' WHEN doc_id % 50 = 1 THEN 'no_field' END AS bad, count(*) AS n, coalesce(CAST(sum(CASE WHEN doc_id % 50 > 1 THEN length(text) END) AS BIGINT), 0) AS chars FROM documents GROUP BY 1")
def src1(spark, d):
    """Documents as JSON lines, some broken on purpose, read leniently and counted."""
    path = scratch(spark, "jsonl")
    docs = table(spark, d, "documents")
    line = F.when(F.col("doc_id") % 50 == 0, F.lit('{"text": "')).when(F.col("doc_id") % 50 == 1, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct("text")))
    docs.select(line).write.text(path)
    return jsonl.read_lenient(spark, path, {"text": "string"}).groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query("src2_strict_jsonl", "SELECT doc_id, lang, n_chars FROM documents")
def src2(spark, d):
    path = scratch(spark, "strict")
    jsonl.write_lines(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path, "gzip")
    return jsonl.read_strict(spark, path, "doc_id long, lang string, n_chars long")


@query("src3_strict_objects", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def src3(spark, d):
    rows = table(spark, d, "events").select("event_id", F.parse_json("props").alias("v"))
    return rows.select("event_id", F.variant_get("v", "$.k", "int").alias("k"))


@query("src8_compressed_scan", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def src8(spark, d):
    path = scratch(spark, "zstd")
    jsonl.write_lines(table(spark, d, "documents").select("doc_id", "lang"), path, "gzip")
    return spark.read.schema("doc_id long, lang string").json(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("src11_notebook_code", "SELECT doc_id, concat(text, chr(10), chr(10), 'print(1)') AS code FROM documents")
def src11(spark, d):
    cell = lambda kind, s: F.struct(F.lit(kind).alias("cell_type"), F.array(s).alias("source"))
    book = F.to_json(F.struct(F.array(cell("code", F.col("text")), cell("markdown", F.lit("# x")), cell("code", F.lit("print(1)"))).alias("cells")))
    return table(spark, d, "documents").select("doc_id", jsonl.notebook_code(book).alias("code"))


@query("snk1_jsonl_round_trip", "SELECT doc_id, sha256(text) AS sha FROM documents")
def snk1(spark, d):
    path = scratch(spark, "lines")
    jsonl.write_lines(table(spark, d, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.sha2("text", 256).alias("sha"))


def _tokens(spark, d):
    """(pos, token): line items as a stream of small ids, in key order without one sorted task."""
    return table(spark, d, "orders").select((F.col("o_orderkey") * 1).alias("pos"), (F.col("o_custkey") % 50000).alias("token"))


@query("snk3_shards", "SELECT o_orderkey // 4096 AS shard, count(*) AS n FROM orders GROUP BY 1")
def snk3(spark, d):
    return shards.to_shards(_tokens(spark, d), 4096).select("shard", "n")


@query("snk3_round_trip", "SELECT o_custkey % 50000 AS token, count(*) AS n FROM orders GROUP BY 1")
def snk3_back(spark, d):
    path = scratch(spark, "shards")
    shards.write_release(spark, shards.to_shards(_tokens(spark, d), 4096), path)
    return shards.from_shards(spark.read.parquet(path), 4096).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk4_manifest",
    """WITH s AS (SELECT o_orderkey // 4096 AS shard, count(*) AS n, sha256(unhex(string_agg(concat(h[3:4], h[1:2]), '' ORDER BY o_orderkey))) AS d FROM (SELECT o_orderkey, printf('%04X', CAST(o_custkey % 50000 AS INTEGER)) AS h FROM orders) GROUP BY 1),
    a AS (SELECT shard // 1024 AS j, sha256(string_agg(d, '' ORDER BY shard)) AS d FROM s GROUP BY 1), b AS (SELECT CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY j)) END AS digest FROM a)
    SELECT count(*) AS shards, CAST(sum(n) AS BIGINT) AS tokens, max(shard) + 1 = count(*) AND count(*) FILTER (WHERE n = 4096) >= count(*) - 1 AS whole, max(digest) AS digest FROM s, b""",
)
def snk4(spark, d):
    return shards.manifest(shards.to_shards(_tokens(spark, d), 4096), 4096)


@query("snk6_checksums")
def snk6(spark, d):
    path = scratch(spark, "sums")
    jsonl.write_lines(table(spark, d, "region").orderBy("r_regionkey").coalesce(1), path)
    return jsonl.checksums(spark, path).where("file like 'part-%'").select("bytes", "sha256")


def _stream_folder(spark, d) -> str:
    path = scratch(spark, "events")
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(path)
    return path


@query("str1_unique_events", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def str1(spark, d):
    """Each event arrives twice; the stream keeps one."""
    path = _stream_folder(spark, d)
    spark.read.parquet(path).repartitionByRange(4, "ts").write.mode("append").parquet(path)
    out, check = scratch(spark, "out"), scratch(spark, "state")
    E.run_once(E.unique_events(E.read_events(spark, path, 100), "60 days"), out, check)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("str2_tumbling_windows")
def str2(spark, d):
    """Windows that the watermark has passed; the last ones are still open when the input ends."""
    out, check = scratch(spark, "out"), scratch(spark, "state")
    E.run_once(E.tumbling_counts(E.read_events(spark, _stream_folder(spark, d), 1), "1 day", "2 days"), out, check)
    return spark.read.parquet(out).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("str3_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str3(spark, d):
    """The same windows in batch."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("tok1_encode_accounting")
def tok1(spark, d):
    """Content and boundary ids of each document by a byte-level BPE file, special tokens as ordinary text."""
    from ..functions.tokens import bpe_counts

    docs = table(spark, d, "documents")
    return docs.select("doc_id", bpe_counts(F.col("text")).alias("content")).withColumn("serialized", F.col("content") + 2)


@query("tok5_round_trip", "SELECT count(*) AS docs, 0::BIGINT AS failing FROM documents")
def tok5(spark, d):
    from ..functions.tokens import bpe_round_trip

    docs = table(spark, d, "documents").select(bpe_round_trip(F.col("text")).alias("ok"))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(~F.col("ok")).alias("failing"))


@query("tok3_merge_statistics", r"SELECT w, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 2)")
def tok3(spark, d):
    """What a BPE trainer starts from: pre-token counts of at least two; tokenizers themselves aren't trained here."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"( ?[\p{L}\p{N}]+)"))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("tok2_id_range")
def tok2(spark, d):
    """Whether a document's ids lie in the vocabulary and none of them is a special token's, with the extremes."""
    from ..functions.tokens import bpe_ids, special_ids, vocabulary_size

    docs = table(spark, d, "documents").select("doc_id", bpe_ids(F.col("text")).alias("ids"))
    special = F.array(*[F.lit(i) for i in special_ids()])
    inside = F.coalesce(F.array_min("ids"), F.lit(0)).between(0, vocabulary_size() - 1) & F.coalesce(F.array_max("ids"), F.lit(0)).between(0, vocabulary_size() - 1)
    return docs.select("doc_id", F.size("ids").alias("n"), F.array_min("ids").alias("least"), F.array_max("ids").alias("most"), (inside & ~F.arrays_overlap("ids", special)).alias("ok"))


@query("cht2_encode_chat")
def cht2(spark, d):
    """Each conversation as ids and labels: labels repeat the ids of answers and their ends, and are -100 elsewhere."""
    from ..operators.chat import encode_chat

    return encode_chat(table(spark, d, "conversations"))
