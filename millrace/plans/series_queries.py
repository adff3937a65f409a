"""Queries: series, metric logs, zstd lines, resumable extraction and selection by streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as V
from ..sources import zstd_lines as Z
from ..sources.tables import table
from ..streaming import extract as X
from ..streaming import selection as K
from .release_queries import scratch
from .select_queries import _cand, candidates

QUERIES: dict = {}
SQL: dict[str, str] = {}
TIE = 3e-8  # added before rounding: averages of decimals lie on ties, where the last bit of a double would decide


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _ema_sql(rows: str, keys: str) -> str:
    """Moving averages of (keys, step, value) in closed form: each value's weight at every later step."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""(SELECT {", ".join(f"b.{k}" for k in keys.split(", "))}, b.step, b.value, sum(a.value * CASE WHEN a.i = 1 THEN power(0.9, b.i - 1) ELSE 0.1 * power(0.9, b.i - a.i) END) AS ema
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY step) AS i FROM {rows}) a JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY step) AS i FROM {rows}) b
    ON {same} AND a.i <= b.i AND a.i > b.i - 400 GROUP BY ALL)"""


@query("win5_moving_average", f"SELECT user_id, step, round(ema + {TIE}, 6) AS ema FROM {_ema_sql('(SELECT user_id, event_id AS step, value FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)', 'user_id')}")
def win5(spark, d):
    """The moving average of every event's value within its user."""
    rows = table(spark, d, "events").where("user_id is not null")
    return V.moving_average(rows, ["user_id"], "event_id", "value").select("user_id", "step", F.round(F.col("ema") + TIE, 6).alias("ema"))


_metrics = """(SELECT concat('run', user_id % 7) AS run, CASE WHEN user_id % 7 < 3 AND event_id % 5 = 0 THEN 'val' WHEN user_id % 7 = 6 THEN event_type ELSE 'train' END AS kind, event_id AS step, field, x AS value
    FROM events, (VALUES ('value'), ('twice')) f(field), LATERAL (SELECT CASE field WHEN 'value' THEN value ELSE 2 * value END AS x) WHERE event_id % 50 <> 0 AND value IS NOT NULL)"""


@query(
    "evl9_run_comparison",
    f"""WITH m AS MATERIALIZED {_metrics}, k AS (SELECT field, run, kind, count(*) AS n FROM m GROUP BY ALL),
    c AS (SELECT *, max(CAST(kind = 'val' AS INTEGER)) OVER (PARTITION BY field, run) AS val FROM k),
    l AS (SELECT field, run, kind, n, CASE WHEN count(*) OVER (PARTITION BY field, run) = 1 THEN run ELSE concat(run, '/', kind) END AS label FROM c WHERE val = 0 OR kind = 'val')
    SELECT field, label, step, round(CASE WHEN n > 200 THEN ema ELSE value END + {TIE}, 6) AS shown FROM {_ema_sql('m', 'field, run, kind')} e JOIN l USING (field, run, kind)""",
)
def evl9_compare(spark, d):
    """Curves of runs from their metric log: JSON lines appended by a stream, some broken on purpose, read back in long form."""
    from ..streaming import events as E

    events = table(spark, d, "events")
    run = F.col("user_id") % 7
    kind = F.when((run < 3) & (F.col("event_id") % 5 == 0), "val").when(run == 6, F.col("event_type")).otherwise("train")
    line = F.to_json(F.struct(kind.alias("kind"), F.col("event_id").alias("step"), "value", (2 * F.col("value")).alias("twice"), F.lit("note").alias("text"), F.lit(True).alias("flag")))
    lines = events.select(F.concat(F.lit("run"), run).alias("run"), F.when(F.col("event_id") % 50 != 0, line).when(F.col("event_id") % 100 == 0, F.substring(line, 1, 20)).otherwise('{"kind": "train", "value": 1}').alias("value"))
    arrived, log = scratch(spark, "arrived"), scratch(spark, "metrics")
    files = max(3, -(-events.count() // 1_000_000))
    lines.repartition(files).write.parquet(arrived)
    for _ in range(2):  # the second run finds nothing new and appends nothing
        E.run_once(spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", -(-2 * files // 3)).parquet(arrived), log, f"{log}-state")
    rows = scratch(spark, "metric-rows")
    V.metric_rows(spark.read.parquet(log)).write.parquet(rows)  # lines are parsed once; a comparison reads the numbers four times
    curves = V.compare_runs(spark.read.parquet(rows))
    return curves.select("field", "label", "step", F.round(F.col("shown") + TIE, 6).alias("shown"))


@query("src8_zstd_lines", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT doc_id) AS docs FROM documents GROUP BY lang")
def src8_zstd(spark, d):
    """Documents as zstd JSON lines in a seeded order, read back and counted."""
    path = scratch(spark, "zst")
    docs = table(spark, d, "documents")
    lines = docs.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("value"))
    Z.write_zstd_lines(Z.shuffled(lines, "value", "mix", Z.file_count(docs, "text", 6)), path)
    rows = Z.read_zstd_lines(spark, path).select(F.from_json("value", "doc_id long, lang string, text string").alias("x")).select("x.*")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_distinct("doc_id").alias("docs"))


@query("src8_zstd_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(chr(31), 'mix', concat('{\"doc_id\":', doc_id, '}')))) AS place FROM documents")
def src8_order(spark, d):
    """The place of each line over all files: counts of the files before its own, and its line."""
    path = scratch(spark, "zst")
    Z.write_zstd_lines(Z.shuffled(table(spark, d, "documents").select(F.to_json(F.struct("doc_id")).alias("value")), "value", "mix", 6), path)
    rows = Z.read_zstd_lines(spark, path)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = sizes.alias("a").join(sizes.alias("b"), F.expr("b.file < a.file"), "left").groupBy(F.col("a.file").alias("file")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "file").select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), (F.col("before") + F.col("line") + 1).alias("place"))


@query(
    "sql7_streamed_selection",
    f"""WITH c AS {_cand}, u AS (SELECT source, rank, min(doc_id) AS doc_id, max(tokens) AS tokens FROM c GROUP BY ALL)
    SELECT source, doc_id, running FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM u) WHERE running - tokens < 5000""",
)
def sql7(spark, d):
    """Documents arrive in small batches, a third of them twice; the run is stopped half way and started again."""
    rows = candidates(spark, d).select("source", "rank", "doc_id", "tokens")
    arrived, log, check = scratch(spark, "arrived"), scratch(spark, "changes"), scratch(spark, "state")
    again = rows.where("doc_id % 3 = 0")
    for part in (rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0").unionByName(again)):
        part.repartition(3).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
        K.keep_prefixes(spark, stream, 5000, log, check)
    return K.kept_rows(spark.read.parquet(log), 5000).select("source", "doc_id", "running")


@query(
    "src9_resumed_extraction",
    r"""WITH r AS (SELECT doc_id, doc_id // 2 * 2 AS blob FROM documents), x AS (SELECT r.doc_id, CASE WHEN blob % 34 = 0 OR s.doc_id IS NULL THEN 'fetch_failed' WHEN blob % 26 = 0 THEN 'decode_failed'
    WHEN trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) = '' THEN 'empty_rejected' WHEN length(text) NOT BETWEEN 40 AND 6000 THEN 'length_rejected' ELSE 'kept' END AS status, text FROM r LEFT JOIN documents s ON s.doc_id = blob)
    SELECT status, status <> 'fetch_failed' AND doc_id % 2 = 1 AS cached, count(*) AS n, coalesce(CAST(sum(CASE WHEN status = 'kept' THEN length(text) END) AS BIGINT), 0) AS chars FROM x GROUP BY ALL""",
)
def src9(spark, d):
    """Every document asks for the blob of an even one: first the even ones, then, in a second run, the odd ones, whose blobs are stored."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    name = lambda c: F.concat(F.lit("blob/"), (F.expr(f"{c} div 2") * 2).cast("string"))
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    faulty = F.when(F.col("doc_id") % 34 == 0, None).when(F.col("doc_id") % 26 == 0, F.concat(raw, F.unhex(F.lit("ff")))).otherwise(raw)
    remote = docs.where("doc_id % 2 = 0").select(name("doc_id").alias("blob_id"), faulty.alias("raw"))
    arrived, store, out = scratch(spark, "requests"), scratch(spark, "blobs"), scratch(spark, "extracted")
    for odd in (0, 1):
        docs.where(F.col("doc_id") % 2 == odd).select(name("doc_id").alias("blob_id")).repartition(3).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema("blob_id string").option("maxFilesPerTrigger", 2).parquet(arrived)
        X.extract(spark, stream, lambda ids: ids.join(remote, "blob_id", "left"), store, out, 40, 6000)
    rows = X.extracted(spark, out)
    return rows.groupBy("status", "cached").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
