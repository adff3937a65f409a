"""Queries: aggregates, joins, windows, sorts, registry statements and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import relational as R
from ..operators import select as S
from ..sources.tables import table
from . import oracle as O
from .dedup_queries import _manifests, exclusion_hashes
from .select_queries import _cand, _off, _prefix, candidates, offsets
from .text_queries import document_reason_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _t(spark, d, name):
    return table(spark, d, name)


# ---- aggregates


@query("agg1_counts_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS quantity, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY ALL")
def agg1(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("quantity"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("agg2_mean_ascii", f"SELECT source, round(avg({O.ascii_share('text')}), 9) AS mean FROM documents GROUP BY source")
def agg2(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.round(F.avg(T.ascii_share(F.col("text"))), 9).alias("mean"))


@query("agg3_nearest_rank", "SELECT source, (list(n_chars ORDER BY n_chars))[1 + CAST(round_even((count(*) - 1) * 0.9, 0) AS INTEGER)] AS q90 FROM documents GROUP BY source")
def agg3(spark, d):
    """Rank round((n - 1) q), halves to even; by row numbers, so no group's values are gathered."""
    w = Window.partitionBy("source")
    rows = _t(spark, d, "documents").select("source", "n_chars", F.row_number().over(w.orderBy("n_chars")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where(F.col("r") == 1 + F.bround((F.col("n") - 1) * F.lit(0.9))).select("source", F.col("n_chars").alias("q90"))


@query("agg4_linear_quantiles", "SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.95), 6) AS q95 FROM documents GROUP BY source")
def agg4(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.round(F.percentile("n_chars", 0.5), 6).alias("q50"), F.round(F.percentile("n_chars", 0.95), 6).alias("q95"))


@query("agg5_ceil_rank", "SELECT source, quantile_disc(n_chars, 0.9) AS q90 FROM documents GROUP BY source")
def agg5(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("q90"))


@query("agg6_top_words", r"SELECT w, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY w) ORDER BY n DESC, w LIMIT 25")
def agg6(spark, d):
    words = _t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))).alias("w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(25)


@query("agg7_histogram", "SELECT least(n_chars // 500, 20) AS bin, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def agg7(spark, d):
    return _t(spark, d, "documents").groupBy(F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("agg8_shares", "SELECT source, round(sum(n_chars) / sum(sum(n_chars)) OVER () - 1.0 / count(*) OVER (), 9) AS excess FROM documents GROUP BY source")
def agg8(spark, d):
    every = Window.partitionBy()
    g = _t(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("s"))
    return g.select("source", F.round(F.col("s") / F.sum("s").over(every) - F.lit(1.0) / F.count(F.lit(1)).over(every), 9).alias("excess"))


@query("agg9_set_sizes", f"SELECT (SELECT count(DISTINCT h) FROM {_manifests}) AS in_any, (SELECT count(*) FROM (SELECT h FROM {_manifests} GROUP BY h HAVING count(DISTINCT manifest) > 1)) AS in_both, (SELECT count(*) FROM {_manifests}) AS entries")
def agg9(spark, d):
    g = exclusion_hashes(spark, d).groupBy("h").agg(F.count_distinct("manifest").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("in_any"), F.count_if(F.col("m") > 1).alias("in_both"), F.sum("n").alias("entries"))


@query("agg10_exposure", "SELECT uses, count(*) AS users FROM (SELECT c_custkey, count(o_orderkey) AS uses FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY uses")
def agg10(spark, d):
    used = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("uses"))
    return _t(spark, d, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.coalesce("uses", F.lit(0)).alias("uses")).agg(F.count(F.lit(1)).alias("users"))


@query("agg11_merged_statistics", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(exp(least(avg(value) / 100, 20)), 6) AS perplexity FROM events GROUP BY event_type")
def agg11(spark, d):
    """Counts and sums of batches, merged, then finished: what two-phase aggregation does."""
    parts = _t(spark, d, "events").groupBy("event_type", (F.col("event_id") % 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    g = parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return g.select("event_type", "n", F.round("s", 4).alias("total"), F.round(F.exp(F.least(F.try_divide("s", "n") / 100, F.lit(20.0))), 6).alias("perplexity"))


@query("agg12_length_summary", "SELECT role, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, quantile_cont(length(text), 0.9) AS p90 FROM conversations GROUP BY role")
def agg12(spark, d):
    n = F.length("text").cast("long")
    return _t(spark, d, "conversations").groupBy("role").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.9).alias("p90"))


@query("agg13_accounting", f"SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS serialized, CAST(sum(tokens) - 2 * count(*) AS BIGINT) AS content FROM {_cand} GROUP BY source")
def agg13(spark, d):
    g = candidates(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("serialized"))
    return g.withColumn("content", F.col("serialized") - 2 * F.col("docs"))


@query("agg14_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg14(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg14_grouping_sets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def agg14_sets(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], []], "lang", "source").agg(F.count(F.lit(1)).alias("n")).select("lang", "source", "n")


@query("agg15_approximate")
def agg15(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"))


# ---- joins


@query("jn1_semi_anti", "SELECT (SELECT count(*) FROM customer SEMI JOIN orders ON c_custkey = o_custkey) AS with_orders, (SELECT count(*) FROM customer ANTI JOIN orders ON c_custkey = o_custkey) AS without_orders")
def jn1(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").select("o_custkey").distinct()
    on = F.col("c_custkey") == F.col("o_custkey")
    a, b = c.join(o, on, "left_semi").agg(F.count(F.lit(1)).alias("with_orders")), c.join(o, on, "left_anti").agg(F.count(F.lit(1)).alias("without_orders"))
    return a.join(b)  # one row each


@query("jn2_owner_lookup", "SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn2(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("jn3_star", "SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jn3(spark, d):
    j = _t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return j.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("jn4_consistent_lookup", "SELECT count(*) AS rows, count(*) FILTER (WHERE n_chars <> length(text)) AS disagreeing FROM documents JOIN labels USING (doc_id)")
def jn4(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_chars") != F.length("text")).alias("disagreeing"))


@query("jn5_merge_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def jn5(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id").hint("merge"), "doc_id", "left_anti")


@query("jn7_interval_overlap", f"SELECT a.doc_id AS doc_id, k AS block FROM {_off} a JOIN range(100000) t(k) ON k * 3000 < a.a + a.n AND a.a < (k + 1) * 3000")
def jn7(spark, d):
    o = offsets(spark, d).withColumn("b", F.col("a") + F.col("n"))
    top = o.agg(F.max("b")).first()[0] or 0
    blocks = spark.range(-(-top // 3000)).select(F.col("id").alias("block"), (F.col("id") * 3000).alias("s"), ((F.col("id") + 1) * 3000).alias("e"))
    return R.overlap(o, blocks, [], ("a", "b"), ("s", "e"), 3000).select("doc_id", "block")


@query("jn8_as_of", "SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def jn8(spark, d):
    e = _t(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("before"))
    return R.as_of(left, right, ["user_id"], "ts", "ts", ["before"]).select("event_id", "before")


@query("jn9_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def jn9(spark, d):
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    s = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("jn11_cross_of_fixed_tables", "SELECT r_name, n_name FROM region, nation")
def jn11(spark, d):
    return _t(spark, d, "nation").select("n_name").crossJoin(F.broadcast(_t(spark, d, "region").select("r_name")))  # five rows


# ---- windows and sorts


@query("win1_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def win1(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _t(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("running"))


@query("win2_best_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def win2(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("o_orderkey"))


@query("win3_previous", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS repeated FROM events")
def win3(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, d, "events").select("event_id", before.alias("before"), (F.col("event_type") == before).alias("repeated"))


@query("win4_block_numbers", f"SELECT doc_id, a // 512 AS first_block, (a + n - 1) // 512 AS last_block FROM {_off}")
def win4(spark, d):
    return offsets(spark, d).select("doc_id", F.floor(F.col("a") / 512).alias("first_block"), F.floor((F.col("a") + F.col("n") - 1) / 512).alias("last_block"))


@query("win6_suffix_sums", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM conversations")
def win6(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return _t(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("rest"))


@query("win7_change", "SELECT event_type, w, round(m - lag(m) OVER (PARTITION BY event_type ORDER BY w), 6) AS change FROM (SELECT event_type, date_trunc('week', ts) AS w, avg(value) AS m FROM events GROUP BY ALL)")
def win7(spark, d):
    g = _t(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").alias("w")).agg(F.avg("value").alias("m"))
    return g.select("event_type", "w", F.round(F.col("m") - F.lag("m").over(Window.partitionBy("event_type").orderBy("w")), 6).alias("change"))


@query("win8_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def win8(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, Window.currentRow)
    return _t(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("last_hour"))


@query("win9_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS quartile FROM part")
def win9(spark, d):
    w = Window.partitionBy("p_brand")
    return _t(spark, d, "part").select("p_partkey", F.rank().over(w.orderBy("p_size")).alias("r"), F.dense_rank().over(w.orderBy("p_size")).alias("dr"), F.ntile(4).over(w.orderBy("p_size", "p_partkey")).alias("quartile"))


@query("win10_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS first FROM events) WHERE first = 1 GROUP BY user_id")
def win10(spark, d):
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, d, "events").withColumn("g", gap).where("g is null or g > 1800000000").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("srt1_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def srt1(spark, d):
    return _t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("srt2_top_per_group", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def srt2(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return _t(spark, d, "part").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_partkey")


@query("srt5_range_shards", "SELECT doc_id, row_number() OVER (ORDER BY sha256(text), doc_id) AS place FROM documents")
def srt5(spark, d):
    """Shards by ranges of the sort key: a row's place is its place in its shard behind all earlier shards' rows."""
    from .source_queries import scratch

    path = scratch(spark, "shards")
    rows = _t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id").repartitionByRange(8, "h", "doc_id")
    rows.withColumn("p", F.spark_partition_id()).write.parquet(path)  # written, as another run may cut other ranges
    rows = spark.read.schema("h string, doc_id long, p int").parquet(path)
    upto = Window.partitionBy().orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", (F.sum("n").over(upto) - F.col("n")).alias("before"))  # a row a shard
    place = F.row_number().over(Window.partitionBy("p").orderBy("h", "doc_id"))
    return rows.join(F.broadcast(shards), "p").select("doc_id", (F.col("before") + place).alias("place"))


# ---- the registry's statements and audits


@query("sql2_exclusion_union", f"SELECT count(DISTINCT h) AS hashes, count(*) AS memberships FROM {_manifests}")
def sql2(spark, d):
    return exclusion_hashes(spark, d).agg(F.count_distinct("h").alias("hashes"), F.count(F.lit(1)).alias("memberships"))


@query("sql3_identity_collisions", "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING min(source) <> max(source)")
def sql3(spark, d):
    return D.disagreements(_t(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "source"), "key", "source")


@query("sql4_worst_candidate", f"SELECT source, max(rank) AS rank FROM {_prefix.replace('{c}', _cand)} WHERE running - tokens < 5000 GROUP BY source")
def sql4(spark, d):
    chosen = S.prefix_by_quota(candidates(spark, d).withColumn("t", F.lit(5000)), "source", ["rank", "doc_id"], "tokens", "t")
    return chosen.groupBy("source").agg(F.max("rank").alias("rank"))


@query("sql5_candidate_totals", f"SELECT source, count(*) AS documents, coalesce(CAST(sum(tokens) AS BIGINT), 0) AS tokens FROM {_cand} GROUP BY source")
def sql5(spark, d):
    return candidates(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


@query("sql6_counters", "SELECT a.source AS source, b.source AS owner, count(*) AS documents FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND b.doc_id < a.doc_id GROUP BY ALL")
def sql6(spark, d):
    """Later copies by their own and every earlier copy's source.

    Pairs of copies are counted, not made: a row counts, for each source that has the
    text, how many of that source's rows come before it.
    """
    rows = _t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    several = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    rows = rows.join(several, "h")
    owners = rows.select("h", F.col("source").alias("owner")).distinct()
    before = F.count_if(F.col("source") == F.col("owner")).over(Window.partitionBy("h", "owner").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1))
    met = rows.join(owners, "h").withColumn("documents", before)
    return met.groupBy("source", "owner").agg(F.sum("documents").alias("documents")).where("documents > 0")


@query("sql9_intersections", "SELECT a.source AS left_source, b.source AS right_source, count(*) AS shared FROM (SELECT DISTINCT source, sha256(text) AS h FROM documents) a JOIN (SELECT DISTINCT source, sha256(text) AS h FROM documents) b ON a.h = b.h AND a.source < b.source GROUP BY ALL")
def sql9(spark, d):
    rows = _t(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")).distinct()
    return rows.select(F.col("source").alias("left_source"), "h").join(rows.select(F.col("source").alias("right_source"), "h"), "h").where("left_source < right_source").groupBy("left_source", "right_source").agg(F.count(F.lit(1)).alias("shared"))


@query("sql10_reference_matches", f"SELECT manifest, source, count(*) AS matches FROM (SELECT DISTINCT * FROM {_manifests}) JOIN documents ON h = sha256(text) GROUP BY ROLLUP (manifest, source)")
def sql10(spark, d):
    j = _t(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")).join(exclusion_hashes(spark, d).distinct(), "h")
    return j.rollup("manifest", "source").agg(F.count(F.lit(1)).alias("matches"))


@query("sql8_ordered_export", f"SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank, doc_id) AS ids FROM {_prefix.replace('{c}', _cand)} WHERE running - tokens < 5000 GROUP BY source")
def sql8(spark, d):
    chosen = S.prefix_by_quota(candidates(spark, d).withColumn("t", F.lit(5000)), "source", ["rank", "doc_id"], "tokens", "t")
    g = chosen.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    return g.select("source", F.array_join(F.transform("x", lambda x: x["doc_id"].cast("string")), ",").alias("ids"))


@query("sql11_dangling", "SELECT count(*) AS dangling FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def sql11(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))


@query("aud1_unique_ids", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def aud1(spark, d):
    ids = _t(spark, d, "documents").select("doc_id").union(_t(spark, d, "labels").select("doc_id"))
    return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("aud2_ordinals", "SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def aud2(spark, d):
    n = F.count(F.lit(1))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(((F.min("turn") == 0) & (F.max("turn") == n - 1) & (F.count_distinct("turn") == n)).alias("contiguous"))


@query("aud3_disjoint_splits", "SELECT count(*) AS shared FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 21 = 0) SEMI JOIN (SELECT sha256(text) AS h FROM documents WHERE doc_id % 21 <> 0) USING (h)")
def aud3(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.where("doc_id % 21 = 0").select("h").distinct().join(rows.where("doc_id % 21 <> 0").select("h"), "h", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query(
    "aud4_identities",
    f"""SELECT source, n = c + 2 * docs AS serialized_ok, docs, CAST(n - c - 2 * docs AS BIGINT) AS surplus FROM (
    SELECT source, sum(tokens + CASE WHEN doc_id % 331 = 7 THEN 1 ELSE 0 END) AS n, sum(tokens - 2) AS c, count(*) AS docs FROM {_cand} GROUP BY source)""",
)
def aud4(spark, d):
    """Content and boundary tokens against what is declared, by source: one token is planted too many in some rows."""
    declared = F.col("tokens") + F.when(F.col("doc_id") % 331 == 7, 1).otherwise(0)
    s = candidates(spark, d).groupBy("source").agg(F.sum(declared).alias("n"), F.sum(F.col("tokens") - 2).alias("c"), F.count(F.lit(1)).alias("docs"))
    surplus = F.col("n") - F.col("c") - 2 * F.col("docs")
    return s.select("source", (surplus == 0).alias("serialized_ok"), "docs", surplus.alias("surplus"))


@query("aud5_exhausted_sources", f"SELECT source, CAST(sum(tokens) AS BIGINT) AS supply, sum(tokens) >= 15000 AS reached FROM {_cand} GROUP BY source")
def aud5(spark, d):
    return candidates(spark, d).groupBy("source").agg(F.sum("tokens").alias("supply"), (F.sum("tokens") >= 15000).alias("reached"))


@query("set6_pivot", "SELECT lang, count(*) FILTER (WHERE q = 1) AS good, count(*) FILTER (WHERE q = 0) AS bad FROM (SELECT lang, quality AS q FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def set6(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    p = j.groupBy("lang").pivot("quality", [1, 0]).agg(F.count(F.lit(1)))
    return p.select("lang", F.coalesce("1", F.lit(0)).alias("good"), F.coalesce("0", F.lit(0)).alias("bad"))


@query("set7_unpivot", "UNPIVOT (SELECT event_id, value, CAST(user_id AS DOUBLE) AS user FROM events) ON value, user INTO NAME field VALUE x")
def set7(spark, d):
    e = _t(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    return e.unpivot(["event_id"], ["value", "user"], "field", "x")


@query("src12_field_sniffing", "SELECT event_id, coalesce(props->>'text', props->>'content', props->>'k') AS picked FROM events")
def src12(spark, d):
    v = F.try_parse_json("props")
    pick = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return _t(spark, d, "events").select("event_id", F.coalesce(pick("text"), pick("content"), pick("k")).alias("picked"))


@query("src4_pooled_scan", "SELECT pool, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'documents' AS pool, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY pool")
def src4(spark, d):
    rows = _t(spark, d, "documents").select(F.lit("documents").alias("pool"), "text").unionByName(_t(spark, d, "benchmark").select(F.lit("benchmark").alias("pool"), "text"))
    return rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src5_eligibility", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def src5(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("src6_binding_scan", f"SELECT doc_id, sha256(b) AS cleaned, {document_reason_sql('b')} AS reason, length(b) AS n FROM (SELECT doc_id, {O.clean('text')} AS b FROM documents)")
def src6(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", T.strip(T.normalise(F.col("text"))).alias("b"))
    return rows.select("doc_id", F.sha2("b", 256).alias("cleaned"), T.document_reason(F.col("b")).alias("reason"), F.length("b").cast("long").alias("n"))


@query("snk2_canonical_json", """SELECT o_orderkey, concat('{"custkey":', o_custkey, ',"key":', o_orderkey, ',"status":"', o_orderstatus, '"}') AS line FROM orders""")
def snk2(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("line"))
