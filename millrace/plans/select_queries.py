"""Queries: selection, sampling, splits and packing arithmetic."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..operators import dedup as D
from ..operators import permutation as P
from ..operators import select as S
from ..sources.tables import shared_folder, table
from . import oracle as O
from .dedup_queries import _checkpoints, _rank, _shingle_sql
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


# tokens are counted by runs of letters and digits: every engine counts them alike
_W = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+'))"
_R = _rank.replace("source", "d.source").replace("text", "d.text")
_cand = f"(SELECT d.doc_id, d.source, d.lang, {_W.replace('text', 'd.text')} + 2 AS tokens, {_R} AS rank, q.quality FROM documents d LEFT JOIN labels q USING (doc_id))"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, lang, tokens, rank, quality): tokens with two boundary tokens."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "source", "lang", (F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) + 2).cast("long").alias("tokens"), I.rank(7, "stage_a", F.col("source"), I.fingerprint(F.col("text"))).alias("rank"))
    return rows.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


_prefix = "(SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM {c})"


@query("sel1_prefix_by_quota", f"SELECT doc_id, source, running FROM {_prefix.replace('{c}', _cand)} WHERE running - tokens < 5000")
def sel1(spark, d):
    rows = candidates(spark, d).withColumn("target", F.lit(5000))
    return S.prefix_by_quota(rows, "source", ["rank", "doc_id"], "tokens", "target").select("doc_id", "source", "running")


@query("sel2_window_prefix", SQL["sel1_prefix_by_quota"])
def sel2(spark, d):
    rows = candidates(spark, d).withColumn("target", F.lit(5000))
    return S.prefix_by_quota_windowed(rows, "source", ["rank", "doc_id"], "tokens", "target").select("doc_id", "source", "running")


def _step(n: int, where: str, target: int) -> str:
    before = " AND ".join([where, *[f"doc_id NOT IN (SELECT doc_id FROM n{i})" for i in range(n)]])
    return f"n{n} AS (SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c WHERE {before}) WHERE running - tokens < {target})"


_nodes = [("b_good", "quality = 1 AND lang = 'en'", 20000), ("a_english", "lang = 'en'", 30000), ("control", "true", 10000)]
_own = f"WITH c AS {_cand}, " + ", ".join(_step(i, w, t) for i, (_, w, t) in enumerate(_nodes))


def _owned(spark, d):
    _checkpoints(spark)
    return S.owned_selection(candidates(spark, d), [(n, F.expr(w), t) for n, w, t in _nodes], "doc_id", ["rank", "doc_id"], "tokens")


@query("sel3_ownership", _own + " " + " UNION ALL ".join(f"SELECT '{n}' AS node, doc_id, running FROM n{i}" for i, (n, _, _) in enumerate(_nodes)))
def sel3(spark, d):
    return _owned(spark, d).select("node", "doc_id", "running")


@query(
    "sel4_ownership_matrix",
    _own + ", o AS (" + " UNION ALL ".join(f"SELECT '{n}' AS owner, {i} AS k, doc_id FROM n{i}" for i, (n, _, _) in enumerate(_nodes)) + "), e AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS consumer, {i} AS j, doc_id FROM c WHERE {w}" for i, (n, w, _) in enumerate(_nodes))
    + ") SELECT consumer, owner, count(*) AS n FROM e JOIN o USING (doc_id) WHERE k < j GROUP BY ALL",
)
def sel4(spark, d):
    owned = _owned(spark, d).select("doc_id", F.col("node").alias("owner"))
    place = {n: i for i, (n, _, _) in enumerate(_nodes)}
    wants = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w, _ in _nodes]))
    eligible = candidates(spark, d).select("doc_id", F.explode(wants).alias("consumer"))
    order = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col(c))
    return eligible.join(owned, "doc_id").where(order("owner") < order("consumer")).groupBy("consumer", "owner").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sel5_score_branch",
    f"""WITH c AS {_cand}, s AS (SELECT *, (SELECT sum(tokens) FROM c WHERE quality >= 1) >= 50000 AS enough FROM c WHERE quality IS NOT NULL),
    o AS (SELECT *, CASE WHEN enough THEN 0 ELSE -quality END AS k FROM s WHERE NOT enough OR quality >= 1)
    SELECT doc_id, running FROM (SELECT *, CAST(sum(tokens) OVER (ORDER BY k, rank, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM o) WHERE running - tokens < 50000""",
)
def sel5(spark, d):
    """Hash order within the good pool if it covers the target, else score order in the whole pool."""
    rows = candidates(spark, d).where("quality is not null")
    supply = rows.where("quality >= 1").agg(F.sum("tokens")).first()[0] or 0
    pool = rows.where("quality >= 1").withColumn("k", F.lit(0)) if supply >= 50000 else rows.withColumn("k", -F.col("quality"))
    pool = pool.withColumn("g", F.lit(0)).withColumn("t", F.lit(50000))
    return S.prefix_by_quota(pool, "g", ["k", "rank", "doc_id"], "tokens", "t", rank="rank").select("doc_id", "running")


@query(
    "sel6_boundary",
    f"""SELECT source, max(rank) FILTER (WHERE running - tokens < 5000) AS crossing_rank, min(rank) FILTER (WHERE running - tokens >= 5000) AS next_rank,
    CAST(max(running) FILTER (WHERE running - tokens < 5000) - 5000 AS BIGINT) AS overshoot, count(*) FILTER (WHERE running - tokens < 5000) AS taken FROM {_prefix.replace('{c}', _cand)} GROUP BY source""",
)
def sel6(spark, d):
    rows = S.running_total(candidates(spark, d), ["source"], ["rank", "doc_id"], "tokens").withColumn("inside", F.col("running") - F.col("tokens") < 5000)
    inside = lambda c: F.when(F.col("inside"), F.col(c))
    return rows.groupBy("source").agg(
        F.max(inside("rank")).alias("crossing_rank"),
        F.min(F.when(~F.col("inside"), F.col("rank"))).alias("next_rank"),
        (F.max(inside("running")) - 5000).alias("overshoot"),
        F.count_if("inside").alias("taken"),
    )


@query(
    "sel7_apportion",
    """WITH w AS (SELECT source, CAST(count(*) AS DOUBLE) + sum(doc_id % 5) AS weight FROM documents GROUP BY source), q AS (SELECT *, weight * 12345.0 / sum(weight) OVER () AS q FROM w),
    f AS (SELECT *, CAST(floor(q) AS BIGINT) AS f FROM q), r AS (SELECT *, row_number() OVER (ORDER BY round(q - f, 9) DESC, source DESC) AS n, 12345 - sum(f) OVER () AS rest FROM f)
    SELECT source, f + CASE WHEN n <= rest THEN 1 ELSE 0 END AS share FROM r""",
)
def sel7(spark, d):
    w = table(spark, d, "documents").groupBy("source").agg((F.count(F.lit(1)).cast("double") + F.sum(F.col("doc_id") % 5)).alias("weight"))
    return S.apportion(w, "weight", 12345, "source").select("source", "share")


@query("sel8_interleave", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(chr(31), 'mix', doc_id)), doc_id) AS place FROM documents")
def sel8(spark, d):
    """A hash order mixes sources in proportion; places come from counts of rank bins, then order within a bin."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\x1f", F.lit("mix"), F.col("doc_id").cast("string")), 256).alias("h"))
    return S.running_total(rows.withColumn("one", F.lit(1)), [], ["h", "doc_id"], "one", "place").select("doc_id", "place")


@query("sel9_reservoir", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(chr(31), 's1', doc_id)), doc_id) AS r FROM documents) WHERE r <= 7")
def sel9(spark, d):
    return S.top_by_hash(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 7, "s1").select("source", "doc_id")


_hold = "CAST(CAST(concat('0x', left(sha256(concat('holdout', chr(31), d.text)), 15)) AS BIGINT) AS HUGEINT) * 100 < CAST(5 AS HUGEINT) * 1152921504606846976"


@query(
    "sel10_routing",
    f"""WITH c AS (SELECT c.*, CASE WHEN {_hold} THEN 'val' ELSE 'train' END AS split FROM {_cand} c JOIN documents d USING (doc_id)),
    p AS (SELECT *, sum(tokens) OVER (PARTITION BY source, split ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM c)
    SELECT source, split, count(*) FILTER (WHERE running - tokens < CASE split WHEN 'val' THEN 300 ELSE 4000 END) AS taken, count(*) FILTER (WHERE running - tokens >= CASE split WHEN 'val' THEN 300 ELSE 4000 END) AS skipped FROM p GROUP BY ALL""",
)
def sel10(spark, d):
    split = table(spark, d, "documents").select("doc_id", F.when(I.holdout(F.col("text"), (95, 5)), "val").otherwise("train").alias("split"))
    rows = S.running_total(candidates(spark, d).join(split, "doc_id"), ["source", "split"], ["rank", "doc_id"], "tokens")
    inside = F.col("running") - F.col("tokens") < F.when(F.col("split") == "val", 300).otherwise(4000)
    return rows.groupBy("source", "split").agg(F.count_if(inside).alias("taken"), F.count_if(~inside).alias("skipped"))


@query("sel11_group_split")
def sel11(spark, d):
    groups = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return S.split_groups(groups, "lang", "source", "n", {"train": 0.9, "val": 0.05, "test": 0.05})


@query("sel12_component_split", "SELECT conv_id, CASE WHEN CAST(concat('0x', left(sha256(concat_ws(chr(31), 'split', conv_id)), 12)) AS BIGINT) / 281474976710656.0 < 1 / 21.0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)")
def sel12(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return c.select("conv_id", F.when(S.hash_share(F.col("conv_id"), "split") < 1 / 21, "validation").otherwise("train").alias("split"))


_h = "sha256(concat_ws(chr(31), 'q', doc_id))"


@query("sel13_family_quota", f"WITH f AS (SELECT lang, CAST(floor(200.0 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS quota FROM documents GROUP BY lang) SELECT lang, doc_id FROM (SELECT d.lang, doc_id, quota, row_number() OVER (PARTITION BY d.lang ORDER BY {_h}, doc_id) AS r FROM documents d JOIN f USING (lang)) WHERE r <= quota")
def sel13(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.sha2(F.concat_ws("\x1f", F.lit("q"), F.col("doc_id").cast("string")), 256).alias("h"), F.lit(1).alias("one"))
    quota = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("quota", F.floor(F.lit(200.0) * F.col("n") / F.sum("n").over(Window.partitionBy())))
    return S.prefix_by_quota(docs.join(F.broadcast(quota.select("lang", "quota")), "lang"), "lang", ["h", "doc_id"], "one", "quota").select("lang", "doc_id")


@query("sel14_ranked_groups", "SELECT source, lang, doc_id FROM (SELECT d.source, d.lang, d.doc_id, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY coalesce(quality, -1) DESC, n_chars, d.doc_id) AS r FROM documents d LEFT JOIN labels USING (doc_id)) WHERE r = 1")
def sel14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    w = Window.partitionBy("source", "lang").orderBy(F.desc(F.coalesce("quality", F.lit(-1))), "n_chars", "doc_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "lang", "doc_id")


@query("sel15_best_of_n", "SELECT conv_id, arg_min(turn, (length(text), turn)) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def sel15(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'")
    return answers.groupBy("conv_id").agg(F.min_by("turn", F.struct(F.length("text"), "turn")).alias("turn"))


SQL["sel15_best_of_n"] = "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1"


def mix_weights(share: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """Weights of buckets whose attributed shares (kinds x buckets) add up to `mix`; ValueError if there are none."""
    if np.linalg.matrix_rank(share, tol=1e-10) < len(mix):
        raise ValueError("token mix unavailable: singular attribution matrix")
    weight = np.linalg.solve(share, mix)
    if (weight <= 0).any():
        raise ValueError("token mix infeasible: a bucket's weight isn't positive")
    return weight


@query("sel16_token_mix")
def sel16(spark, d):
    """Weights of all languages that give an equal mix of tokens, and prefixes cut where they come nearest.

    Tokens are attributed to languages too: every fourth document counts for the
    language that follows its own. The attribution matrix (languages by languages)
    is summed by Spark and solved on the driver; a mix that can't be had raises.
    """
    rows = candidates(spark, d).where("lang is not null")
    table_ = {(r["lang"], r["moved"]): float(r["t"]) for r in rows.groupBy("lang", (F.col("doc_id") % 4 == 0).alias("moved")).agg(F.sum("tokens").alias("t")).collect()}  # two rows a language
    langs = sorted({g for g, _ in table_})
    k = len(langs)
    m = np.zeros((k, k))
    for i, g in enumerate(langs):
        m[i, i] += table_.get((g, False), 0.0) + table_.get((g, None), 0.0)
        m[(i + 1) % k, i] += table_.get((g, True), 0.0)
    supply = m.sum(0)
    weight = mix_weights(m / supply, np.full(k, 1 / k)) if k else supply
    total = min([20000.0, *(supply / weight)])
    targets = spark.createDataFrame([(g, float(total * x)) for g, x in zip(langs, weight)], "lang string, target double")
    cut = S.running_total(rows.join(F.broadcast(targets), "lang"), ["lang"], ["rank", "doc_id"], "tokens").withColumn("before", F.col("running") - F.col("tokens"))
    nearer = (F.col("running") - F.col("target")) < (F.col("target") - F.col("before"))
    return cut.where((F.col("running") <= F.col("target")) | ((F.col("before") < F.col("target")) & nearer)).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


@query("sel17_capped_choice", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_h}, doc_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_h}, doc_id) AS s FROM documents) WHERE s <= 12) WHERE r <= 100")
def sel17(spark, d):
    """At most twelve rows of a source, a hundred in all: the caps are the feature."""
    capped = S.top_by_hash(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 12, "q")
    return capped.orderBy(F.sha2(F.concat_ws("\x1f", F.lit("q"), F.col("doc_id").cast("string")), 256), "doc_id").limit(100).select("doc_id")


@query("sel18_budget_and_cap", f"SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id) AS r FROM {_prefix.replace('{c}', _cand)}) WHERE running - tokens < 5000 AND r <= 10")
def sel18(spark, d):
    rows = candidates(spark, d).withColumn("target", F.lit(5000))
    # the first ten of the prefix: the prefix holds a source's first rows, so its own ranks are theirs
    r = F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id"))
    return S.prefix_by_quota(rows, "source", ["rank", "doc_id"], "tokens", "target").withColumn("r", r).where("r <= 10").select("doc_id")


@query("sel19_stratified_preview", f"SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY {_h}, doc_id) AS r FROM documents) ORDER BY r, source, lang LIMIT 100")
def sel19(spark, d):
    w = Window.partitionBy("source", "lang").orderBy(F.sha2(F.concat_ws("\x1f", F.lit("q"), F.col("doc_id").cast("string")), 256), "doc_id")
    rows = table(spark, d, "documents").select("source", "lang", "doc_id").withColumn("r", F.row_number().over(w))
    return rows.orderBy("r", "source", "lang").limit(100).select("source", "lang", "doc_id")


@query("sel20_family_cap", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 25")
def sel20(spark, d):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return table(spark, d, "documents").select("lang", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 25").select("lang", "doc_id")


@query("sel21_exact_split", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_h}, doc_id) <= CAST(floor(0.05 * count(*) OVER ()) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM documents")
def sel21(spark, d):
    """An exact number of rows by hash order: the boundary comes from bin counts, not from one sorted task."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\x1f", F.lit("q"), F.col("doc_id").cast("string")), 256).alias("h"), F.lit(1).alias("one"))
    every = docs.agg(F.count(F.lit(1)).alias("every"))
    placed = S.running_total(docs, [], ["h", "doc_id"], "one", "place").crossJoin(F.broadcast(every))  # one row
    return placed.select("doc_id", F.when(F.col("place") <= F.floor(F.lit(0.05) * F.col("every")), "val").otherwise("train").alias("split"))


@query(
    "sel22_reserve_then_finalise",
    f"""WITH c AS {_cand}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM c),
    k AS (SELECT doc_id, source, tokens, rank FROM r WHERE running - tokens < 8000), f AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM k WHERE doc_id % 3 <> 0)
    SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM f WHERE running - tokens < 3000""",
)
def sel22(spark, d):
    pool = S.prefix_by_quota(candidates(spark, d).withColumn("t", F.lit(8000)), "source", ["rank", "doc_id"], "tokens", "t").drop("running", "t")
    final = S.prefix_by_quota(pool.where("doc_id % 3 <> 0").withColumn("t", F.lit(3000)), "source", ["rank", "doc_id"], "tokens", "t")
    return final.select("doc_id", "source", "running")


@query(
    "sel23_two_ways_agree",
    f"""WITH p AS {_prefix.replace('{c}', _cand)}, a AS (SELECT source, doc_id FROM p WHERE running - tokens < 5000), b AS (SELECT source, doc_id FROM p WHERE running - tokens < 5000 + doc_id % 2 * 3000)
    SELECT a.source IS NOT NULL AS by_first, b.source IS NOT NULL AS by_second, count(*) AS docs FROM a FULL JOIN b USING (source, doc_id) GROUP BY ALL""",
)
def sel23(spark, d):
    """Documents that both ways take, or one alone: the second way is given a planted difference for odd ids."""
    a = sel1(spark, d).select("source", "doc_id", F.lit(True).alias("x"))
    rows = candidates(spark, d).withColumn("t", F.lit(5000) + F.col("doc_id") % 2 * 3000)
    b = S.prefix_by_quota_windowed(rows, "source", ["rank", "doc_id"], "tokens", "t").select("source", "doc_id", F.lit(True).alias("y"))
    j = a.join(b, ["source", "doc_id"], "full")
    return j.groupBy(F.col("x").isNotNull().alias("by_first"), F.col("y").isNotNull().alias("by_second")).agg(F.count(F.lit(1)).alias("docs"))


def share_search(start: dict[str, int], caps: dict[str, int], amounts, strides=(128, 32, 8, 1), ahead: int = 400) -> dict[str, int]:
    """Prefix lengths whose token shares come nearest to equal, by exchange of `stride` rows between two groups.

    Lengths keep their total. At each stride the exchange that lowers the squared
    share error most is made, until none does. Where `ahead` exchanges at the first
    stride wouldn't cross all rows, larger strides, by four, come before it.
    `amounts(wanted)` gives the running sums of all (group, length) pairs in `wanted`.
    """
    while strides[0] * ahead < sum(start.values()):
        strides = (4 * strides[0], *strides)
    groups, counts, known = sorted(start), dict(start), {}

    def loss(ns):
        total = sum(known[g, ns[g]] for g in groups)
        return sum((known[g, ns[g]] / total - 1 / len(groups)) ** 2 for g in groups) if total else 0.0

    for stride in strides:
        while True:
            # each group's next lengths, some exchanges ahead, are fetched at once
            near = {(g, counts[g] + k * stride) for g in groups for k in (-1, 0, 1)}
            if any(0 <= n <= caps[g] and (g, n) not in known for g, n in near):
                near = {(g, counts[g] + k * stride) for g in groups for k in range(-ahead, ahead + 1)}
                known |= amounts({(g, n) for g, n in near if 0 <= n <= caps[g] and (g, n) not in known})
            best, choice = loss(counts), None
            for i in groups:
                for j in groups:
                    if i == j or counts[i] < stride or counts[j] + stride > caps[j]:
                        continue
                    trial = counts | {i: counts[i] - stride, j: counts[j] + stride}
                    score = loss(trial)
                    if score < best - 1e-16:
                        best, choice = score, trial
            if choice is None:
                break
            counts = choice
    return counts


@query("sel24_prefix_search")
def sel24(spark, d):
    """Lengths of the languages' prefixes, half of all rows together, whose token shares come nearest to equal.

    Starts from equal lengths as far as languages have the rows, and exchanges rows
    between languages at strides 128, 32, 8 and 1. Windows give each language's
    running sums; the driver fetches those that a stride's next exchanges can reach,
    at most 801 numbers a language at once. Rows without a language take no part.
    """
    rows = candidates(spark, d).where("lang is not null").withColumn("one", F.lit(1))
    rows = S.running_total(S.running_total(rows, ["lang"], ["rank", "doc_id"], "one", "n"), ["lang"], ["rank", "doc_id"], "tokens")
    rows = rows.select("lang", "n", "running").persist(StorageLevel.DISK_ONLY)
    caps = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.max("n").alias("n")).collect()}
    goal, start = sum(caps.values()) // 2, {g: 0 for g in caps}
    for left, g in zip(range(len(caps), 0, -1), sorted(caps, key=lambda g: (caps[g], g))):
        start[g] = min(caps[g], (goal - sum(start.values())) // left)

    def amounts(wanted):
        at = spark.createDataFrame(sorted(wanted), "lang string, n long")
        found = {(r["lang"], r["n"]): r["running"] for r in rows.join(F.broadcast(at), ["lang", "n"]).collect()}
        return {(g, n): 0 for g, n in wanted if n == 0} | found

    chosen = share_search(start, caps, amounts)
    sums = amounts(set(chosen.items()))
    rows.unpersist()
    return spark.createDataFrame([(g, n, int(sums[g, n])) for g, n in sorted(chosen.items())], "lang string, docs long, tokens long")


# ---- tokens, packing, windows

_ids = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
_len = f"(SELECT doc_id, len({_ids}) + 2 AS n FROM documents)"
_off = f"(SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS a FROM {_len})"
T_LEN = 512


def offsets(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, a): where each document starts in the stream, without one task that sorts everything:
    documents are cut into id ranges, ranges are summed, and offsets are taken within ranges."""
    docs = table(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) + 2).cast("long").alias("n"))
    docs = docs.withColumn("part", F.floor(F.col("doc_id") / 1000))
    # a thousand ids a part, a thousand parts a block: no window holds more than the blocks, a millionth of the ids
    parts = docs.groupBy("part").agg(F.sum("n").alias("s")).withColumn("block", F.floor(F.col("part") / 1000))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = parts.groupBy("block").agg(F.sum("s").alias("b"))
    blocks = blocks.select("block", (F.sum("b").over(upto(Window.partitionBy().orderBy("block"))) - F.col("b")).alias("base"))
    parts = parts.join(blocks, "block").select("part", (F.col("base") + F.sum("s").over(upto(Window.partitionBy("block").orderBy("part"))) - F.col("s")).alias("before"))
    v = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return docs.join(parts, "part").select("doc_id", "n", (F.col("before") + F.sum("n").over(v) - F.col("n")).alias("a"))


@query("pck1_stream_accounting", f"SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST((sum(n) - 1) // {T_LEN} AS BIGINT) AS blocks, CAST((sum(n) - 1) // {T_LEN} * {T_LEN} AS BIGINT) AS positions, CAST(sum(n) - 1 - (sum(n) - 1) // {T_LEN} * {T_LEN} AS BIGINT) AS tail FROM {_len}")
def pck1(spark, d):
    s = offsets(spark, d).agg(F.sum("n").alias("tokens"))
    blocks = F.floor((F.col("tokens") - 1) / T_LEN)
    return s.select("tokens", blocks.alias("blocks"), (blocks * T_LEN).alias("positions"), (F.col("tokens") - 1 - blocks * T_LEN).alias("tail"))


@query("pck2_block_documents", f"SELECT doc_id, unnest(range(a // {T_LEN}, (a + n - 1) // {T_LEN} + 1)) AS block, a FROM {_off}")
def pck2(spark, d):
    return offsets(spark, d).select("doc_id", F.explode(F.sequence(F.floor(F.col("a") / T_LEN), F.floor((F.col("a") + F.col("n") - 1) / T_LEN))).alias("block"), "a")


@query("pck3_loss_mask", f"SELECT doc_id, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS repeated, len(w) AS n FROM (SELECT doc_id, {_ids} AS w FROM documents)")
def pck3(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)")).alias("w"))
    return w.select("doc_id", F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1)))).cast("long").alias("repeated"), F.size("w").cast("long").alias("n"))


@query("pck4_epoch_order", "SELECT e AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY sha256(concat_ws(chr(31), e, doc_id)), doc_id) AS place FROM documents, range(2) t(e)")
def pck4(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
    rows = rows.withColumns({"h": F.sha2(F.concat_ws("\x1f", F.col("epoch").cast("string"), F.col("doc_id").cast("string")), 256), "one": F.lit(1)})
    return S.running_total(rows, ["epoch"], ["h", "doc_id"], "one", "place").select("epoch", "doc_id", "place")


@query(
    "pck6_contiguity",
    f"""WITH o AS (SELECT doc_id, n, a + CASE WHEN doc_id % 97 = 5 THEN 3 ELSE 0 END AS a FROM {_off}), s AS (SELECT *, lag(a + n) OVER (ORDER BY doc_id) AS back FROM o)
    SELECT CASE WHEN back < a THEN 'gap' WHEN back > a THEN 'overlap' ELSE 'joined' END AS state, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, min(doc_id) AS first_doc FROM s GROUP BY 1""",
)
def pck6(spark, d):
    """Where the stream of documents isn't contiguous: some starts are planted three positions too late.

    A document's predecessor is found in its id range; a range's first row looks at the
    last one of the nearest range before it that has rows.
    """
    o = offsets(spark, d).select("doc_id", "n", (F.col("a") + F.when(F.col("doc_id") % 97 == 5, 3).otherwise(0)).alias("a")).withColumn("part", F.floor(F.col("doc_id") / 1000))
    ends = o.groupBy("part").agg(F.max_by(F.col("a") + F.col("n"), "doc_id").alias("end")).withColumn("block", F.floor(F.col("part") / 1000))
    last = ends.groupBy("block").agg(F.max_by("end", "part").alias("last"))
    last = last.select("block", F.lag("last").over(Window.partitionBy().orderBy("block")).alias("carried"))
    ends = ends.join(last, "block").select("part", F.coalesce(F.lag("end").over(Window.partitionBy("block").orderBy("part")), "carried").alias("carried"))
    back = F.coalesce(F.lag(F.col("a") + F.col("n")).over(Window.partitionBy("part").orderBy("doc_id")), "carried")
    state = F.when(back < F.col("a"), "gap").when(back > F.col("a"), "overlap").otherwise("joined")
    return o.join(ends, "part").withColumn("state", state).groupBy("state").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.min("doc_id").alias("first_doc"))


@query("jn6_position_to_shard", f"WITH o AS {_off} SELECT doc_id, max(s) AS shard FROM o JOIN (SELECT CAST(k AS BIGINT) AS s, k * 40000 AS b FROM range((SELECT max(a) // 40000 + 1 FROM o)) t(k)) ON b <= a GROUP BY doc_id")
def jn6(spark, d):
    """The shard of fixed width that holds each position: arithmetic, so no shard list can be too short."""
    return offsets(spark, d).select("doc_id", F.floor(F.col("a") / 40000).alias("shard"))


@query("tok4_bytes_per_token", f"SELECT source, round(sum(strlen(text)) / sum(len({_ids})), 6) AS bytes_per_token FROM documents GROUP BY ROLLUP (source)")
def tok4(spark, d):
    rows = table(spark, d, "documents").select("source", F.octet_length("text").alias("b"), F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).alias("n"))
    return rows.rollup("source").agg(F.round(F.sum("b") / F.sum("n"), 6).alias("bytes_per_token"))


@query("tok6_first_tokens", f"SELECT token, n FROM (SELECT ({_ids})[1] AS token, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, token LIMIT 20")
def tok6(spark, d):
    first = F.regexp_extract("text", r"[\p{L}\p{N}]+", 0)
    return table(spark, d, "documents").groupBy(first.alias("token")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query(
    "pln1_two_pass_plan",
    """WITH s AS (SELECT e, doc_id, row_number() OVER (ORDER BY e, sha256(concat_ws(chr(31), e, doc_id)), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents, range(2) t(e))
    SELECT uses, count(*) AS docs FROM (SELECT doc_id, count(*) FILTER (WHERE p < least(1000, n // 32) * 32) AS uses FROM s GROUP BY doc_id) GROUP BY uses""",
)
def pln1(spark, d):
    """Two hash-ordered passes, groups of 32, a thousand at most; how many rows are used how often."""
    order = pck4(spark, d)
    n = table(spark, d, "documents").count()
    place = F.col("epoch") * n + F.col("place") - 1
    used = place < min(1000, 2 * n // 32) * 32
    return order.groupBy("doc_id").agg(F.count_if(used).alias("uses")).groupBy("uses").agg(F.count(F.lit(1)).alias("docs"))


# an epoch is cut into blocks of ten updates: seven take eight rows of each language, three take 32 opening turns
_kinds = "(SELECT e, b, i, CASE WHEN i < 7 THEN 'language' ELSE 'replay' END AS kind, row_number() OVER (PARTITION BY e, b ORDER BY sha256(concat_ws(chr(31), 'kind', e, b, i)), i) - 1 AS slot FROM range(2) x(e), range((SELECT blocks FROM m)) y(b), range(10) z(i))"


@query(
    "pln2_block_plan",
    f"""WITH f AS (SELECT e, lang AS stream, 'd' || doc_id AS id, row_number() OVER (PARTITION BY e, lang ORDER BY sha256(concat_ws(chr(31), e, lang, doc_id)), doc_id) - 1 AS p FROM documents, range(2) x(e) WHERE lang IS NOT NULL),
    r AS (SELECT e, 'replay' AS stream, 'c' || conv_id AS id, row_number() OVER (PARTITION BY e ORDER BY sha256(concat_ws(chr(31), e, 'replay', conv_id)), conv_id) - 1 AS p FROM (SELECT DISTINCT conv_id FROM conversations), range(2) x(e)),
    m AS (SELECT least((SELECT min(n) FROM (SELECT count(*) // 56 AS n FROM f WHERE e = 0 GROUP BY stream)), (SELECT count(*) // 96 FROM r WHERE e = 0)) AS blocks),
    k AS (SELECT *, row_number() OVER (PARTITION BY e, b, kind ORDER BY slot) - 1 AS j FROM {_kinds}),
    t AS (SELECT e, stream, id, p // 8 AS q, 7 AS per, 'language' AS kind FROM f UNION ALL SELECT e, stream, id, p // 32, 3, 'replay' FROM r)
    SELECT t.e * (SELECT blocks FROM m) * 10 + k.b * 10 + k.slot AS update_id, t.stream, t.id FROM t JOIN k ON t.e = k.e AND t.kind = k.kind AND t.q // t.per = k.b AND t.q % t.per = k.j""",
)
def pln2(spark, d):
    """(update_id, stream, id): two epochs of blocks of ten updates, seven of eight rows of each language, three of 32 conversations.

    Streams are shuffled by a hash for each epoch, the kinds of a block's updates too. There are as many whole
    blocks as the shortest stream fills; what is left over takes no part in that epoch.
    """
    epochs = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("e")
    h = lambda *c: F.sha2(F.concat_ws("\x1f", *[x.cast("string") for x in c]), 256)
    docs = table(spark, d, "documents").where("lang is not null").select("lang", "doc_id", epochs)
    docs = docs.select("e", F.col("lang").alias("stream"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("o"), h(F.col("e"), F.col("lang"), F.col("doc_id")).alias("h"))
    talks = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", epochs)
    talks = talks.select("e", F.lit("replay").alias("stream"), F.concat(F.lit("c"), "conv_id").alias("id"), F.col("conv_id").alias("o"), h(F.col("e"), F.lit("replay"), F.col("conv_id")).alias("h"))
    rows = S.running_total(docs.unionByName(talks).withColumn("one", F.lit(1)), ["e", "stream"], ["h", "o"], "one", "p")
    counts = {r["stream"]: r["n"] for r in docs.unionByName(talks).where("e = 0").groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a stream
    blocks = min((n // (96 if s == "replay" else 56) for s, n in counts.items()), default=0) if "replay" in counts else 0
    slots = spark.range(2 * blocks * 10).select(F.floor(F.col("id") / (blocks * 10 or 1)).alias("e"), F.floor(F.col("id") / 10 % (blocks or 1)).cast("long").alias("b"), (F.col("id") % 10).alias("i"))
    slots = slots.withColumn("slot", F.row_number().over(Window.partitionBy("e", "b").orderBy(h(F.lit("kind"), F.col("e"), F.col("b"), F.col("i")), "i")) - 1)
    slots = slots.withColumn("replay", F.col("i") >= 7).withColumn("j", F.row_number().over(Window.partitionBy("e", "b", "replay").orderBy("slot")) - 1)
    replay = F.col("stream") == "replay"
    q = F.floor((F.col("p") - 1) / F.when(replay, 32).otherwise(8))
    per = F.when(replay, 3).otherwise(7)
    rows = rows.select("e", "stream", "id", replay.alias("replay"), F.floor(q / per).alias("b"), (q % per).alias("j"))
    return rows.join(slots, ["e", "replay", "b", "j"]).select((F.col("e") * blocks * 10 + F.col("b") * 10 + F.col("slot")).alias("update_id"), "stream", "id")


# ---- the flagship: clean, deduplicate, decontaminate, select, report

_flag = f"""WITH c AS (SELECT doc_id, source, b AS text FROM (SELECT doc_id, source, {O.clean('text')} AS b FROM documents) WHERE {document_reason_sql('b')} IS NULL),
    u AS (SELECT * FROM (SELECT *, sha256(text) AS key, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM c) WHERE r = 1),
    g AS ({_shingle_sql('u', 13, 'doc_id')}), p AS (SELECT DISTINCT g FROM ({_shingle_sql('benchmark', 13, 'item_id')})),
    k AS (SELECT source, doc_id, key, {_W} + 2 AS tokens FROM u WHERE doc_id NOT IN (SELECT doc_id FROM g SEMI JOIN p USING (g))),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM k)
    SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, min(doc_id) AS first_doc FROM s WHERE running - tokens < 5000 GROUP BY source"""


@query("flagship_report", _flag)
def flagship(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", T.strip(T.normalise(F.col("text"))).alias("text"))
    kept = docs.where(T.document_reason(F.col("text")).isNull())
    unique = D.representatives(kept.withColumn("key", F.sha2("text", 256)), "key", ["doc_id"])
    bad = D.protected_overlap(unique, table(spark, d, "benchmark"), "doc_id", "text", "text").select("doc_id")
    rows = unique.join(bad, "doc_id", "left_anti").select("source", "doc_id", "key", (F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) + 2).cast("long").alias("tokens"))
    chosen = S.prefix_by_quota(rows.withColumn("t", F.lit(5000)), "source", ["key", "doc_id"], "tokens", "t")
    return chosen.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.min("doc_id").alias("first_doc"))


# ---- orders by arithmetic, caps with replacement, rounds and proportional merges


def _round_sql(x: str, n: str, seed: int, epoch: str, backwards: bool) -> str:
    """The swap-or-not rounds of `operators.permutation` in SQL."""
    key = f"(CAST(concat('0x', left(md5(concat('{seed}:', {epoch}, ':', r)), 15)) AS BIGINT) % {n} + {n} - a) % {n}"
    order = "range(31, -1, -1)" if backwards else "range(32)"
    return f"list_reduce(list_prepend({x}, {order}), lambda a, r: CASE WHEN left(md5(concat('{seed}:', {epoch}, ':', r, ':', greatest(a, {key}))), 1) < '8' THEN {key} ELSE a END)"


_numbered = "(SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(chr(31), 'epoch', doc_id)), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, place): documents numbered from 0 in hash order."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\x1f", F.lit("epoch"), F.col("doc_id").cast("string")), 256).alias("h"), F.lit(1).alias("one"))
    return S.running_total(rows, [], ["h", "doc_id"], "one", "place").select("doc_id", (F.col("place") - 1).alias("place"))


@query(
    "pck4_resumed_epochs",
    f"""WITH d AS {_numbered}, n AS (SELECT count(*) AS n FROM documents), p AS (SELECT unnest(range(n // 3, n // 3 + n + n // 4)) AS position, n FROM n),
    q AS (SELECT position, position // n AS epoch, {_round_sql("position % n", "n", 11, "(position // n)", True)} AS place FROM p)
    SELECT position, epoch, doc_id FROM q JOIN d USING (place)""",
)
def pck4_resumed(spark, d):
    """Documents at positions n/3 to n/3 + 5n/4 over two epochs, used in three runs that each go on where the log says."""
    _checkpoints(spark)
    places = _places(spark, d).checkpoint()
    n = places.count()
    if not n:
        return places.select(F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("epoch"), "doc_id")
    path = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    P.PositionLog(spark, path).append(P.Plan(n, 11, n // 3, n // 3, n // 3 + n + n // 4))
    parts = []
    for _ in range(3):
        log = P.PositionLog(spark, path)
        plan = log.latest()
        most = min(-(-(plan.end - plan.start) // 3), plan.end - plan.committed)
        parts.append(P.planned_rows(spark, plan, most))
        log.append(plan.commit(most))
    used = parts[0].union(parts[1]).union(parts[2])
    return used.join(places, "place").select("position", "epoch", "doc_id")


@query(
    "pck4_place_of_document",
    f"WITH d AS {_numbered} SELECT doc_id, 5 * n + {_round_sql('place', 'n', 11, '5', False)} AS position FROM d",
)
def pck4_place(spark, d):
    """Where each document comes in epoch 5: the way back from a row to its position."""
    _checkpoints(spark)
    places = _places(spark, d).checkpoint()
    return P.positions_of(places, "place", max(places.count(), 1), 11, 5).select("doc_id", "position")


@query(
    "pck4_fixed_subset",
    f"""WITH d AS {_numbered}, k AS (SELECT n, n // 7 AS k FROM (SELECT count(*) AS n FROM documents)), i AS (SELECT unnest(range(k)) AS i, n, k FROM k),
    s AS (SELECT i AS stratum, i * n // k + CAST(concat('0x', left(md5(concat('3:subset:', i)), 15)) AS BIGINT) % ((i + 1) * n // k - i * n // k) AS place FROM i)
    SELECT stratum, doc_id FROM s JOIN d USING (place)""",
)
def pck4_subset(spark, d):
    _checkpoints(spark)
    places = _places(spark, d).checkpoint()
    n = places.count()
    return P.fixed_subset(spark, n, n // 7, 3).join(places, "place").select("stratum", "doc_id")


@query(
    "sel17_share_caps",
    """WITH RECURSIVE t AS (SELECT CAST(floor(0.4 * count(*)) AS BIGINT) AS total FROM documents),
    d AS (SELECT doc_id, concat('s', source) AS s, concat('l', lang) AS l, row_number() OVER (ORDER BY sha256(concat_ws(chr(31), 'cap', doc_id))) AS i, total, CAST(ceil(0.12 * total) AS BIGINT) AS sc, CAST(ceil(0.45 * total) AS BIGINT) AS lc FROM documents, t),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, MAP {'': CAST(0 AS BIGINT)} AS c, CAST(NULL AS BIGINT) AS doc_id UNION ALL
          SELECT x.i, n + CAST(x.ok AS BIGINT), CASE WHEN x.ok THEN map_concat(c, MAP {x.s: x.cs + 1, x.l: x.cl + 1}) ELSE c END, CASE WHEN x.ok THEN x.id END
          FROM (SELECT d.i, g.n, g.c, d.doc_id AS id, s, l, coalesce(c[s], 0) AS cs, coalesce(c[l], 0) AS cl, g.n < total AND coalesce(c[s], 0) < sc AND coalesce(c[l], 0) < lc AS ok FROM g JOIN d ON d.i = g.i + 1) x)
    SELECT doc_id FROM g WHERE doc_id IS NOT NULL""",
)
def sel17_shares(spark, d):
    """Two fifths of all documents, at most 12 % of them from a source and 45 % in a language; the next in hash order replace those turned away."""
    _checkpoints(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2(F.concat_ws("\x1f", F.lit("cap"), F.col("doc_id").cast("string")), 256).alias("h"))
    total = int(0.4 * docs.count())
    return S.capped_choice(docs, total, {"source": math.ceil(0.12 * total), "lang": math.ceil(0.45 * total)}, "h").select("doc_id")


_families = "(SELECT concat_ws('/', lang, source) AS family, doc_id, row_number() OVER (PARTITION BY concat_ws('/', lang, source) ORDER BY sha256(concat_ws(chr(31), 'q', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY concat_ws('/', lang, source)) AS n FROM documents)"


@query(
    "sel13_top_up",
    f"""WITH f AS {_families}, t AS (SELECT CAST(floor(0.6 * count(*)) AS BIGINT) AS total, count(DISTINCT family) AS k FROM f),
    b AS (SELECT *, least(n, total // k) AS base FROM f, t), l AS (SELECT max(total) - count(*) FILTER (WHERE r <= base) AS lack FROM b),
    x AS (SELECT family, doc_id, row_number() OVER (ORDER BY r - base, family) AS turn FROM b WHERE r > base)
    SELECT family, doc_id FROM b WHERE r <= base UNION ALL SELECT family, doc_id FROM x, l WHERE turn <= lack""",
)
def sel13_top_up(spark, d):
    """Three fifths of all documents in equal shares of language and source; what small families lack is dealt to the others in rounds."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("family"), "doc_id", F.sha2(F.concat_ws("\x1f", F.lit("q"), F.col("doc_id").cast("string")), 256).alias("h"), F.lit(1).alias("one"))
    quotas = S.top_up_quotas(docs.groupBy("family").agg(F.count(F.lit(1)).alias("n")), int(0.6 * docs.count())).select("family", "quota")
    return S.prefix_by_quota(docs.join(F.broadcast(quotas), "family"), "family", ["h", "doc_id"], "one", "quota").select("family", "doc_id")


_merged = "(SELECT doc_id, source, row_number() OVER (ORDER BY (2 * r - 1) / q, source) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(chr(31), 'mix', doc_id)), doc_id) AS r, CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS q FROM documents))"


def _merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.concat_ws("\x1f", F.lit("mix"), F.col("doc_id").cast("string")), 256).alias("h"))
    return S.proportional_merge(docs, "source", ["h", "doc_id"])


@query("sel8_quota_interleave", f"SELECT doc_id, place FROM {_merged}")
def sel8_merge(spark, d):
    return _merge(spark, d).select("doc_id", "place")


@query(
    "sel8_prefix_shares",
    f"""WITH m AS {_merged}, q AS (SELECT source, count(*) AS q FROM m GROUP BY source), n AS (SELECT count(*) AS n FROM m),
    x AS (SELECT source, place, q, n, row_number() OVER (PARTITION BY source ORDER BY place) AS r FROM m JOIN q USING (source), n)
    SELECT source, max(greatest(abs(CAST(r * n - place * q AS DOUBLE) / n), abs(CAST((r - 1) * n - (place - 1) * q AS DOUBLE) / n))) < 1 AS within_one, count(*) AS docs FROM x GROUP BY source""",
)
def sel8_shares(spark, d):
    """Whether each source's count in every prefix of the merge is within one row of its share."""
    merged = _merge(spark, d).select("source", "h", "doc_id", "place")
    n = merged.count()
    quota = merged.groupBy("source").agg(F.count(F.lit(1)).alias("q"))
    r = S.running_total(merged.withColumn("one", F.lit(1)), ["source"], ["h", "doc_id"], "one", "r")
    rows = r.join(F.broadcast(quota.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    off = lambda k, at: F.abs((k * F.lit(n) - at * F.col("q")).cast("double") / F.lit(n))
    worst = F.greatest(off(F.col("r"), F.col("place")), off(F.col("r") - 1, F.col("place") - 1))
    return rows.groupBy("source").agg((F.max(worst) < 1).alias("within_one"), F.count(F.lit(1)).alias("docs"))
