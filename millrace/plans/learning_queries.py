"""Queries: preference pairs, rewards, loss masks, splits by component, exports in total order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions.code import asserts_from_pairs, entry_point
from ..operators import census as C
from ..operators import dedup as D
from ..operators import learning as L
from ..operators import select as S
from ..sources.tables import table
from . import oracle as O
from .chat_queries import _sp
from .dedup_queries import _checkpoints, _pairs, _print, turn_pairs
from .release_queries import _stream_sql, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_count = lambda x: f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'))"


@query(
    "cht7_preference_pairs",
    f"""WITH t AS (SELECT conv_id, turn, role, {O.strip("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")} AS x FROM conversations WHERE role IN ('user', 'assistant')),
    c AS (SELECT conv_id, list({{'role': role, 'content': x}} ORDER BY turn) AS c FROM t GROUP BY conv_id),
    r AS (SELECT conv_id, c, CASE WHEN conv_id % 7 = 3 THEN c[:-2] WHEN conv_id % 7 = 4 THEN [{{'role': c[1].role, 'content': concat(c[1].content, ' other')}}] || c[2:] ELSE c END AS s FROM c),
    q AS (SELECT conv_id, c, CASE WHEN len(s) = 0 OR conv_id % 7 = 5 THEN s ELSE s[:-2] || [{{'role': s[-1].role, 'content': concat(s[-1].content, ' worse')}}] END AS r FROM r),
    p AS (SELECT conv_id, c[:-2] AS m, r[:-2] AS n, c[-1].content AS a, r[-1].content AS b, coalesce(c[-1].role = 'assistant' AND r[-1].role = 'assistant', false) AS ends FROM q),
    k AS (SELECT *, coalesce(list_sum(list_transform(m, lambda z: {_count('z.content')})), 0) AS np, {_count('a')} + 1 AS na, {_count('b')} + 1 AS nb FROM p)
    SELECT conv_id, len(m) AS messages, sha256(a) AS chosen, sha256(b) AS rejected, CASE WHEN NOT ends THEN 'no_answer' WHEN len(m) = 0 THEN 'no_prompt' WHEN m <> n THEN 'prefix_differs' WHEN len(list_filter(m, lambda z: z.content = '')) > 0 THEN 'empty_turn'
    WHEN a = b THEN 'same_answer' WHEN least(length(a), length(b)) < 30 THEN 'short_answer' WHEN np > 150 THEN 'long_prompt' WHEN least(na, nb) < 8 THEN 'few_tokens' WHEN np + greatest(na, nb) > 260 THEN 'too_long' END AS reject FROM k""",
)
def cht7_pairs(spark, d):
    """Dialogues in one text each, and copies with another answer; in some copies the prefix differs, the answer is the same, or the last turn is gone."""
    rows = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    turn = F.struct("turn", F.when(F.col("role") == "user", "Human").otherwise("Assistant").alias("who"), "text")
    c = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("c"))
    kind = F.col("conv_id") % 7
    said = lambda x: F.concat(F.lit("\n\n"), x["who"], F.lit(": "), x["text"])
    whole = lambda c: F.array_join(F.transform(c, said), "")
    cut = F.when(kind == 3, F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0)))).otherwise(F.col("c"))
    other = F.when(kind == 4, F.transform(cut, lambda x, i: F.struct(x["turn"].alias("turn"), x["who"].alias("who"), F.when(i == 0, F.concat(F.rtrim(x["text"]), F.lit(" other"))).otherwise(x["text"]).alias("text")))).otherwise(cut)
    pairs = c.select("conv_id", whole(F.col("c")).alias("chosen"), F.when((kind == 5) | (F.size(cut) == 0), whole(other)).otherwise(F.concat(whole(other), F.lit(" worse"))).alias("rejected"))
    tokens = lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+"))
    out = L.preference_pairs(pairs, tokens, 150, 30, 8, 260)
    return out.select("conv_id", F.size("messages").cast("long").alias("messages"), F.sha2("chosen", 256).alias("chosen"), F.sha2("rejected", 256).alias("rejected"), "reject")


SPEC = "nonempty + no_repeat:0.5 + length:0.25 + reference_exact:2 + reference_contains:0.125"


@query(
    "rwd1_weighted_spec",
    f"""SELECT conv_id, turn, round(CASE WHEN {O.strip('a')} <> '' THEN 1.0 ELSE 0.0 END + 0.5 * CASE WHEN len(w) < 4 THEN 1.0 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) / (len(w) - 2) END
    + 0.25 * CASE WHEN len(w) = 0 THEN 0.0 ELSE exp(-power((len(w) - target) / CAST(target AS DOUBLE), 2)) END + CASE WHEN {O.squeeze('lower(a)')} = {O.squeeze('lower(r)')} THEN 2.0 ELSE 0.0 END
    + CASE WHEN r <> '' AND contains({O.squeeze('lower(a)')}, {O.squeeze('lower(r)')}) THEN 0.125 ELSE 0.0 END, 9) AS reward
    FROM (SELECT *, {_sp.replace('(text', '(a')} AS w, 20 + conv_id % 50 AS target, CASE WHEN conv_id % 3 = 0 THEN concat('  ', a, chr(10)) WHEN conv_id % 3 = 1 THEN left(a, 12) ELSE p END AS r FROM {_pairs})""",
)
def rwd1_spec(spark, d):
    """Answers rewarded by a spec of five weighted rules; references are the answer in other white space, its first letters, or the question."""
    reference = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), "a", F.lit("\n"))).when(F.col("conv_id") % 3 == 1, F.left("a", F.lit(12))).otherwise(F.col("p"))
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(L.reward(SPEC, F.col("a"), reference, 20 + F.col("conv_id") % 50), 9).alias("reward"))


@query(
    "pck3_block_masks",
    f"""WITH {_stream_sql}, x AS (SELECT split, start + k AS pos, w FROM p), n AS (SELECT split, count(*) AS n FROM x GROUP BY split),
    l AS (SELECT split, CAST((pos - 1) // 128 AS BIGINT) AS block, (pos - 1) % 128 AS i, w, lag(w) OVER (PARTITION BY split ORDER BY pos) AS before FROM x WHERE pos > 0)
    SELECT l.split, block, CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS learned, CAST(sum(CASE WHEN keep THEN i ELSE 0 END) AS BIGINT) AS places
    FROM (SELECT *, NOT (w = '0001' OR (w = '0002' AND i > 0 AND before = '0002')) AS keep FROM l) l JOIN n USING (split) WHERE (block + 1) * 128 < n GROUP BY ALL""",
)
def pck3_masks(spark, d):
    """Blocks of 128 inputs over the released streams: how many labels are learned from, and the sum of their places."""
    blocks = L.masked_blocks(streams(spark, d), 128, 1, 2)
    learned = F.aggregate("mask", F.lit(0).cast("long"), lambda a, b: a + b)
    places = F.aggregate(F.transform("mask", lambda x, i: x * i), F.lit(0).cast("long"), lambda a, b: a + b)
    return blocks.select("split", "block", learned.alias("learned"), places.alias("places"))


_linked = """g AS (SELECT DISTINCT conv_id AS a, min(conv_id) OVER (PARTITION BY text) AS b FROM conversations WHERE role = 'user' AND text <> ''),
    e AS (SELECT a, b FROM g WHERE a <> b UNION SELECT b, a FROM g WHERE a <> b), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT conv_id, least(conv_id, coalesce(m, conv_id)) AS component FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT a AS conv_id, min(b) AS m FROM r GROUP BY a) USING (conv_id))"""


@query(
    "sel12_linked_split",
    f"WITH RECURSIVE {_linked} SELECT conv_id, component, CASE WHEN CAST(concat('0x', left(sha256(concat_ws(chr(31), 'split', component)), 12)) AS BIGINT) / 281474976710656.0 < 1 / 21.0 THEN 'validation' ELSE 'train' END AS split FROM c",
)
def sel12_linked(spark, d):
    """Conversations that share a user's text are one component, and a component is on one side of the split."""
    _checkpoints(spark)
    said = table(spark, d, "conversations").where("role = 'user' and text <> ''").select("conv_id", F.sha2("text", 256).alias("h")).distinct()
    least = said.groupBy("h").agg(F.min("conv_id").alias("b"))
    linked = D.components(said.join(least, "h").where("conv_id <> b").select(F.col("conv_id").alias("a"), "b").distinct())
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    rows = ids.join(linked.withColumnRenamed("id", "conv_id"), "conv_id", "left").withColumn("component", F.coalesce("component", "conv_id"))
    return rows.select("conv_id", "component", F.when(S.hash_share(F.col("component"), "split") < 1 / 21, "validation").otherwise("train").alias("split"))


@query("srt1_total_order", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, source, doc_id) AS place FROM documents")
def srt1_total(spark, d):
    """Every document's place in a total order: a range sort, and the counts of the partitions before its own."""
    docs = table(spark, d, "documents").select("n_chars", "source", "doc_id")
    order = [F.desc("n_chars"), F.asc("source"), F.asc("doc_id")]
    _checkpoints(spark)
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33)).checkpoint()
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first"))  # a row for each partition
    before = F.sum("n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "_part").select("doc_id", (F.col("_pos") - F.col("first") + F.col("before") + 1).alias("place"))


_census = f"""(SELECT doc_id AS row_index, text, {O.clean('text')} AS b, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE doc_id % 6 END AS int_score, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE doc_id / 8.0 END AS score FROM documents WHERE doc_id % 9 <> 4)"""


def _census_of(spark, d):
    """Documents as JSON lines with scores under literal dotted names, bound by their count, exclusions and digest."""
    docs = table(spark, d, "documents")
    fields = F.struct(F.when(F.col("doc_id") % 4 != 1, F.col("doc_id") % 6).alias("metadata.int_score"), F.when(F.col("doc_id") % 5 != 2, F.col("doc_id") / 8.0).alias("metadata.score"), F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select(F.col("doc_id").alias("row_index"), F.to_json(fields).alias("raw"))
    excluded = docs.where("doc_id % 9 = 4").select(F.col("doc_id").alias("row_index"))
    binding = C.Binding(lines.count(), excluded.count(), C.multiset_digest(lines, "raw").first()["digest"])
    words = lambda c: F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))
    return C.census(lines, excluded, binding, lambda c: T.strip(T.normalise(c)), words, I.fingerprint, "text", "metadata.int_score", "metadata.score", 40)


@query("src6_census_records", f"SELECT row_index, sha256(b) AS cleaned_sha256, {_print.replace('(t)', '(b)')} AS fingerprint, {_count('b')} + 2 AS tokens, sha256(text) AS raw_sha256, int_score, score FROM {_census} WHERE text <> '' AND b <> '' AND length(b) >= 40")
def src6_records(spark, d):
    return _census_of(spark, d)[0].drop("record_sha256")


@query("src6_census_counters", f"""SELECT 'physical_rows' AS counter, count(*) AS n FROM documents UNION ALL SELECT 'excluded_rows', count(*) FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT 'empty_text', count(*) FILTER (WHERE text = '') FROM {_census}
    UNION ALL SELECT 'empty_after_cleaning', count(*) FILTER (WHERE text <> '' AND (b = '' OR length(b) < 40)) FROM {_census} UNION ALL SELECT 'eligible_rows', count(*) FILTER (WHERE text <> '' AND b <> '' AND length(b) >= 40) FROM {_census}""")
def src6_counters(spark, d):
    return _census_of(spark, d)[1]


@query("aud4_multiset_digest", """SELECT source, sha256(concat_ws(':', count(*), sum(p[1]), sum(p[2]), sum(p[3]), sum(p[4]))) AS digest FROM (SELECT source, list_transform(range(4), lambda k: CAST(CAST(concat('0x', substring(sha256(text), CAST(1 + 15 * k AS BIGINT), 15)) AS BIGINT) AS HUGEINT)) AS p FROM documents) GROUP BY source""")
def aud4_digest(spark, d):
    """The order-free digest of each source's texts: sums by partial aggregation, so a hot source is summed everywhere."""
    h = F.sha2("text", 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return table(spark, d, "documents").groupBy("source").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(k) for k in range(4)]), 256).alias("digest"))


@query(
    "vrf5_tests_from_pairs",
    """WITH a AS (SELECT conv_id, turn, list_transform(range(least(1 + (conv_id + turn) % 12, 8)), lambda i: concat('assert f', conv_id, '(', CASE i % 3 WHEN 0 THEN concat(conv_id, ', ', i) WHEN 1 THEN CAST(i AS VARCHAR) ELSE concat('[', i, ', ', turn, ']') END, ') == ',
    CASE i % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'None' WHEN 2 THEN '''a b''' ELSE CAST(conv_id * i AS VARCHAR) END)) AS tests FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN CASE WHEN conv_id % 5 IN (0, 4) THEN concat('g', turn) END WHEN conv_id % 5 IN (0, 4) THEN concat('g', turn) ELSE concat('f', conv_id) END AS entry,
    CASE WHEN turn % 6 = 5 THEN 0 ELSE len(tests) END AS n, sha256(CASE WHEN turn % 6 = 5 THEN '' ELSE array_to_string(tests, chr(10)) END) AS tests FROM a""",
)
def vrf5_pairs(spark, d):
    """Asserts from each turn's I/O pairs (some turns have malformed ones), and the entry point: of the code if it has one function, else of the tests."""
    number = lambda x: x.cast("string")
    given = lambda i: F.when(i % 3 == 0, F.concat(F.lit("["), "conv_id", F.lit(", "), number(i), F.lit("]"))).when(i % 3 == 1, number(i)).otherwise(F.concat(F.lit("[["), number(i), F.lit(", "), "turn", F.lit("]]")))
    wanted = lambda i: F.when(i % 4 == 0, "true").when(i % 4 == 1, "null").when(i % 4 == 2, '"a b"').otherwise(number(F.col("conv_id") * i))
    every = F.sequence(F.lit(0), ((F.col("conv_id") + F.col("turn")) % 12).cast("int"))
    io = F.concat(F.lit('{"inputs": ['), F.array_join(F.transform(every, given), ", "), F.lit('], "outputs": ['), F.array_join(F.transform(every, wanted), ", "), F.when(F.col("turn") % 6 == 5, "]").otherwise("]}"))
    one = F.concat(F.lit("def g"), "turn", F.lit("(x):\n    return x\n"))
    code = F.element_at(F.array(one, F.concat(one, F.lit("def h(x):\n    return x\n")), F.lit("def g(:"), F.concat(F.lit("async "), one), F.concat(one.substr(F.lit(1), F.length(one) - 13), F.lit("    def inner():\n        pass\n    return inner\n"))), (F.col("conv_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", code.alias("code"), asserts_from_pairs(io, F.concat(F.lit("f"), "conv_id")).alias("tests"))
    return rows.select("conv_id", "turn", entry_point(F.col("code"), F.col("tests")).alias("entry"), F.size("tests").cast("long").alias("n"), F.sha2(F.array_join("tests", "\n"), 256).alias("tests"))
