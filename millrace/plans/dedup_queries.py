"""Queries: identities, duplicates and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..operators import dedup as D
from ..sources.tables import shared_folder, table
from . import oracle as O

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder, where the session has none."""
    shared_folder(spark)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_norm = f"(SELECT doc_id, source, text, {O.clean('text')} AS cleaned FROM documents)"


def _cleaned(spark, d):
    return _docs(spark, d).select("doc_id", "source", "text", T.strip(T.normalise(F.col("text"))).alias("cleaned"))


@query("hsh1_sha256", f"SELECT doc_id, sha256(text) AS raw_sha256, sha256(cleaned) AS cleaned_sha256, strlen(text) AS raw_bytes FROM {_norm}")
def hsh1(spark, d):
    return _cleaned(spark, d).select("doc_id", I.sha256(F.col("text")).alias("raw_sha256"), I.sha256(F.col("cleaned")).alias("cleaned_sha256"), F.octet_length("text").cast("long").alias("raw_bytes"))


_print = f"sha256(encode('{I.DOMAIN}') || '\\x00'::BLOB || from_hex(lpad(hex(strlen(t)), 16, '0')) || encode(t))"


@query("hsh2_fingerprint", f"SELECT doc_id, {_print.replace('(t)', '(text)')} AS fingerprint FROM documents")
def hsh2(spark, d):
    return _docs(spark, d).select("doc_id", I.fingerprint(F.col("text")).alias("fingerprint"))


_rank = f"sha256(concat_ws(chr(31), '{I.RANK_DOMAIN}', '7', 'stage_a', source, {_print.replace('(t)', '(text)')}))"


@query("hsh3_rank", f"SELECT doc_id, {_rank} AS rank FROM documents")
def hsh3(spark, d):
    return _docs(spark, d).select("doc_id", I.rank(7, "stage_a", F.col("source"), I.fingerprint(F.col("text"))).alias("rank"))


@query("hsh4_blake2b_rank")
def hsh4(spark, d):
    return _docs(spark, d).select("doc_id", I.blake2b_rank(I.sha256(F.col("text"))).alias("rank"))


_h15 = "CAST(concat('0x', left(sha256(concat('holdout', chr(31), text)), 15)) AS BIGINT)"


@query("hsh5_holdout", f"SELECT doc_id, CAST({_h15} AS HUGEINT) * 100 < CAST(5 AS HUGEINT) * 1152921504606846976 AS val FROM documents")
def hsh5(spark, d):
    return _docs(spark, d).select("doc_id", I.holdout(F.col("text"), (95, 5)).alias("val"))


@query("hsh6_tail_key", "SELECT doc_id, sha1(right(text, 3000)) AS tail_sha1, sha1(text) AS sha1 FROM documents")
def hsh6(spark, d):
    return _docs(spark, d).select("doc_id", I.tail_key(F.col("text")).alias("tail_sha1"), F.sha1("text").alias("sha1"))


@query("hsh7_short_id", "SELECT conv_id, turn, concat('c_', left(md5(concat_ws('||', 'c', role, text)), 10)) AS id FROM conversations")
def hsh7(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", I.short_id("c", F.col("role"), F.col("text")).alias("id"))


@query("hsh8_seeds", "SELECT source, (CAST(concat('0x', left(sha256(source), 15)) AS BIGINT)) AS seed FROM (SELECT DISTINCT source FROM documents)")
def hsh8(spark, d):
    return _docs(spark, d).select("source").distinct().select("source", F.conv(F.left(F.sha2("source", 256), F.lit(15)), 16, 10).cast("long").alias("seed"))


@query("hsh9_set_fingerprint", "SELECT source, sha256(concat_ws(chr(31), CAST(count(*) AS VARCHAR), string_agg(i, chr(31) ORDER BY i))) AS fingerprint FROM (SELECT source, CAST(doc_id AS VARCHAR) AS i FROM documents) GROUP BY source")
def hsh9(spark, d):
    return _docs(spark, d).groupBy("source").agg(I.set_fingerprint(F.col("doc_id")).alias("fingerprint"))


@query("hsh10_sequence_commitment", "SELECT source, sha256(string_agg(concat(doc_id, ':', sha256(text)), chr(31) ORDER BY doc_id)) AS commitment FROM documents GROUP BY source")
def hsh10(spark, d):
    rows = _docs(spark, d).select("source", F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("p")).alias("x"))
    return rows.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), "\x1f"), 256).alias("commitment"))


@query("hsh11_file_digests")
def hsh11(spark, d):
    files = spark.read.format("binaryFile").load(f"{d}/region.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("nrm12_nfc_folded")
def nrm12(spark, d):
    return _docs(spark, d).select("doc_id", I.nfc_folded(F.col("text")).alias("folded"))


@query("ddp1_exact_dedup", f"SELECT min(doc_id) AS doc_id, sha1(cleaned) AS key FROM {_norm} GROUP BY sha1(cleaned)")
def ddp1(spark, d):
    rows = _cleaned(spark, d).select("doc_id", F.sha1("cleaned").alias("key"))
    return D.representatives(rows, "key", ["doc_id"]).select("doc_id", "key")


SQL["ddp2_window_dedup"] = SQL["ddp1_exact_dedup"]
QUERIES["ddp2_window_dedup"] = lambda spark, d: D.keep_first(_cleaned(spark, d).select("doc_id", F.sha1("cleaned").alias("key")), ["key"], ["doc_id"]).select("doc_id", "key")


@query("ddp3_representatives", f"SELECT key, raw, doc_id FROM (SELECT sha256(cleaned) AS key, sha256(text) AS raw, doc_id, row_number() OVER (PARTITION BY sha256(cleaned) ORDER BY sha256(text), doc_id) AS r FROM {_norm}) WHERE r = 1")
def ddp3(spark, d):
    rows = _cleaned(spark, d).select(F.sha2("cleaned", 256).alias("key"), F.sha2("text", 256).alias("raw"), "doc_id")
    return D.representatives(rows, "key", ["raw", "doc_id"])


@query("ddp4_disagreements", "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING min(lang) <> max(lang) OR min(source) <> max(source)")
def ddp4(spark, d):
    rows = _docs(spark, d).select(F.sha2("text", 256).alias("key"), F.concat_ws("|", "lang", "source").alias("v"), "lang", "source")
    return D.disagreements(rows, "key", "v")


SQL["ddp4_disagreements"] = "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING min(concat_ws('|', lang, source)) <> max(concat_ws('|', lang, source))"
_pairs = "(SELECT u.conv_id, u.turn, u.text AS p, a.text AS a FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def turn_pairs(spark, d):
    """(conv_id, turn, p, a): each user turn with the answer behind it."""
    c = table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("p")).join(answers, ["conv_id", "turn"])


@query("ddp5_pair_dedup", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY {O.prompt_key('p')}, {O.prompt_key('a')} ORDER BY conv_id, turn) AS r FROM {_pairs}) WHERE r = 1")
def ddp5(spark, d):
    rows = turn_pairs(spark, d).select("conv_id", "turn", T.prompt_key(F.col("p")).alias("kp"), T.prompt_key(F.col("a")).alias("ka"))
    return D.keep_first(rows, ["kp", "ka"], ["conv_id", "turn"]).select("conv_id", "turn")


@query("ddp6_prompt_dedup", "SELECT min(conv_id) AS conv_id FROM (SELECT conv_id, string_agg(concat(role, chr(31), text), chr(30) ORDER BY turn) AS k FROM conversations WHERE role <> 'assistant' GROUP BY conv_id) GROUP BY k")
def ddp6(spark, d):
    c = table(spark, d, "conversations").where("role <> 'assistant'")
    m = c.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"], x["text"]))).alias("k"))
    return m.groupBy("k").agg(F.min("conv_id").alias("conv_id")).select("conv_id")


_tok = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda z: z <> '')"


def _shingle_sql(source: str, n: int, keys: str) -> str:
    return f"SELECT DISTINCT {keys}, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g FROM (SELECT {keys}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT {keys}, {_tok} AS w FROM {source}) WHERE len(w) >= {n})"


_near = f"""WITH s AS ({_shingle_sql('documents', 3, 'doc_id, source')}), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.source = b.source AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a, b, round(p.c / (x.c + y.c - p.c), 9) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE p.c / (x.c + y.c - p.c) >= {{t}}"""


@query("ddp7_lexical_pairs", _near.replace("{t}", "0.6"))
def ddp7_pairs(spark, d):
    pairs = D.jaccard_pairs(_docs(spark, d), "doc_id", "text", "source", 3, 0.6)
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("ddp7_lexical_dedup")
def ddp7(spark, d):
    _checkpoints(spark)
    return D.greedy_similar(_docs(spark, d), "doc_id", "text", "source", 3, 0.95)


_cos = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_vec = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("ddp8_semantic_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_cos}, 6) AS cos FROM {_vec} a JOIN {_vec} b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_cos} >= 0.3")
def ddp8_pairs(spark, d):
    return D.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.3).select("a", "b", F.round("cos", 6).alias("cos"))


@query("ddp8_semantic_dedup")
def ddp8(spark, d):
    _checkpoints(spark)
    return D.greedy_keep(table(spark, d, "embeddings"), D.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.3).select("a", "b"), "vec_id")


@query("ddp9_diversity", f"SELECT a.vec_id AS vec_id, round(1 - avg({_cos}), 6) AS diversity FROM {_vec} a JOIN {_vec} b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def ddp9(spark, d):
    """One less the mean cosine to the rest of a label: (u . (S - u)) / (n - 1), S the sum of the label's n unit vectors."""
    v = _vectors(spark, d)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.withColumn("norm", norm).select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    parts = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("total"), F.max("n").alias("n"))  # a row a label
    mean = (F.aggregate(F.zip_with("u", "total", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - 1) / (F.col("n") - 1)
    return unit.join(sums.where("n > 1"), "label").select("vec_id", F.round(1 - mean, 6).alias("diversity"))


@query("ddp10_protected_overlap", f"WITH s AS ({_shingle_sql('documents', 13, 'doc_id')}), p AS (SELECT DISTINCT g FROM ({_shingle_sql('benchmark', 13, 'item_id')})) SELECT doc_id, count(*) AS grams FROM s SEMI JOIN p USING (g) GROUP BY doc_id")
def ddp10(spark, d):
    return D.protected_overlap(_docs(spark, d), table(spark, d, "benchmark"), "doc_id", "text", "text")


@query("ddp10_exact_prompt", f"SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND {O.squeeze('lower(text)')} IN (SELECT {O.squeeze('lower(text)')} FROM conversations WHERE role = 'user' AND conv_id % 10 = 0)")
def ddp10_prompt(spark, d):
    users = table(spark, d, "conversations").where("role = 'user'").select("conv_id", T.squeeze(F.lower("text")).alias("k"))
    suite = users.where("conv_id % 10 = 0").select("k").distinct()
    return users.join(suite, "k", "left_semi").select("conv_id").distinct()


@query(
    "ddp11_components",
    """WITH RECURSIVE k AS (SELECT DISTINCT conv_id AS id, left(lower(text), 12) AS key FROM conversations WHERE role = 'user'),
    e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (key)),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a""",
)
def ddp11(spark, d):
    _checkpoints(spark)
    keys = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"), F.left(F.lower("text"), F.lit(12)).alias("key")).distinct()
    star = keys.join(keys.groupBy("key").agg(F.min("id").alias("a")), "key").select("a", F.col("id").alias("b"))
    return D.components(star)


_blocks = f"(SELECT doc_id, array_to_string(list_slice(w, i, i + {{w}} - 1), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {{w}} + 2, {{s}})) AS i FROM (SELECT doc_id, {_tok} AS w FROM documents) WHERE len(w) >= {{w}}))"


def _window_rows(spark, d, w: int, s: int):
    words = _docs(spark, d).select("doc_id", D.tokens(F.col("text")).alias("w")).where(F.size("w") >= w)
    at = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w") - w + 1, F.lit(s))).alias("i"))
    return at.select(F.xxhash64(F.slice("w", F.col("i"), w)).alias("g"))


_rate = "SELECT coalesce(CAST(sum(n) AS BIGINT), 0) AS blocks, count(*) AS distinct_blocks, round(CASE WHEN sum(n) > 0 THEN 1 - count(*) / sum(n) ELSE 0.0 END, 9) AS rate FROM (SELECT count(*) AS n FROM {b} GROUP BY g)"


@query("ddp12_block_rate", _rate.format(b=_blocks.replace("{w}", "16").replace("{s}", "16")))
def ddp12(spark, d):
    return D.duplicate_rate(_window_rows(spark, d, 16, 16), "g")


@query("ddp13_window_rate", _rate.format(b=_blocks.replace("{w}", "32").replace("{s}", "4")))
def ddp13(spark, d):
    return D.duplicate_rate(_window_rows(spark, d, 32, 4), "g")


_manifests = "(SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS manifest, sha256(text) AS h FROM documents WHERE doc_id % 7 = 0)"


def exclusion_hashes(spark, d):
    """A stand-in for manifests of excluded hashes: every seventh document, in two manifests."""
    rows = _docs(spark, d).where("doc_id % 7 = 0")
    return rows.select(F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("manifest"), F.sha2("text", 256).alias("h"))


@query("ddp14_excluded_counts", f"SELECT manifest, source, count(*) AS n FROM documents JOIN (SELECT DISTINCT * FROM {_manifests}) ON sha256(text) = h GROUP BY ALL")
def ddp14(spark, d):
    return _docs(spark, d).select("source", F.sha2("text", 256).alias("h")).join(exclusion_hashes(spark, d).distinct(), "h").groupBy("manifest", "source").agg(F.count(F.lit(1)).alias("n"))


@query("ddp15_not_excluded", f"SELECT doc_id FROM documents WHERE sha256(trim(text, concat(chr(10), chr(13)))) NOT IN (SELECT h FROM {_manifests})")
def ddp15(spark, d):
    docs = _docs(spark, d).select("doc_id", F.sha2(F.btrim("text", F.lit("\n\r")), 256).alias("h"))
    return docs.join(exclusion_hashes(spark, d).select("h").distinct(), "h", "left_anti").select("doc_id")


@query(
    "ddp16_protected_reason",
    """WITH m AS (SELECT conv_id, string_agg(text, chr(31) ORDER BY turn) AS k FROM conversations GROUP BY conv_id), p AS (SELECT * FROM m WHERE conv_id % 9 = 0)
    SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM p) THEN 'id' WHEN sha256(k) IN (SELECT sha256(k) FROM p) THEN 'messages'
    WHEN left(k, 40) IN (SELECT left(k, 40) FROM p) THEN 'context' END AS reason FROM m""",
)
def ddp16(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\x1f").alias("k"))
    m = c.select("conv_id", F.sha2("k", 256).alias("h"), F.left("k", F.lit(40)).alias("ctx"))
    p = m.where("conv_id % 9 = 0")
    out = m.join(p.select("conv_id").withColumn("i", F.lit(True)), "conv_id", "left").join(p.select("h").distinct().withColumn("j", F.lit(True)), "h", "left")
    out = out.join(p.select("ctx").distinct().withColumn("l", F.lit(True)), "ctx", "left")
    return out.select("conv_id", T.first_reason(("id", F.coalesce("i", F.lit(False))), ("messages", F.coalesce("j", F.lit(False))), ("context", F.coalesce("l", F.lit(False)))).alias("reason"))


@query("set1_union_all", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY source")
def set1(spark, d):
    docs = _docs(spark, d).select("doc_id", "source")
    return docs.unionByName(docs.where("doc_id % 2 = 0")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set2_union_distinct", f"SELECT h FROM {_manifests} WHERE manifest = 'a' UNION SELECT h FROM {_manifests} WHERE manifest = 'b'")
def set2(spark, d):
    m = exclusion_hashes(spark, d)
    return m.where("manifest = 'a'").select("h").union(m.where("manifest = 'b'").select("h")).distinct()


@query("set3_intersection", "SELECT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1")
def set3(spark, d):
    docs = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.where("doc_id % 2 = 0").select("h").intersect(docs.where("doc_id % 2 = 1").select("h"))


@query("set4_difference", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set4(spark, d):
    return _docs(spark, d).select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query(
    "set5_equality",
    """WITH a AS (SELECT doc_id, sha1(text) AS k FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 101 = 3 THEN sha1(text || '.') ELSE sha1(text) END AS k FROM documents WHERE doc_id % 103 <> 4)
    SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS missing, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS extra""",
)
def set5(spark, d):
    """Rows of one table that the other lacks, both ways: some are planted to differ, some to be missing."""
    a = _docs(spark, d).select("doc_id", F.sha1("text").alias("k"))
    changed = F.when(F.col("doc_id") % 101 == 3, F.sha1(F.concat("text", F.lit(".")))).otherwise(F.sha1("text"))
    b = _docs(spark, d).where("doc_id % 103 <> 4").select("doc_id", changed.alias("k"))
    missing, extra = a.exceptAll(b), b.exceptAll(a)
    return missing.agg(F.count(F.lit(1)).alias("missing")).join(extra.agg(F.count(F.lit(1)).alias("extra")))
