"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_pairs

    return contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .runtime import scratch
    from .warc import assemble_transactions, read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    captures = assemble_transactions(read_warc(spark, path, payloads=False))
    field = lambda name: F.col("metadata.fields")[name]
    return captures.select(
        field("pageId").cast("long").alias("page_id"),
        F.coalesce(F.col("principal.payload_bytes"), field("payloadLength").cast("long")).alias("payload_bytes"),
        F.col("principal.payload_digest").alias("payload_digest"),
        F.col("principal.type").alias("record_type"),
        field("refersToPage").cast("long").alias("refers_to"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import brown_scores

    return brown_scores(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores, train_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, chain).select("doc_id", "p_quality", "p_toxic", "is_toxic")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def _crc32(text):
    from pyspark.sql import functions as F

    return F.crc32(text.cast("string").cast("binary"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .repair import repair_conversations

    rows = _table(spark, sf_dir, "conversations")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damaged = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(_crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20)).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    damaged = damaged.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return repair_conversations(damaged, rows.select("conv_id"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .merkle import merkle_manifest

    tampered = F.when(F.pmod(_crc32(F.col("doc_id")), F.lit(7)) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle_manifest(_table(spark, sf_dir, "documents"), audited={"n_chars": tampered}, keep_proof=False).drop("grp_index")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_brown_lm": op6_brown_lm,
    "op7_toxicity": op7_toxicity,
    "op8_top_k": op8_top_k,
    "op9_packing": op9_packing,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe": op13_byte_bpe,
}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"



def _crc32_sql(x: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: {byte}, 4294967295), 4294967295)"


_VISIBLE_END = "rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', {0}) END"
_LEAF = lambda n_chars: "sha256(concat(" + ", ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + "))"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, w, least(13, len(w)) AS wn FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
        dp AS (SELECT doc_id, len(w) AS dn, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d),
        ip AS (SELECT item_id, len(w) AS n, wn, CAST(ceil(wn * 0.75) AS INTEGER) AS need, unnest(range(0, len(w))) AS ipos, unnest(w) AS word FROM i),
        same AS (SELECT doc_id, item_id, dn, n, wn, need, pos - ipos AS off, list_sort(list(pos)) AS p FROM dp JOIN ip USING (word)
                 GROUP BY ALL HAVING count(*) >= need),
        placed AS (SELECT *, greatest(off, 0) AS low, least(dn, n + off) AS high FROM same),
        begun AS (SELECT doc_id, item_id, list_min(list_transform(list_filter(range(1, len(p) - need + 2), lambda k: p[k + need - 1] - p[k] < wn),
                         lambda k: greatest(low, p[k + need - 1] - wn + 1))) AS first_word
                  FROM placed WHERE high - low >= wn)
        SELECT doc_id, item_id, CAST(min(first_word) AS INTEGER) AS first_word FROM begun WHERE first_word IS NOT NULL GROUP BY doc_id, item_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op4_ngram_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              WHERE 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id
        FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        w AS MATERIALIZED (SELECT doc_id, s, md5(substring(x, 2 * s + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS s FROM d)),
        r AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
        g AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k
              FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r)),
        i AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY doc_id, k),
        o AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM i GROUP BY doc_id),
        c AS (SELECT doc_id, a, b FROM i UNION ALL SELECT doc_id, n, n FROM d),
        p AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS z FROM c),
        k AS (SELECT doc_id, string_agg(substring(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d LEFT JOIN o USING (doc_id) JOIN k USING (doc_id)""",
    "op8_top_k": """
        WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
              FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_conversation_repair": f"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                             {_crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
        m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
              unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE k <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text)), copy) AS i,
              row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, {_VISIBLE_END} AS ended, role[1] AS f FROM m),
        x AS (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
              CASE WHEN concat(lag(f) OVER (PARTITION BY conv_id ORDER BY i), f) IN ('su', 'ua', 'au') OR i = 1 THEN 0 ELSE 1 END AS bad FROM r),
        ins(a, b, letters, lines) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']),
              (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
        ed(b, letter, f, z, role) AS (VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL), (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'),
              (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user'), (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL)),
        p AS (SELECT ins.a, ed.z, ed.f, ed.letter, ed.role, ins.lines, concat(ins.letters, ed.letter) AS letters, 3 * length(ins.letters) + CASE ed.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END AS price FROM ins JOIN ed USING (b)),
        d AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM conversations
              UNION ALL
              SELECT d.conv_id, x.i, p.z, min({{'cost': CAST(best.cost + price + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'audit': concat(best.audit, letters),
                     'lines': best.lines || p.lines || CASE WHEN letter = 'D' THEN [] ELSE [concat(coalesce(p.role, x.role), ':', text)] END}})
              FROM d JOIN x ON d.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = d.i + 1 JOIN p ON p.a = d.state AND (p.f IS NULL OR p.f = x.f) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
              GROUP BY d.conv_id, x.i, p.z),
        e AS (SELECT conv_id, i, min({{'cost': CAST(best.cost + 3 * length(letters) AS BIGINT), 'audit': concat(best.audit, letters), 'lines': best.lines || ins.lines}}) AS best FROM d JOIN ins ON ins.a = d.state WHERE ins.b IN (0, 3) GROUP BY conv_id, i),
        n AS (SELECT conv_id, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
              count(*) FILTER (WHERE fault = 'truncated') AS truncated, CAST(sum(bad) AS BIGINT) AS illegal FROM x GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best.cost AS cost, best.audit AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id WHERE e.i = coalesce(rows, 0)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE l AS (SELECT doc_id, coalesce(concat('=', lang), '-') AS g, {_LEAF("n_chars")} AS leaf,
                             CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF("n_chars + 1")} END AS found FROM documents),
        z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
        t AS (SELECT 0 AS k, g, i, leaf AS h, n FROM z UNION ALL SELECT k + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, g, i // 2, n),
        s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS k, i, h, n FROM s UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY k, i // 2, n),
        a AS (SELECT z.g, z.i, list(CASE WHEN b.h IS NULL THEN 'N' ELSE concat(CASE WHEN (z.i >> o.k) % 2 = 1 THEN 'L' ELSE 'R' END, b.h) END ORDER BY o.k) AS steps
              FROM z JOIN (SELECT DISTINCT g, k FROM t WHERE n > 1) o ON o.g = z.g LEFT JOIN t b ON b.g = z.g AND b.k = o.k AND b.i = xor(z.i >> o.k, 1) GROUP BY z.g, z.i),
        v AS (SELECT s.g, list(CASE WHEN b.h IS NULL THEN 'N' ELSE concat(CASE WHEN (s.i >> o.k) % 2 = 1 THEN 'L' ELSE 'R' END, b.h) END ORDER BY o.k) AS steps
              FROM s JOIN (SELECT DISTINCT k FROM u WHERE n > 1) o ON true LEFT JOIN u b ON b.k = o.k AND b.i = xor(s.i >> o.k, 1) GROUP BY s.g),
        f AS (SELECT doc_id, leaf, s.h AS subroot, w.h AS root, coalesce(a.steps, []) || coalesce(v.steps, []) AS steps, coalesce(found, leaf) AS now
              FROM z JOIN s ON s.g = z.g CROSS JOIN (SELECT h FROM u WHERE n = 1) w LEFT JOIN a ON a.g = z.g AND a.i = z.i LEFT JOIN v ON v.g = z.g),
        o AS (SELECT *, list_reduce(list_prepend(now, steps), lambda x, y: CASE y[1] WHEN 'L' THEN sha256(concat(y[2:], x)) WHEN 'R' THEN sha256(concat(x, y[2:])) ELSE sha256(x) END) AS folded_root FROM f)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda y: y[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o""",
}
