"""Queries: text normalisation, features and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from . import oracle as O

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _projection(name: str, source: str, key: str, columns: dict, sql: dict | None, value: str = "text") -> None:
    """A query that computes columns of each row's text; `sql` has the same columns for the oracle."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.select(*key.split(), *[f(F.col(value)).alias(c) for c, f in columns.items()])

    QUERIES[name] = query
    if sql is not None:
        keys = ", ".join(key.split())
        SQL[name] = f"SELECT {keys}, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + f" FROM {source}"


def _documents(name: str, columns: dict, sql: dict | None) -> None:
    _projection(name, "documents", "doc_id", columns, sql)


x = "text"
n = "b"  # the normalised text in nested oracle queries


def _nested(name: str, columns: dict, sql: dict | None) -> None:
    """As _documents, over the normalised and stripped text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "documents").select("doc_id", T.strip(T.normalise(F.col("text"))).alias("b"))
        return df.select("doc_id", *[f(F.col("b")).alias(c) for c, f in columns.items()])

    QUERIES[name] = query
    if sql is not None:
        SQL[name] = "SELECT doc_id, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + f" FROM (SELECT doc_id, {O.clean('text')} AS b FROM documents)"


_documents("src10_story_text", {"story": T.squeeze}, {"story": O.squeeze(x)})
_documents("nrm1_normalise", {"normal": T.normalise}, {"normal": O.normalise(x)})
_documents("nrm2_minimal", {"normal": T.normalise_minimal}, {"normal": "translate(" + O.sub(x, "\r\n?", "\n") + ", concat(chr(11), chr(12)), '')"})
_lines = O.strip(O.sub(O.sub("translate(" + O.sub(O.sub(x, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]") + f", {O.lit(T.QUOTES_FROM)}, {O.lit(T.QUOTES_TO)})", r"[ \t]+", " "), T._BLANK + r"+\n", "\n"))
_lines = O.strip(O.sub(_lines, "_{4,}", " "))
_noise = rf"^(?:{T.S}*)[^\p{{L}}\p{{N}}_<>{{}}\[\]().,;:'\"/\-\n#|]{{1,32}}(?:{T.S}*)"
_documents("nrm3_line_spaces", {"normal": T.normalise_lines}, {"normal": f"ltrim({O.sub(_lines, _noise)}, {O.lit(T.SPACES)})"})


def _contract(policy: str) -> str:
    t = rf"trim({x}, concat(chr(10), chr(13)))"
    t = O.sub(t, rf"^(?:{T.S}|\uFEFF|<!--(?s:.*?)-->|<\?xml(?s:.*?)\?>)+")
    t = f"translate({t}, {O.lit(chr(0x201c) + chr(0x201d) + chr(0x2019) + chr(0x2018))}, {O.lit(chr(34) * 2 + chr(39) * 2)})"
    t = t if policy == "keep" else f"replace({t}, '_', {O.lit(' ' if policy == 'space' else '')})"
    return f"CASE WHEN {t} <> '' AND length({t}) >= 200 AND {O.ascii_share(t)} >= 0.9 THEN {t} END"


_documents(
    "nrm4_contract_clean",
    {p: (lambda c, p=p: T.contract_clean(c, p, 200, 0.9)) for p in ("keep", "space", "remove")},
    {p: _contract(p) for p in ("keep", "space", "remove")},
)
_projection("nrm5_strip_metadata", "pages", "page_id", {"body": T.strip_metadata}, None, value="html")
SQL["nrm5_strip_metadata"] = """SELECT page_id, CASE WHEN k = 0 THEN html ELSE ltrim(array_to_string(list_slice(rows, k + 1, len(rows)), chr(10)), chr(10)) END AS body
    FROM (SELECT *, CASE WHEN list_position(marks, false) IS NULL OR list_position(marks, false) = 0 THEN len(marks) ELSE list_position(marks, false) - 1 END AS k
          FROM (SELECT page_id, html, string_split(html, chr(10)) AS rows, list_transform(list_slice(string_split(html, chr(10)), 1, 20), lambda z: regexp_matches(z, '^<[^>]{1,64}>')) AS marks FROM pages))"""
_documents("nrm6_repository_header", {"body": lambda c: T.strip_repository_header(F.concat(F.lit("<reponame>a/b\n"), c))}, {"body": O.sub("concat('<reponame>a/b', chr(10), text)", rf"^{T.S}*<(?i:reponame)>[^\n]*\n")})
_tail = rf"(?is)\n{T.S}*(?:{T.WIKI_TAILS}){T.S}*\n.*$"
_with_tail = "concat(text, chr(10), ' References ', chr(10), text)"
_documents(
    "nrm7_wiki_tail",
    {"body": lambda c: T.trim_wiki_tail(F.concat(c, F.lit("\n References \n"), c)), "own": T.trim_wiki_tail},
    {c: f"CASE WHEN {O.like(t, _tail)} THEN {O.rstrip(f'regexp_replace({t}, {O.pattern(_tail)}, {O.lit(str())})')} ELSE {t} END" for c, t in (("body", _with_tail), ("own", x))},
)
_documents(
    "nrm8_truncate_lines",
    {"body": lambda c: T.truncate_lines(c, 6)},
    {
        "body": "CASE WHEN len(string_split(text, chr(10))) > 6 THEN "
        + O.strip("array_to_string(list_concat(list_concat(list_slice(string_split(text, chr(10)), 1, 3), ['# ... truncated ...']), list_slice(string_split(text, chr(10)), -3, -1)), chr(10))")
        + " ELSE text END"
    },
)
_documents("nrm9_answer_text", {"answer": T.answer_text}, {"answer": O.answer_text(x)})
_documents("nrm10_prompt_key", {"prompt_key": T.prompt_key}, {"prompt_key": O.prompt_key(x)})
_documents("nrm11_hash_text", {"sha": lambda c: F.sha2(T.hash_text(c), 256)}, {"sha": f"sha256({O.squeeze('lower(' + O.sub(x, chr(13) + chr(10) + '?', chr(10)) + ')')})"})
_projection(
    "nrm13_clean_prompt", "conversations", "conv_id turn",
    {"prompt": lambda c: T.clean_prompt(F.concat(F.lit("User:  "), c))},
    {"prompt": O.strip(O.sub(O.sub(O.answer_text("concat('User:  ', text)"), rf"^(?i:user):{T.S}*"), rf"^(?i:instruction):{T.S}*"))},
)
_documents(
    "nrm14_completion_text",
    {"completion": lambda c: T.completion_text(F.concat(F.lit("a [title] b [x]  "), c))},
    {"completion": "replace(" + O.sub("replace(" + O.strip("concat('a [title] b [x]  ', text)") + ", ' [title]', '. ')", r"\[[^\]\n]*\]") + ", '  ', ' ')"},
)
_chat = O.sub(x, "\r\n?", "\n")
SQL["nrm15_chat_text"] = f"SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN {O.rstrip(_chat)} ELSE {O.strip(_chat)} END AS content FROM conversations"
QUERIES["nrm15_chat_text"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", T.chat_text(F.col("role"), F.col("text")).alias("content"))
_num = "replace(" + O.sub(O.strip("concat(CAST(l_quantity AS VARCHAR), '00')"), "%$") + ", ',', '')"
SQL["nrm16_numeric_token"] = f"SELECT l_orderkey, l_linenumber, CASE WHEN {O.like(_num, r'^-?\d+\.\d+$')} THEN {O.sub(O.sub(_num, '0+$'), chr(92) + '.$')} ELSE {_num} END AS token FROM lineitem"
QUERIES["nrm16_numeric_token"] = lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.numeric_token(F.concat(F.col("l_quantity").cast("string"), F.lit("00"))).alias("token"))
_documents("nrm17_python_block", {"block": T.python_block}, {"block": f"concat('```python', chr(10), {O.strip(x)}, chr(10), '```')"})

_documents("ftr1_ascii_share", {"ascii_share": T.ascii_share}, {"ascii_share": O.ascii_share(x)})
_documents("ftr2_symbol_share", {"symbol_share": T.symbol_share}, {"symbol_share": f"CASE WHEN text = '' THEN 0.0 ELSE length({O.sub(x, rf'[\p{{L}}\p{{N}}{T._SPACE_CLASS}]')}) / length(text) END"})
_documents("ftr3_url_density", {"url_density": T.url_density, "per_thousand": lambda c: 1000 * T.url_density(c)}, {"url_density": O.url_density(x), "per_thousand": f"1000 * ({O.url_density(x)})"})
_documents("ftr4_short_lines", {"share": T.short_line_share}, {"share": O.short_share(x)})
_documents("ftr5_menu_spam", {"hits": T.menu_hits, "is_menu": lambda c: T.is_menu(c, 0.3, 1)}, {"hits": O.menu_hits(x), "is_menu": f"({O.menu_hits(x)} >= 1 AND {O.short_share(x)} >= 0.3)"})
_projection("ftr6_html_heavy", "pages", "page_id", {"units": T.html_units, "heavy": lambda c: T.is_html_heavy(c, 0.02)}, {"units": O.html_units("html"), "heavy": O.html_heavy("html", 0.02)}, value="html")
_documents("ftr7_filler", {"filler": T.has_filler}, {"filler": O.filler(x)})
_documents("ftr7_repeated_character", {"repeats": T.has_repeats}, {"repeats": "(SELECT coalesce(bool_or(contains(text, repeat(c, 50))), false) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\n]')) AS c))"})
_documents(
    "ftr8_layout_signs",
    {"empty_line": lambda c: c.contains("\n\n"), "indented": lambda c: c.rlike("(?m)^    "), "html": lambda c: c.rlike(rf"(?i)</?(?:{T.HTML_TAGS})\b"), "filler": T.has_filler},
    {"empty_line": "contains(text, concat(chr(10), chr(10)))", "indented": O.like(x, "(?m)^    "), "html": O.like(x, rf"(?i)</?(?:{T.HTML_TAGS})\b"), "filler": O.filler(x)},
)
_documents("ftr9_head_label", {"head": T.head_label}, None)
SQL["ftr9_head_label"] = f"SELECT doc_id, {O.head_label('h')} AS head FROM (SELECT doc_id, {O.first_line(x)} AS h FROM documents)"
_projection("ftr10_markup_head", "pages", "page_id", {"htmlish": T.is_html_head, "markdownish": T.is_markdown_early}, None, value="html")
SQL["ftr10_markup_head"] = f"""SELECT page_id, starts_with({O.first_line('html')}, '<') AND NOT starts_with({O.first_line('html')}, '#include ') AS htmlish,
    contains(html, '```') OR len(list_filter(list_slice(string_split(html, chr(10)), 1, 60), lambda z: {O.like('z', '^' + T.S + '*#{1,6}' + T.S + '+' + T.NS)})) >= 2
    OR {O.times("array_to_string(list_slice(string_split(html, chr(10)), 1, 60), chr(10))", '|')} >= 24 AS markdownish FROM pages"""
_py = f"""CASE WHEN {O.like(f'ltrim(text, {O.lit(T.SPACES)})', '^#!/usr/bin/(?:env python|python)')} OR {O.like(x, rf'(?m)^{T.S}*def{T.S}+{T.W}+{T.S}*' + chr(92) + '(')}
    OR {O.like(x, rf'(?m)^{T.S}*class{T.S}+{T.W}+{T.S}*[:(]')} OR {O.any_of(x, ("if __name__ == '__main__':", 'if __name__ == "__main__":'))} THEN true
    WHEN {O.any_of(x, T.NOT_PYTHON)} OR {O.times(x, '{')} + {O.times(x, '}')} > 8 OR {O.times(x, ';')} > 12 THEN false
    WHEN len(list_filter(string_split(text, chr(10)), lambda z: {O.strip('z')} <> '')) = 0 THEN false
    ELSE (len(list_filter(list_slice(list_filter(string_split(text, chr(10)), lambda z: {O.strip('z')} <> ''), 1, 200), lambda z: starts_with(z, '    '))) >= 6
      AND len(list_filter(list_slice(list_filter(string_split(text, chr(10)), lambda z: {O.strip('z')} <> ''), 1, 200), lambda z: ends_with({O.rstrip('z')}, ':'))) >= 2)
      OR {' + '.join(O.times(x, k) for k in T.PYTHON_WORDS)} >= 2 END"""
_documents("ftr11_looks_python", {"python": T.looks_python}, {"python": _py})
_code = f"({O.any_of(x, T.CODE_WORDS)} OR (contains(text, '{{') AND contains(text, '}}')) OR (contains(text, ';') AND contains(text, chr(10))) OR (length(text) - length(replace(text, chr(10), '')) >= 8 AND {O.times(x, '(')} + {O.times(x, ')')} >= 6))"
_rows = f"list_slice({O.full_lines(x)}, 1, 220)"
_codey = (
    "starts_with(z, '#!') OR (starts_with(z, '#') AND (starts_with(z, '#include') OR starts_with(z, '#define') OR contains(lower(z), 'coding:') OR length(z) < 200))"
    + f" OR {O.like('z', T.CODE_SIGNS)} OR {O.like('z', '^(?:' + '|'.join(T.CODE_STARTS) + ')')}"
)
_documents("ftr12_code_signs", {"code": T.looks_code, "share": T.code_line_share}, {"code": _code, "share": f"CASE WHEN len({_rows}) = 0 THEN 0.0 ELSE len(list_filter({_rows}, lambda z: {_codey})) / len({_rows}) END"})


def _reasons(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {e} THEN '{r}'" for r, e in pairs) + " END"


def _code_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", T.normalise_lines(F.col("text")).alias("t"))
    return df.select("doc_id", T.code_reason(F.col("t")).alias("reason"))


QUERIES["ftr13_code_filter"] = _code_filter
_t = "t"
_code_t, _rows_t, _codey_t = _code.replace("text", "t"), f"list_slice({O.full_lines('t')}, 1, 220)", _codey
_head220 = "list_slice(string_split(t, chr(10)), 1, 220)"
SQL["ftr13_code_filter"] = (
    "SELECT doc_id, "
    + _reasons(
        [
            ("empty", "t = ''"),
            ("heading", "label = 'md_heading' AND NOT contains(lower(h), 'coding')"),
            ("table_or_fence", "label IN ('pipes_table', 'fence')"),
            ("htmlish", "starts_with(h, '<') AND NOT starts_with(h, '#include ')"),
            ("markdownish", f"contains(t, '```') OR len(list_filter(list_slice(string_split(t, chr(10)), 1, 60), lambda z: {O.like('z', '^' + T.S + '*#{1,6}' + T.S + '+' + T.NS)})) >= 2 OR {O.times('array_to_string(list_slice(string_split(t, chr(10)), 1, 60), chr(10))', '|')} >= 24"),
            ("long_line", "list_max(list_transform(string_split(t, chr(10)), lambda z: length(z))) > 1000"),
            ("foreign_lines", f"len(list_filter({_head220}, lambda z: {O.ascii_share('z', '1.0')} < 0.85)) / greatest(1, len({_head220})) > 0.2"),
            ("few_lines", "len(string_split(t, chr(10))) < 3"),
            ("low_ascii", f"{O.ascii_share('t', '1.0')} < 0.9"),
            ("symbols", f"length({O.sub('t', rf'[\p{{L}}\p{{N}}{T._SPACE_CLASS}]')}) / length(t) > 0.35"),
            ("no_code_signs", f"NOT {_code_t}"),
            ("few_code_lines", f"CASE WHEN len({_rows_t}) = 0 THEN 0.0 ELSE len(list_filter({_rows_t}, lambda z: {_codey_t})) / len({_rows_t}) END < 0.2"),
            ("crash_dump", O.any_of("t", ("core dumped", "PyGILState_Release", "terminate called without an active exception"))),
            ("few_letters", f"length({O.sub('t', r'[^\p{L}]')}) / greatest(1, length(t)) < 0.03"),
        ]
    )
    + f" AS reason FROM (SELECT *, {O.head_label('h')} AS label FROM (SELECT doc_id, t, {O.first_line('t')} AS h FROM ({SQL['nrm3_line_spaces'].replace('AS normal', 'AS t')})))"
)
QUERIES["ftr14_wiki_filter"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.normalise_lines(F.col("text")).alias("t")).select("doc_id", T.wiki_reason(F.col("t")).alias("reason"))
_cut = f"CASE WHEN {O.like('t', _tail)} THEN {O.rstrip(f'regexp_replace(t, {O.pattern(_tail)}, {O.lit(str())})')} ELSE t END"
SQL["ftr14_wiki_filter"] = (
    "SELECT doc_id, "
    + _reasons(
        [
            ("empty", "t = ''"),
            ("head", "label IN ('pipes_table', 'md_heading', 'fence')"),
            ("only_tail", "c = ''"),
            ("licence", O.any_of("lower(c)", T.LICENCE_SNIPPETS)),
            ("bullets", "(length(c) - length(replace(c, concat(chr(10), '- '), ''))) / 3 >= 12"),
            ("few_paragraphs", f"len(list_filter(string_split(c, concat(chr(10), chr(10))), lambda z: {O.strip('z')} <> '')) < 2"),
        ]
    )
    + f" AS reason FROM (SELECT doc_id, t, {O.head_label('h')} AS label, {_cut} AS c FROM (SELECT doc_id, t, {O.first_line('t')} AS h FROM ({SQL['nrm3_line_spaces'].replace('AS normal', 'AS t')})))"
)
QUERIES["ftr15_language_list"] = lambda spark, d: table(spark, d, "documents").where(F.lower(T.strip(F.col("lang"))).isin("en", "de")).select("doc_id", "lang")
SQL["ftr15_language_list"] = "SELECT doc_id, lang FROM documents WHERE lower(trim(lang)) IN ('en', 'de')"
_documents("ftr16_reasonable", {"ok": lambda c: (F.length(c) >= 100) & (F.length(c) <= 5000) & c.rlike(T.NS)}, {"ok": f"length(text) BETWEEN 100 AND 5000 AND {O.like(x, T.NS)}"})


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by domain; a document's source number picks one."""
    presets = spark.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(T.PRESETS.items())], "n int, domain string, least_ascii double, tags double, urls double, short double, hits int")
    docs = table(spark, sf_dir, "documents").withColumn("n", F.pmod(F.col("doc_id"), F.lit(len(T.PRESETS))).cast("int"))
    joined = docs.join(F.broadcast(presets), "n")  # five rows
    return joined.select("doc_id", "domain", (T.ascii_share(F.col("text")) >= F.col("least_ascii")).alias("ascii_ok"), (T.url_density(F.col("text")) <= F.col("urls")).alias("urls_ok"))


QUERIES["ftr17_domain_presets"] = _presets
_values = ", ".join(f"({i}, '{k}', {v[0]}, {v[2]})" for i, (k, v) in enumerate(T.PRESETS.items()))
SQL["ftr17_domain_presets"] = f"SELECT doc_id, domain, {O.ascii_share(x)} >= a AS ascii_ok, {O.url_density(x)} <= u AS urls_ok FROM documents JOIN (VALUES {_values}) p(n, domain, a, u) ON doc_id % 5 = n"


def document_reason_sql(t: str, domain: str = "web") -> str:
    a, tags, urls, short, hits = T.PRESETS[domain]
    repeats = f"coalesce((SELECT bool_or(contains({t}, repeat(c, 50))) FROM (SELECT DISTINCT unnest(regexp_extract_all({t}, '[^\\n]')) AS c)), false)"
    return _reasons(
        [
            ("empty", f"{t} = ''"),
            ("too_short", f"length({t}) < 200"),
            ("too_long", f"length({t}) > 50000"),
            ("placeholders", f"{O.filler(t)} OR {repeats}"),
            ("html_heavy", O.html_heavy(t, tags)),
            ("url_spam", f"{O.url_density(t)} > {urls}"),
            ("menu_spam", f"({O.menu_hits(t)} >= {hits} AND {O.short_share(t)} >= {short})"),
            ("low_ascii", f"{O.ascii_share(f'left({t}, 20000)')} < {a}"),
        ]
    )


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("source", T.strip(T.normalise(F.col("text"))).alias("b"))
    return df.select("source", "b", T.document_reason(F.col("b")).alias("r")).groupBy("source", F.coalesce("r", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("b")).alias("chars"))


QUERIES["ftr18_cleaner_report"] = _clean
SQL["ftr18_cleaner_report"] = f"SELECT source, coalesce(r, 'kept') AS reason, count(*) AS n, CAST(sum(length(b)) AS BIGINT) AS chars FROM (SELECT source, b, {document_reason_sql('b')} AS r FROM (SELECT source, {O.clean('text')} AS b FROM documents)) GROUP BY ALL"

_c = "conversations", "conv_id turn"
_styles = [rf"^-{T.S}+", rf"^\*{T.S}+", rf"^\u2022{T.S}+", rf"^[0-9]+\.{T.S}+"]
_projection(
    "ftr19_answer_counts", *_c,
    {"words": T.word_count, "sentences": T.sentence_count, "lines": T.line_count, "bullets": T.bullet_count, "numbered": T.has_numbered_list, "styles": T.bullet_styles},
    {
        "words": O.word_count(x), "sentences": O.sentence_count(x), "lines": f"len({O.full_lines(x)})",
        "bullets": f"len(list_filter(string_split(text, chr(10)), lambda z: {O.like('z', T.BULLET)}))",
        "numbered": f"len(list_filter(string_split(text, chr(10)), lambda z: {O.like('z', rf'^{T.S}*[0-9]+' + chr(92) + f'.{T.S}+')})) > 0",
        "styles": " + ".join(f"CAST(len(list_filter({O.full_lines(x)}, lambda z: {O.like('concat(z, chr(32))', s)})) > 0 AS INTEGER)" for s in _styles),
    },
)
_tail3 = f"lower(array_to_string(list_slice({O.full_lines(x)}, greatest(1, len({O.full_lines(x)}) - 2), len({O.full_lines(x)})), chr(10)))"
_projection(
    "ftr20_answer_marks", *_c,
    {
        "placeholder": T.has_placeholder, "code": lambda c: c.rlike(T.CODE_MARKS), "meta": T.has_meta_prefix, "several": lambda c: c.rlike(T.MULTI_ANSWER),
        "technical": T.looks_technical, "greeting": T.has_greeting, "sign_off": T.has_sign_off, "email": lambda c: T.has_greeting(c) & T.has_sign_off(c), "body_sentences": T.body_sentences,
    },
    {
        "placeholder": O.any_of("lower(text)", T.PLACEHOLDERS), "code": O.like(x, T.CODE_MARKS), "meta": O.like(f"lower({O.answer_text(x)})", T.META_PREFIX),
        "several": O.like(x, T.MULTI_ANSWER), "technical": " + ".join(f"CAST(contains(lower(text), {O.lit(t)}) AS INTEGER)" for t in T.TECHNICAL) + " >= 2",
        "greeting": O.like(f"lower({O.first_line(x)})", "^(?:dear|hello|hi) "), "sign_off": O.any_of(_tail3, T.SIGN_OFFS),
        "email": O.like(f"lower({O.first_line(x)})", "^(?:dear|hello|hi) ") + " AND " + O.any_of(_tail3, T.SIGN_OFFS),
        "body_sentences": f"CASE WHEN len({O.full_lines(x)}) < 3 THEN {O.sentence_count(x)} ELSE " + O.sentence_count(f"array_to_string(list_slice({O.full_lines(x)}, 2, len({O.full_lines(x)}) - 1), chr(10))") + " END",
    },
)
QUERIES["ftr21_prompt_echo"] = lambda spark, d: (
    table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("p"))
    .join(table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a")), ["conv_id", "turn"])
    .select("conv_id", "turn", T.has_echo(F.col("p"), F.col("a")).alias("echo"))
)
SQL["ftr21_prompt_echo"] = f"SELECT u.conv_id, u.turn, {O.prompt_key('u.text')} <> '' AND {O.prompt_key('a.text')} <> '' AND contains({O.prompt_key('a.text')}, left({O.prompt_key('u.text')}, 80)) AS echo FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"
_quoted = "concat('say \"', text, '\" or \"', lower(text), ' more\" now')"
_found = f"list_filter(list_transform(regexp_extract_all({_quoted}, '\"([^\"]+)\"', 1), lambda z: {O.squeeze('z')}), lambda z: z <> '')"
_documents(
    "ftr22_longest_quote",
    {"quote": lambda c: T.longest_quote(F.concat(F.lit('say "'), c, F.lit('" or "'), F.lower(c), F.lit(' more" now')))},
    {"quote": f"(list_filter({_found}, lambda z: length(z) = list_max(list_transform({_found}, lambda y: length(y)))))[1]"},
)
REFUSALS = ("i can't", "i cannot", "as an ai", "no puedo", "je ne peux")
QUERIES["ftr23_refusal_weight"] = lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(
    F.when(F.max(F.when(F.col("role") == "assistant", T.is_refusal(F.col("text"), REFUSALS)).otherwise(False)), 0.25).otherwise(1.0).alias("weight")
)
SQL["ftr23_refusal_weight"] = f"SELECT conv_id, CASE WHEN bool_or(role = 'assistant' AND {O.any_of('lower(text)', REFUSALS)}) THEN 0.25 ELSE 1.0 END AS weight FROM conversations GROUP BY conv_id"
_fenced = "concat('x ```python', chr(10), text, chr(10), '``` Final answer: 12.5 of -3', chr(10), 'y')"
_documents(
    "ftr24_answer_parts",
    {
        c: (lambda t, f=f: f(F.concat(F.lit("x ```python\n"), t, F.lit("\n``` Final answer: 12.5 of -3\ny"))))
        for c, f in {"block": T.first_code_block, "blocks": T.code_blocks, "answer": T.final_answer, "last_number": lambda z: F.element_at(T.numbers(T.final_answer(z)), -1)}.items()
    },
    {
        "block": O.strip(f"regexp_extract({_fenced}, '(?is)```(?:python)?\\s*(.*?)```', 1)"), "blocks": f"CAST(floor({O.times(_fenced, '```')} / 2) AS INTEGER)",
        "answer": O.strip(f"regexp_extract({_fenced}, '(?i)final answer:[ \\t]*([^\\n]*)', 1)"),
        "last_number": f"list_last(regexp_extract_all({O.strip(f'regexp_extract({_fenced}, {O.pattern(chr(40) + chr(63) + chr(105) + chr(41) + "final answer:[ " + chr(92) + "t]*([^" + chr(92) + "n]*)")}, 1)')}, '-?[0-9]+(?:\\.[0-9]+)?'))",
    },
)
