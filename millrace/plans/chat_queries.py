"""Queries: conversations, verification, instruction checks, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as C
from ..operators import verify as V
from ..sources.tables import table
from . import oracle as O
from .dedup_queries import _pairs, turn_pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_content = f"CASE WHEN role = 'assistant' THEN {O.rstrip(O.sub('text', chr(13) + chr(10) + '?', chr(10)))} ELSE {O.strip(O.sub('text', chr(13) + chr(10) + '?', chr(10)))} END"
_msgs = f"(SELECT conv_id, turn, role, {_content} AS content FROM conversations)"


def _conv(spark, d):
    return table(spark, d, "conversations")


@query("src13_render_chat", f"SELECT conv_id, string_agg(concat(role, ':', chr(10), content), concat(chr(10), chr(10)) ORDER BY turn) AS chat FROM {_msgs} WHERE content <> '' GROUP BY conv_id")
def src13(spark, d):
    return C.messages(_conv(spark, d)).select("conv_id", C.render(F.col("messages")).alias("chat"))


@query(
    "cht1_validation",
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM {_msgs}),
    x AS (SELECT *, i - CASE WHEN f = 'system' THEN 1 ELSE 0 END AS j FROM m),
    s AS (SELECT conv_id, bool_or(role NOT IN ('system', 'user', 'assistant')) AS unknown, bool_or({O.strip('content')} = '' AND NOT (i = 1 AND role = 'system')) AS hollow,
      bool_or(j >= 1 AND role <> CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END) AS disorder, max(j) AS rest, arg_max(role, turn) AS last FROM x GROUP BY conv_id)
    SELECT conv_id, CASE WHEN unknown THEN 'unknown_role' WHEN hollow THEN 'empty_content' WHEN disorder THEN 'role_order' WHEN rest = 0 THEN 'no_user' WHEN last <> 'assistant' THEN 'end_not_assistant' END AS error FROM s""",
)
def cht1(spark, d):
    return C.messages(_conv(spark, d)).select("conv_id", C.chat_error(F.col("messages")).alias("error"))


@query(
    "cht3_truncate",
    """WITH n AS (SELECT *, length(text) + 1 AS n FROM conversations), s AS (SELECT *, sum(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
      sum(CASE WHEN role = 'system' THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n),
    f AS (SELECT *, min(turn) FILTER (WHERE role = 'user' AND rest + sys <= 2000) OVER (PARTITION BY conv_id) AS start FROM s)
    SELECT conv_id, turn FROM f WHERE start IS NOT NULL AND (role = 'system' OR turn >= start)""",
)
def cht3(spark, d):
    return C.truncate(_conv(spark, d), F.length("text") + 1, 2000).select("conv_id", "turn")


@query("cht4_first_rounds", "SELECT conv_id, turn FROM (SELECT *, max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS u FROM conversations) WHERE turn <= last AND u <= 2")
def cht4(spark, d):
    """The first two rounds, without user turns that no answer follows."""
    w = Window.partitionBy("conv_id")
    rows = _conv(spark, d).withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w))
    rows = rows.withColumn("u", F.count(F.when(F.col("role") == "user", 1)).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where("turn <= last and u <= 2").select("conv_id", "turn")


@query("cht5_last_exchange", "SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id")
def cht5(spark, d):
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return _conv(spark, d).groupBy("conv_id").agg(last("user").alias("last_user"), last("assistant").alias("answer"))


_tok = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+'))"


@query("cht6_supervised_tokens", f"SELECT conv_id, coalesce(CAST(sum({_tok} + 1) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS supervised, CAST(sum({_tok} + 1) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def cht6(spark, d):
    n = (F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) + 1).cast("long")
    return _conv(spark, d).groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("supervised"), F.sum(n).alias("tokens"))


@query("cht7_split_dialogue", "SELECT conv_id, count(*) AS parts FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def cht7(spark, d):
    """A dialogue in one text is split at its speaker marks again."""
    rows = _conv(spark, d).where("role <> 'system'").select("conv_id", "turn", F.concat(F.lit("\n\n"), F.when(F.col("role") == "user", "Human: ").otherwise("Assistant: "), "text").alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "").alias("t"))
    return whole.select("conv_id", F.regexp_count("t", F.lit(r"\n\n(?:Human|Assistant): ")).cast("long").alias("parts"))


# ---- verification and classification


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN {e} THEN '{n}'" for n, e in rules) + " END"


_prompt = "concat(['Please summarize this', 'Rewrite it shorter', 'Write an email to a recruiter', 'Explain what is meant', 'Say'][1 + conv_id % 5], ' ', text)"


def _prompts(spark, d):
    """User turns behind a request that turns with the conversation's number, as raw prompts."""
    heads = F.array(*map(F.lit, ("Please summarize this", "Rewrite it shorter", "Write an email to a recruiter", "Explain what is meant", "Say")))
    return _conv(spark, d).where("role = 'user'").select("conv_id", "turn", F.concat(F.get(heads, (F.col("conv_id") % 5).cast("int")), F.lit(" "), "text").alias("prompt"))


_family = _case([(n, O.any_of("lower(prompt)", k)) for n, k in V.FAMILIES.items()])


@query("cls1_families", f"SELECT conv_id, turn, {_family} AS family FROM (SELECT conv_id, turn, {_prompt} AS prompt FROM conversations WHERE role = 'user')")
def cls1(spark, d):
    return _prompts(spark, d).select("conv_id", "turn", V.family(F.col("prompt")).alias("family"))


def _sub_sql() -> str:
    low = "lower(prompt)"
    out = f"WHEN family = 'summary_bullets' THEN CASE WHEN contains({low}, 'one sentence') THEN 'summary_1_sentence' WHEN contains({low}, 'takeaway') OR (contains({low}, '2') AND {O.any_of(low, ('main idea', 'key point'))}) THEN 'summary_2_takeaways' WHEN {O.any_of(low, ('key point', 'main point', 'main idea'))} THEN 'extract_key_points' ELSE 'summary_3_bullets' END"
    for name, (rules, rest) in V.SUBFAMILIES.items():
        out += f" WHEN family = '{name}' THEN coalesce({_case([(s, O.any_of(low, k)) for s, k in rules])}, '{rest}')"
    return f"CASE {out} END"


@query("cls2_subfamilies", f"SELECT family, {_sub_sql()} AS subfamily, count(*) AS n FROM (SELECT *, {_family} AS family FROM (SELECT {_prompt} AS prompt FROM conversations WHERE role = 'user')) GROUP BY ALL")
def cls2(spark, d):
    rows = _prompts(spark, d).select(V.family(F.col("prompt")).alias("family"), V.subfamily(F.col("prompt")).alias("subfamily"))
    return rows.groupBy("family", "subfamily").agg(F.count(F.lit(1)).alias("n"))


@query("cls4_prompt_filter", f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND {O.word_count('text')} BETWEEN 6 AND 80 AND NOT {O.like('lower(text)', 'https?://|python|sql')}")
def cls4(spark, d):
    t = F.col("text")
    return _conv(spark, d).where("role = 'user'").where(T.word_count(t).between(6, 80) & ~F.lower(t).rlike("https?://|python|sql")).select("conv_id", "turn")


@query("cls3_scope", "SELECT conv_id, CASE WHEN bool_or(length(text) > 4000) THEN 'too_long' WHEN count(*) > 12 THEN 'too_many_turns' WHEN NOT bool_or(role = 'assistant') THEN 'no_answer' ELSE 'in_scope' END AS decision FROM conversations GROUP BY conv_id")
def cls3(spark, d):
    g = _conv(spark, d).groupBy("conv_id").agg(F.bool_or(F.length("text") > 4000).alias("l"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role") == "assistant").alias("a"))
    return g.select("conv_id", F.coalesce(T.first_reason(("too_long", F.col("l")), ("too_many_turns", F.col("n") > 12), ("no_answer", ~F.col("a"))), F.lit("in_scope")).alias("decision"))


@query("cls5_inferred_fields", "SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '^(\\w+)', 1), ''), 'none') AS entry, CASE WHEN turn < 2 THEN 'opening' ELSE 'later' END AS family FROM conversations")
def cls5(spark, d):
    entry = F.coalesce(F.nullif(F.regexp_extract("text", r"^([0-9A-Za-z_]+)", 1), F.lit("")), F.lit("none"))
    return _conv(spark, d).select("conv_id", "turn", entry.alias("entry"), F.when(F.col("turn") < 2, "opening").otherwise("later").alias("family"))


_tset = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{L}\p{N}_]+'), lambda z: z <> ''))"


@query("cls6_token_overlap", f"SELECT conv_id, turn, round(len(list_intersect({_tset.replace('{x}', 'p')}, {_tset.replace('{x}', 'a')})) / greatest(1, len({_tset.replace('{x}', 'p')})), 9) AS overlap FROM {_pairs}")
def cls6(spark, d):
    from ..operators.dedup import tokens

    s = turn_pairs(spark, d).select("conv_id", "turn", F.array_distinct(tokens(F.col("p"))).alias("x"), F.array_distinct(tokens(F.col("a"))).alias("y"))
    return s.select("conv_id", "turn", F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.lit(1), F.size("x")), 9).alias("overlap"))


@query("cls7_preference_filter", f"SELECT conv_id, turn FROM {_pairs} WHERE {O.strip('p')} <> '' AND {O.strip('a')} <> '' AND {O.strip('p')} <> {O.strip('a')} AND length(a) >= 40 AND length(p) + length(a) <= 3000")
def cls7(spark, d):
    p, a = T.strip(F.col("p")), T.strip(F.col("a"))
    return turn_pairs(spark, d).where((p != "") & (a != "") & (p != a) & (F.length("a") >= 40) & (F.length("p") + F.length("a") <= 3000)).select("conv_id", "turn")


@query("cls8_prompt_length", f"SELECT conv_id, turn, CASE WHEN {_tok} < 5 THEN 'too_short' WHEN {_tok} > 120 THEN 'too_long' END AS reject FROM conversations WHERE role = 'user'")
def cls8(spark, d):
    n = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))
    return _conv(spark, d).where("role = 'user'").select("conv_id", "turn", T.first_reason(("too_short", n < 5), ("too_long", n > 120)).alias("reject"))


@query("cls9_salvaged_json", """SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events""")
def cls9(spark, d):
    """A JSON object is found within free text."""
    wrapped = F.concat(F.lit("Sure: "), "props", F.lit(" done"))
    found = F.coalesce(F.try_parse_json(wrapped), F.try_parse_json(F.regexp_extract(wrapped, r"(?s)(\{.*\})", 1)))
    return table(spark, d, "events").select("event_id", F.try_variant_get(found, "$.k", "int").alias("k"))


def _reason_sql(rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in rules) + "], lambda z: z IS NOT NULL)"


def _echo(p: str, a: str) -> str:
    return f"({O.prompt_key(p)} <> '' AND {O.prompt_key(a)} <> '' AND contains({O.prompt_key(a)}, left({O.prompt_key(p)}, 80)))"


_ans = O.answer_text("a")
_hard_sql = [
    ("empty", f"{O.strip('t')} = ''"), ("too_short", f"{O.word_count('t')} < 2"), ("code_pollution", O.like("t", T.CODE_POLLUTION)), ("placeholder", O.any_of("lower(t)", T.PLACEHOLDERS)),
    ("meta_prefix", O.like(f"lower({O.answer_text('t')})", T.META_PREFIX)), ("multiple_answers", O.like("t", T.MULTI_ANSWER)), ("prompt_echo", _echo("p", "t")), ("meta_ai", "contains(lower(t), 'as an ai')"),
]
_explain_sql = [
    ("sentences", f"{O.sentence_count('t')} < 1 OR {O.sentence_count('t')} > 3"), ("too_long", f"{O.word_count('t')} > 70"),
    ("list", f"len(list_filter(string_split(t, chr(10)), lambda z: {O.like('z', T.BULLET)})) > 0"), ("technical", " + ".join(f"CAST(contains(lower(t), {O.lit(x)}) AS INTEGER)" for x in T.TECHNICAL) + " >= 2"),
]


def _verified(spark, d):
    rows = turn_pairs(spark, d).select("conv_id", "turn", "p", T.answer_text(F.col("a")).alias("t"))
    hard = V.hard_fails(F.col("t"), F.col("p"))
    soft = V.explain_reasons(F.col("t"), F.lit(70), F.lit(3))
    return rows.withColumn("hard", hard).withColumn("reasons", F.when(F.size("hard") > 0, F.col("hard")).otherwise(soft))


@query("vrf1_explain_reasons", f"SELECT conv_id, turn, array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ',') AS reasons FROM (SELECT *, {_reason_sql(_hard_sql)} AS hard, {_reason_sql(_explain_sql)} AS soft FROM (SELECT conv_id, turn, p, {_ans} AS t FROM {_pairs}))")
def vrf1(spark, d):
    return _verified(spark, d).select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query("vrf1_all_families")
def vrf1_all(spark, d):
    t = F.col("t")
    rows = turn_pairs(spark, d).select("conv_id", "turn", T.answer_text(F.col("a")).alias("t"))
    low, high, s_low, s_high, _ = V.CONSTRAINTS["email"]
    return rows.select(
        "conv_id",
        "turn",
        F.array_join(V.email_reasons(t, F.lit(low), F.lit(high), F.lit(s_low), F.lit(s_high), F.lit(True)), ",").alias("email"),
        F.array_join(V.rewrite_reasons(t, F.lit(30), F.lit(2)), ",").alias("rewrite"),
        F.array_join(V.summary_reasons(t, F.lit(3), F.lit(60)), ",").alias("summary"),
    )


@query(
    "vrf2_scores",
    f"""SELECT verdict, instruction_following, count(*) AS n FROM (SELECT greatest(1, 5 - len(r)) AS instruction_following,
    CASE WHEN len(r) = 0 THEN 'pass' WHEN len(list_intersect(r, {list(V.HARD_REASONS)})) > 0 THEN 'reject' ELSE 'repair' END AS verdict FROM (
    SELECT CASE WHEN len(hard) > 0 THEN hard ELSE soft END AS r FROM (SELECT *, {_reason_sql(_hard_sql)} AS hard, {_reason_sql(_explain_sql)} AS soft FROM (SELECT conv_id, turn, p, {_ans} AS t FROM {_pairs})))) GROUP BY ALL""",
)
def vrf2(spark, d):
    r = F.col("reasons")
    verdict = F.when(F.size(r) == 0, "pass").when(F.arrays_overlap(r, F.array(*map(F.lit, V.HARD_REASONS))), "reject").otherwise("repair")
    return _verified(spark, d).select(verdict.alias("verdict"), V.score(F.size(r)).alias("instruction_following")).groupBy("verdict", "instruction_following").agg(F.count(F.lit(1)).alias("n"))


# bodies that break one rule each, or none, by turn and conversation; the text is their comment
_bodies = ["return x", "import os", "return f{c}(x)", "return eval(x)", "yield x", "return (", "return x\nf{c}(1)"]
_broken = [[], ["banned_node"], ["recursion"], ["banned_call"], ["banned_node"], ["syntax_error"], ["extra_top_level_code", "recursion"]]


@query("vrf3_code_structure", "SELECT conv_id, turn, " + "CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {i} THEN '{','.join(r)}'" for i, r in enumerate(_broken)) + " END AS reasons FROM conversations")
def vrf3(spark, d):
    """Structure of Python answers by their syntax tree: each answer is planted one fault, or none."""
    from ..functions.code import code_structure

    c = F.col("conv_id").cast("string")
    body = F.element_at(F.array(*map(F.lit, _bodies)), (F.col("conv_id") + F.col("turn")).cast("int") % 7 + 1)
    comment = F.regexp_replace("text", r"[^\p{L}\p{N} ]+", " ")
    made = F.concat(F.lit("def f"), c, F.lit("(x):\n    # "), comment, F.lit("\n    "), F.replace(body, F.lit("{c}"), c))
    return _conv(spark, d).select("conv_id", "turn", F.array_join(code_structure(made, F.concat(F.lit("f"), c))["reasons"], ",").alias("reasons"))


@query("vrf5_entry_points", "SELECT conv_id, turn, concat('f', conv_id) AS entry FROM conversations")
def vrf5(spark, d):
    tests = F.concat(F.lit("assert f"), F.col("conv_id").cast("string"), F.lit("(1) == 2"))
    return _conv(spark, d).select("conv_id", "turn", F.regexp_extract(tests, r"assert\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1).alias("entry"))


# the answer's number and its form, and whether steps are shown, vary by row
_number = "CASE conv_id % 4 WHEN 0 THEN '1,200.50' WHEN 1 THEN '7' WHEN 2 THEN '-2.0' ELSE '3.250' END"
_plain = "CASE conv_id % 4 WHEN 0 THEN '1200.5' WHEN 1 THEN '7' WHEN 2 THEN '-2' ELSE '3.25' END"


@query("vrf6_math_format", f"SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE {_plain} END AS answer, turn % 2 = 0 OR contains(text, 'Steps:') AS has_steps FROM conversations")
def vrf6(spark, d):
    """The final answer's number in its plain form, and whether steps come before it; some rows lack either."""
    t = F.concat(F.when(F.col("turn") % 2 == 0, "Steps: ").otherwise(""), "text", F.when(F.col("turn") % 5 == 4, "\nno end").otherwise(F.concat(F.lit("\nFinal answer: "), F.expr(_number))))
    answer = F.when(T.final_answer(t) != "", T.numeric_token(T.final_answer(t)))
    return _conv(spark, d).select("conv_id", "turn", answer.alias("answer"), t.contains("Steps:").alias("has_steps"))


_want = "(SELECT conv_id, turn, text, 20 + conv_id % 50 AS most, (['the', 'la', 'der', 'que'])[1 + conv_id % 4] AS word, 1 + turn % 3 AS times FROM conversations WHERE role = 'assistant')"


@query("vrf7_constraint_checks", f"SELECT conv_id, turn, {O.word_count('text')} <= most AS short, NOT contains(text, ',') AS no_comma, lower(text) = text AS lower_case, {O.like('text', '[.!?]$')} AS ends, (length(lower(text)) - length(replace(lower(text), word, ''))) // length(word) >= times AS frequent FROM {_want}")
def vrf7(spark, d):
    """Constraints whose operands differ by row: a word limit, a keyword and how often it must occur, and fixed ones."""
    t, n = F.lower("text"), F.length("word")
    want = _conv(spark, d).where("role = 'assistant'").withColumns({"most": 20 + F.col("conv_id") % 50, "word": F.element_at(F.array(*map(F.lit, ("the", "la", "der", "que"))), (1 + F.col("conv_id") % 4).cast("int")), "times": 1 + F.col("turn") % 3})
    frequent = F.floor((F.length(t) - F.length(F.replace(t, F.col("word")))) / n) >= F.col("times")
    return want.select("conv_id", "turn", (T.word_count(F.col("text")) <= F.col("most")).alias("short"), V.followed("punctuation:no_comma", F.col("text")).alias("no_comma"), (t == F.col("text")).alias("lower_case"), F.col("text").rlike("[.!?]$").alias("ends"), frequent.alias("frequent"))


# a turn's first word is asked for; the answer has it alone, with other text, in another word, or not at all
_first = r"regexp_extract(text, '[\p{L}\p{N}]+')"


@query(
    "vrf8_task_checks",
    f"""SELECT conv_id, turn, a = v AS passes, a <> v AND regexp_matches(a, concat('(^|[^\\p{{L}}\\p{{N}}_])', v, '($|[^\\p{{L}}\\p{{N}}_])')) AS extra, NOT regexp_matches(a, concat('(^|[^\\p{{L}}\\p{{N}}_])', v, '($|[^\\p{{L}}\\p{{N}}_])')) AS missing,
    CASE WHEN list_contains(w, 'the') THEN 'positive' ELSE 'negative' END AS actual, (['positive', 'negative', 'invalid'])[1 + conv_id % 3] AS predicted,
    turn % 4 = 0 AS json_passes, turn % 4 = 1 AS duplicate_keys, turn % 4 < 3 AS json_valid FROM (
    SELECT *, CASE conv_id % 4 WHEN 0 THEN v WHEN 1 THEN concat('It is ', v, '.') WHEN 2 THEN concat(v, 'x9') ELSE '' END AS a, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w
    FROM (SELECT *, {_first} AS v FROM conversations)) WHERE v <> ''""",
)
def vrf8(spark, d):
    """Copying, membership and object answers, with planted faults: extra text, a longer word, a wrong label, repeated keys, no JSON."""
    from ..operators.tasks import exact_answer, json_answer, membership_answer

    v = F.regexp_extract("text", r"[\p{L}\p{N}]+", 0)
    rows = _conv(spark, d).withColumn("v", v).where("v <> ''")
    k, c = F.col("turn") % 4, F.col("conv_id") % 4
    a = F.when(c == 0, F.col("v")).when(c == 1, F.concat(F.lit("It is "), "v", F.lit("."))).when(c == 2, F.concat("v", F.lit("x9"))).otherwise("")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    label = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (F.col("conv_id") % 3).cast("int") + 1)
    one = F.concat(F.lit('{"word": "'), "v", F.lit('"'))
    made = F.when(k == 0, F.concat(one, F.lit("}"))).when(k == 1, F.concat(one, F.lit(', "word": "'), "v", F.lit('"}'))).when(k == 2, F.concat(one, F.lit(', "more": {"word": 1}}'))).otherwise(one)
    rows = rows.select(
        "conv_id", "turn", exact_answer(F.col("v"), a).alias("e"), membership_answer(words, F.lit("the"), F.lit("yes"), F.lit("no"), label).alias("m"),
        json_answer(F.array(F.lit("word")), F.array("v"), made).alias("j"),
    )
    return rows.select("conv_id", "turn", "e.*", "m.actual", "m.predicted", F.col("j.passes").alias("json_passes"), F.col("j.duplicate_keys").alias("duplicate_keys"), F.col("j.valid").alias("json_valid"))


_sp = "list_filter(regexp_split_to_array(text, " + O.pattern(T.S + "+") + "), lambda z: z <> '')"


@query(
    "rwd1_rewards",
    f"""SELECT conv_id, turn, CASE WHEN {O.strip('text')} <> '' THEN 1.0 ELSE 0.0 END AS nonempty, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE exp(-power((len(w) - 40) / 40.0, 2)) END, 9) AS length,
    round(CASE WHEN len(w) < 4 THEN 1.0 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) / (len(w) - 2) END, 9) AS no_repeat
    FROM (SELECT *, {_sp} AS w FROM conversations) WHERE role = 'assistant'""",
)
def rwd1(spark, d):
    w = F.array_remove(F.split("text", T.S + "+"), "")
    rows = _conv(spark, d).where("role = 'assistant'").withColumn("w", w).withColumn("n", F.size("w"))
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    return rows.select(
        "conv_id", "turn", F.when(T.strip(F.col("text")) != "", 1.0).otherwise(0.0).alias("nonempty"),
        F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.exp(-F.pow((F.col("n") - 40) / 40.0, 2))), 9).alias("length"),
        F.round(F.when(F.col("n") < 4, 1.0).otherwise(F.size(F.array_distinct(grams)) / (F.col("n") - 2)), 9).alias("no_repeat"),
    )


@query("rwd2_reference", f"SELECT conv_id, turn, {O.squeeze('lower(p)')} = {O.squeeze('lower(a)')} AS exact, contains({O.squeeze('lower(a)')}, {O.squeeze('lower(p)')}) AS within FROM {_pairs}")
def rwd2(spark, d):
    p, a = T.squeeze(F.lower("p")), T.squeeze(F.lower("a"))
    return turn_pairs(spark, d).select("conv_id", "turn", (p == a).alias("exact"), F.contains(a, p).alias("within"))


@query("gen1_templates", "SELECT r_name AS region, n_name AS nation, concat('Compare ', n_name, ' with ', r_name) AS prompt, row_number() OVER (ORDER BY n_name, r_name) AS n FROM region CROSS JOIN nation")
def gen1(spark, d):
    """A product of two tables of fixed size: five regions, 25 nations."""
    r, n = table(spark, d, "region").select(F.col("r_name").alias("region")), table(spark, d, "nation").select(F.col("n_name").alias("nation"))
    rows = n.crossJoin(F.broadcast(r)).withColumn("prompt", F.concat(F.lit("Compare "), "nation", F.lit(" with "), "region"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy().orderBy("nation", "region")))


# ---- instruction following

CHECKS = [
    ("keywords:existence", {"keywords": ["the"]}), ("keywords:frequency", {"keyword": "la", "relation": "at least", "frequency": 3}), ("keywords:forbidden_words", {"forbidden_words": ["der"]}),
    ("keywords:letter_frequency", {"letter": "e", "relation": "less than", "frequency": 40}), ("length_constraints:number_words", {"relation": "less than", "num_words": 60}),
    ("punctuation:no_comma", {}), ("detectable_format:title", {}), ("startend:quotation", {}),
]
_check_sql = {
    "keywords:existence": "contains(lower({t}), 'the')", "keywords:frequency": "len(regexp_extract_all(lower({t}), 'la')) >= 3", "keywords:forbidden_words": "NOT regexp_matches(lower({t}), '\\bder\\b')",
    "keywords:letter_frequency": "length({t}) - length(replace(lower({t}), 'e', '')) < 40", "length_constraints:number_words": "len(regexp_extract_all({t}, '[\\p{L}\\p{N}_]+')) < 60",
    "punctuation:no_comma": "NOT contains({t}, ',')", "detectable_format:title": "regexp_matches({t}, '<<[^\\n]*[^\\s<>][^\\n]*>>')", "startend:quotation": f"length({O.strip('{t}')}) > 1 AND starts_with({O.strip('{t}')}, '\"') AND ends_with({O.strip('{t}')}, '\"')",
}


def _checked(t: str, kind: str) -> str:
    return f"coalesce({O.strip(t)} <> '' AND ({_check_sql[kind].replace('{t}', t)}), false)"


def _instructions(spark, d, check):
    answers = _conv(spark, d).where("role = 'assistant'")
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), check(kind, F.col("text"), **k).alias("ok")) for kind, k in CHECKS])
    return answers.select("conv_id", "turn", F.explode(made).alias("x")).select("conv_id", "turn", "x.*")


@query("evl3_strict", "SELECT kind, round(avg(CAST(ok AS INTEGER)), 9) AS share, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {_checked('text', k)} AS ok FROM conversations WHERE role = 'assistant'" for k, _ in CHECKS) + ") GROUP BY kind")
def evl3(spark, d):
    return _instructions(spark, d, V.followed).groupBy("kind").agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("share"), F.count(F.lit(1)).alias("n"))


@query("evl3_prompt_level", "SELECT round(avg(CAST(ok AS INTEGER)), 9) AS share FROM (SELECT " + " AND ".join(_checked("text", k) for k, _ in CHECKS) + " AS ok FROM conversations WHERE role = 'assistant')")
def evl3_prompt(spark, d):
    """The share of answers that follow all instructions of their prompt."""
    return _instructions(spark, d, V.followed).groupBy("conv_id", "turn").agg(F.bool_and("ok").alias("ok")).agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("share"))


def _variants_sql() -> str:
    rows = "string_split(text, chr(10))"
    cut = lambda a, b: O.strip(f"array_to_string(list_slice({rows}, {1 + a}, greatest(0, len({rows}) - {b})), chr(10))")
    base = ["text", cut(1, 0), cut(0, 1), cut(1, 1)]
    return "[" + ", ".join(base + [f"replace({b}, '*', '')" for b in base]) + "]"


@query("evl4_loose", "SELECT kind, round(avg(CAST(ok AS INTEGER)), 9) AS share FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(list_filter({_variants_sql()}, lambda t: {_checked('t', k)})) > 0 AS ok FROM conversations WHERE role = 'assistant'" for k, _ in CHECKS) + ") GROUP BY kind")
def evl4(spark, d):
    return _instructions(spark, d, V.followed_loosely).groupBy("kind").agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("share"))


# ---- evaluation tables, from events: a request has four choices with log-probabilities

_choices = "(SELECT user_id % 7 AS task, event_id // 4 AS request, event_id % 4 AS choice, -value AS logprob, 1 + event_id % 9 AS denom, (event_id // 4) % 4 AS gold FROM events)"


def _choice_rows(spark, d):
    e = table(spark, d, "events")
    request = F.floor(F.col("event_id") / 4)
    return e.select((F.col("user_id") % 7).alias("task"), request.alias("request"), (F.col("event_id") % 4).alias("choice"), (-F.col("value")).alias("logprob"), (F.lit(1) + F.col("event_id") % 9).alias("denom"), (request % 4).alias("gold"))


@query(
    "evl1_multiple_choice",
    f"""SELECT round(avg(CASE WHEN b = gold THEN 1 ELSE 0 END), 9) AS acc, round(avg(CASE WHEN bn = gold THEN 1 ELSE 0 END), 9) AS acc_norm, count(*) AS n FROM (
    SELECT request, max(gold) AS gold, (list(choice ORDER BY logprob DESC, choice))[1] AS b, (list(choice ORDER BY logprob / denom DESC, choice))[1] AS bn FROM {_choices} GROUP BY request HAVING count(*) = 4)""",
)
def evl1(spark, d):
    best = lambda s: F.min_by("choice", F.struct(-s, "choice"))
    g = _choice_rows(spark, d).groupBy("request").agg(F.max("gold").alias("gold"), best(F.col("logprob")).alias("b"), best(F.col("logprob") / F.col("denom")).alias("bn"), F.count(F.lit(1)).alias("n"))
    hit = lambda c: F.round(F.avg((F.col(c) == F.col("gold")).cast("int")), 9)
    return g.where("n = 4").agg(hit("b").alias("acc"), hit("bn").alias("acc_norm"), F.count(F.lit(1)).alias("n"))


@query("evl2_coverage", f"SELECT count(*) FILTER (WHERE n < 4) AS missing, count(*) FILTER (WHERE n > 4) AS extra, count(*) AS requests FROM (SELECT request, count(*) AS n FROM {_choices} GROUP BY request)")
def evl2(spark, d):
    g = _choice_rows(spark, d).groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count_if(F.col("n") < 4).alias("missing"), F.count_if(F.col("n") > 4).alias("extra"), F.count(F.lit(1)).alias("requests"))


# task rows made from whole benchmark texts, some with a fault: four labelled choices, or two solutions
_made = r"""(SELECT item_id, text, w, CASE WHEN item_id % 6 = 1 THEN ['A', 'B', 'B', 'D'] ELSE ['A', 'B', 'C', 'D'] END AS labels, ([w[1], w[2], w[3], CASE WHEN item_id % 7 = 2 THEN '' ELSE w[4] END]) AS four,
    (['A', 'B', 'C', 'D', 'E'])[1 + item_id % 5] AS key FROM (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM benchmark))"""
_arc_error = "CASE WHEN len(list_distinct(labels)) <> 4 THEN 'labels' WHEN text = '' THEN 'question' WHEN len(list_filter(four, lambda c: c IS NULL OR c = '')) > 0 THEN 'choices' WHEN key = 'E' THEN 'gold' END"
_piqa_error = "CASE WHEN text = '' THEN 'question' WHEN w[1] IS NULL OR w[2] IS NULL THEN 'choices' WHEN item_id % 3 = 2 THEN 'gold' END"


@query(
    "evl5_task_rows",
    f"""SELECT task, item_id, CASE WHEN error IS NULL THEN concat('Question: ', text, chr(10), 'Answer:') END AS prompt, CASE WHEN error IS NULL THEN array_to_string(choices, '|') END AS choices, CASE WHEN error IS NULL THEN gold END AS gold, error FROM (
    SELECT 'arc' AS task, item_id, text, four AS choices, CAST(list_position(labels, key) - 1 AS INTEGER) AS gold, {_arc_error} AS error FROM {_made}
    UNION ALL SELECT 'piqa', item_id, text, [w[1], w[2]], CAST(item_id % 3 AS INTEGER), {_piqa_error} FROM {_made})""",
)
def evl5(spark, d):
    """Requests of two task shapes; rows with a planted fault say what it is."""
    from ..operators.tasks import multiple_choice

    w = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"))
    rows = table(spark, d, "benchmark").withColumn("w", w)
    at = lambda i: F.get("w", F.lit(i))
    labels = F.when(F.col("item_id") % 6 == 1, F.array(*map(F.lit, "ABBD"))).otherwise(F.array(*map(F.lit, "ABCD")))
    four = F.array(at(0), at(1), at(2), F.when(F.col("item_id") % 7 == 2, "").otherwise(at(3)))
    key = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("item_id") % 5).cast("int") + 1)
    arc = rows.select(F.lit("arc").alias("task"), "item_id", multiple_choice(F.col("text"), four, key, labels).alias("x"))
    piqa = rows.select(F.lit("piqa").alias("task"), "item_id", multiple_choice(F.col("text"), F.array(at(0), at(1)), F.col("item_id") % 3).alias("x"))
    return arc.unionByName(piqa).select("task", "item_id", "x.prompt", F.array_join("x.choices", "|").alias("choices"), "x.gold", "x.error")


_word = r"(?i)(?:^|[^\p{L}\p{N}_])(yes|no|unknown)(?:$|[^\p{L}\p{N}_])"


@query("evl6_extraction", f"SELECT conv_id, turn, regexp_extract(text, '-?[0-9]+(?:\\.[0-9]+)?') AS number, lower(regexp_extract(text, '{_word}', 1)) AS ynu FROM conversations")
def evl6(spark, d):
    """The first number, and the first yes, no or unknown, of each turn; empty if it has none."""
    return _conv(spark, d).select("conv_id", "turn", F.regexp_extract("text", r"-?[0-9]+(?:\.[0-9]+)?", 0).alias("number"), F.lower(F.regexp_extract("text", _word, 1)).alias("ynu"))


_gen = "(SELECT user_id, list(CAST(event_type = 'purchase' AS INTEGER) ORDER BY event_id) AS ids FROM events GROUP BY user_id)"


@query(
    "evl7_stop_rates",
    f"""SELECT round(avg(CAST(list_position(ids, 1) IS NOT NULL AND list_position(ids, 1) > 0 AS INTEGER)), 9) AS stopped, round(avg(CAST(coalesce(list_position(ids, 1), 0) BETWEEN 1 AND 3 AS INTEGER)), 9) AS premature, count(*) AS n FROM {_gen}""",
)
def evl7(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_type") == "purchase").cast("int").alias("v")))), lambda x: x["v"]).alias("ids"))
    at = F.array_position("ids", 1)
    return rows.agg(F.round(F.avg((at > 0).cast("int")), 9).alias("stopped"), F.round(F.avg(at.between(1, 3).cast("int")), 9).alias("premature"), F.count(F.lit(1)).alias("n"))


@query(
    "evl8_position_buckets",
    """SELECT bucket, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, CASE WHEN i = 1 THEN 'first' WHEN i <= 8 THEN 'next' WHEN i = m THEN 'end' ELSE 'rest' END AS bucket FROM (
    SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events)) GROUP BY bucket""",
)
def evl8(spark, d):
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(w.orderBy("event_id"))).withColumn("m", F.count(F.lit(1)).over(w))
    bucket = F.when(F.col("i") == 1, "first").when(F.col("i") <= 8, "next").when(F.col("i") == F.col("m"), "end").otherwise("rest")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "evl9_moving_average",
    """WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id)
    SELECT user_id, round(v[1] * power(0.9, len(v) - 1) + coalesce(list_sum(list_transform(range(2, len(v) + 1), lambda i: 0.1 * v[i] * power(0.9, len(v) - i))), 0), 6) AS ema FROM s""",
)
def evl9(spark, d):
    """The last exponential moving average of each series."""
    from ..operators.series import moving_average

    every = moving_average(table(spark, d, "events").where("user_id is not null"), ["user_id"], "event_id", "value")
    return every.groupBy("user_id").agg(F.round(F.max_by("ema", "step"), 6).alias("ema"))
