"""Rule-based checks of answers, prompts and instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Key phrases of the prompt families, in the order of the tests.
FAMILIES = {
    "rewrite_style": (
        "rewrite", "rephrase", "paraphrase", "make this sound", "make it sound", "more formal", "more concise", "more polite", "clearer", "shorter",
        "more direct", "improve the wording", "professional tone", "change the tone", "edit this sentence", "polish this sentence", "simplify this sentence",
    ),
    "summary_bullets": (
        "summarize", "summary", "tl;dr", "tldr", "bullet points", "key takeaways", "main points", "main ideas", "one sentence summary", "extract key points",
        "condense this", "short summary", "brief summary",
    ),
    "email_message": (
        "email", "follow up", "follow-up", "reschedule", "thank you", "thank-you", "confirm receipt", "professional message", "polite message",
        "write a message", "draft a note", "write a note", "ask a colleague", "ask politely", "request a meeting", "schedule a meeting",
    ),
    "explain_compare": ("explain", "what is", "what are", "difference between", "simple terms", "plain language", "everyday language", "describe", "define"),
}
SUBFAMILIES = {
    "email_message": (
        [("job_followup_email", ("job", "application", "interview", "hiring", "recruiter")), ("reschedule_email", ("reschedule", "move", "postpone", "next week", "meeting")),
         ("thank_you_email", ("thank",)), ("request_or_confirm_email", ("file", "report", "notes", "attachment", "slides", "document", "receipt"))],
        "polite_short_message",
    ),
    "rewrite_style": (
        [("rewrite_concise", ("concise", "shorter")), ("rewrite_polite", ("polite",)), ("rewrite_clearer", ("clear",)), ("rewrite_more_direct", ("direct",)), ("rewrite_formal", ("formal", "professional"))],
        "rewrite_clearer",
    ),
    "explain_compare": (
        [("compare_simple", ("difference between",)), ("explain_budget_simple", ("budget",)), ("explain_deadline_simple", ("deadline",)), ("explain_password_simple", ("password",)),
         ("explain_receipt_simple", ("receipt",)), ("explain_schedule_simple", ("schedule",))],
        "explain_simple",
    ),
}
# sub-family: least and most words, least and most sentences, bullets; null where there is no bound
CONSTRAINTS = {
    "polite_short_message": (8, 45, 1, 3, None),
    "email": (35, 110, 2, 6, None),
    "rewrite": (None, 30, None, 2, None),
    "summary_3_bullets": (None, 60, None, None, 3),
    "extract_key_points": (None, 60, None, None, 3),
    "summary_2_takeaways": (None, 50, None, None, 2),
    "summary_1_sentence": (None, 30, None, 1, None),
    "other": (None, 70, None, 3, None),
}
HARD_REASONS = ("code_pollution", "placeholder", "prompt_echo", "multiple_answers", "meta_ai")


def family(prompt: Column) -> Column:
    """The first family with a key phrase in the prompt; null if there is none."""
    low = F.lower(prompt)
    return T.first_reason(*[(name, T.any_of(low, keys)) for name, keys in FAMILIES.items()])


def subfamily(prompt: Column) -> Column:
    low, fam = F.lower(prompt), family(prompt)
    out = F.when(fam == "summary_bullets", F.when(low.contains("one sentence"), "summary_1_sentence").when(low.contains("takeaway") | (low.contains("2") & T.any_of(low, ("main idea", "key point"))), "summary_2_takeaways").when(T.any_of(low, ("key point", "main point", "main idea")), "extract_key_points").otherwise("summary_3_bullets"))
    for name, (rules, rest) in SUBFAMILIES.items():
        inner = T.first_reason(*[(s, T.any_of(low, keys)) for s, keys in rules])
        out = out.when(fam == name, F.coalesce(inner, F.lit(rest)))
    return out


def constraint_group(sub: Column) -> Column:
    """The row of CONSTRAINTS that a sub-family goes by."""
    own = [k for k in CONSTRAINTS if k not in ("email", "rewrite", "other")]
    return F.when(sub.isin(*own), sub).when(sub.endswith("email"), "email").when(sub.startswith("rewrite_"), "rewrite").otherwise("other")


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def hard_fails(answer: Column, prompt: Column) -> Column:
    return reasons(
        ("empty", T.strip(answer) == ""),
        ("too_short", T.word_count(answer) < 2),
        ("code_pollution", answer.rlike(T.CODE_POLLUTION)),
        ("placeholder", T.has_placeholder(answer)),
        ("meta_prefix", T.has_meta_prefix(answer)),
        ("multiple_answers", answer.rlike(T.MULTI_ANSWER)),
        ("prompt_echo", T.has_echo(prompt, answer)),
        ("meta_ai", F.lower(answer).contains("as an ai")),
    )


def email_reasons(a: Column, low: Column, high: Column, s_low: Column, s_high: Column, is_email: Column) -> Column:
    words, body, sentences = T.word_count(a), T.body_sentences(a), T.sentence_count(a)
    return reasons(
        ("length", (words < low) | (words > high)),
        ("bullets", T.bullet_count(a) > 0),
        ("missing_greeting", is_email & ~T.has_greeting(a)),
        ("missing_signoff", is_email & ~T.has_sign_off(a)),
        ("body_sentences", is_email & ((body < s_low) | (body > s_high))),
        ("sentences", ~is_email & ((sentences < s_low) | (sentences > s_high))),
        ("lines", ~is_email & (T.line_count(a) > 4)),
    )


def rewrite_reasons(a: Column, high: Column, s_high: Column) -> Column:
    return reasons(
        ("paragraphs", T.line_count(a) > 3),
        ("sentences", T.sentence_count(a) > s_high),
        ("too_long", T.word_count(a) > high),
        ("became_email", T.has_greeting(a) & T.has_sign_off(a)),
    )


def summary_reasons(a: Column, bullets: Column, high: Column) -> Column:
    rows = F.filter(T.lines(a), lambda x: T.strip(x) != "")
    listed = F.filter(rows, lambda x: x.rlike(T.BULLET))
    return reasons(
        ("wrong_bullet_count", bullets.isNotNull() & (F.size(listed) != bullets)),
        ("extra_text", bullets.isNotNull() & (F.size(listed) != F.size(rows))),
        ("bullet_too_long", bullets.isNotNull() & F.exists(listed, lambda x: T.word_count(T.rx(x, T.BULLET)) > 20)),
        ("not_one_sentence", bullets.isNull() & (T.sentence_count(a) != 1)),
        ("too_long", bullets.isNull() & (T.word_count(a) > high)),
    )


def explain_reasons(a: Column, high: Column, s_high: Column) -> Column:
    n = T.sentence_count(a)
    return reasons(
        ("sentences", (n < 1) | (n > s_high)),
        ("too_long", T.word_count(a) > high),
        ("list", (T.bullet_count(a) > 0) | T.has_numbered_list(a)),
        ("technical", T.looks_technical(a)),
    )


def score(count: Column) -> Column:
    """5 less the number of reasons, at least 1."""
    return F.greatest(F.lit(1), F.lit(5) - count)


# ---- instruction checks: text -> whether the instruction is followed


def _split(c: Column, pattern: str) -> Column:
    return F.split(c, pattern, -1)


def relation(n: Column, op: str, k: int) -> Column:
    return n < k if op == "less than" else n >= k


def highlighted(c: Column) -> Column:
    """Spans *x* and **x** that aren't blank."""
    one = F.filter(F.regexp_extract_all(c, F.lit(r"(\*[^\n*]*\*)"), F.lit(1)), lambda x: T.strip(F.btrim(x, F.lit("*"))) != "")
    two = F.filter(F.regexp_extract_all(c, F.lit(r"(\*\*[^\n*]*\*\*)"), F.lit(1)), lambda x: T.strip(F.replace(x, F.lit("**"))) != "")
    return F.size(one) + F.size(two)


def paragraphs_ok(c: Column, n: int) -> Column:
    """Exactly `n` paragraphs between *** lines; an empty one is allowed at either end only."""
    parts = F.transform(_split(c, r"\s?\*\*\*\s?"), T.strip)
    middle = F.exists(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), lambda x: x == "")
    return ~middle & (F.size(F.filter(parts, lambda x: x != "")) == n)


def first_word_ok(c: Column, paragraphs: int, nth: int, word: str) -> Column:
    parts = F.filter(_split(c, "\n\n"), lambda x: T.strip(x) != "")
    first = F.regexp_extract(F.ltrim(F.get(parts, F.lit(nth - 1)), F.lit(T.SPACES + "'\"")), r"^([^\s.,?!'\"]*)", 1)
    return (F.size(parts) == paragraphs) & F.coalesce(F.lower(first) == word.lower(), F.lit(False))


def json_ok(c: Column) -> Column:
    bare = T.strip(T.rx(T.rx(T.strip(c), r"^```(?:json|Json|JSON)?"), r"```$"))
    return F.try_parse_json(bare).isNotNull()


def followed(kind: str, c: Column, **k) -> Column:
    """Whether a response follows an instruction of a kind; an empty response follows none.

    Language detection and a sentence model are left out: of the kinds that ask for a
    language, the two case checks hold for text in any language by its cased letters
    alone, and capital words are runs without white space whose cased letters are all
    upper-case; response language and sentence counts have no check.
    """
    low = F.lower(c)
    rules = {
        "keywords:existence": lambda: _all([low.contains(w.lower()) for w in k["keywords"]]),
        "keywords:frequency": lambda: relation(F.regexp_count(low, F.lit(_quote(k["keyword"].lower()))), k["relation"], k["frequency"]),
        "keywords:forbidden_words": lambda: ~_any([low.rlike(rf"\b{_quote(w.lower())}\b") for w in k["forbidden_words"]]),
        "keywords:letter_frequency": lambda: relation(T.occurrences(low, k["letter"].lower()), k["relation"], k["frequency"]),
        "length_constraints:number_paragraphs": lambda: paragraphs_ok(c, k["num_paragraphs"]),
        "length_constraints:number_words": lambda: relation(F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+")), k["relation"], k["num_words"]),
        "length_constraints:nth_paragraph_first_word": lambda: first_word_ok(c, k["num_paragraphs"], k["nth_paragraph"], k["first_word"]),
        "detectable_content:number_placeholders": lambda: F.regexp_count(c, F.lit(r"\[[^\n]*?\]")) >= k["num_placeholders"],
        "detectable_content:postscript": lambda: low.rlike(r"(?m)\s*p\.\s?p\.\s?s.*$" if k.get("marker") == "P.P.S" else r"(?m)\s*p\.\s?s\..*$"),
        "detectable_format:number_bullet_lists": lambda: F.regexp_count(c, F.lit(r"(?m)^\s*\*[^\*\n].*$")) + F.regexp_count(c, F.lit(r"(?m)^\s*-.*$")) == k["num_bullets"],
        "detectable_format:constrained_response": lambda: _any([T.strip(c).contains(o) for o in ("My answer is yes.", "My answer is no.", "My answer is maybe.")]),
        "detectable_format:number_highlighted_sections": lambda: highlighted(c) >= k["num_highlights"],
        "detectable_format:multiple_sections": lambda: F.size(_split(c, rf"\s?{_quote(k['section_spliter'])}\s?\d+\s?")) - 1 >= k["num_sections"],
        "detectable_format:json_format": lambda: json_ok(c),
        "detectable_format:title": lambda: F.exists(F.regexp_extract_all(c, F.lit(r"<<([^\n]+)>>"), F.lit(1)), lambda x: T.strip(F.btrim(x, F.lit("<>"))) != ""),
        "combination:two_responses": lambda: _two(c),
        "combination:repeat_prompt": lambda: F.startswith(T.strip(low), F.lit(k["prompt_to_repeat"].strip().lower())),
        "startend:end_checker": lambda: F.endswith(F.lower(F.btrim(T.strip(c), F.lit('"'))), F.lit(k["end_phrase"].strip().lower())),
        "startend:quotation": lambda: (F.length(T.strip(c)) > 1) & T.strip(c).startswith('"') & T.strip(c).endswith('"'),
        "punctuation:no_comma": lambda: ~c.contains(","),
        "change_case:english_capital": lambda: _one_case(c, F.upper),
        "change_case:english_lowercase": lambda: _one_case(c, F.lower),
        "change_case:capital_word_frequency": lambda: relation(F.size(F.filter(F.split(c, T.S + "+"), lambda w: _one_case(w, F.upper))), k["capital_relation"], k["capital_frequency"]),
    }
    return F.coalesce((T.strip(c) != "") & rules[kind](), F.lit(False))


def _one_case(c: Column, case) -> Column:
    """Some letter has cases, and all that do are of this one."""
    return (c == case(c)) & (F.upper(c) != F.lower(c))


def _two(c: Column) -> Column:
    parts = F.transform(_split(c, r"\*{6}"), T.strip)
    inner = F.exists(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), lambda x: x == "")
    full = F.filter(parts, lambda x: x != "")
    return ~inner & (F.size(full) == 2) & (F.get(full, F.lit(0)) != F.get(full, F.lit(1)))


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _any(parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _quote(s: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch.isspace() or ch == "_") else ch for ch in s)


def variants(c: Column) -> Column:
    """The eight readings of loose checking: with and without first and last line, with and without asterisks."""
    rows = T.lines(c)
    cut = lambda a, b: T.strip(F.array_join(F.slice(rows, F.lit(1 + a), F.greatest(F.lit(0), F.size(rows) - a - b)), "\n"))
    base = [c, cut(1, 0), cut(0, 1), cut(1, 1)]
    return F.array(*base, *[F.replace(x, F.lit("*")) for x in base])


def followed_loosely(kind: str, c: Column, **k) -> Column:
    return F.exists(variants(c), lambda x: followed(kind, x, **k))
