"""Text normalisation and document features as column expressions.

White space, letters and digits are Unicode's throughout, by explicit classes, so
that every engine agrees on them. A null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode calls white space, with the four
# information separators.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S = f"[{_SPACE_CLASS}]"
NS = f"[^{_SPACE_CLASS}]"
# blanks within a line
_BLANK = r"[\t\x0b\x0c\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
W = r"[\p{L}\p{N}_]"

# Words and patterns of the filters.
MENU_WORDS = "home|about|contact|privacy|terms|cookies|cookie|subscribe|sign in|login|register|newsletter"
HTML_TAGS = "html|div|span|script|style|head|body|p|br|table|tr|td|ul|li|a"
URL = r"(?i)https?://[^\t-\r\x1c-\x20\x85\xa0]+|www\.[^\t-\r\x1c-\x20\x85\xa0]+"
WIKI_TAILS = "See also|References|External links|Further reading|Notes|Bibliography|Sources"
LICENCE_SNIPPETS = ("creative commons", "licensed under", "copyright", "citation needed", "retrieved ", "isbn ")

PRESETS = {
    # domain: least ASCII share, most tags per character, most URLs per character, most short lines, least menu words
    "web": (0.75, 0.020, 0.0025, 0.75, 4),
    "wiki": (0.80, 0.015, 0.0020, 0.80, 4),
    "cosmo": (0.75, 0.020, 0.0025, 0.80, 4),
    "story": (0.80, 0.020, 0.0030, 0.85, 4),
    "code": (0.0, 0.050, 0.0100, 0.90, 10),
}


def rx(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def occurrences(c: Column, part: str) -> Column:
    """How often a fixed string occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part)))) / len(part)).cast("int")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def full_lines(c: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(rx(c, S + "+", " "))


# ---- normalisation


def normalise(c: Column) -> Column:
    """Line ends as newlines; no zero-width characters, NULs or other controls but tab and newline."""
    # the left class tells most characters apart by two comparisons
    return rx(rx(c, "\r\n?", "\n"), r"[[\x00-\x1F\u200B-\uFEFF]&&[\u200B-\u200D\uFEFF\x00-\x08\x0B\x0C\x0E-\x1F]]+")


def normalise_minimal(c: Column) -> Column:
    """Line ends as newlines; no NUL, vertical tab or form feed."""
    return F.translate(rx(c, "\r\n?", "\n"), "\x00\x0b\x0c", "")


# Quotation marks and their ASCII forms.
QUOTES_FROM, QUOTES_TO = "\u201c\u201d\u201e\u201f\u2018\u2019\u201a\u201b\u00ab\u00bb", "\"\"\"\"''''\"\""


def ascii_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES_FROM, QUOTES_TO)


def normalise_lines(c: Column, quotes: bool = True, underscores: bool = True, leading_noise: bool = True) -> Column:
    """Spaces and tabs of a line as one space, none at its end; optional ASCII quotes, underscore runs
    as a space, and up to 32 odd characters off the front."""
    out = rx(rx(c, "\r\n?", "\n"), r"[[\x00-\x1F]&&[^\t\n\r]]+")
    if quotes:
        out = ascii_quotes(out)
    out = rx(out, r"[ \t]{2,}|\t", " ")  # single spaces stay as they are
    # newlines are found first, as few have blanks before them; the array binds the text once
    tidy = lambda x: F.when(x.rlike(rf"(?<={_BLANK})\n"), rx(x, rf"{_BLANK}++\n", "\n")).otherwise(x)
    out = strip(F.element_at(F.transform(F.array(out), tidy), 1))
    if underscores:
        out = strip(rx(out, "_{4,}", " "))
    if leading_noise:
        out = F.ltrim(rx(out, rf"^(?:{S}*)[^\p{{L}}\p{{N}}_<>{{}}\[\]().,;:'\"/\-\n#|]{{1,32}}(?:{S}*)", ""), F.lit(SPACES))
    return out


def ascii_share(c: Column, empty: float = 0.0) -> Column:
    return F.when(c == "", F.lit(empty)).when(F.octet_length(c) == F.length(c), F.lit(1.0)).otherwise(F.length(rx(c, r"[^\x00-\x7F]+")) / F.length(c))


def contract_clean(c: Column, underscores: str = "keep", min_chars: int = 0, min_ascii: float = 0.0, quotes: bool = True, leading_noise: bool = True) -> Column:
    """Null if rejected: newlines off the ends, byte-order marks, comments and XML heads off the front,
    ASCII quotes, underscores kept, spaced or removed, then the least length and ASCII share."""
    out = F.btrim(c, F.lit("\n\r"))
    if leading_noise:
        out = rx(out, rf"^(?:{S}|\uFEFF|<!--(?s:.*?)-->|<\?xml(?s:.*?)\?>)+")
    if quotes:
        out = F.translate(out, "\u201c\u201d\u2019\u2018", "\"\"''")
    if underscores != "keep":
        out = F.translate(out, "_", " " if underscores == "space" else "")
    good = (out != "") & (F.length(out) >= min_chars)
    if min_ascii > 0:
        good = good & (ascii_share(out) >= min_ascii)
    return F.when(good, out)


def strip_metadata(c: Column, most: int = 20) -> Column:
    """Without up to `most` leading lines such as <name>value, and the newlines behind them."""
    return rx(c, rf"^(?:<[^>]{{1,64}}>[^\n]*(?:\n|$)){{1,{most}}}\n*")


def strip_repository_header(c: Column) -> Column:
    return rx(c, rf"^{S}*<(?i:reponame)>[^\n]*\n")


def trim_wiki_tail(c: Column) -> Column:
    """The text before the first heading line that opens its references."""
    at = F.regexp_instr(c, F.lit(rf"(?i)\n{S}*(?:{WIKI_TAILS}){S}*\n"))
    return F.when(at > 0, rstrip(F.substring(c, F.lit(1), at - 1))).otherwise(c)


def truncate_lines(c: Column, most: int, marker: str = "# ... truncated ...") -> Column:
    """First half, marker and last lines of a text with more than `most` lines."""
    rows, head = lines(c), most // 2
    cut = F.concat(F.slice(rows, 1, head), F.array(F.lit(marker)), F.slice(rows, F.size(rows) - (most - head) + 1, F.lit(most - head)))
    return F.when(F.size(rows) > most, strip(F.array_join(cut, "\n"))).otherwise(c)


def answer_text(c: Column) -> Column:
    """Curly quotes and no-break spaces in ASCII, blanks squeezed, at most one empty line in a row."""
    out = F.translate(c, "\u2019\u201c\u201d\u00a0", "'\"\" ")
    return strip(rx(rx(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def prompt_key(c: Column) -> Column:
    """Lower case, no punctuation but quotes and hyphens, one space between words."""
    return squeeze(rx(F.lower(answer_text(c)), rf"[^\p{{L}}\p{{N}}_\"'\-{_SPACE_CLASS}]", " "))


def hash_text(c: Column) -> Column:
    return squeeze(F.lower(rx(c, "\r\n?", "\n")))


def clean_prompt(c: Column) -> Column:
    return strip(rx(rx(answer_text(c), rf"^(?i:user):{S}*"), rf"^(?i:instruction):{S}*"))


def completion_text(c: Column) -> Column:
    """[title] as a full stop, other brackets dropped, double spaces as one."""
    return F.replace(rx(F.replace(strip(c), F.lit(" [title]"), F.lit(". ")), r"\[[^\]\n]*\]"), F.lit("  "), F.lit(" "))


def chat_text(role: Column, c: Column) -> Column:
    """Line ends as newlines; answers lose white space at the end, other turns at both."""
    out = rx(c, "\r\n?", "\n")
    return F.when(role == "assistant", rstrip(out)).otherwise(strip(out))


def numeric_token(c: Column) -> Column:
    """Thousands separators and a trailing % off, then trailing zeros and point; other strings as they are."""
    out = F.replace(F.regexp_replace(strip(c), "%$", ""), F.lit(","), F.lit(""))
    return F.when(out.rlike(r"^-?\d+\.\d+$"), rx(rx(out, "0+$"), r"\.$")).otherwise(out)


def python_block(c: Column) -> Column:
    return F.concat(F.lit("```python\n"), strip(c), F.lit("\n```"))


# ---- features


def symbol_share(c: Column) -> Column:
    """Characters that are neither letters, numbers nor white space."""
    return F.when(c == "", F.lit(0.0)).otherwise(F.length(rx(c, rf"[a-z[\p{{L}}\p{{N}}{_SPACE_CLASS}]]+")) / F.length(c))


def url_density(c: Column) -> Column:
    maybe = c.contains("://") | c.rlike(r"(?i)www\.")
    return F.when((c == "") | ~maybe, F.lit(0.0)).otherwise(count(c, URL) / F.length(c))


def short_line_share(c: Column, most: int = 30) -> Column:
    rows = full_lines(c)
    return F.when(F.size(rows) == 0, F.lit(0.0)).otherwise(F.size(F.filter(rows, lambda x: F.length(x) <= most)) / F.size(rows))


def menu_hits(c: Column) -> Column:
    first = "".join(sorted({word[0] for word in MENU_WORDS.split("|")}))  # most words begin otherwise
    return count(c, rf"(?i)(?=[{first}])\b(?:{MENU_WORDS})\b")


def html_units(c: Column) -> Column:
    """Tags and half the entities, per character."""
    tags, entities = (F.when(c.contains(mark), count(c, pattern)).otherwise(0) for mark, pattern in (("<", "<[^>]{1,200}>"), ("&", "&[a-zA-Z]{2,10};")))
    return F.when(c == "", F.lit(0.0)).otherwise((tags + 0.5 * entities) / F.length(c))


def is_html_heavy(c: Column, most: float) -> Column:
    known = c.contains("<") & c.rlike(rf"(?i)</?(?:{HTML_TAGS})\b")
    return html_units(c) > F.when(known, F.lit(most * 0.5)).otherwise(F.lit(most))


def has_filler(c: Column) -> Column:
    """Long runs of underscores, dots, dashes or equals signs."""
    return any_of(c, ("_" * 20, "." * 20, "-" * 30, "=" * 30))


def has_repeats(c: Column) -> Column:
    """One character, not a newline, fifty times in a row."""
    return c.rlike(r"([^\n])\1{49,}")


def is_menu(c: Column, share: float, hits: int) -> Column:
    return (menu_hits(c) >= hits) & (short_line_share(c) >= share)


def first_line(c: Column) -> Column:
    return rstrip(F.substring_index(F.ltrim(c, F.lit(SPACES)), "\n", 1))


def head_label(c: Column) -> Column:
    """Kind of the first line that isn't blank."""
    x = first_line(c)
    return (
        F.when(x == "", "empty")
        .when(x.startswith("```"), "fence")
        .when(x.startswith("|"), "pipes_table")
        .when(x.rlike(rf"^#{{1,6}}{S}+{NS}"), "md_heading")
        .when(x.rlike(rf"^-{S}+{NS}"), "dash_list")
        .when(x.rlike(rf"^\*{S}+{NS}"), "star_list")
        .when(x.rlike(rf"^>{S}+{NS}"), "blockquote")
        .when(x.startswith("_"), "underscores")
        .when(x.rlike(r"^\p{Nd}"), "digit")
        .when(x.rlike(r"^\p{L}"), "alpha")
        .otherwise("other_symbol")
    )


def is_html_head(c: Column) -> Column:
    x = first_line(c)
    return x.startswith("<") & ~x.startswith("#include ")


def is_markdown_early(c: Column, most: int = 60) -> Column:
    head = F.slice(lines(c), 1, most)
    headings = F.size(F.filter(head, lambda x: x.rlike(rf"^{S}*#{{1,6}}{S}+{NS}")))
    return c.contains("```") | (headings >= 2) | (occurrences(F.array_join(head, "\n"), "|") >= 24)


# What tells languages apart.
NOT_PYTHON = (
    "using System", "namespace ", "public class", "private ", "protected ", "#include ", "BEGIN CERTIFICATE", "<!DOCTYPE html", "<html", "<?xml",
    "package ", "public static void main", "console.log(", "function(", "SELECT ", "CREATE TABLE", "echo ", "REM ", "setlocal", "::", "/*", "*/",
)
PYTHON_WORDS = ("def ", "class ", "import ", "from ", "None", "True", "False")
CODE_WORDS = (
    "def ", "class ", "import ", "from ", "#include", "#define", "public ", "private ", "protected ", "template<", "function ", "const ", "let ",
    "var ", "package ", "namespace ", "using ", "return ", "if ", "else", "elif ", "try", "except", "for ", "while ", "switch ", "case ",
)
CODE_SIGNS = r"[;{}()=:]|->"
CODE_STARTS = ("def ", "class ", "import ", "from ", "return ", "fn ", "func ")


def any_of(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def looks_python(c: Column) -> Column:
    """Strong signs first, then signs of other languages, then shape and keywords."""
    rows = F.slice(F.filter(lines(c), lambda x: strip(x) != ""), 1, 200)
    strong = F.ltrim(c, F.lit(SPACES)).rlike(r"^#!/usr/bin/(?:env python|python)") | c.rlike(rf"(?m)^{S}*def{S}+{W}+{S}*\(") | c.rlike(rf"(?m)^{S}*class{S}+{W}+{S}*[:(]") | any_of(c, ("if __name__ == '__main__':", 'if __name__ == "__main__":'))
    braces = (occurrences(c, "{") + occurrences(c, "}") > 8) | (occurrences(c, ";") > 12)
    shape = (F.size(F.filter(rows, lambda x: x.startswith("    "))) >= 6) & (F.size(F.filter(rows, lambda x: rstrip(x).endswith(":"))) >= 2)
    words = sum((occurrences(c, k) for k in PYTHON_WORDS), F.lit(0))
    return F.when(strong, True).when(any_of(c, NOT_PYTHON) | braces, False).when(F.size(rows) == 0, False).otherwise(shape | (words >= 2))


def looks_code(c: Column) -> Column:
    blocky = (c.contains("{") & c.contains("}")) | (c.contains(";") & c.contains("\n"))
    return any_of(c, CODE_WORDS) | blocky | ((occurrences(c, "\n") >= 8) & (occurrences(c, "(") + occurrences(c, ")") >= 6))


def code_line_share(c: Column, most: int = 220) -> Column:
    rows = F.slice(full_lines(c), 1, most)
    comment = lambda x: x.startswith("#!") | (x.startswith("#") & (x.startswith("#include") | x.startswith("#define") | F.lower(x).contains("coding:") | (F.length(x) < 200)))
    starts = lambda x: x.rlike("^(?:" + "|".join(CODE_STARTS) + ")")
    good = F.filter(rows, lambda x: comment(x) | x.rlike(CODE_SIGNS) | starts(x))
    return F.when(F.size(rows) == 0, F.lit(0.0)).otherwise(F.size(good) / F.size(rows))


def letter_share(c: Column) -> Column:
    return F.length(rx(c, r"[^a-z\p{L}]+")) / F.greatest(F.lit(1), F.length(c))


# ---- instruction-data features

# Phrases that detectors look for.
PLACEHOLDERS = ("[name]", "[your name]", "[general]", "[company]", "[email]", "[date]", "[contact]")
META_PREFIX = r"^(?:here is|here's|below is|this is|rewritten|drafted by)\b"
CODE_MARKS = r"(?i)\bimport\b|\bdef\b|\bclass\b|```|\breturn\b|\bprint\s*\("
CODE_POLLUTION = r"(?i)```|\bimport\s+\w+|\bfrom\s+\w+\s+import\b|\bdef\s+\w+\s*\(|\bclass\s+\w+|\bprint\s*\("
MULTI_ANSWER = r"(?i)\boption\s*1\b|\balternative\b|\bversion\s*1\b|\bthree versions\b|\b3 versions\b"
TECHNICAL = ("financial statement", "cash flow", "income statement", "liabilities", "equity", "algorithm", "implementation", "framework", "optimization")
SIGN_OFFS = ("best regards", "best,", "kind regards", "sincerely", "thank you,", "best wishes")
BULLET = rf"^{S}*(?:[-*\u2022]|[0-9]+\.){S}+"


def word_count(c: Column) -> Column:
    """Runs of letters, digits, underscores, apostrophes and hyphens that hold one of the first three."""
    return F.size(F.filter(F.split(c, r"[^\p{L}\p{N}_'\-]+"), lambda x: x.rlike(r"[\p{L}\p{N}_]")))


def sentence_count(c: Column) -> Column:
    """Pieces between sentence ends with white space behind, or newlines."""
    return F.size(F.filter(F.split(rx(answer_text(c), rf"([.!?]){S}+", "$1\n"), r"\n+"), lambda x: strip(x) != ""))


def line_count(c: Column) -> Column:
    return F.size(full_lines(c))


def bullet_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(BULLET)))


def has_numbered_list(c: Column) -> Column:
    return F.exists(lines(c), lambda x: x.rlike(rf"^{S}*[0-9]+\.{S}+"))


def bullet_styles(c: Column) -> Column:
    """How many kinds of bullets lines begin with."""
    rows = F.transform(full_lines(c), lambda x: F.concat(x, F.lit(" ")))
    kinds = (rf"^-{S}+", rf"^\*{S}+", rf"^\u2022{S}+", rf"^[0-9]+\.{S}+")
    begins = lambda k: F.exists(rows, lambda x: x.rlike(k)).cast("int")
    return sum(map(begins, kinds), F.lit(0))


def has_placeholder(c: Column) -> Column:
    return any_of(F.lower(c), PLACEHOLDERS)


def has_meta_prefix(c: Column) -> Column:
    return F.lower(answer_text(c)).rlike(META_PREFIX)


def looks_technical(c: Column) -> Column:
    low = F.lower(c)
    return sum((low.contains(t).cast("int") for t in TECHNICAL), F.lit(0)) >= 2


def has_greeting(c: Column) -> Column:
    return F.lower(first_line(c)).rlike("^(?:dear|hello|hi) ")


def has_sign_off(c: Column) -> Column:
    rows = full_lines(c)
    tail = F.lower(F.array_join(F.slice(rows, F.greatest(F.lit(1), F.size(rows) - 2), F.lit(3)), "\n"))
    return any_of(tail, SIGN_OFFS)


def body_sentences(c: Column) -> Column:
    """Sentences without the first and last line, if there are three lines or more."""
    rows = full_lines(c)
    return F.when(F.size(rows) < 3, sentence_count(c)).otherwise(sentence_count(F.array_join(F.slice(rows, F.lit(2), F.size(rows) - 2), "\n")))


def has_echo(prompt: Column, answer: Column) -> Column:
    p, a = prompt_key(prompt), prompt_key(answer)
    return (p != "") & (a != "") & F.contains(a, F.left(p, F.lit(80)))


def longest_quote(c: Column) -> Column:
    """The longest text in double quotes, white space squeezed; ties to the first; null without one."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)), squeeze), lambda x: x != "")
    most = F.array_max(F.transform(found, F.length))
    return F.get(F.filter(found, lambda x: F.length(x) == most), F.lit(0))


def first_code_block(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?is)```(?:python)?\s*(.*?)```", 1))


def code_blocks(c: Column) -> Column:
    return F.floor(occurrences(c, "```") / 2).cast("int")


def final_answer(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?i)final answer:[ \t]*([^\n]*)", 1))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def is_refusal(c: Column, phrases) -> Column:
    low = F.lower(strip(c))
    return (low != "") & any_of(low, [p.strip().lower() for p in phrases if p.strip()])


# ---- ordered filters


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def document_reason(c: Column, domain: str = "web", min_chars: int = 200, max_chars: int = 50_000) -> Column:
    """Why the cleaner drops a normalised, stripped text of a domain; null if it stays."""
    least_ascii, tags, urls, short, hits = PRESETS[domain]
    rules = [
        ("empty", c.isNull() | (c == "")),
        ("too_short", F.length(c) < min_chars),
        ("too_long", F.length(c) > max_chars),
        ("placeholders", has_filler(c) | has_repeats(c)),
        ("html_heavy", is_html_heavy(c, tags)),
        ("url_spam", url_density(c) > urls),
    ]
    if domain in ("web", "wiki", "cosmo"):
        rules.append(("menu_spam", is_menu(c, short, hits)))
    if least_ascii > 0:
        rules.append(("low_ascii", ascii_share(F.left(c, F.lit(20_000))) < least_ascii))
    return first_reason(*rules)


def code_reason(c: Column, min_lines: int = 3, max_line: int = 1000, min_ascii: float = 0.9, max_symbols: float = 0.35, min_code: float = 0.2, max_foreign: float = 0.2) -> Column:
    """Why the code filter drops a normalised text; null if it stays."""
    rows = lines(c)
    head = F.slice(rows, 1, 220)
    foreign = F.size(F.filter(head, lambda x: ascii_share(x, 1.0) < 0.85)) / F.greatest(F.lit(1), F.size(head))
    label = head_label(c)
    return first_reason(
        ("empty", c.isNull() | (c == "")),
        ("heading", (label == "md_heading") & ~F.lower(first_line(c)).contains("coding")),
        ("table_or_fence", label.isin("pipes_table", "fence")),
        ("htmlish", is_html_head(c)),
        ("markdownish", is_markdown_early(c)),
        ("long_line", F.exists(rows, lambda x: F.length(x) > max_line)),
        ("foreign_lines", foreign > max_foreign),
        ("few_lines", F.size(rows) < min_lines),
        ("low_ascii", ascii_share(c, 1.0) < min_ascii),
        ("symbols", symbol_share(c) > max_symbols),
        ("no_code_signs", ~looks_code(c)),
        ("few_code_lines", code_line_share(c) < min_code),
        ("crash_dump", any_of(c, ("core dumped", "PyGILState_Release", "terminate called without an active exception"))),
        ("few_letters", letter_share(c) < 0.03),
    )


def wiki_reason(c: Column, min_paragraphs: int = 2) -> Column:
    """Why the wiki filter drops a normalised text; null if it stays. The text is judged without its tail."""
    t = trim_wiki_tail(c)
    return first_reason(
        ("empty", c.isNull() | (c == "")),
        ("head", head_label(c).isin("pipes_table", "md_heading", "fence")),
        ("only_tail", t == ""),
        ("licence", any_of(F.lower(t), LICENCE_SNIPPETS)),
        ("bullets", occurrences(t, "\n- ") >= 12),
        ("few_paragraphs", F.size(F.filter(F.split(t, "\n\n", -1), lambda x: strip(x) != "")) < min_paragraphs),
    )
