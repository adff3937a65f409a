"""Pieces of DuckDB SQL for the oracle queries."""

from __future__ import annotations

import re

from ..functions import text as T


def pattern(java: str) -> str:
    """A pattern as RE2 writes it, in SQL quotes."""
    return "'" + re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", java).replace("'", "''") + "'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, java: str, by: str = "") -> str:
    return f"regexp_replace({x}, {pattern(java)}, {lit(by)}, 'g')"


def like(x: str, java: str) -> str:
    return f"regexp_matches({x}, {pattern(java)})"


def cnt(x: str, java: str) -> str:
    return f"len(regexp_extract_all({x}, {pattern(java)}))"


def strip(x: str) -> str:
    return f"trim({x}, {lit(T.SPACES)})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {lit(T.SPACES)})"


def full_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda z: {strip('z')}), lambda z: z <> '')"


def times(x: str, part: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {lit(part)}, ''))) / {len(part)} AS INTEGER)"


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def normalise(x: str) -> str:
    return sub(sub(x, "\r\n?", "\n"), r"[\u200B-\u200D\uFEFF\x00-\x08\x0B\x0C\x0E-\x1F]")


def clean(x: str) -> str:
    return strip(normalise(x))


def squeeze(x: str) -> str:
    return strip(sub(x, T.S + "+", " "))


def ascii_share(x: str, empty: str = "0.0") -> str:
    return f"CASE WHEN {x} = '' THEN {empty} ELSE length({sub(x, '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')}) / length({x}) END"


def answer_text(x: str) -> str:
    x = f"translate({x}, {lit(chr(0x2019) + chr(0x201c) + chr(0x201d) + chr(0xa0))}, {lit(chr(39) + chr(34) * 2 + ' ')})"
    return strip(sub(sub(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def prompt_key(x: str) -> str:
    return squeeze(sub(f"lower({answer_text(x)})", rf"[^\p{{L}}\p{{N}}_\"'\-{T._SPACE_CLASS}]", " "))


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {pattern(chr(91) + '^' + r'\p{L}\p{N}_' + chr(39) + r'\-]+')}), lambda z: {like('z', r'[\p{L}\p{N}_]')}))"


def sentence_count(x: str) -> str:
    inner = f"regexp_replace({answer_text(x)}, {pattern('([.!?])' + T.S + '+')}, concat(chr(92), '1', chr(10)), 'g')"
    return f"len(list_filter(string_split({inner}, chr(10)), lambda z: {strip('z')} <> ''))"


def short_share(x: str, most: int = 30) -> str:
    rows = full_lines(x)
    return f"CASE WHEN len({rows}) = 0 THEN 0.0 ELSE len(list_filter({rows}, lambda z: length(z) <= {most})) / len({rows}) END"


def url_density(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0.0 ELSE {cnt(x, T.URL)} / length({x}) END"


def html_units(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0.0 ELSE ({cnt(x, '<[^>]{1,200}>')} + 0.5 * {cnt(x, '&[a-zA-Z]{2,10};')}) / length({x}) END"


def html_heavy(x: str, most: float) -> str:
    return f"({html_units(x)} > CASE WHEN {like(x, rf'(?i)</?(?:{T.HTML_TAGS})' + chr(92) + 'b')} THEN {most * 0.5} ELSE {most} END)"


def menu_hits(x: str) -> str:
    return cnt(x, rf"(?i)\b(?:{T.MENU_WORDS})\b")


def filler(x: str) -> str:
    return like(x, r"_{20,}|\.{20,}|-{30,}|={30,}")



def first_line(x: str) -> str:
    return f"coalesce(({full_lines(x)})[1], '')"


def head_label(x: str) -> str:
    return f"""CASE WHEN {x} = '' THEN 'empty' WHEN starts_with({x}, '```') THEN 'fence' WHEN starts_with({x}, '|') THEN 'pipes_table'
      WHEN {like(x, '^#{1,6}' + T.S + '+' + T.NS)} THEN 'md_heading' WHEN {like(x, '^-' + T.S + '+' + T.NS)} THEN 'dash_list'
      WHEN {like(x, '^' + chr(92) + '*' + T.S + '+' + T.NS)} THEN 'star_list' WHEN {like(x, '^>' + T.S + '+' + T.NS)} THEN 'blockquote'
      WHEN starts_with({x}, '_') THEN 'underscores' WHEN {like(x, r'^\p{Nd}')} THEN 'digit' WHEN {like(x, r'^\p{L}')} THEN 'alpha' ELSE 'other_symbol' END"""
