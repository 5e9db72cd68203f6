"""DuckDB SQL of the column functions, used only by ``oracle_sql()``.

The steps, their order and their patterns are written here by hand, in RE2's
syntax; only the tables of phrases, characters and rules are shared data.
Known dialect gap: RE2's ``\\b`` is ASCII-only (Spark uses Unicode word
boundaries); ``\\p{C}`` in RE2 does not include unassigned code points.
"""

from __future__ import annotations

from quire.functions import patterns as P
from quire.functions import rules as R
from quire.functions.rulebook import BOILERPLATE_PHRASES, DUBIOUS_TEXTS, HYPHEN_LIKE, QUOTE_LIKE

NL = "chr(10)"
# white space, as class body and as characters
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                  0x202F, 0x205F, 0x3000))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def hyphens(e: str) -> str:
    return f"translate({e}, {lit(HYPHEN_LIKE)}, {lit('-' * len(HYPHEN_LIKE))})"


def tags(e: str) -> str:
    return sub(e, "<[^>]+>")


def urls(e: str) -> str:
    return sub(e, rf"(?i)\b(?:https?://|www\.)[^{SPACE}]+\b")


def dates(e: str) -> str:
    n, sep = r"\p{Nd}", "[./]"
    return sub(e, rf"\b{n}{{4}}{sep}{n}{{1,2}}{sep}{n}{{1,2}}\b|\b{n}{{1,2}}{sep}{n}{{1,2}}{sep}{n}{{4}}\b"
                  rf"|\b{n}{{1,2}}{sep}{n}{{1,2}}{sep}{n}{{1,2}}\b")


def hours(e: str) -> str:
    return sub(e, r"\b\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\b")


def boilerplate(e: str) -> str:
    for phrase in BOILERPLATE_PHRASES:
        e = f"replace({e}, {lit(phrase)}, '')"
    return e


def quotes(e: str) -> str:
    return f"translate({e}, {lit(QUOTE_LIKE)}, {lit(chr(39) * len(QUOTE_LIKE))})"


def ends(e: str) -> str:
    return f"trim(trim(trim({e}, {lit(SPACES)}), {lit(HYPHEN_LIKE)}), '-')"


def collapse(e: str) -> str:
    return f"trim({sub(e, f'[{SPACE}]+', ' ')})"


def short_suffix(e: str, sep: str) -> str:
    word = rf"[^{SPACE}\{sep}]+"
    return sub(e, rf"\{sep}(?:[{SPACE}]+|[{SPACE}]*{word}(?:[{SPACE}]+{word}){{0,2}}[{SPACE}]*)\z")


def fix_quotes(e: str) -> str:
    e = sub(sub(e, "['\"]['\"]+", "'"), "^['\"]|['\"]\\z")
    return sub(f"trim(trim({e}, ''''), '\"')", f"['\"][{SPACE}]*:")


def emoji(e: str) -> str:
    return sub(e, r"[\x{10000}-\x{10FFFF}]")


def control(e: str) -> str:
    return sub(e, r"\p{C}")


def punctuation(e: str) -> str:
    return f"trim({e}, {lit(PUNCTUATION)})"


def digits(e: str) -> str:
    return sub(e, r"^\p{Nd}+|\p{Nd}+\z")


def one_pass(e: str) -> str:
    e = short_suffix(short_suffix(collapse(ends(e)), "-"), "|")
    return digits(punctuation(control(emoji(fix_quotes(e)))))


def clean_text(expr: str, passes: int = 10) -> str:
    start = quotes(boilerplate(hours(dates(urls(tags(hyphens(expr)))))))
    blanks = ", ".join(["''"] * passes)
    loop = f"list_reduce(list_prepend(s, [{blanks}]), lambda acc, y: {one_pass('acc')})"
    return f"(list_transform([{start}], lambda s: CASE WHEN s = '' THEN s ELSE nullif({loop}, '') END))[1]"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{SPACE}]+'), lambda x: x <> '')"


def token_count(expr: str) -> str:
    return f"coalesce(len({tokens(expr)}), 0)"


def rx_match(expr: str, portable_pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({expr}, {lit(P.re2(portable_pattern, ignore_case=ignore_case))})"


def py_strip(expr: str) -> str:
    return f"trim({expr}, {lit(SPACES)})"


def has_content(expr: str) -> str:
    return f"coalesce(({expr}) IS NOT NULL AND ({expr}) <> '' AND ({expr}) <> 'None', false)"


def is_too_short(expr: str) -> str:
    n = token_count(expr)
    return (f"(CASE WHEN ({expr}) IS NULL THEN true WHEN {n} < 2 AND length({expr}) > 20 THEN false "
            f"ELSE {n} <= 4 END)")


def is_known_dubious(expr: str) -> str:
    return f"coalesce(({expr}) IN ({', '.join(lit(x) for x in DUBIOUS_TEXTS)}), false)"


def is_error_message(expr: str, rule_set: str = "compat") -> str:
    return f"(CASE WHEN NOT {has_content(expr)} THEN true ELSE {rx_match(expr, R.error_regex(rule_set))} END)"


def is_site_name(expr: str, rule_set: str = "compat") -> str:
    return f"coalesce({rx_match(expr, R.site_regex(rule_set))}, false)"


def is_boilerplate(expr: str, ctype: str, rule_set: str = "compat") -> str:
    return f"coalesce({rx_match(expr, R.boilerplate_regex(ctype, rule_set))}, false)"


def to_be_kept(expr: str, ctype: str, keep_titles: bool = False, rule_set: str = "compat") -> str:
    inner = (f"CASE WHEN {is_too_short('t')} OR {is_known_dubious('t')} THEN false "
             f"WHEN {is_site_name('t', rule_set)} THEN {'true' if keep_titles else 'false'} "
             f"ELSE NOT {is_boilerplate('t', ctype, rule_set)} END")
    return (f"(CASE WHEN NOT {has_content(expr)} THEN false "
            f"ELSE (list_transform([{py_strip(expr)}], lambda t: {inner}))[1] END)")


def to_be_kept_by_type(expr: str, ctype_expr: str, keep_titles: bool = False, rule_set: str = "compat") -> str:
    return ("(CASE " + " ".join(
        f"WHEN {ctype_expr} = '{ct}' THEN {to_be_kept(expr, ct, keep_titles, rule_set)}" for ct in R.CONTENT_TYPES
    ) + " END)")


def gate_reason(expr: str, ctype: str, rule_set: str = "compat") -> str:
    return (f"(CASE WHEN {is_error_message(expr, rule_set)} THEN 'Error message' "
            f"WHEN NOT {to_be_kept(expr, ctype, False, rule_set)} THEN 'Parsing problem' END)")


def has_subject(expr: str) -> str:
    return f"(CASE WHEN ({expr}) IS NOT NULL AND CAST({expr} AS VARCHAR) <> 'None' THEN 1 ELSE 0 END)"


def keyword_regex() -> str:
    from quire.functions.extract import keyword_pattern
    return keyword_pattern()


RAW_CORPUS = f"""
  SELECT d.doc_id,
         split_part(d.text, {NL}, 1) AS trafilatura_title,
         string_split(d.text, {NL})[2] AS trafilatura_abstract,
         d.text AS trafilatura_fulltext,
         CASE WHEN d.lang = 'en' THEN split_part(d.text, {NL}, 1) END AS translation_title,
         CASE WHEN l.toxic = 1 THEN d.source END AS sujet,
         l.quality,
         d.lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
