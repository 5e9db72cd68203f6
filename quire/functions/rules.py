"""Scrape-failure predicates (F1-F8) as Column functions.

Rule tables are fused into one anchored, case-insensitive alternation per
purpose and evaluated with ``rlike``: the pattern is a literal, so each task
compiles it once. Two rule sets exist:

* ``compat``  (default) reproduces the original behaviour, where abstract and
  full text are checked against the *title* table;
* ``intended`` uses the per-content-type tables as they were written;
* ``strict`` is ``intended`` with the known defects of the tables repaired:
  the two header entries that became one-letter prefix rules, the two error
  patterns glued by a missing comma, and site names whose unescaped ``|``
  or parentheses turned them into prefix rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .rulebook import (
    ABSTRACT_EXTRA_RULES,
    DUBIOUS_TEXTS,
    ERROR_RULES,
    FULLTEXT_EXTRA_RULES,
    HEADER_RULES,
    SITE_NAME_RULES,
    TITLE_EXTRA_RULES,
)
from .text import at_least_tokens, may_hold

CONTENT_TYPES = ("title", "abstract", "fulltext")

# ---- FIXED VALUES: repairs applied by the "strict" rule set ----
HEADER_REPAIRS = {"^b|Browse$": "^Browse$", "^S|shop$": "^Shop$"}


def _split_glued(rules):
    """'^a$^b$' (two patterns missing a comma) -> '^a$', '^b$'."""
    out = []
    for r in rules:
        parts = r.split("$^")
        out += [("^" if i else "") + p + ("$" if i < len(parts) - 1 else "") for i, p in enumerate(parts)]
    return out


def _escape_literal_meta(rules):
    """Escape '|', '(' and ')' that are not escaped: site names are literal names."""
    out = []
    for r in rules:
        buf, i = [], 0
        while i < len(r):
            if r[i] == "\\" and i + 1 < len(r):
                buf.append(r[i:i + 2])
                i += 2
                continue
            buf.append("\\" + r[i] if r[i] in "|()" else r[i])
            i += 1
        out.append("".join(buf))
    return out


_STRICT_ERRORS = _split_glued(ERROR_RULES)
_STRICT_HEADERS = [HEADER_REPAIRS.get(r, r) for r in HEADER_RULES]
SITE_NAMES = {"compat": list(SITE_NAME_RULES), "intended": list(SITE_NAME_RULES),
              "strict": _escape_literal_meta(SITE_NAME_RULES)}
ERRORS = {"compat": list(ERROR_RULES), "intended": list(ERROR_RULES), "strict": _STRICT_ERRORS}

_ALWAYS = list(ERROR_RULES) + list(HEADER_RULES)
_STRICT_ALWAYS = _STRICT_ERRORS + _STRICT_HEADERS
RULE_TABLES = {
    "compat": {
        "title": _ALWAYS + list(TITLE_EXTRA_RULES),
        "abstract": _ALWAYS + list(TITLE_EXTRA_RULES),
        "fulltext": _ALWAYS + list(TITLE_EXTRA_RULES),
    },
    "intended": {
        "title": _ALWAYS + list(TITLE_EXTRA_RULES),
        "abstract": _ALWAYS + list(ABSTRACT_EXTRA_RULES),
        "fulltext": _ALWAYS + list(FULLTEXT_EXTRA_RULES),
    },
    "strict": {
        "title": _STRICT_ALWAYS + list(TITLE_EXTRA_RULES),
        "abstract": _STRICT_ALWAYS + list(ABSTRACT_EXTRA_RULES),
        "fulltext": _STRICT_ALWAYS + list(FULLTEXT_EXTRA_RULES),
    },
}


def error_regex(rule_set: str = "compat") -> str:
    return P.rule_alternation(ERRORS[rule_set])


def site_regex(rule_set: str = "compat") -> str:
    return P.rule_alternation(SITE_NAMES[rule_set])


def _boilerplate_rules(content_type: str, rule_set: str, no_error: bool) -> list:
    if content_type not in CONTENT_TYPES:
        raise ValueError(f"unknown content type {content_type!r}: one of {', '.join(CONTENT_TYPES)}")
    # the tables begin with the error rules
    return RULE_TABLES[rule_set][content_type][len(ERRORS[rule_set]) if no_error else 0:]


def boilerplate_regex(content_type: str, rule_set: str = "compat", no_error: bool = False) -> str:
    return P.rule_alternation(_boilerplate_rules(content_type, rule_set, no_error))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rlike(c: Column, portable_pattern: str) -> Column:
    return c.rlike(P.java(portable_pattern, ignore_case=True))


#: Rules about a word anywhere in the first line, which cost a search of the text each.
_ANYWHERE = re.compile(r"\^\.\*([A-Za-z ]+)(?:\.\*)?\$")


def _matches(c: Column, rules) -> Column:
    """Whether any rule matches; rules about a word anywhere are read only where the text holds the word."""
    words = [m[1] for m in map(_ANYWHERE.fullmatch, rules) if m]
    others = [r for r in rules if not _ANYWHERE.fullmatch(r)]
    out = _rlike(c, P.rule_alternation(others)) if others or not words else F.lit(False)
    if words:
        out = out | may_hold(c, words) & _rlike(c, P.rule_alternation([r for r in rules if r not in others]))
    return out


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.btrim(_col(c), F.lit(P.WS_CHARS))


def has_content(c) -> Column:
    """a string that is not null, not '' and not 'None'."""
    c = _col(c)
    return F.coalesce(c.isNotNull() & (c != F.lit("")) & (c != F.lit("None")), F.lit(False))


def is_too_short(c) -> Column:
    """fewer than 2 tokens but > 20 chars is long enough (no-space scripts);
    otherwise at most 4 tokens is short; null is short."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(True)).when(at_least_tokens(c, 5), F.lit(False)).otherwise(
        at_least_tokens(c, 2) | (F.length(c) <= 20))


def is_known_dubious(c) -> Column:
    """exact membership in the (tiny, fixed) dubious set."""
    return F.coalesce(_col(c).isin(*DUBIOUS_TEXTS), F.lit(False))


def is_error_message(c, rule_set: str = "compat") -> Column:
    """blank/missing, or an error-rule match on the *unstripped* text."""
    c = _col(c)
    return F.when(~has_content(c), F.lit(True)).otherwise(_matches(c, ERRORS[rule_set]))


def is_site_name(c, rule_set: str = "compat") -> Column:
    """website / journal name rules."""
    return F.coalesce(_rlike(_col(c), site_regex(rule_set)), F.lit(False))


def is_boilerplate(c, content_type, rule_set: str = "compat", no_error: bool = False) -> Column:
    """error + header + content-type rules; `content_type` is a name or a Column of names.

    With `no_error` the text is known to match no error rule, which are then left out.
    """
    if isinstance(content_type, str):
        return F.coalesce(_matches(_col(c), _boilerplate_rules(content_type, rule_set, no_error)), F.lit(False))
    out, other = F.lit(False), []
    for ct in reversed(CONTENT_TYPES):
        if RULE_TABLES[rule_set][ct] not in other:
            other.append(RULE_TABLES[rule_set][ct])
    for table in other:
        names = [ct for ct in CONTENT_TYPES if RULE_TABLES[rule_set][ct] == table]
        out = F.when(content_type.isin(*names), is_boilerplate(c, names[0], rule_set, no_error)).otherwise(out)
    return out


def _kept_on_stripped(t: Column, content_type, keep_titles: bool, rule_set: str, no_error: Column | None = None) -> Column:
    boiler = is_boilerplate(t, content_type, rule_set)
    if no_error is not None:
        boiler = F.when(no_error, is_boilerplate(t, content_type, rule_set, True)).otherwise(boiler)
    return (F.when(is_too_short(t) | is_known_dubious(t), F.lit(False))
            .when(is_site_name(t, rule_set), F.lit(bool(keep_titles)))
            .otherwise(~boiler))


def to_be_kept(c, content_type, keep_titles: bool = False, rule_set: str = "compat", no_error: bool = False) -> Column:
    """is this text real content (not a scrape failure)?

    `content_type` is 'title' / 'abstract' / 'fulltext' or a Column of them. With `no_error`
    the unstripped text is known to match no error rule (F4).
    The stripped text is bound once through a one-element ``transform``.
    """
    if content_type is None:
        raise ValueError(f"unknown content type {content_type!r}: one of {', '.join(CONTENT_TYPES)}")
    if isinstance(content_type, str) and content_type not in CONTENT_TYPES:
        raise ValueError(f"unknown content type {content_type!r}: one of {', '.join(CONTENT_TYPES)}")
    c = _col(c)
    kept = F.transform(F.array(py_strip(c)),
                       lambda t: _kept_on_stripped(t, content_type, keep_titles, rule_set, t == c if no_error else None))[0]
    return F.when(~has_content(c), F.lit(False)).otherwise(kept)


def quality_gate(text, content_type, rule_set: str = "compat") -> Column:
    """F8: struct<kept boolean, reason string>.

    'Error message' first, then 'Parsing problem' (F7 with keep_titles=False).
    """
    text = _col(text)
    err = is_error_message(text, rule_set)
    ok = to_be_kept(text, content_type, keep_titles=False, rule_set=rule_set, no_error=True)  # read where `err` is false
    reason = (F.when(err, F.lit("Error message"))
              .when(~ok, F.lit("Parsing problem")))
    return F.transform(F.array(reason), lambda r: F.struct(r.isNull().alias("kept"), r.alias("reason")))[0]
