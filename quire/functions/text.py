"""Text-cleaning column functions.

Every function takes and returns a ``Column`` and compiles to built-in Spark
expressions (regexp_replace, translate, replace, btrim, higher-order
functions), so cleaning runs inside the JVM with no Python round trip.

The steps are declared once as small op tuples (``PRE_OPS``, ``PASS_OPS``);
``apply_ops`` turns them into Column expressions. The same tuples are
rendered to DuckDB SQL by the oracle module, which keeps the two in step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .rulebook import ASCII_PUNCTUATION, BOILERPLATE_PHRASES, HYPHEN_LIKE, QUOTE_LIKE

MAX_PASSES = 10

_H = "".join(f"\\x{{{ord(c):x}}}" for c in HYPHEN_LIKE)  # hyphen class body
_WS = P.WS
_D = P.DIGIT

# The patterns and the order of the steps must match, as the tables do.
# Op tuples:
#   ("translate", chars, to_char)   every char of `chars` -> to_char
#   ("regex", pattern, repl, ignore_case, unicode_words)
#   ("literal", phrase)             delete every occurrence of phrase
#   ("trim_chars", chars)           strip any of `chars` at both ends
#   ("trim_space",)                 strip U+0020 at both ends
OP_HYPHENS = ("translate", HYPHEN_LIKE, "-")
OP_TAGS = ("regex", r"<[^>]+>", "", False, False)
OP_URLS = ("regex", rf"\b(?:https?://|www\.)[^{_WS}]+\b", "", True, True)
# The separator class is the range "." .. "/" exactly as in the original
# pattern, so ISO dates with "-" are left alone.
OP_DATES = ("regex",
            rf"\b[{_D}]{{4}}[.-/][{_D}]{{1,2}}[.-/][{_D}]{{1,2}}\b"
            rf"|\b[{_D}]{{1,2}}[.-/][{_D}]{{1,2}}[.-/][{_D}]{{4}}\b"
            rf"|\b[{_D}]{{1,2}}[.-/][{_D}]{{1,2}}[.-/][{_D}]{{1,2}}\b",
            "", False, True)
OP_ISO_DATES = ("regex", rf"\b[{_D}]{{4}}-[{_D}]{{1,2}}-[{_D}]{{1,2}}\b", "", False, True)
OP_HOURS = ("regex", rf"\b[{_D}]{{1,2}}:[{_D}]{{2}}(?::[{_D}]{{2}})?\b", "", True, True)
OPS_BOILERPLATE = tuple(("literal", p) for p in BOILERPLATE_PHRASES)
OP_QUOTES = ("translate", QUOTE_LIKE, "'")

# Flanking white space and hyphen-likes: plain character-set trims (no regex).
OPS_TRIM_WS_HYPHEN = (
    ("trim_chars", P.WS_CHARS),
    ("trim_chars", HYPHEN_LIKE),
    ("trim_chars", "-"),
)
# Every white-space character becomes a space, then runs of spaces one space.
OPS_COLLAPSE_WS = (("translate", "".join(c for c in P.WS_CHARS if c != " "), " "), ("regex", " {2,}", " ", False, False),
                   ("trim_space",))


def _short_suffix_op(sep: str):
    """Cut at the last `sep` when something, but at most three tokens, follows it.

    The pattern ends at the text's end and what follows `sep` can't contain
    it, so a match always starts at the last one.
    """
    tok = rf"[^{_WS}\{sep}]+"
    pat = rf"\{sep}(?:[{_WS}]+|[{_WS}]*{tok}(?:[{_WS}]+{tok}){{0,2}}[{_WS}]*)\z"
    return ("regex", pat, "", False, False)


OPS_SHORT_SUFFIX = (_short_suffix_op("-"), _short_suffix_op("|"))
OPS_FIX_QUOTES = (
    ("regex", r"""['"]['"]+""", "'", False, False),
    ("regex", r"""^['"]|['"]\z""", "", False, False),
    ("trim_chars", "'"),
    ("trim_chars", '"'),
    ("regex", rf"""['"][{_WS}]*:""", "", False, False),
)
OP_EMOJI = ("regex", r"[\x{10000}-\x{10FFFF}]", "", False, False)
OP_CONTROL = ("regex", r"\p{C}", "", False, False)
# T12 then T13 delete single characters, so one class does both in one scan.
OP_EMOJI_CONTROL = ("regex", r"[\x{10000}-\x{10FFFF}\p{C}]", "", False, False)
OP_PUNCT = ("trim_chars", ASCII_PUNCTUATION)
OP_DIGITS = ("regex", rf"^[{_D}]+|[{_D}]+\z", "", False, False)

OPS_BEFORE_BOILERPLATE = (OP_HYPHENS, OP_TAGS, OP_URLS, OP_DATES, OP_HOURS)
PRE_OPS = (OP_HYPHENS, OP_TAGS, OP_URLS, OP_DATES, OP_HOURS) + OPS_BOILERPLATE + (OP_QUOTES,)
PASS_HEAD = OPS_TRIM_WS_HYPHEN + OPS_COLLAPSE_WS
PASS_TAIL = OPS_SHORT_SUFFIX + OPS_FIX_QUOTES + (OP_EMOJI_CONTROL, OP_PUNCT, OP_DIGITS)
PASS_OPS = PASS_HEAD + PASS_TAIL

#: One character that some step of a pass may take off an end.
_END = rf"[{_WS}{_H}{_D}'\"\-\x{{21}}-\x{{2f}}\x{{3a}}-\x{{40}}\x{{5b}}-\x{{60}}\x{{7b}}-\x{{7e}}]"


def _any_of(phrases) -> str:
    """A pattern that finds any of the phrases: a tree of their common beginnings."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = {}

    def body(node) -> str:
        if "" in node:
            return ""
        parts = [f"\\x{{{ord(ch):x}}}{body(rest)}" for ch, rest in node.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    # what may begin a phrase; common letters only with what follows them
    hexed = lambda x: "".join(f"\\x{{{ord(ch):x}}}" for ch in x)
    common = sorted({p[:4] for p in phrases if "a" <= p[0] <= "z"})
    rare = [ch for ch in tree if not "a" <= ch <= "z"]
    first = "|".join([f"[{hexed(rare)}]"] * bool(rare) + [hexed(x) for x in common])
    return f"(?={first}){body(tree)}"


def _has(s: Column, parts) -> Column:
    out = F.contains(s, F.lit(parts[0]))
    for x in parts[1:]:
        out = out | F.contains(s, F.lit(x))
    return out


#: Characters beside the letters themselves that patterns which ignore case take for i, i, s and k.
_LIKE_ASCII = "\u0130\u0131\u017f\u212a"


def may_hold(c, words) -> Column:
    """False only where a text holds none of the (ASCII) `words` in any case: a cheap test before a pattern."""
    low = F.transform(F.array(F.lower(_col(c))), lambda x: _has(x, [w.lower() for w in words]))[0]
    return low | _has(_col(c), _LIKE_ASCII)


_WWW = tuple(f"{x}{y}{z}." for x in "wW" for y in "wW" for z in "wW")
#: Plain tests without which a step changes nothing; a search for a few bytes costs far less than a pattern.
_NEEDED = {
    OP_HYPHENS: lambda s: (F.octet_length(s) != F.length(s)) & _has(s, [c for c in HYPHEN_LIKE if c != "-"]),
    OP_TAGS: lambda s: _has(s, "<"),
    OP_URLS: lambda s: _has(s, ("://", *_WWW)),
    OP_HOURS: lambda s: _has(s, ":"),
    OPS_COLLAPSE_WS[1]: lambda s: _has(s, ("  ",)),
    **{OPS_FIX_QUOTES[i]: lambda s: _has(s, "'\"") for i in (0, 1, 4)},
    OP_DIGITS: lambda s: F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1))).rlike(f"[{_D}]"),
}
#: Steps that look at the end of a text only.
_SUFFIX_OF = dict(zip(OPS_SHORT_SUFFIX, "-|"))
#: A match begins with a digit: told before the word bounds, which cost more.
_AT_DIGIT = (OP_DATES, OP_ISO_DATES, OP_HOURS)


def _short_suffix(s: Column, sep: str) -> tuple[Column, Column]:
    """(whether a short suffix is to be cut, the text without it): only what follows the last `sep` is matched."""
    tail = F.substring_index(s, sep, -1)
    tok = rf"[^{_WS}]++"
    cut = F.contains(s, F.lit(sep)) & tail.rlike(rf"\A(?:[{_WS}]++|[{_WS}]*+{tok}(?:[{_WS}]++{tok}){{0,2}}+[{_WS}]*+)\z")
    return cut, F.left(s, F.length(s) - F.length(tail) - 1)


def apply_op(c: Column, op) -> Column:
    kind = op[0]
    if kind == "translate":
        return F.translate(c, op[1], op[2] * len(op[1]))
    if kind == "regex":
        _, pat, repl, ic, uw = op
        pat = f"(?=[{_D}])(?:{pat})" if op in _AT_DIGIT else pat
        return F.regexp_replace(c, P.java(pat, ignore_case=ic, unicode_words=uw), repl)
    if kind == "literal":
        return F.replace(c, F.lit(op[1]), F.lit(""))
    if kind == "trim_chars":
        return F.btrim(c, F.lit(op[1]))
    if kind == "trim_space":
        return F.trim(c)
    raise ValueError(f"unknown op {kind}")


def apply_ops(c: Column, ops) -> Column:
    for op in ops:
        c = apply_op(c, op)
    return c


def _where_needed(c: Column, ops) -> Column:
    """``apply_ops``, but steps with a plain test leave texts that don't need them alone (a deeper expression)."""
    def step(op):
        if op in _SUFFIX_OF:
            return lambda s: F.when(_short_suffix(s, _SUFFIX_OF[op])[0], _short_suffix(s, _SUFFIX_OF[op])[1]).otherwise(s)
        return lambda s: F.when(_NEEDED[op](s), apply_op(s, op)).otherwise(s)

    for op in ops:
        c = F.transform(F.array(c), step(op))[0] if op in _NEEDED or op in _SUFFIX_OF else apply_op(c, op)
    return c


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- T1-T15: public step functions ----

def normalize_hyphens(c) -> Column:
    return apply_op(_col(c), OP_HYPHENS)


def strip_tags(c) -> Column:
    return apply_op(_col(c), OP_TAGS)


def strip_urls(c) -> Column:
    return apply_op(_col(c), OP_URLS)


def strip_dates(c, iso: bool = False) -> Column:
    out = apply_op(_col(c), OP_DATES)
    return apply_op(out, OP_ISO_DATES) if iso else out


def strip_hours(c) -> Column:
    return apply_op(_col(c), OP_HOURS)


def strip_boilerplate(c, phrases=None) -> Column:
    """Delete the phrases, one after the other.

    Most texts hold none of them: one scan tells, and only the others go
    through the chain (a deletion can't make a phrase where there was none).
    """
    phrases = BOILERPLATE_PHRASES if phrases is None else tuple(p for p in phrases if p)
    if not phrases:
        return _col(c)
    chain = tuple(("literal", p) for p in phrases)
    return F.transform(F.array(_col(c)), lambda s: F.when(s.rlike(_any_of(phrases)), apply_ops(s, chain)).otherwise(s))[0]


def normalize_quotes(c) -> Column:
    return apply_op(_col(c), OP_QUOTES)


def trim_ws_hyphen(c) -> Column:
    return apply_ops(_col(c), OPS_TRIM_WS_HYPHEN)


def collapse_ws(c) -> Column:
    return apply_ops(_col(c), OPS_COLLAPSE_WS)


def drop_short_suffix(c, sep: str = "-") -> Column:
    return apply_op(_col(c), _short_suffix_op(sep))


def fix_quotes(c) -> Column:
    return apply_ops(_col(c), OPS_FIX_QUOTES)


def strip_emoji(c) -> Column:
    return apply_op(_col(c), OP_EMOJI)


def strip_control(c) -> Column:
    return apply_op(_col(c), OP_CONTROL)


def trim_punct(c) -> Column:
    return apply_op(_col(c), OP_PUNCT)


def trim_digits(c) -> Column:
    return apply_op(_col(c), OP_DIGITS)


def clean_pass(c) -> Column:
    """One pass of the fixpoint loop (T8-T15 in order)."""
    return apply_ops(_col(c), PASS_OPS)


def _settled(head: Column, out: Column) -> Column:
    """Whether another pass over `out` is known to change nothing.

    `head` is the text after the pass's white-space steps. If `out` is a
    stretch of it, nothing inside was deleted, so its white space is collapsed
    still; ends that no step trims, no quotes that a step takes out and no short
    suffix leave nothing to do. (Otherwise the next pass finds out.)
    """
    ends = F.concat(F.left(out, F.lit(1)), F.right(out, F.lit(1)))
    quotes = _has(out, "'\"") & out.rlike(rf"""['"](?:['"]|[{_WS}]*:)""")
    return (~ends.rlike(_END) & ~quotes & F.contains(head, out)
            & ~_short_suffix(out, "-")[0] & ~_short_suffix(out, "|")[0] & (out != F.lit("")))


def clean_text(c, max_passes: int = MAX_PASSES) -> Column:
    """T1-T7 once, then T8-T15 until a fixpoint (at most `max_passes`).

    * null -> null
    * empty after T1-T7 -> '' (the loop never runs)
    * empty inside the loop -> null

    The loop is an ``aggregate`` over ``sequence(1, max_passes)`` whose state
    carries a ``done`` flag, so converged rows skip the remaining passes
    (``CASE`` evaluates only the taken branch). Most texts are settled after
    their first pass, which a cheap test shows (`_settled`). Lambda variables
    bind each intermediate string once, so the expression tree stays linear in
    the number of steps.
    """
    # no step brings in other white space than blanks: it becomes blanks once, before the passes, with the quotes
    head_ops = tuple(op for op in PASS_HEAD if op is not OPS_COLLAPSE_WS[0])

    def step(acc):
        def tail(head):
            return F.transform(F.array(_where_needed(head, PASS_TAIL)), lambda t: F.struct(
                t.alias("s"), ((t == acc["s"]) | _settled(head, t)).alias("done")))[0]

        return F.when(acc["done"], acc).otherwise(F.transform(F.array(_where_needed(acc["s"], head_ops)), tail)[0])

    def body(s):
        # the finish lambda turns '' into null on the bound variable; a
        # nullif() around the loop would evaluate the whole loop twice
        loop = F.aggregate(
            F.sequence(F.lit(1), F.lit(max_passes)),
            F.struct(s.alias("s"), F.lit(False).alias("done")),
            lambda acc, _i: step(acc),
            lambda acc: F.when(acc["s"] != F.lit(""), acc["s"]),
        )
        return F.when(s == F.lit(""), s).otherwise(loop)

    before = strip_boilerplate(_where_needed(_col(c), OPS_BEFORE_BOILERPLATE))
    blanks = OPS_COLLAPSE_WS[0]
    once = F.translate(before, OP_QUOTES[1] + blanks[1], "'" * len(OP_QUOTES[1]) + " " * len(blanks[1]))
    return F.transform(F.array(once), body)[0]


def clean_columns(df, cols, max_passes: int = MAX_PASSES):
    """Clean several content columns in place."""
    return df.withColumns({c: clean_text(F.col(c), max_passes) for c in cols})


def tokens(c) -> Column:
    """Python ``str.split()`` tokens (white-space runs, no empty tokens)."""
    return F.filter(F.split(_col(c), f"[{_WS}]+"), lambda x: x != F.lit(""))


def at_least_tokens(c, n: int) -> Column:
    """Whether a text has `n` tokens (T18) or more, without splitting what follows them."""
    return _col(c).rlike(rf"\A[{_WS}]*+(?:[^{_WS}]++[{_WS}]++){{{n - 1}}}[^{_WS}]")


def token_count(c) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0)).cast("bigint")


def content_type(name: str):
    """T19 on a column *name* (driver side): title / abstract / fulltext / None."""
    low = name.lower()
    for kind in ("title", "abstract", "fulltext"):
        if kind in low:
            return kind
    return None


def content_type_col(c) -> Column:
    """T19 as a column function over a column holding source names."""
    low = F.lower(_col(c))
    return (F.when(low.contains("title"), F.lit("title"))
            .when(low.contains("abstract"), F.lit("abstract"))
            .when(low.contains("fulltext"), F.lit("fulltext")))


def hashed_token_ids(c, vocab_size: int = 1 << 18) -> Column:
    """Word tokens mapped to stable ids in [1, vocab_size) (0 is padding): md5 prefix mod size."""
    def tid(t):
        h = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
        return (F.pmod(h, F.lit(vocab_size - 1)) + 1).cast("int")
    return F.transform(tokens(c), tid)


def encode_fixed(c, max_len: int = 100, vocab_size: int = 1 << 18) -> Column:
    """T20 (re-aimed): ids + attention mask truncated/padded to `max_len`.

    Sub-word vocabularies of pretrained models are not built; word tokens are
    hashed to ids instead. Returns struct<input_ids, attention_mask>.
    """
    def enc(ids):
        kept = F.slice(ids, 1, max_len)
        pad = F.greatest(F.lit(max_len) - F.size(kept), F.lit(0))
        return F.struct(
            F.concat(kept, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        )
    return F.transform(F.array(F.coalesce(hashed_token_ids(c, vocab_size), F.array().cast("array<int>"))), enc)[0]
