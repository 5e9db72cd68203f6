"""Regex rendering for the JVM (Spark) and for RE2 (the DuckDB oracle).

The rule tables and cleaning patterns are written once in Python ``re``
syntax. Python, Java and RE2 disagree on a few classes, so every pattern is
first rewritten into a subset that all three read alike:

* ``\\s`` / ``\\S``  -> the explicit white-space class of ``str.isspace``
* ``\\d``           -> ``\\p{Nd}`` (Unicode decimal digits, as in Python)
* ``.``            -> ``[^\\n]`` (Python's dot)
* ``$``            -> ``\\n?\\z`` (Python's end: end of text or before a final
  newline). Matching is only used as a yes/no test, so consuming the newline
  is harmless.

The two dialects then only differ in flags: Java needs ``u`` for Unicode case
folding and ``U`` for Unicode word boundaries; RE2 folds Unicode case by
default and its ``\\b`` is ASCII-only (documented oracle approximation).
"""

from __future__ import annotations

# Code points for which Python's str.isspace() is true.
WS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
# The same white space as a plain character set (for btrim / trim).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# White space other than the plain space, as a class body.
WS_NOT_SPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def portable(py_pattern: str) -> str:
    """Rewrite a Python ``re`` pattern into the Java/RE2 common subset."""
    out = []
    i, n = 0, len(py_pattern)
    in_class = False
    while i < n:
        ch = py_pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = py_pattern[i + 1]
            if nxt == "s":
                out.append(WS if in_class else f"[{WS}]")
            elif nxt == "S":
                out.append(f"[^{WS}]")
            elif nxt == "d":
                out.append(DIGIT if in_class else f"[{DIGIT}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            # a leading "]" or "^]" is literal inside a class
            if py_pattern[i + 1: i + 2] == "^":
                out.append("^")
                i += 1
            if py_pattern[i + 1: i + 2] == "]":
                out.append("]")
                i += 1
        elif ch == ".":
            out.append(r"[^\n]")
        elif ch == "$":
            out.append(r"\n?\z")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def rule_alternation(rules) -> str:
    """One anchored alternation: Python's ``re.match('|'.join(rules))``."""
    return "^(?:" + portable("|".join(rules)) + ")"


def java(pattern: str, *, ignore_case: bool = False, unicode_words: bool = False) -> str:
    flags = ""
    if ignore_case:
        flags += "iu"
    if unicode_words:
        flags += "U"
    return f"(?{flags}){pattern}" if flags else pattern


def re2(pattern: str, *, ignore_case: bool = False, unicode_words: bool = False) -> str:
    return f"(?i){pattern}" if ignore_case else pattern
