"""Scrape-failure predicates (F1-F8) and the subject flag (A1): FIXTURES.md edge rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.operators.label import has_subject


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", fn(F.col("t")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_too_short(spark):
    values = ["x" * 21, "one two three four", "one two three four five", None, "短い"]
    assert _eval(spark, values, R.is_too_short) == [False, True, False, True, True]


def test_known_dubious_is_a_character_set(spark):
    assert _eval(spark, ["X", "X-MOL", "-", "MOL"], R.is_known_dubious) == [True, False, True, False]


def test_site_names_compat_prefixes(spark):
    values = ["Products are good for you", "La Rioja hoy", "Vidéos de la semaine", "A normal sentence here"]
    assert _eval(spark, values, R.is_site_name) == [True, True, True, False]


def test_boilerplate_quirks_and_dialect(spark):
    values = [
        "Bonjour tout le monde ici",      # ^b rule (compat quirk)
        "Some text here long enough",     # ^S rule (compat quirk)
        "a cookie\nsecond line",          # '.' stops at the newline: no match
        "x Cookie y z w",                 # single line: match
        "HOME\n",                         # '$' before a final newline
        "٣٤٥",                           # Arabic-Indic digits are \d
        "Facebook Twitter Instagram",  # NBSP is \s
        "Plain content about olive trees",
    ]
    assert _eval(spark, values, lambda c: R.is_boilerplate(c, "title")) == \
        [True, True, False, True, True, True, True, False]


def test_error_message_checks_unstripped_text(spark):
    values = ["Error", "  Error", "", None, "None", "404", "Timeout error"]
    assert _eval(spark, values, R.is_error_message) == [True, False, True, True, True, True, True]


def test_to_be_kept_site_name_follows_keep_titles(spark):
    v = ["Products are good for you"]
    assert _eval(spark, v, lambda c: R.to_be_kept(c, "title", keep_titles=True)) == [True]
    assert _eval(spark, v, lambda c: R.to_be_kept(c, "title", keep_titles=False)) == [False]


def test_to_be_kept_strips_first(spark):
    values = ["   Plain content about olive trees   ", "  X  ", "", None, "None", "Home"]
    assert _eval(spark, values, lambda c: R.to_be_kept(c, "fulltext")) == [True, False, False, False, False, False]


def test_to_be_kept_rejects_unknown_type():
    with pytest.raises(ValueError):
        R.to_be_kept(F.col("t"), "body")
    with pytest.raises(ValueError):
        R.to_be_kept(F.col("t"), None)


def test_quality_gate_reasons(spark):
    values = ["Error", "Home sweet", "Plain content about olive trees", None]
    rows = _eval(spark, values, lambda c: R.quality_gate(c, "title"))
    assert [(r.kept, r.reason) for r in rows] == [
        (False, "Error message"), (False, "Parsing problem"), (True, None), (False, "Error message")]


def test_has_subject(spark):
    assert _eval(spark, [None, "None", "x", "3"], has_subject) == [0, 0, 1, 1]


def test_strict_rules_repair_the_quirks(spark):
    values = ["Bonjour tout le monde ici", "Some text here long enough", "Browse", "shop",
              "Copyright All Rights Reserved 2020"]
    got = _eval(spark, values, lambda c: R.is_boilerplate(c, "title", "strict"))
    assert got == [False, False, True, True, True]
    compat = _eval(spark, values, lambda c: R.is_boilerplate(c, "title", "compat"))
    assert compat == [True, True, True, True, False]  # the glued pair can never match


def test_strict_site_names_are_literal(spark):
    values = ["Products are good for you", "Products | Syngenta", "La Rioja hoy"]
    assert _eval(spark, values, lambda c: R.is_site_name(c, "strict")) == [False, True, False]


def _gate_texts(spark):
    ws = ["", " ", " ", " \t", "\n"]
    texts = [f"{a}{b.join(['w'] * n)}{c}" for a in ws for b in ws for c in ws for n in range(7)]
    texts += [None, "None", "x" * 20, "x" * 21, "x" * 21 + " y", " 404 not found here it is", "404 Not Found",
              " Loading...", "a b c d cookie e", "a b\nc d cookie e f", " a b c\nd e your browser", "a b c d e f pdf",
              "  Just a moment... a b c d", "HTTPSConnectionPool a b c d e f", " Menu Home Expert search Contact About AGUIA"]
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_short_texts_are_told_without_making_their_words(spark):
    df = _gate_texts(spark)
    n = T.token_count("text")
    old = F.when(F.col("text").isNull(), F.lit(True)).otherwise(F.when((n < 2) & (F.length("text") > 20), F.lit(False)).otherwise(n <= 4))
    got = df.select("i", R.is_too_short("text").alias("new"), old.alias("old"))
    assert got.where("not (new <=> old)").count() == 0
    assert "split(" not in df.select(R.quality_gate("text", "title"))._jdf.queryExecution().toString()


def test_gate_looks_for_errors_once(spark):
    df = _gate_texts(spark)
    for rules in ("compat", "intended", "strict"):
        for kind in R.CONTENT_TYPES:
            ok = R.to_be_kept("text", kind, False, rules)
            old = F.when(R.is_error_message("text", rules), "Error message").when(~ok, "Parsing problem")
            got = df.select(R.quality_gate("text", kind, rules)["reason"].alias("new"), old.alias("old"))
            assert got.where("not (new <=> old)").count() == 0


def test_rules_about_a_word_anywhere_read_texts_that_hold_it(spark):
    texts = ["a cookie here", "a COOKIE here", "a b\ncookie", "a Javaſcript b", "your browser", "YOUR BROWSER", "x pdf", "x PDF\n",
             "x pdf y", "İ b c", "plain", "", None, "cook ie", "browser your", "a cookıe", "404 Not Found"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    c = F.col("t")
    for rules in ("compat", "intended", "strict"):
        for kind in R.CONTENT_TYPES:
            old = F.coalesce(R._rlike(c, R.boilerplate_regex(kind, rules)), F.lit(False))
            err = F.when(~R.has_content(c), F.lit(True)).otherwise(R._rlike(c, R.error_regex(rules)))
            got = df.select("i", (R.is_boilerplate(c, kind, rules) == old).alias("a"), R.is_error_message(c, rules).eqNullSafe(err).alias("b"))
            assert [r.i for r in got.where("not a or not b").collect()] == []
    plan = df.select(R.is_error_message(c))._jdf.queryExecution().toString().lower()
    assert "contains(" in plan  # the words are told by a plain search first
