"""Markup extraction and keyword sentences.

X1 is the one place where Python runs per document: markup needs a real HTML
tokenizer for nested element text. It is an Arrow-batched ``pandas_udf``
(the stdlib ``html.parser``) returning all fields in one struct, so each
document is parsed once.
Keyword search and sentence selection are native expressions.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from . import patterns as P
from .rulebook import KEYWORDS
from .text import may_hold

# The UDF below is shipped with this module's code (pickled by value), so
# Python workers need neither this package installed nor the driver's path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ("title", "abstract", "fulltext")
# Element that holds each field in the original markup (title, abstract, text);
# web pages use <article> for the body text.
DEFAULT_TAGS = {"title": "title", "abstract": "abstract", "fulltext": "text"}
PAGE_TAGS = {"title": "title", "abstract": "abstract", "fulltext": "article"}


class _FirstElements(HTMLParser):
    """Collects the text of the first element with each wanted tag name."""

    _RAW = {"script", "style", "template"}

    def __init__(self, tags):
        super().__init__(convert_charrefs=True)
        self.want = set(tags)
        self.depth = {}
        self.buf = {}
        self.done = {}
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        if tag in self._RAW:
            self.raw += 1
        if tag in self.depth:
            self.depth[tag] += 1
        elif tag in self.want and tag not in self.done:
            self.depth[tag] = 1
            self.buf[tag] = []

    def handle_endtag(self, tag):
        if tag in self._RAW and self.raw:
            self.raw -= 1
        if tag in self.depth:
            self.depth[tag] -= 1
            if self.depth[tag] == 0:
                del self.depth[tag]
                self.done[tag] = "".join(self.buf.pop(tag))

    def handle_data(self, data):
        if not self.raw:
            for tag in self.depth:
                self.buf[tag].append(data)

    def result(self):
        for tag in list(self.depth):
            self.done[tag] = "".join(self.buf.pop(tag))
        return self.done


def _clean_field(s):
    if s is None:
        return None
    s = s.strip()
    return None if s in ("", "None") else s


def parse_markup(markup, tags=DEFAULT_TAGS):
    """(title, abstract, fulltext) of one document; failures give nulls."""
    if not isinstance(markup, str):
        return (None, None, None)
    p = _FirstElements(tags.values())
    try:
        p.feed(markup)
        p.close()
    except Exception:  # noqa: BLE001 - a broken page yields what was parsed
        pass
    found = p.result()
    return tuple(_clean_field(found.get(tags[f])) for f in FIELDS)


def _make_udf(tags):
    @pandas_udf("title string, abstract string, fulltext string")
    def _extract(markup: pd.Series) -> pd.DataFrame:
        rows = [parse_markup(m, tags) for m in markup]
        return pd.DataFrame(rows, columns=list(FIELDS))
    return _extract


def extract_fields(markup, tags=None) -> Column:
    """struct<title, abstract, fulltext> from markup."""
    c = F.col(markup) if isinstance(markup, str) else markup
    return _make_udf(dict(tags or DEFAULT_TAGS))(c)


def extract_title(markup, tag: str = "title") -> Column:
    """X1, the title alone: the same parser, so all entities are decoded alike."""
    return extract_fields(markup, dict(DEFAULT_TAGS, title=tag))["title"]


def add_parsed_columns(df: DataFrame, markup_col: str = "trafilatura_extracted_xml_tei", columns=None,
                       tags=None) -> DataFrame:
    """Parse once, then fill each output column from the field its name names."""
    columns = columns or ["parsed_trafilatura_title", "parsed_trafilatura_abstract", "parsed_trafilatura_fulltext"]
    parsed = df.withColumn("_parsed", extract_fields(markup_col, tags))
    out = {}
    for col in columns:
        for f in FIELDS:
            if f in col:
                out[col] = F.col("_parsed")[f]
    return parsed.withColumns(out).drop("_parsed")


def keyword_pattern(keywords=KEYWORDS) -> str:
    """Case-insensitive substring alternation (keywords are plain words)."""
    return "|".join(keywords)


def contains_keywords(c) -> Column:
    """Any keyword as a case-insensitive substring (no word bounds)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(may_hold(c, KEYWORDS) & c.rlike(P.java(keyword_pattern(), ignore_case=True)), F.lit(False))


SENTENCE = r"([^.!?]+[.!?]*)"

# ---- learned abbreviations ----

#: Abbreviations that are sent out, at most; longest word that may be one; least score and least count with a full stop.
MAX_ABBREVIATIONS, MAX_LENGTH, LEAST_SCORE, LEAST_COUNT = 1000, 12, 0.3, 2
#: What a sentence may begin with.
OPENING = r"[\p{Lu}\p{Nd}\p{Pi}\p{Ps}\"'¿¡]"


def abbreviation_scores(df: DataFrame, text: str) -> DataFrame:
    """(word, n, k, score): words before a full stop, how often they occur, how often before one, and how
    likely they are abbreviations.

    The score is the log-likelihood ratio of Kiss and Strunk (2006) between "always before a full
    stop" and "before one as often as any word", less for long words and for words that also
    stand without one, more for inner full stops. Nothing is labelled; the words of all texts
    are counted in Spark, with partial sums before the shuffle: first as they stand, so that marks
    are taken off distinct words only. The counts are stored (no filter on words can then be
    moved into the scan of the texts), as the totals read them too.
    """
    blanks = [ch for ch in P.WS_CHARS if ch != " "]
    words = F.split(F.translate(F.lower(F.col(text)), "".join(blanks), " " * len(blanks)), " ")
    raw = df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    bare = raw.select(F.regexp_replace("w", r"^[^\p{L}\p{Nd}]+|[,;:!?)\]\p{Pf}\"']+$", "").alias("w"), "n")
    stop = F.col("w").rlike(r"[^.]\.$")
    counted = bare.select(F.when(stop, F.substr("w", F.lit(1), F.length("w") - 1)).otherwise(F.col("w")).alias("word"), "n",
                          F.when(stop, F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("k"))
    each = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "word-counts")
    each = each.where(F.col("word") != "")
    total = each.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    n, k, letters = F.col("n"), F.col("k"), F.length(F.replace("word", F.lit("."), F.lit("")))
    p = F.greatest(F.least(F.col("_k") / F.col("_n"), F.lit(0.98)), F.lit(1e-9))
    ratio = 2 * (k * (F.log(F.lit(0.99)) - F.log(p)) + (n - k) * (F.log(F.lit(0.01)) - F.log(1 - p)))
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -(n - k).cast("double"))
    joined = each.withColumn("_o", F.lit(1)).join(F.broadcast(total.withColumn("_o", F.lit(1))), "_o")  # one row
    some = (k >= LEAST_COUNT) & (letters >= 1) & (F.length("word") <= MAX_LENGTH) & F.col("word").rlike(r"^[\p{L}.]+$")
    return joined.where(some).select("word", "n", "k", score.alias("score"))


def learn_abbreviations(df: DataFrame, text: str, count: int = MAX_ABBREVIATIONS) -> list[str]:
    """The `count` likeliest abbreviations of a corpus, without their last full stop."""
    found = abbreviation_scores(df, text).where(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "word").limit(count)
    return sorted(r["word"] for r in found.collect())  # `count` words


def _tree(words) -> str:
    """An alternation of `words` by their common beginnings."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def body(node) -> str:
        parts = [re.escape(ch) + body(rest) for ch, rest in sorted(node.items(), reverse=True) if ch]
        parts += [""] * ("" in node)
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return body(tree) if tree else ""


def sentence_break(abbreviations) -> str:
    """The white space between two sentences: after `.`, `!`, `?` (and closing quotes or brackets), before what a
    sentence may begin with; not after an abbreviation or an initial."""
    known = _tree(abbreviations)
    after = rf"(?<![^\p{{L}}\p{{Nd}}.](?iu:{known})\.)(?<!^(?iu:{known})\.)" if known else ""
    # the cheapest tests first: white space before a beginning, then what is before it
    begin = rf"(?=[{P.WS}])(?<=[.!?…][\"'\p{{Pf}}\p{{Pe}}]{{0,2}})(?=[{P.WS}]++{OPENING})"
    return rf"{begin}(?<![^\p{{L}}\p{{Nd}}]\p{{Lu}}\.)(?<!^\p{{Lu}}\.){after}[{P.WS}]++"


def sentences(c, abbreviations=None) -> Column:
    """Paragraphs (non-empty lines, stripped) split into sentences.

    With `abbreviations` (``learn_abbreviations``) a sentence ends at white space between an
    end mark and a beginning, but not after an abbreviation; without, at every run of
    `.`, `!` or `?`.
    """
    c = F.col(c) if isinstance(c, str) else c
    paras = F.filter(F.split(c, "\n"), lambda p: p != F.lit(""))
    strip = lambda x: F.btrim(x, F.lit(P.WS_CHARS))
    if abbreviations is None:
        cut = lambda p: F.regexp_extract_all(strip(p), F.lit(SENTENCE), 1)
    else:
        cut = lambda p: F.split(strip(p), sentence_break(abbreviations))
    return F.flatten(F.transform(paras, lambda p: F.transform(cut(p), strip)))


def relevant_sentences(c, abbreviations=None) -> Column:
    """Sentences holding a keyword, joined with '.'; none -> null.

    Sentences of the learned splitter keep their end marks and are joined with a blank.
    """
    c = F.col(c) if isinstance(c, str) else c
    kept = F.filter(sentences(c, abbreviations), lambda s: s.rlike(P.java(keyword_pattern(), ignore_case=True)))
    # bind the filtered list once (it is used twice below)
    glue = "." if abbreviations is None else " "
    joined = F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.array_join(k, glue)))[0]
    return F.when(contains_keywords(c), joined)  # a text without a keyword has no such sentence


def add_sentence_columns(df: DataFrame, cols=None, keep_content: bool = True, abbreviations=None) -> DataFrame:
    """Keyword-sentence columns; fall back to the whole text or null."""
    cols = cols or ["parsed_trafilatura_abstract", "parsed_trafilatura_fulltext"]
    suffix = "keep_original_content" if keep_content else "only_relevant_sentences"
    out = {}
    for col in cols:
        rel = relevant_sentences(F.col(col), abbreviations)
        out[f"sentence_with_keywords_{col}_{suffix}"] = F.coalesce(rel, F.col(col)) if keep_content else rel
    return df.withColumns(out)
