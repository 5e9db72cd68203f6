"""Fill-in-middle: a text's prefix, middle and suffix, cut at units and put in another order.

``regexp_count`` gives a text's number of units n; two hashes of the id choose the cuts
a <= b; then one match of a pattern made for the row, with possessive groups ``unit{a}`` and
``unit{b-a}``, captures prefix, middle and suffix, and the replacement writes them in the
form's order. A possessive counted group is matched in a loop without backtracking, so a
text of any number of units takes linear time and no stack. Everything is a projection of
built-in functions: no shuffle, no Python.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``,
``plain`` is the text as it is. A text that holds a marker stays plain, so the output can
always be taken apart again (``restored``).

Defined cases: a null text is empty, and an empty text is plain; a null doc_id hashes as an
empty id; repeated rows give equal results; other columns are kept by ``fill_in_middle`` and
may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
SEED = 7
RATE = 100
SPM_RATE = 50
# ---- FIXED VALUES: the markers of the output ----
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _hash(seed: int, key: str, i: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def _times(unit: str, count: Column) -> Column:
    return F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))


def transform(text: Column, key: str, unit: str = LINE, seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> Column:
    """A struct of n, form and output for a text that isn't null."""
    n = F.regexp_count(text, F.lit(unit))

    def cut(n: Column) -> Column:
        x, y = _hash(seed, key, 0) % (n + 1), _hash(seed, key, 1) % (n + 1)
        a, b = F.least(x, y), F.greatest(x, y)
        pattern = F.concat(F.lit(r"(?s)\A"), _times(unit, a), _times(unit, b - a), F.lit(r"(.*)\z"))
        marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
        form = (F.when((text == "") | marked | (_hash(seed, key, 2) % 100 >= rate), "plain")
                .when(_hash(seed, key, 3) % 100 < spm_rate, "spm").otherwise("psm"))
        order = F.when(form == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
        output = F.when(form == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
        return F.struct(n.cast("bigint").alias("n"), form.alias("form"), output.alias("output"))

    # n is bound once
    return F.get(F.transform(F.array(n), cut), F.lit(0))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone."""
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*){MIDDLE}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, column: str = "fim", key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """`docs` with a struct `column` of n, form and output; it replaces a column of that name."""
    return docs.withColumn(column, transform(F.coalesce(F.col(text), F.lit("")), key, **kw))


def digests(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of `docs`."""
    done = fill_in_middle(docs.select(F.col("doc_id").cast("bigint"), "text"), **kw)
    output, form = F.col("fim.output"), F.col("fim.form")
    first, second = F.instr(output, SUFFIX), F.instr(output, PREFIX)
    prefix = F.when(form == "psm", first - 1 - len(PREFIX)).when(
        form == "spm", F.instr(output, MIDDLE) - second - len(PREFIX))
    middle = F.when(form != "plain", F.length(output) - F.instr(output, MIDDLE) - len(MIDDLE) + 1)
    return done.select("doc_id", "fim.n", "fim.form", prefix.cast("bigint").alias("prefix_chars"),
                       middle.cast("bigint").alias("middle_chars"), F.sha2(output, 256).alias("output_sha256"),
                       F.sha2(restored(output, form), 256).alias("restored_sha256"))
