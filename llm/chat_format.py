"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as ``[INST] role [/INST] text </s>`` and a line end.
The parser is deterministic: it splits the text at the three control strings, so three
parts make a turn, and takes one backslash out of every escaped control string. The rendered
text is parsed again and compared with the source; where a conversation's contents conflict
with the grammar (they hold control strings, or look escaped), they are escaped -- one
backslash after the first character of each such string -- and the round trip is made
again, until the recovered turns are identical. An escape adds one backslash and the
parser takes one away, so the second round always succeeds; `rounds` tells which one did.

Only built-in functions run. A conversation becomes one string, as its digests need all of
its turns in order; a conversation must therefore fit in one row (2 GB).

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own;
null turns come first; rows with equal turns are ordered by role, then text, and all
count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
_CONTROL = r"\[INST\]|\[/INST\]|</s>"
#: A control string with any number of backslashes after its first character.
_ESCAPABLE = r"([<\[])(\\*)(?=INST\]|/INST\]|/s>)"
_ESCAPED = r"([<\[])\\(\\*)(?=INST\]|/INST\]|/s>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPABLE, r"$1$2\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2")


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of structs (turn, role, text)."""
    content = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(f"{OPEN} "), content(t["role"]), F.lit(f" {CLOSE} "), content(t["text"]), F.lit(f" {END}\n"))), "")


def parse(text: Column) -> Column:
    """Array of structs (role, text) read back from a rendered text; null where it isn't of the grammar."""
    def inner(c):  # without the blanks around it
        return unescape(F.substring(c, F.lit(2), F.length(c) - 2))

    def turns(parts):
        count = F.floor(F.size(parts) / 3).cast("int")
        found = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
            inner(F.get(parts, 3 * i + 1)).alias("role"), inner(F.get(parts, 3 * i + 2)).alias("text"))))
        return F.when(F.size(parts) % 3 == 1, F.coalesce(found, F.array().cast("array<struct<role:string,text:string>>")))

    # the parts are a variable of an outer function, so they are split once and not once per turn
    return F.transform(F.array(F.split(text, _CONTROL)), turns)[0]


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, rounds, turns, learned): `turns` are read back from `formatted`;
    `learned` marks those under the loss mask. Raises where the round trip isn't identical."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))
    want = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = whole.withColumn("want", want).withColumn("plain", render(F.col("source"), False))
    first = first.withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("want"), F.lit(False)))
    second = first.select(
        "conv_id", "want", F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("source"), True)).alias("formatted"),
        F.when(F.col("same"), 1).otherwise(2).alias("rounds"))
    back = second.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.coalesce(F.col("turns") == F.col("want"), F.lit(False)), F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return back.select("conv_id", "formatted", "rounds", checked.alias("turns")).withColumn(
        "learned", F.transform("turns", lambda t: t["role"] == LEARNED))


def digests(formatted: DataFrame) -> DataFrame:
    """What the query returns of the formatted conversations."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter(F.arrays_zip("turns", "learned"), lambda x: x["learned"]),
                                    lambda x: x["turns"]["text"]), "")
    return formatted.select("conv_id", "formatted", "rounds", F.size("turns").cast("bigint").alias("n_turns"),
                            F.array_join(said, "").alias("said"), loss.alias("loss")).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("rounds").cast("bigint").alias("rounds"))
