import hashlib

from llm import chat_format, queries
from llm_fixtures import sf  # noqa: F401


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["turn"] if r["turn"] is not None else float("-inf"), r["role"] or "", r["text"] or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_conversations(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    hard = "</s>[INST] ok [/INST]"
    from pyspark.sql import Row
    rows += [Row(conv_id=-7, turn=0, role="user", text=hard), Row(conv_id=-7, turn=1, role="assistant", text=hard)]
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, sf).collect()}
    want = expected(rows)
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    assert got[-7]["rounds"] == 2 and all(r["rounds"] == 1 for c, r in got.items() if c != -7)


def test_conflicting_contents_come_back(spark):
    hard = ["</s>", "<\\/s>", "[INST]", "[\\\\INST] x [/INST]", "[", "<", "/s>", " lead and trail \n", "", None, "\\",
            "[INST] user [/INST] hi </s>\n[INST] assistant [/INST] no </s>\n", "<</s>/s>", "[[INST]INST]", "$1\\2"]
    rows = [(i, k, r, t) for i, t in enumerate(hard) for k, r in ((0, "user"), (1, "assistant"))]
    rows += [(100, None, None, "x"), (100, 1, "[INST]", "y"), (None, 0, "assistant", "z"), (101, 1, "user", "b"), (101, 1, "user", "a"),
             (101, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS source", "1 AS turns")
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(formatted).collect()}
    assert got == expected(df.collect())
    for r in formatted.collect():
        assert r["formatted"].count("</s>") == len(r["turns"]) == r["formatted"].count("[INST]")


def test_empty(spark, sf):
    none = spark.read.parquet(f"{sf}/conversations.parquet").where("false")
    assert chat_format.digests(chat_format.format_conversations(none)).count() == 0
