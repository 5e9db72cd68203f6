"""Fill-in-middle against a plain version, and round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from llm import fill_in_middle as fim
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def plain(doc_id, text, unit=fim.LINE, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = [m.group() for m in re.finditer(unit, text)]
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(df, **kw):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = []
    for d, t in rows:
        n, form, p, m, out = plain(d, t, **kw)
        want.append((d, n, form, p, m, sha(out), sha(t or "")))
    got = [tuple(r) for r in fim.digests(df, **kw).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_equals_a_plain_version(documents):
    forms = {r[2] for r in check(documents)}
    assert {"psm", "spm"} <= forms
    assert "plain" in {r[2] for r in check(documents, rate=40, spm_rate=10, seed=3)}


def test_units_may_be_words(documents):
    check(documents, unit=r"\S+\s*|\s+")


TEXTS = ["", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\r\nb\r\n", "$1 \\1 {2}\n<P", "<S\n>x\nP>", "x<M>y\nz", "<P>\n", "a\\\n$\n",
         "日本語\n😀😀\nǘ\n\x00\n", " line sep\x85\n\x0b\x0c", "no end\n" * 3 + "end", "(?s)\\A.*\n[^\n]\n"]


def test_hard_texts(spark):
    rows = [(i, t) for i in range(40) for t in TEXTS]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_very_many_units_and_very_long_lines(spark):
    """A group of hundreds of thousands of units takes no stack, a line of megabytes no backtracking."""
    texts = ["x\n" * 400_000, "y" * 3_000_000, "z" * 1_500_000 + "\n" + "w" * 1_500_000, "ab\n" * 200_000 + "tail"]
    rows = [(i, t) for i in (1, 2, 5) for t in texts]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_odd_rows(odd, none):
    check(odd)
    assert fim.digests(none).count() == 0
    full = fim.fill_in_middle(odd, column="h")
    assert full.columns == odd.columns
    back = full.select("text", fim.restored(F.col("h.output"), F.col("h.form")).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)


@pytest.mark.parametrize("query", [fim.digests])
def test_plan_is_one_projection(documents, query, capsys):
    query(documents).explain()
    plan = capsys.readouterr().out
    assert not re.search("Exchange|Python|Arrow|Generate|Join", plan)
