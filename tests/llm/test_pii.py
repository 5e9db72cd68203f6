import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import pii
from llm_fixtures import none, odd  # noqa: F401

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_luhn(digits):
    double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in double) % 10 == 0


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), order, m.end()))
    return [(o, s, e) for s, o, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.text("ab1.2@-_+4 ()%é5", max_size=40))
def test_base_spans_follow_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_runs_of_one_character_take_linear_time():
    for c in "a1.+@- ":
        pii.base_spans(c * 300_000)
        pii.wider_spans(c * 300_000, [])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [k for k, _ in PATTERNS]
    some = 0
    for r in pii.personal_data(docs).collect():
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in names] == [sum(o == i for o, _, _ in base) for i in range(4)]
        said = [f"{names[o]}:{s}:{e}" for o, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",") if r["spans"] else [])
        some += len(said)
    assert some > 10


def test_a_phone_run_together_with_an_address_is_added():
    text = "call me on +1 (826) 555-4081 190.137.223.204 today"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == [pii.IP]
    assert (pii.PHONE, 11, 28) in pii.wider_spans(text, base)
    text = "write to jo.doe at mail dot example dot com now"
    assert [text[s:e] for _, s, e in pii.wider_spans(text, [])] == [
        "jo.doe at mail dot example dot com"]


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    right = np.array([0.95, 0.9, 0.85, 0.55])
    vote = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, count = np.unique(vote, axis=0, return_counts=True)
    belief, prior, rates = pii.estimate(patterns, count, np.zeros(len(patterns), bool))
    assert abs(prior - 0.5) < 0.05
    assert np.abs(rates[1, :, 2] - right).max() < 0.06
    assert belief[(patterns == 1).all(axis=1)][0] > 0.95 and belief[(patterns == -1).all(axis=1)][0] < 0.05


def test_odd_rows(odd, none):
    rows = pii.personal_data(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 14 and all(r["spans"] == "" and r["base_sha256"] == empty for r in rows)
    assert pii.personal_data(none).count() == 0
