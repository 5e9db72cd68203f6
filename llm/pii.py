"""Personal data by weak supervision.

Candidate spans come from wide patterns: the base kinds below, and forms that these leave
out (phone numbers without a plus or run together with other digits, e-mail addresses
spelled with "at" and "dot", IPv6 addresses, spaced or dotted card numbers). Labelers vote
+1, 0 (no opinion) or -1 on each: shape patterns, gazetteers (domain endings, country
codes, card issuers, reserved networks) and context words around the span.
Expectation-maximisation over the counts of vote patterns -- all candidates of the corpus,
a bounded number of patterns -- estimates each labeler's reliabilities by kind. Its
posteriors train the final span classifier, a logistic model over votes and shape, from at
most SAMPLE candidates. Base spans always stay; others are added where the classifier
gives MIN_SCORE or more and they touch no base span.

Base spans, leftmost and not overlapping within a kind:
email, ip (four numbers up to 255), card (14 to 19 digits that pass Luhn), phone (a plus
and 10 to 15 digits); matches that fail are dropped, without retries. All patterns take
time in proportion to the text, also on runs of one character.

Positions are code points, ends exclusive. Defined cases: a null text is empty and has no
spans; spans of several kinds may overlap; repeated rows have the same spans; without
candidates there is no model; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

from . import words
from .common import id_and_text

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE = 20_000
MIN_SCORE = 0.8
#: Characters on either side in which context words count.
WINDOW = 48

# The base patterns, with possessive runs that start where a run starts.
_LOCAL = "A-Za-z0-9._%+-"
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++{_DOMAIN}")
_EMAIL_GOES_ON = re.compile(rf"[{_LOCAL}]++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider forms.
_SPELLED = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s")
_SPELLED_LEFT = re.compile(rf"[{_LOCAL}]{{1,64}}+")
_SPELLED_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]{2,63})+")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_PLUS_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_BARE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_DOTTED_CARD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9A-Za-z.])")

# Gazetteers and context words.
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
                 "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82",
                 "84", "86", "90", "91", "92", "94", "351", "352", "353", "358", "420")
FOR = {EMAIL: "email e-mail mail contact write correo courriel".split(),
       IP: "ip address host server client login network adresse".split(),
       CARD: "card visa mastercard amex credit debit payment karte carte tarjeta".split(),
       PHONE: "phone tel call fax mobile cell whatsapp telefon teléfono téléphone".split()}
AGAINST = "version isbn issn order invoice serial token sha hash id no number page section".split()
LABELERS = ("strict shape", "gazetteer", "context for", "context against", "borders", "variety")
SHAPES = 12

_REASON = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, w)) + r")\b", re.I) for k, w in FOR.items()}
_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST) + r")\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    at = 0
    while m := (_EMAIL_GOES_ON.match(text, at) if at else None) or _EMAIL.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind."""
    out = [(EMAIL, *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def wider_spans(text: str, base) -> list[tuple[int, int, int]]:
    """Candidates beyond the base ones, touching none of these and not each other."""
    out = []
    if "at" in text and "dot" in text:
        for m in _SPELLED.finditer(text):
            left = text[max(m.start() - 64, 0): m.start()]
            start = m.start() - (len(left) - max((i + 1 for i, c in enumerate(left) if not _SPELLED_LEFT.match(c)), default=0))
            if start < m.start() and (r := _SPELLED_RIGHT.match(text, m.end())):
                out.append((EMAIL, start, r.end()))
    if ":" in text:
        out += [(IP, *m.span()) for m in _IPV6.finditer(text)]
    out += [(CARD, *m.span()) for m in _DOTTED_CARD.finditer(text)]
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PLUS_PHONE.finditer(text)]
    out += [(PHONE, *m.span()) for m in _BARE_PHONE.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    free, end = [], -1
    for k, s, e in sorted(out, key=lambda x: (x[1], x[0])):
        i = int(np.searchsorted(starts, e))
        if s >= end and not any(y > s for _, y in taken[max(i - 4, 0): i]):
            free.append((k, s, e))
            end = e
    return free


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """The labelers' votes on a span, in the order of LABELERS."""
    span = text[start:end]
    digits = _digits(span)
    if kind == EMAIL:
        ending = re.split(r"[.\s\])}]", span)[-1].lower()
        strict = 1 if "@" in span and ".." not in span and not span.startswith(".") else -1 if ".." in span else 0
        known = 1 if ending in ENDINGS else -1 if ending.isdigit() else 0
    elif kind == IP:
        parts = span.split(".")
        strict = 1 if len(parts) == 4 and all(p == "0" or not p.startswith("0") for p in parts) or ":" in span else -1
        known = -1 if parts[0] in ("0", "255") else 1
    elif kind == CARD:
        strict = 1 if len(digits) in (15, 16) and luhn(digits) else -1
        known = 1 if digits[0] in "3456" else -1 if digits[0] in "09" else 0
    else:
        strict = 1 if re.fullmatch(r"\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", span) else -1 if len(digits) < 10 else 0
        known = (1 if digits.startswith(COUNTRY_CODES) else -1) if span[0] == "+" else 0
    near = text[max(start - WINDOW, 0): start] + " " + text[end: end + WINDOW]
    before, after = text[start - 1: start] if start else "", text[end: end + 1]
    border = -1 if before.isalnum() or after.isalnum() or before in ("=", "/", "#") and before else 1
    variety = len(set(digits or span))
    return [strict, known, 1 if _REASON[kind].search(near) else 0, -1 if _AGAINST.search(near) else 0, border,
            1 if variety >= 4 else -1]


def shape(text: str, kind: int, start: int, end: int) -> list[float]:
    """SHAPES numbers that describe a span and its borders."""
    span = text[start:end]
    n, digits = len(span), len(_digits(span))
    count = [span.count(c) for c in (" ", ".", "-", "(", "+", "@", ":")]
    before = text[start - 1: start] if start else " "
    after = text[end: end + 1] or " "
    return [min(n, 64) / 64, digits / n, *[min(c, 4) / 4 for c in count], float(before.isspace()), float(after.isspace()),
            float(any(c.isalpha() for c in span))]


def _find(batches):
    for b in words.slices(batches):
        found, sizes = [], []
        for text in b.column(1).to_pylist():
            base = base_spans(text)
            spans = [(*s, True) for s in base] + [(*s, False) for s in wider_spans(text, base)]
            sizes.append(len(spans))
            found += [{"kind": k, "start": s, "end": e, "base": sure, "votes": votes(text, k, s, e), "shape": shape(text, k, s, e)}
                      for k, s, e, sure in spans]
        values = pa.array(found, _SPAN)
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, values)], ["doc_id", "spans"])


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                   ("votes", pa.list_(pa.int32())), ("shape", pa.list_(pa.float64()))])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with each candidate's kind, place, votes and shape; texts are read once."""
    return cut_lineage(id_and_text(docs).mapInArrow(
        _find, "doc_id bigint, spans array<struct<kind: int, start: bigint, end: bigint, base: boolean, "
               "votes: array<int>, shape: array<double>>>"), "pii-candidates")


def estimate(patterns: np.ndarray, count: np.ndarray, sure: np.ndarray, rounds: int = 100):
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) of one kind.

    Returns (posterior of each pattern, prior, reliabilities[class, labeler, vote + 1]). It
    starts from the majority of the votes, and from near certainty for base spans.
    """
    belief = np.where(sure, 0.95, np.clip(0.5 + patterns.mean(axis=1) / 2, 0.05, 0.95))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        prior = ((belief * count).sum() + 1) / (count.sum() + 2)
        rates = []
        for w in (count * (1 - belief), count * belief):
            seen = (onehot * w[:, None, None]).sum(axis=0) + 0.5
            rates.append(seen / seen.sum(axis=1, keepdims=True))
        rates = np.stack(rates)
        logs = [np.log(p) + (onehot * np.log(r)).sum(axis=(1, 2)) for p, r in ((1 - prior, rates[0]), (prior, rates[1]))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        new = np.where(sure, np.maximum(new, 0.9), new)
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return belief, prior, rates


def inputs(kind: np.ndarray, vote: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The classifier's inputs: votes by kind, shape by kind, and the kind."""
    one = np.eye(len(KINDS))[kind]
    wide = np.concatenate([vote, form], axis=1)
    return np.concatenate([(one[:, :, None] * wide[:, None, :]).reshape(len(kind), -1), one], axis=1)


def logistic(x: np.ndarray, target: np.ndarray, decay: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model with soft targets (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - target) / len(x) + decay * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _matrix(rows, name: str, width: int) -> np.ndarray:
    return np.array(rows.column(name).to_pylist(), float).reshape(-1, width)


def fit(found: DataFrame) -> np.ndarray | None:
    """The span classifier's weights; None without candidates."""
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    # at most 4 kinds x 3**6 vote patterns x 2
    patterns = spans.groupBy("kind", "votes", "base").agg(F.count(F.lit(1)).alias("c")).toArrow()
    if not patterns.num_rows:
        return None
    kind, vote = patterns.column("kind").to_numpy(), _matrix(patterns, "votes", len(LABELERS)).astype(int)
    count, sure = patterns.column("c").to_numpy(), patterns.column("base").to_numpy(zero_copy_only=False)
    belief = {}
    for k in set(kind.tolist()):
        own = kind == k
        for v, b, p in zip(vote[own], sure[own], estimate(vote[own], count[own], sure[own])[0]):
            belief[k, bool(b), tuple(v)] = p
    some = spans.orderBy(F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind").limit(SAMPLE).toArrow()
    kind, vote, form = some.column("kind").to_numpy(), _matrix(some, "votes", len(LABELERS)), _matrix(some, "shape", SHAPES)
    sure = some.column("base").to_numpy(zero_copy_only=False)
    target = np.array([belief[k, bool(b), tuple(v)] for k, b, v in zip(kind.tolist(), sure, vote.astype(int))])
    return logistic(inputs(kind, vote, form), target)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row of `docs`.

    The counts are those of the base spans; `spans` has all of them.
    """
    found = candidates(docs)
    weights = fit(found)

    def run(batches):
        for b in batches:
            out = []
            for doc, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = spans or []
                keep = spans
                if spans and not all(s["base"] for s in spans):
                    x = inputs(np.array([s["kind"] for s in spans]), np.array([s["votes"] for s in spans], float),
                               np.array([s["shape"] for s in spans]))
                    p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
                    keep = [s for s, y in zip(spans, p) if s["base"] or y >= MIN_SCORE]
                base = [s for s in keep if s["base"]]
                text = [",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}"
                                 for s in sorted(x, key=lambda s: (s["start"], s["kind"]))) for x in (base, keep)]
                out.append((doc, *[sum(s["kind"] == k for s in base) for k in range(4)],
                            hashlib.sha256(text[0].encode()).hexdigest(), text[1], len(keep)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()])],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    return found.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                                 "base_sha256 string, spans string, n_spans bigint")
