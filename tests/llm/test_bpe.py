import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm import bpe
from llm_fixtures import documents, none, odd, sf  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(codec, library):
    rng = random.Random(3)
    letters = "ab cdeéß 中日\n\t\r\x0b\x1c\x85 'sllre1٣².,!?😀‍_<|endoftext|>" + "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(200))
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    assert codec.encode("x" * 100_000) == np.array(library.encode_ordinary("x" * 100_000), "<u4").tobytes()


def test_merging_reaches_every_token(codec):
    for rank, token in enumerate(codec.tokens):
        assert codec.model.encode(token.decode("latin-1").translate(codec.characters)) == [rank]


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    small = bpe.Codec(PATH, public_tokenizers.PATTERN)
    t = " ".join(f"wordy{i}" for i in range(300))
    for _ in range(2):
        assert np.frombuffer(small.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_text_with_more_pieces_than_the_cache_and_some_cached(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    small = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for n in (5, 300, 8, 20):
        t = " ".join(f"wordy{i}" for i in range(n))
        assert np.frombuffer(small.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert len(small.cache) <= 10


def test_documents(documents, library, odd, none):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in bpe.encode_documents(documents, PATH, public_tokenizers.PATTERN).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    rows = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN, full=True).collect()
    source = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == 14 and all(bytes(r["decoded"]).decode() == source[r["doc_id"]] for r in rows)
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert all((r["n_tokens"], r["ids"], r["ids_sha256"]) == (0, [], hashlib.sha256(b"").hexdigest()) for r in empty)
    assert bpe.encode_documents(none, PATH, public_tokenizers.PATTERN).count() == 0
