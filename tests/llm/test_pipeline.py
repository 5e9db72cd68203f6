"""run() against plain versions of its stages."""

import hashlib
import re
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers

from llm import bpe, mixing, toxicity
from llm_fixtures import odd, sf  # noqa: F401


def test_run(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect() if r["predicted"]}
    left = {d: r for d, r in docs.items() if d not in rejected}
    last = {}
    for d, r in left.items():
        last[r["text"]] = max(d, last.get(r["text"], d))
    left = {d: r for d, r in left.items() if last[r["text"]] == d}
    near = brute.near_components({d: r["text"] for d, r in left.items()}, 5, 80)
    left = {d: r for d, r in left.items() if near[d][1] == d}
    size = Counter()
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for d, r in left.items()}
    for d, r in left.items():
        size[r["source"]] += words[d]
    target = mixing.targets(dict(size))

    rows = corpus_pipeline.run(spark, sf).collect()
    took, codec = Counter(r["doc_id"] for r in rows), bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert set(took) <= set(left) and max(took.values()) <= 2
    for s, goal in target.items():
        taken = sum(took[d] * words[d] for d, r in left.items() if r["source"] == s)
        assert abs(taken - goal) <= max(words[d] for d, r in left.items() if r["source"] == s) / 2
    for r in rows:
        ids = np.frombuffer(codec.encode(docs[r["doc_id"]]["text"]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_stages_keep_the_columns(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, odd.where("false"), sf).count() == 0, name


def test_registered_queries(spark):
    import __spark_entry__
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "pipeline" in queries and len([q for q in queries if q.startswith("op")]) == 13
    assert set(sql) <= set(queries)
