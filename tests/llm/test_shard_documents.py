from __future__ import annotations

from collections import Counter

import numpy as np

from lexloom.llm import token_shards


def test_every_document_is_in_the_index(spark):
    texts = [f"short text {i}" for i in range(80)] + ["long words again and again " * 40, "", None]
    rows = [*enumerate(texts), (None, "null id"), (3, "short text 3"), (3, "short text 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    encode = token_shards._encoder(open(token_shards.VOCABULARY, "rb").read()).encode_ordinary
    want = Counter()
    for i, t in rows:
        want[i] += len(encode(t or "")) + 1
    shards = token_shards.write_shards(df, length=64, shard_bytes=2048)
    held = {r.slot: np.frombuffer(bytes(r.ids), "<u2") for r in shards.read().collect()}
    got, marks = Counter(), 0
    for r in shards.manifest().collect():
        assert r.docs[0].doc_id == r.doc_id and [d.start for d in r.docs] == np.cumsum([0, *(d.n_tokens for d in r.docs)]).tolist()[:-1] and sum(d.n_tokens for d in r.docs) == r.n_tokens
        for d in r.docs:
            got[d.doc_id] += d.n_tokens
            marks += held[r.slot][d.start + d.n_tokens - 1] == token_shards.END
    assert got == want and marks == len(rows)
    index = token_shards.shard_index(df, length=64, shard_bytes=2048)
    assert {d.doc_id for r in index.collect() for d in r.docs} == {i for i, _ in rows}
