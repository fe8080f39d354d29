"""The pipeline's stages against plain versions of their contracts, each on its own input."""

from __future__ import annotations

import hashlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from llm.test_dedup_operators import brute_lines, brute_near
from llm.test_text_operators import brute_contamination

from topicspark.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), name)
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    text = lambda rows: {r["doc_id"]: r["text"] for r in rows}

    before, after = seen["language_id"]
    assert len(after) >= 0.98 * len(before) and text(after).items() <= text(before).items()

    before, after = seen["line_dedup"]
    gone = brute_lines(text(before).items())
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in text(before).items()}
    assert text(after) == want and gone and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["near_dedup"]
    groups = brute_near(list(text(before).items()), 5, 80)
    assert {r["doc_id"] for r in after} == {i for i, (_, root) in groups.items() if root == i}

    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = set()
    for i, t in text(before).items():
        if len(t) < 20_000:
            n, hit, _ = brute_contamination(t, items)
            if not (hit and 20 * hit >= n):
                kept.add(i)
    assert kept == {i for i in text(after) if len(text(before)[i]) < 20_000}

    before, after = seen["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in after:
        ids = lib.encode(text(before)[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(after) == len(before)
