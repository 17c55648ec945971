"""run() against a plain version of every stage."""

import os
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from rankfit.llm import op2_lines as O2, op3_language as O3

from .test_operators import _fingerprint, _overlaps, _repeats

SMALL = "/root/testdata/sf0.001"


def _language(model, text):
    """Label and score from n-gram counts, one at a time."""
    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    chars, last = [], False
    for c in low + " ":
        if c.isalpha() or last:
            chars.append(c if c.isalpha() else " ")
        last = c.isalpha()
    counts, total = Counter(), 0
    for k in (1, 2, 3):
        for i in range(len(chars) - k + 1):
            h = 0
            for j in range(k):
                h = (h ^ ord(chars[i + j])) * 2654435761 + j + 1 & 0xFFFFFFFF
            counts[((h ^ h >> 15) * 2246822519 & 0xFFFFFFFF) >> 16] += 1
            total += 1
    s = sum(np.float64(n) * model.table[g] for g, n in counts.items()) * O3.SCALE / total / model.heat
    p = np.exp(s - s.max())
    return model.labels[int(p.argmax())], float(p.max() / p.sum())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables absent")
def test_run(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in rows.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    model = O3.fit(rows)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in O3.identified(rows, model).collect()}
    for d, text in docs.items():
        lang, score = _language(model, text)
        assert told[d][0] == lang and abs(told[d][1] - score) < 1e-3
    kept = {d: t for d, t in docs.items() if told[d][0] != "und" and told[d][1] >= 0.5}
    cut = _repeats(sorted(kept.items()), O2.MIN_WORDS)
    fps = {d: _fingerprint(t) for d, t in cut.items()}
    root = {d: d for d in fps}
    near = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    firsts = {d: t for d, t in cut.items() if root[d] == d}
    bad = {d for d, *_ in _overlaps(list(firsts.items()), items)}
    clean = {d: t for d, t in firsts.items() if d not in bad}
    assert bad and len(firsts) < len(cut) and len(clean) > 0.8 * len(docs)

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in clean.items()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == set(clean)
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048
