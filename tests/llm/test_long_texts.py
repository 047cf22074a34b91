"""Long texts are taken whole, in memory of a few times their size."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from cadenza.llm import crf, hostrules, minhash, ngram, toxicity
from cadenza.llm import textvec as tv

from test_hostrules import brute as measures


def text(size, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 12))) for _ in range(5000)]
    out = []
    while sum(map(len, out)) < size:
        out.append(" ".join(rng.choices(words, k=2000)) + rng.choice(["\n", "\n\n", " "]))
    return "".join(out)


def test_parts_hash_alike(monkeypatch):
    x = text(30_000) + "w" * 3000 + " end\n" + "\n".join(["same line"] * 5)
    whole = next(iter(tv.blocks(pa.array([x]))))
    hashes = whole.hashes(), tv.shingles(whole.hashes(), whole.offsets, 5)[0], whole.span_hashes(*whole.lines()[:2], False)
    rules = {k: v.tolist() for k, v in hostrules.measure_block(whole).items()}
    assert tuple(rules[k][0] for k in hostrules.MEASURES.names) == measures(x)
    lines = crf.lines_of(whole)
    monkeypatch.setattr(tv, "BLOCK_BYTES", 700)
    part = next(iter(tv.blocks(pa.array([x]), 10**9)))
    for a, b in zip(hashes, (part.hashes(), tv.shingles(part.hashes(), part.offsets, 5)[0], part.span_hashes(*part.lines()[:2], False)), strict=True):
        assert np.array_equal(a, b)
    assert rules == {k: v.tolist() for k, v in hostrules.measure_block(part).items()}
    assert np.array_equal(lines.active, crf.lines_of(part).active)


def test_flags_in_ranges():
    rng = np.random.default_rng(1)
    for _ in range(50):
        flags, cut = rng.random(40) < 0.4, np.sort(rng.integers(0, 41, 12))
        start, end = cut[::2], cut[1::2]
        assert tv.sums(flags, start, end).tolist() == [int(flags[a:b].sum()) for a, b in zip(start, end, strict=True)]


def test_memory_of_a_text_of_30_mb():
    x = text(1_000_000) * 30
    column, size = pa.array([x]), len(x.encode())
    none = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    for work in (
        lambda: hostrules._measure(5)([column]), lambda: [len(s) for _, s in minhash.document_sets(column, 5)], lambda: [ngram._streams(b) for b in tv.blocks(column)],
        lambda: [crf.lines_of(b) for b in tv.blocks(column)], lambda: [none.score(b) for b in tv.blocks(column)],
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 15 * size, peak / size
