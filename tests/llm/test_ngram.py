import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import eliasfano as ef
from cadenza.llm import ngram
from cadenza.llm import textvec as tv
from cadenza.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=60), st.integers(0, 62), st.integers(1, 5))
def test_elias_fano(xs, shift, times):
    x = np.sort(np.array([v >> shift for v in xs] * times, np.uint64))
    parts, meta = ef.encode(x)
    c = ef.EliasFano(parts["low"], parts["vector"], parts["ones"], **meta)
    assert np.array_equal(c.access(np.arange(len(x))), x)
    ask = np.unique(np.concatenate([x, x + np.uint64(1), np.array([0, 5, 2**64 - 1], np.uint64)]))
    where = {}
    for i, v in enumerate(x.tolist()):
        where.setdefault(v, i)
    assert c.find(ask).tolist() == [where.get(v, -1) for v in ask.tolist()]


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


def brute(docs, order, prior, least):
    train = [tokens(t) for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = [Counter() for _ in range(order)]
    for x in train:
        x = ["</s>", *x]
        for n in range(1, order + 1):
            for i in range(max(1, n - 1), len(x)):
                c[n - 1][tuple(x[i - n + 1 : i + 1])] += 1
    total, v = sum(c[0].values()), len(c[0])
    ones, twos = (sum(1 for k in c[0].values() if k == j) for j in (1, 2))
    d = min(0.9, ones / (ones + 2 * twos)) if ones else 0.5

    def p(ctx, w):
        if not ctx:
            k = c[0][w,]
            return (k - d) / total if k else d * v / total
        m = prior[len(ctx) - 1]
        low = p(ctx[1:], w)
        k = c[len(ctx)][(*ctx, w)]
        if len(ctx) > 1 and k < least:
            k = 0
        seen = c[len(ctx) - 1][ctx]
        return (k + m * low) / (seen + m) if seen else low

    out = {}
    for doc, t in docs:
        x = ["</s>", *tokens(t)]
        s = sum(math.log10(p(tuple(x[max(0, i - order + 1) : i]), x[i])) for i in range(1, len(x)))
        base = sum(math.log10((c[0][w,] + 1) / (total + 1 * (v + 1))) for w in x[1:])
        out[doc] = (doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2, len(x) - 1, sum(c[0][w,] > 0 for w in x[1:]), total, base, s)
    return out


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(60)] + ["The", "AND"]
    docs = [(i * 2 + 1, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 200])))) for i in range(120)]
    docs += [(1001 + i, docs[3][1] + " " + docs[5][1]) for i in range(6)]
    return [*docs, (5000, None), (5001, ""), (None, "the and new-word"), (5003, "never seen words\there\n" * 3)]


@pytest.mark.parametrize("order,shard", [(1, 10**6), (2, 700), (3, 900), (3, 10**6)])
def test_against_brute_force(spark, order, shard):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, score double, id string").repartition(3)
    got = {r.doc_id: r for r in ngram.held_out_scores(df, order=order, prior=(9.0, 3.0), shard_tokens=shard).collect()}
    want = brute(docs, order, (9.0, 3.0), 2)
    assert got.keys() == want.keys()
    for k, (held, n, known, total, base, s) in want.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6
        assert abs(r.score - s) < 2e-3 * n + 1e-6


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram.held_out_scores(df).collect() == []


def test_query_keeps_trigrams_seen_once(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    train = [(i, " ".join(rng.choices(words, k=60))) for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [(i, train[i % len(train)][1]) for i in range(1000, 1040) if zlib.crc32(str(i).encode()) % 7 == 2]
    spark.createDataFrame(train + held, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_ngram"](spark, str(tmp_path)).collect()}
    want, pruned = (brute(train + held, 3, ngram.PRIOR, k) for k in (1, 2))
    for d, _ in train + held:
        assert abs(got[d].score - want[d][5]) < 2e-3 * want[d][1]
    assert all(want[d][5] - pruned[d][5] > 0.1 * want[d][1] for d, _ in held)


def test_probabilities_after_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([("a b c d",), ("a b e",), ("a b c",), ("b f",)], "text string")
    t = ngram.build(docs, least=1, prior=(9.0, 3.0))
    unknown = 10.0 ** ngram.word_logs(t, np.zeros(1, np.int64))[0]  # of one word not in the trie
    n = 0.0
    for w in "abcdef":
        n += 10.0 ** ngram.walk(t, next(iter(tv.blocks(pa.array([f"a b {w}"]))))).logs[2]
    n += 10.0 ** ngram.walk(t, next(iter(tv.blocks(pa.array(["a b"]))))).logs[2]
    back = 3.0 / (3 + 3.0) * 9.0 / (4 + 9.0)  # a b: 3 times, b: 4 times
    assert abs(n + back * unknown - 1) < 2e-3


def test_texts_in_parts_are_texts_whole(spark, monkeypatch):
    """The grams that are counted and the scores don't depend on where a long text is cut."""
    texts = [t for _, t in corpus()] + [" ".join(str(i * i % 37) for i in range(3000))]
    t = ngram.build(spark.createDataFrame([(x,) for x in texts], "text string"), least=1, shard_tokens=5000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])

    def grams(n):
        below = ngram.Trie(t.tokens, t.words, t.discount, t.prior, t.levels[: n - 1])
        rows = [x for b in ngram._count_grams(below, n, 1)(iter([batch.select(["text"])])) for x in b.column("blob").to_pylist()]
        return [c.tolist() for c in ngram._unsqueeze(rows[0], 2 + (n > 2), 1)], len(rows)

    def scores():
        return [x for b in ngram._score(t)(iter([batch])) for x in b.to_pylist()]

    whole = grams(2), grams(3), scores()
    for part in (1, 2, 7, 1000):
        monkeypatch.setattr(ngram, "PART", part)
        assert (grams(2), grams(3), scores()) == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=2, max_size=300), st.integers(0, 40))
def test_elias_fano_pairs(xs, shift):
    x = np.sort(np.array([v >> shift for v in xs], np.uint64))
    parts, meta = ef.encode(x)
    a, b = ef.EliasFano(parts["low"], parts["vector"], parts["ones"], **meta).access_pairs(np.arange(len(x) - 1))
    assert np.array_equal(a, x[:-1]) and np.array_equal(b, x[1:])
