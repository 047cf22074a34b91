import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadenza.llm import idfiles, packing
from cadenza.llm.tokens import Encoder, tokenizer_path

PATH = tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)
TEXT = st.one_of(
    st.none(), st.text(max_size=40), st.text("aAbBéÉ'sd 1٣.,!\n\t ́​Σİ<|>#中", max_size=60),
    st.lists(st.sampled_from(["Hello", "it's", "WE'LL", "é", "́x", "<|endoftext|>", "<|ENDOFTEXT|>", "x1y2", "—,", "ﬁ", "\x1c", "\x85"]), max_size=12).map(" ".join),
)


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encoder_equals_whole_text_encoding(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENC.encode(pa.array(texts, pa.string()))]
    assert got == [ids(t) for t in texts]


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(Encoder, "LIMIT", 50)
    enc = Encoder(PATH)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdef.", k=rng.randint(1, 5))) for _ in range(rng.choice([3, 300]))) for _ in range(40)]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(pa.array(texts))]
    assert got == [ids(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=50)), max_size=8))
def test_file_round_trip(docs):
    content = idfiles.pack([d for d, _ in docs], [np.array(x, "<u4").tobytes() for _, x in docs])
    names, size, flat = idfiles.unpack(content)
    assert names == [d for d, _ in docs] and size.tolist() == [len(x) for _, x in docs]
    assert flat.tolist() == [y for _, x in docs for y in x]


def test_wide_ranks_round_trip():
    x = np.random.default_rng(1).permutation(np.concatenate([np.arange(70000), np.zeros(5000, np.int64)])).astype("<u4")
    assert np.array_equal(idfiles.unpack(idfiles.pack([1], [x.tobytes()]))[2], x)
    assert len(idfiles.pack([1], [np.zeros(100000, "<u4").tobytes()])) < 100000 * 1.26 + 100


def table(spark):
    rng = random.Random(4)
    rows = [(i * 3, " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 7))) for _ in range(rng.choice([0, 1, 5, 50, 900])))) for i in range(150)]
    rows += [(None, "no id"), (9999, None), (9998, ""), (3, "again the same id"), (5000, "long text here " * 9000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(6)


def test_files_hold_every_text_in_order(spark, tmp_path):
    rows, df = table(spark)
    manifest = idfiles.write_ids(df, f"file://{tmp_path}/out", file_ids=5000)
    assert manifest.count() > 5
    got = idfiles.read_ids(spark, f"file://{tmp_path}/out", manifest).orderBy("start").collect()
    order = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(d), ids(t)) for d, t in rows)
    digest = {(r.doc_id, r.start, r.ids_crc32) for r in idfiles.id_file_digests(df.where("doc_id is not null and doc_id != 3")).collect()}
    assert {x[2] for x in digest} == {zlib.crc32(np.array(ids(t), "<u4").tobytes()) for d, t in rows if d not in (None, 3)}


def test_cuts():
    for n in range(0, 9000):
        c = packing.cuts(n)
        assert sum(c) == n and all(0 < x <= 2048 for x in c) and len(c) <= n // 2048 + 7


def test_packing_round_trip(spark):
    rows, df = table(spark)
    packed = packing.pack(df, with_ids=True)
    got = packed.collect()
    docs = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    whole = sorted((str(k), [y for _, x in sorted(v) for y in x]) for k, v in docs.items())
    assert whole == sorted((str((d, len(ids(t)))), ids(t)) for d, t in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    used = sum(n for b in bins.values() for _, n in b)
    assert len(bins) * 2048 - used < 4 * 2048
    seqs = packing.sequences(packed).collect()
    assert sum(len(s.ids) // 4 for s in seqs) == used and len(seqs) == len(bins)
    s = max(seqs, key=lambda s: len(s.pieces))
    assert [p.offset for p in s.pieces] == sorted(p.offset for p in s.pieces)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df).collect() == []
    assert idfiles.id_file_digests(df).collect() == []
