import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cadenza.llm import hostrules, minhash, mixing, toxicity
from cadenza.llm import textvec as tv
from cadenza.llm.tokens import tokenizer_path
from cadenza.session import read

from oracle import SMALL
from test_hostrules import brute as measures
from test_minhash import brute as groups


def expected(rows, labels):
    """The pipeline in plain Python and SQL: what each stage keeps, as (doc_id, source, text)."""
    m = {d: measures(t) for d, _, t in rows}
    fails = {d: (n < 10, 100 * r > 20 * n, 10 * s > c, 10 * dup > n) for d, (n, c, s, dup, r) in m.items()}
    hosts = {}
    for d, s, _ in rows:
        hosts.setdefault(s, []).append(fails[d])
    bad = set()
    for k in range(4):
        rate = {s: np.mean([f[k] for f in v]) for s, v in hosts.items()}
        mu, var = np.mean(list(rate.values())), np.var(list(rate.values()))
        z = min(max(mu * (1 - mu) / var - 1, 1.0), 1e4) if var > 0 else 1e4
        bad |= {s for s, v in hosts.items() if (sum(f[k] for f in v) + mu * z) / (len(v) + z) > 0.5}
    a = [r for r in rows if not any(fails[r[0]][:2]) and r[1] not in bad]
    learn = sorted((d, t, labels[d]) for d, _, t in a if d in labels and zlib.crc32(str(d).encode()) % 5)
    model = toxicity.train([x[1] for x in learn], [x[2] for x in learn])
    b = [r for r in a if next(iter(model.score(x)[0] for x in tv.blocks(pa.array([r[2]])))) < 0.5]
    kept = groups([(d, t) for d, _, t in b])
    c = [r for r in b if kept[r[0]][2]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(c, columns=["doc_id", "source", "text"]))
    copies = dict(con.execute(f"select doc_id, copies from ({mixing.ORACLE})").fetchall())
    return a, b, c, [(r, copies[r[0]]) for r in c if copies[r[0]]]


def test_stages_and_run_against_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    labels = {r.doc_id: r.toxic for r in read(spark, SMALL, "labels").collect()}
    a, b, c, mix = expected(rows, labels)
    now = docs
    for (name, stage), want in zip(cp.STAGES[:3], (a, b, c), strict=False):
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns
        assert Counter((r.doc_id, r.source, r.text) for r in now.collect()) == Counter(want), name
        now = spark.createDataFrame(now.collect(), docs.schema)
    taken = cp.STAGES[3][1](spark, now, SMALL)
    assert Counter((r.doc_id, r.source, r.text) for r in taken.collect()) == Counter({r: n for r, n in mix})
    bpe = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: [*bpe.encode(r[2], add_special_tokens=False).ids, 1] for r, _ in mix}
    got = cp.run(spark, SMALL).collect()
    tokens = Counter()
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        tokens[r.doc_id] += r.length
    assert tokens == Counter({r[0]: n * len(ids[r[0]]) for r, n in mix})


def test_stages_on_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, words, None, None, 1), (3, words, None, None, 1), (4, words, "en", None, 2), (None, words + " x", "en", "b", 3), (5, words * 200, "en", "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now = df
    for _, stage in cp.STAGES[:4]:
        now = stage(spark, now, SMALL)
        assert now.columns == df.columns
    assert cp.STAGES[4][1](spark, now, SMALL).count() > 0
    ids = [r.doc_id for r in cp.near_dedup_stage(spark, df, SMALL).collect()]
    assert sorted(ids, key=str) == [1, 2, 3, None]  # 5 repeats the windows of 3
    now = df.limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, SMALL)
    assert now.collect() == []


def test_joins_by_shuffle(spark, monkeypatch):
    """The stages that broadcast what is small give the same rows when nothing is small enough."""
    docs = read(spark, SMALL, "documents")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    rows = lambda df: Counter((r.doc_id, r.source, r.text) for r in df.collect())
    small = [rows(stage(spark, docs, SMALL)) for _, stage in (cp.STAGES[0], cp.STAGES[2], cp.STAGES[3])]
    monkeypatch.setattr(hostrules, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(cp, "BROADCAST_IDS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [rows(stage(spark, docs, SMALL)) for _, stage in (cp.STAGES[0], cp.STAGES[2], cp.STAGES[3])] == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_one_id_leave_one(spark):
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(3, words, 1), (3, "another text of the same id that is long enough", 2), (4, words + " x", 3), (9, "a text of its own that is like none of the others", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, cp.near_dedup_stage(spark, df, SMALL).collect())) == [rows[1], rows[3]]
