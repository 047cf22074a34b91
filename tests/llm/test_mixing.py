import pandas as pd

from cadenza.llm.mixing import mix_sources, mixed
from cadenza.llm.queries import ORACLES, QUERIES

from oracle import SMALL, same


def test_query_equals_sql(spark):
    same(spark, QUERIES["op4_mixing"](spark, SMALL), ORACLES["op4_mixing"])


def rows():
    out = [(i, "w " * (i % 17), f"s{i % 4}") for i in range(400)] + [(1000 + i, "hot word " * 5, "hot") for i in range(300)]
    return [*out, (2000, None, None), (2001, "a b c", None), (None, "x y", "s1"), (2002, "", "empty"), (2003, "long " * 5000, "s2")]


def test_edges_equal_sql(spark):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows()], "doc_id long, text string, source string, size int, copies string")
    got = mix_sources(df).select("doc_id", "size", "source_size", "target", "copies", "taken")
    same(spark, got, ORACLES["op4_mixing"], {"documents": pd.DataFrame(rows(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})})
    taken = {}
    for r in mix_sources(df).collect():
        assert r.taken <= 2 * r["size"]
        x = taken.setdefault(r.source, [0, r.target, 0])
        x[0] += r.taken
        x[2] = max(x[2], r["size"])
    for got, target, most in taken.values():
        assert abs(got - target) <= 2 * most + 1
    assert abs(sum(x[1] for x in taken.values()) - 1.5 * sum(len((t or "").split()) for _, t, _ in rows())) < 1e-6


def test_the_mix_repeats_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, source string, copies int")
    plan = {(r.doc_id, r.source): r.copies for r in mix_sources(df).collect()}
    got = {}
    for r in mixed(df).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
        assert r.asDict().keys() == {"doc_id", "text", "source", "copies"}
    assert got == {k: n for k, n in plan.items() if n}


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"]) for r in mix_sources(df).collect()) == [(1, 4), (2, 1)]
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
