import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
import re

from cadenza.llm import hostrules
from cadenza.llm import textvec as tv
from cadenza.llm.queries import ORACLES, QUERIES

from oracle import SMALL, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, g in enumerate(wins) if wins.count(g) > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXT = st.one_of(st.none(), st.text("ab \n\t\r#é 中A", max_size=60), st.lists(st.sampled_from(["a", "b", "é", "\n", "a b a b a", "x\n"]), max_size=60).map(" ".join))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 100))
def test_measures_against_brute_force(texts, size):
    got = []
    for b in tv.blocks(pa.array(texts, pa.string()), size):
        m = hostrules.measure_block(b)
        got += list(zip(*(m[f].tolist() for f in hostrules.MEASURES.names), strict=True))
    assert got == [brute(t) for t in texts]


def test_query_equals_sql(spark):
    same(spark, QUERIES["op9_hostrules"](spark, SMALL), ORACLES["op9_hostrules"])


def test_edge_rows_equal_sql(spark):
    long = "word " * 30 + "other " * 5
    rows = [(1, None, "a"), (2, "", "a"), (3, long * 50, None), (4, long, None), (5, "| # $ % &" * 20, "b")]
    rows += [(100 + i, f"good words number {i} in a host that is mostly junk but this one is fine", "junk") for i in range(3)] + [(200 + i, "x\n" * 40 + str(i), "junk") for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, kept string, n_words int")
    want = same(spark, hostrules.quality_rules(df), ORACLES["op9_hostrules"], {"documents": pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})})
    assert len(want) == len(rows)
    again = [*rows, (4, long, None), (None, "one two three four five six seven eight nine ten", "b"), (None, None, None)]
    more = hostrules.quality_rules(spark.createDataFrame(again, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id, *r[1:6]) for r in more), key=str) == sorted(((d, *brute(t)) for d, t, _ in again), key=str)
    kept = hostrules.passing(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in hostrules.quality_rules(df).where("kept").collect()}


def test_empty(spark):
    assert hostrules.quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
