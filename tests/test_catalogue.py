import math

import duckdb
import pytest

from cadenza.plans.catalogue import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = clean(map(tuple, df.select(*names).collect()))
    want = con.execute(ORACLES[name])
    assert sorted(x[0] for x in want.description) == names
    want = clean(con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({ORACLES[name]})").fetchall())
    assert got and got == want


def test_uris_of_whole_texts(spark, tmp_path):
    long = "plain words " * 40
    rows = [(1, long + "é%20 [x] 漢\\b/c|\x7f\t🎵'"), (2, long + "another end"), (3, ""), (4, None), (5, long + "another end"), (None, "~-_.!$()*+,;=:@\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    escaped = set(b" \"#%&'<>?[]^`{|}")

    def uri(path):
        raw = ("/" + path.replace("\\", "/")).encode()
        return "file://localhost" + "".join(f"%{b:02X}" if b < 32 or b >= 127 or b in escaped else chr(b) for b in raw)

    want = []
    for d, t in rows:
        path = None if t is None else f"C:\\My Music\\{t}#1.mp3"
        want.append((d, path, path and uri(path)))
    got = QUERIES["location_uri_texts"](spark, str(tmp_path)).select("doc_id", "path", "uri").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
