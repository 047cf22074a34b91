import re
from collections import Counter

from tokenizers import Tokenizer

from cadenza.llm.rollup import Rollup, counted, token_counts
from cadenza.llm.tokens import tokenizer_path
from cadenza.session import read

from oracle import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, lang string, tokenizer string, n_tokens long"


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_signed_batches_are_applied_once(spark, tmp_path):
    r = Rollup(spark, f"file://{tmp_path}/rollup")
    assert totals(r) == {} and r.totals().columns == ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = [(1, "a", "en", "t", 10), (2, "a", "en", "t", 20), (2, "a", "en", "u", 7), (3, None, None, "t", 5), (None, "a", "en", "t", 1)]
    assert r.apply("b1", make(first))
    assert totals(r) == {("a", "en", "t"): (3, 31), ("a", "en", "u"): (1, 7), (None, None, "t"): (1, 5)}
    assert not r.apply("b1", make(first)) and totals(r)["a", "en", "t"] == (3, 31)
    # revised counts, a moved document, a new one, and deletes; deleting what isn't there changes nothing
    assert r.apply("b2", make([(1, "a", "en", "t", 12), (2, "b", "fr", "t", 20), (9, "b", "fr", "t", 4), (9, "b", "fr", "t", 4)]), spark.createDataFrame([(3,), (77,)], "doc_id long"))
    want = {("a", "en", "t"): (2, 13), ("a", "en", "u"): (1, 7), ("b", "fr", "t"): (2, 24)}
    assert totals(r) == want
    assert r.apply("b3", deletes=spark.createDataFrame([(2, "t"), (3, "t")], "doc_id long, tokenizer string"))
    assert totals(r) == {("a", "en", "t"): (2, 13), ("a", "en", "u"): (1, 7), ("b", "fr", "t"): (1, 4)}
    assert r.apply("b4", make([(3, "a", "en", "t", 2)]), spark.createDataFrame([(3,), (None,)], "doc_id long"))
    assert totals(r) == {("a", "en", "t"): (2, 14), ("a", "en", "u"): (1, 7), ("b", "fr", "t"): (1, 4)}
    assert list(sorted(r.committed(), key=r.committed().get)) == ["b1", "b2", "b3", "b4"]


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    r = Rollup(spark, f"file://{tmp_path}/rollup")
    r.apply("b1", spark.createDataFrame([(1, "a", "en", "t", 10)], SCHEMA))
    spark.createDataFrame([(1, "t", "a", "en", 99, True)], "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean").write.parquet(f"file://{tmp_path}/rollup/state/b2")
    spark.createDataFrame([("a", "en", "t", 50, 99)], "source string, lang string, tokenizer string, n_docs long, n_tokens long").write.parquet(f"file://{tmp_path}/rollup/deltas/b2")
    assert totals(r) == {("a", "en", "t"): (1, 10)}
    assert r.apply("b2", spark.createDataFrame([(1, "a", "en", "t", 11)], SCHEMA))
    assert totals(r) == {("a", "en", "t"): (1, 11)}


def test_counts_of_texts(spark):
    rows = [(1, None, "s", "en"), (2, "", "s", "en"), (3, "One two\tthree's", None, "en"), (4, "é " * 3000, "s", None), (None, "x", "s", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, n_tokens int")
    bpe = Tokenizer.from_file(tokenizer_path())
    want = {}
    for d, t, s, lang in rows:
        want[d, s, lang, "words-1"] = len(WORD.findall(t or ""))
        want[d, s, lang, "word_bpe_49k-1"] = len(bpe.encode(t or "", add_special_tokens=False).ids)
    assert {(r.doc_id, r.source, r.lang, r.tokenizer): r.n_tokens for r in counted(df).collect()} == want


def test_query_against_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    bpe = Tokenizer.from_file(tokenizer_path())
    n, t = Counter(), Counter()
    for r in docs.collect():
        for k, v in (("words-1", len(WORD.findall(r.text))), ("word_bpe_49k-1", len(bpe.encode(r.text, add_special_tokens=False).ids))):
            n[r.source, r.lang, k] += 1
            t[r.source, r.lang, k] += v
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in token_counts(docs).collect()}
    assert got == {k: (n[k], t[k]) for k in n}
    assert token_counts(docs.limit(0)).collect() == []


def test_query_revises_deletes_and_puts_back(spark, monkeypatch):
    rows = [(1, "one two", "s", "en"), (-7, "x", "s", "en"), (None, "a b c", "s", "en"), (None, "d", "s", "en"), (None, "d", "s", "en"), (None, None, None, None)]
    made, sums, apply = [], [], Rollup.apply

    def watched(self, batch, *a):
        new = apply(self, batch, *a)
        made.append((batch, new))
        sums.append(totals(self))
        return new

    monkeypatch.setattr(Rollup, "apply", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in token_counts(df, tokenizers=("words-1",)).collect()}
    assert made == [(b, new) for b in ("documents", "revised", "deleted", "reinserted") for new in (True, False)]
    want = {("s", "en", "words-1"): (5, 8), (None, None, "words-1"): (1, 0)}
    assert sums[0] == sums[1] == {("s", "en", "words-1"): (5, 13), (None, None, "words-1"): (1, 1)}
    assert sums[2] == sums[3] == want and sums[4] == sums[5] == {} and sums[6] == sums[7] == got == want


def test_two_writers_of_one_log(spark, tmp_path, monkeypatch):
    """A writer that another overtakes starts again, so no version is counted twice."""
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    a, b = (Rollup(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    a.apply("first", make((1, "s", "en", "t", 10)))
    write, tries = Rollup._write, []

    def overtaken(self, at, *rest):
        write(self, at, *rest)
        tries.append(at)
        if len(tries) == 1:
            assert b.apply("second", make((1, "s", "en", "t", 20)))

    monkeypatch.setattr(Rollup, "_write", overtaken)
    assert a.apply("third", make((1, "s", "en", "t", 30)))
    assert [x.split("-")[0] for x in tries] == ["third", "second", "third"]
    assert totals(a) == totals(b) == {("s", "en", "t"): (1, 30)}
    assert a.committed() == {"first": 1, "second": 2, "third": 3}
    assert not a._commit(3, {"batch": "fourth", "at": "x"}) and a._commit(4, {"batch": "fourth", "at": tries[-1]})


def test_batches_read_a_bounded_number_of_folders(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    r, plain = Rollup(spark, f"file://{tmp_path}/a", every=3), Rollup(spark, f"file://{tmp_path}/b", every=10**6)
    for i in range(8):
        up = [(i, "s", "en", "t", i), (i - 1, "s2", "en", "t", 100 + i), (None, None, "en", "t", i)]
        gone = spark.createDataFrame([(i - 3,)], "doc_id long")
        for x in (r, plain):
            assert x.apply(f"b{i}", make(up), gone)
        assert len(r._log()[1]) <= 3 and totals(r) == totals(plain)
    assert list(r.committed()) == list(plain.committed()) == [f"b{i}" for i in range(8)]
    assert not r.apply("b0", make(up))
    r.vacuum()
    assert totals(r) == totals(plain)
    assert r.apply("last", deletes=spark.createDataFrame([(7,), (None,)], "doc_id long")) and plain.apply("last", deletes=spark.createDataFrame([(7,), (None,)], "doc_id long"))
    assert totals(r) == totals(plain)
