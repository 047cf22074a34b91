import random
import re

from cadenza.llm import minhash
from cadenza.llm.components import components
from cadenza.llm.minhash import near_duplicates
from cadenza.session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(500)]
    rows, at = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(1, 120))
        for _ in range(rng.choice([1, 1, 2, 8, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = rng.choice([" ", "\n", "\t "]).join(w)
            rows.append((at, text.upper() if rng.random() < 0.2 and text.isascii() else text))
            at += rng.randint(1, 3)
    return [*rows, (at + 1, ""), (at + 2, None), (at + 3, " \n"), (at + 4, "one two"), (at + 5, "One  TWO"), (at + 6, "")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_near_copies_below_the_centre(spark):
    """A chain in which most pairs lie below the threshold still forms one component."""
    rng = random.Random(7)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base)))
        base[i * 5] = f"new{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == [(4, 4, True), (4, 4, True), (None, 4, False)] or got == [(4, 4, True), (4, 4, True), (None, None, True)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (102, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_equals_sql(spark):
    from cadenza.llm.queries import ORACLES, QUERIES
    from oracle import SMALL, same

    same(spark, QUERIES["op10_minhash"](spark, SMALL), ORACLES["op10_minhash"])


def relatives(n, seed=11, words=200, changed=9):
    """n texts that are near copies of one, whose similarity to each other lies about the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(rng.choice([1, 2, 4, changed])):
            w[rng.randrange(words)] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_hot_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 20)
    monkeypatch.setattr(minhash, "ASK", 7)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)  # joins by shuffle
    rows = relatives(150) + [(1000 + i, t) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for large in (3, 40):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, large=large).collect()}
        assert got == want
    assert len({c for _, c, _ in want.values()}) > 20


def test_rows_grow_with_the_members_of_a_group(spark, monkeypatch):
    """Four times as many near copies make about four times as many rows in every table that is written."""
    made = {}

    def counted(df, name):
        out = stored(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    sizes = []
    for n in (1000, 4000):
        made.clear()
        rows = near_duplicates(spark.createDataFrame(relatives(n, words=120, changed=12), "doc_id long, text string")).collect()
        assert len(rows) == n
        sizes.append(dict(made))
    small, large = sizes
    assert large["members"] <= 4000 and large["spans"] <= 32 * 4000
    for name, count in large.items():
        assert count <= 5 * max(small.get(name, 0), 1000), (name, sizes)


def test_rows_of_one_id(spark):
    """They are one document, linked where any of its texts is; a null id takes the label of an equal text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (3, a + " more"), (9, b + " more"), (5, c), (None, c), (None, "x y z"), (None, "x y z"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 36, 3, False)] * 3 + [(3, 37, 3, True), (9, 37, 3, False), (5, 36, 5, True), (None, 36, 5, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)], key=str)
