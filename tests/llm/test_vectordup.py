import tracemalloc

import numpy as np

from cadenza.llm import vectordup
from cadenza.llm.hnsw import Graph


def brute(rows, threshold=0.98):
    ok, unit = [], []
    for _, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        good = label is not None and len(a) > 0 and np.isfinite(a).all() and a.any()
        ok.append(bool(good))
        unit.append(a / np.linalg.norm(a) if good else None)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (links[i], low[find(i)], low[find(i)] == rows[i][0]) for i in range(n)}


def table(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((int(len(rows) * 7 % 2003), None if v is None else [None if x is None else float(np.float32(x)) for x in v], label))

    for label in range(3):
        for _ in range(120):
            add(rng.normal(size=dim), label)
    for label, size, noise in ((0, 150, 0.1), (1, 40, 0.12), (2, 6, 0.05), (7, 3, 0.01)):
        base = rng.normal(size=dim)
        for _ in range(size):
            add(base + noise * rng.normal(size=dim), label)
    same = rng.normal(size=dim)
    for _ in range(60):
        add(same, 1)
    add(same * 0.5, 1)
    add(same, 0)
    add(same, None)
    for v in (None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]):
        add(v, 1)
    return rows


def test_against_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, kept string, n_links int").repartition(5)
    for how in ({}, {"shard": 64, "block": 50}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectordup.near_duplicate_vectors(df, **how).collect()}
        assert got == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label string"
    df = spark.createDataFrame([(None, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (3, [1.0, 0.001], "a"), (4, [0.0, 1.0], "a"), (5, [1.0, 0.0], None)], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectordup.near_duplicate_vectors(df).collect()), key=str)
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 0, None, True)]
    assert vectordup.near_duplicate_vectors(df.limit(0)).collect() == []


def test_graph_recall_and_reachability():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v[:900] = v[0] + 0.15 * rng.normal(size=(900, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = v[rng.permutation(3000)]
    g = Graph.build(v)
    truth = v @ v.T >= 0.97
    who, what = g.within(v, 0.97, 64)
    got = np.zeros_like(truth)
    got[who, what] = True
    assert not (got & ~truth & (np.abs(v @ v.T - 0.97) > 1e-5)).any()
    assert (got & truth).sum() / truth.sum() > 0.999


def test_query_equals_sql(spark):
    from cadenza.llm.queries import ORACLES, QUERIES
    from oracle import SMALL, same

    same(spark, QUERIES["op1_hnsw"](spark, SMALL), ORACLES["op1_hnsw"])


def near(n, dim=64, noise=0.012, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=dim) / 8 + noise * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_a_dense_group_in_bounded_memory():
    """A step of queries that all link with all of a shard holds its own pairs only."""
    x = near(3000)
    graph = Graph.build(x.astype(np.float32))
    assert (x[:50] @ x.T >= 0.98).mean() > 0.9
    tracemalloc.start()
    who, what = vectordup._neighbours(graph, x[:256], x, np.arange(256), 0.98, vectordup.BEAM, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.zeros((256, 3000), bool)
    got[who, what] = True
    assert np.array_equal(got, x[:256] @ x.T >= 0.98)
    assert peak < 200e6


def test_what_the_graph_does_not_lead_to_is_compared():
    """Audits fail on a graph without links, at the widest beam too, and the shard is then compared with all queries."""
    x = np.concatenate([near(60, seed=1), near(40, seed=2)])
    graph = Graph.build(x.astype(np.float32))
    for layer in graph.layers:
        layer.links[:] = -1
    for own in (np.arange(100), np.full(100, -1)):
        who, what = vectordup._neighbours(graph, x, x, own, 0.98, 4, 8)
        got = np.zeros((100, 100), bool)
        got[who, what] = True
        assert np.array_equal(got, x @ x.T >= 0.98)
