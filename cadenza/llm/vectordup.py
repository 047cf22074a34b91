"""Embedding near-duplicates: navigable small-world graphs per shard, every shard queried, cosine verified, components united.

1. Vectors that can link (finite, not zero, with a label and an id) are collapsed by value: equal vectors are one node with
   a multiplicity.
2. The nodes of a label (and a dimension) are dealt by hash to shards of about `shard` nodes; each shard becomes a graph in
   a file of the shared folder, small ones many to a file.
3. Each shard is asked for the neighbours of all its label's nodes.  What is dealt to tasks are pairs of a graph and a block
   of `block` nodes of another graph's file, so vectors are not shuffled again.  `STEP` queries are searched together: a
   search finds the neighbourhood with a beam, then follows links that stay near the threshold, so what it returns is not
   bounded by the beam.  Two audits follow: a query that is itself a node of the shard must find itself, and for some
   queries of each step (`audit` of them a block) the hits must be those of a comparison with the whole shard.  Queries that
   fail, or the step, are searched again with twice the beam; where `WIDEST` times the beam isn't enough, they are compared
   with the whole shard.
4. Hits are verified by cosine in double precision.  A block returns each query's number of links, and a star of edges for
   every component among its hits: a group of a thousand near copies gives a thousand edges, not a million pairs.
5. Components come from alternating large-star and small-star.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textvec as tv
from cadenza.llm.components import components
from cadenza.llm.files import arrays, mapped, put
from cadenza.llm.hnsw import Graph
from cadenza.llm.minhash import _groups, _signed
from cadenza.session import scratch, ship, stored

SHARD = 8192
BLOCK = 2048
BEAM = 48
AUDIT = 32
STEP = 256
WIDEST = 16
_NEAR = 1e-4  # what single precision may be off


def _clean(batches):
    """(id, label, dim, ok, d1, d2, vec): vectors in double precision and a digest of their values."""
    for batch in batches:
        ids, vectors, labels = batch.column(0), batch.column(1), batch.column(2)
        ok, d1, d2, raw, dim = [], [], [], [], []
        good = [x and y for x, y in zip(ids.is_valid().to_pylist(), labels.is_valid().to_pylist(), strict=True)]
        flat = vectors.flatten().cast(pa.float64()) if not isinstance(vectors, pa.NullArray) else None
        bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(float)) if flat is not None and len(flat) else np.zeros(0, bool)
        values = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float)) if flat is not None and len(flat) else np.zeros(0)
        at = 0
        for i, n in enumerate(vectors.value_lengths().to_pylist()):
            n = n or 0
            v, fine = values[at : at + n], bool(good[i]) and n > 0 and not bad[at : at + n].any()
            at += n
            fine = fine and bool(v.any())
            if fine:
                v = v / np.abs(v).max()  # the direction is what counts; no product over- or underflows
            ok.append(fine)
            dim.append(n)
            h = tv.mix(np.ascontiguousarray(v + 0.0).view(np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if fine else np.zeros(0, np.uint64)
            with np.errstate(over="ignore"):
                d1.append(_signed(int(h.sum(dtype=np.uint64))))
                d2.append(_signed(int(tv.mix(h + np.uint64(7)).sum(dtype=np.uint64))))
            raw.append(v.tobytes() if fine else None)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), labels, pa.array(dim, pa.int32()), pa.array(ok, pa.bool_()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(raw, pa.binary())], names=["id", "label", "dim", "ok", "d1", "d2", "vec"])


def _unit(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), float).reshape(-1, dim)
    x = x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    return x, x.astype(np.float32)


def _build(folder: str, target: int):
    """Rows sorted by (group, shard) to graphs in files; returns where each graph is."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def close():
            parts, meta, rows = {}, {}, []
            for k, (group, shard, ids, mult, double, graph) in enumerate(held):
                p, m = graph.arrays(f"g{k}_")
                parts |= p | {f"g{k}_ids": ids, f"g{k}_mult": mult, f"g{k}_double": double.reshape(-1)}
                meta |= m
                rows.append((group, shard, k, len(ids)))
            name = f"graphs-{held[0][0] & (2**64 - 1):016x}-{held[0][1]:06d}.bin"
            path = put(folder, name, arrays(parts, meta))
            cols = [pa.array(x) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([cols[0].cast(pa.int64()), cols[1].cast(pa.int32()), pa.array([path] * len(rows)), cols[2].cast(pa.int32()), cols[3].cast(pa.int64())], names=["grp", "shard", "path", "g", "n"])

        def work(t: pa.Table):
            nonlocal size
            double, single = _unit(t.column("vec").to_pylist(), t.column("dim")[0].as_py())
            held.append((t.column("grp")[0].as_py(), t.column("shard")[0].as_py(), t.column("id").to_numpy(), t.column("mult").to_numpy(), double, Graph.build(single)))
            size += len(double)
            if size >= target:
                yield close()
                held.clear()
                size = 0

        yield from _groups(batches, ["grp", "shard"], work)
        if held:
            yield close()

    return run


def _neighbours(graph: Graph, double: np.ndarray, nodes: np.ndarray, own: np.ndarray, threshold: float, beam: int, audit: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified (query, node) pairs; own: a query's own place in the shard, or -1."""
    n, least, single = len(nodes), threshold - _NEAR, double.astype(np.float32)
    sample = np.unique(np.linspace(0, len(double) - 1, min(audit, len(double))).astype(int))
    truth = [np.flatnonzero(nodes @ double[i] >= threshold) for i in sample]  # not what only single precision lets in
    who, what = graph.within(single, least, beam)
    widest = min(n, beam * WIDEST)
    while True:
        found = np.zeros(len(double), bool)
        found[who[what == own[who]]] = True
        again = np.flatnonzero((own >= 0) & ~found)
        failed = any(not np.isin(t, what[who == i]).all() for i, t in zip(sample, truth, strict=True))
        if not (failed or len(again)):
            break
        if failed:
            again = np.arange(len(double))
        if beam >= widest:  # the graph doesn't lead there: compare with all of it
            a, b = np.nonzero(single[again] @ graph.vectors.T >= least)
            self_ = again[own[again] >= 0]
            a, b = np.concatenate([again[a], self_]), np.concatenate([b, own[self_]])
        else:
            beam = min(widest, beam * 2)
            a, b = graph.within(single[again], least, beam)
            a = again[a]
        both = np.unique(np.concatenate([who * n + what, a * n + b]))
        who, what = both // n, both % n
    inside = np.flatnonzero(own >= 0)
    if len(inside):  # a link between nodes of the shard holds in both directions
        query = np.full(n, -1)
        query[own[inside]] = inside
        back = (own[who] >= 0) & (query[what] >= 0)
        both = np.unique(np.concatenate([who * n + what, query[what[back]] * n + own[who[back]]]))
        who, what = both // n, both % n
    keep = np.zeros(len(who), bool)
    for s in range(0, len(who), 1 << 16):
        a, b = who[s : s + (1 << 16)], what[s : s + (1 << 16)]
        keep[s : s + (1 << 16)] = (np.einsum("nd,nd->n", double[a], nodes[b]) >= threshold) | (own[a] == b)
    return who[keep], what[keep]


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the smallest of its component, given edges between ids."""
    u, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    low = np.arange(len(u))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    m = np.flatnonzero(low != np.arange(len(u)))
    return u[m], u[low[m]]


def _ask(threshold: float, beam: int, audit: int, block: int):
    """Pairs of a graph and a block of another one's nodes: counts of links as (a, null, n), edges as (a, b, 0)."""

    def ask(path: str, g: int, other: str, other_g: int, number: int):
        f, q, dim = mapped(path), mapped(other), mapped(path).meta[f"g{g}_dim"]
        graph, ids, mult = Graph.read(f, f"g{g}_"), getattr(f, f"g{g}_ids"), getattr(f, f"g{g}_mult")
        nodes, queries = getattr(f, f"g{g}_double").reshape(-1, dim), getattr(q, f"g{other_g}_double").reshape(-1, dim)
        names = getattr(q, f"g{other_g}_ids")
        edges = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(number * block, min(len(names), (number + 1) * block), STEP):
            hi = min(len(names), lo + STEP, (number + 1) * block)
            own = np.arange(lo, hi) if (path, g) == (other, other_g) else np.full(hi - lo, -1)
            who, what = _neighbours(graph, queries[lo:hi], nodes, own, threshold, beam, max(1, -(-audit * STEP // block)))
            links = np.bincount(who, mult[what].astype(float), hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi]), pa.nulls(hi - lo, pa.int64()), pa.array(links)], names=["a", "b", "links"])
            away = ids[what] != names[lo:hi][who]
            a, b = _star(names[lo:hi][who[away]], ids[what[away]])
            edges = _star(np.concatenate([edges[0], a]), np.concatenate([edges[1], b]))  # at most one for each node
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1]), pa.array(np.zeros(len(edges[0]), np.int64))], names=["a", "b", "links"])

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "g", "other", "other_g", "block")), strict=True):
                yield from ask(*row)

    return run


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.98, shard: int = SHARD, block: int = BLOCK, beam: int = BEAM, audit: int = AUDIT) -> DataFrame:
    """(id, n_links, component_id, kept) per row of df.

    Rows with equal labels, not null, and vectors of one dimension are linked when their cosine is `threshold` or more.
    n_links counts the other rows linked directly, component_id is the smallest id reachable.  A row whose vector is null,
    empty, zero or holds a null or a value that isn't finite, or whose label or id is null, is linked with nothing and
    kept.  Rows with equal ids are rows of their own in n_links and share their component when their vectors link.
    Other columns are ignored.  An empty table gives an empty table.
    """
    spark = df.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    d = stored(d.mapInArrow(_clean, "id long, label string, dim int, ok boolean, d1 long, d2 long, vec binary"), "vectors")
    value = ["label", "dim", "d1", "d2"]
    node = d.where("ok").groupBy(*value).agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    node = stored(node.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered, so two are never taken for one
    sizes = node.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("grp", F.monotonically_increasing_id())
    sizes = stored(sizes.select("label", "dim", "grp", F.ceil(F.col("n") / shard).cast("int").alias("shards")), "sizes")
    dealt = node.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards")).cast("int"))
    place = dealt.select("grp", "shard", F.col("node").alias("id"), "mult", "vec", "dim").repartition(tasks, "grp", "shard").sortWithinPartitions("grp", "shard", "id")
    graphs = stored(place.mapInArrow(_build(scratch(spark, "graphs"), shard), "grp long, shard int, path string, g int, n long"), "graphs")
    other = graphs.select("grp", F.col("path").alias("other"), F.col("g").alias("other_g"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("block"))
    ask = graphs.select("grp", "path", "g").join(other, "grp").select("path", "g", "other", "other_g", "block")
    ask = ask.repartition(tasks, "path", "g", "other", "other_g", "block")
    found = stored(ask.mapInArrow(_ask(threshold, beam, audit, block), "a long, b long, links long"), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    comp = components(found.where("b is not null"))
    named = node.select("node", "id", *value).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named.join(links, F.col("node") == F.col("a")).select(*value, "id", "component", "links"), "named")
    smallest = stored(named.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    per = stored(named.join(smallest, "component").select(*value, "component_id", "links"), "per")
    # both sides are plain tables: adaptive execution splits the copies of one vector, and the rows that cannot link
    out = d.select("id", *(F.when(F.col("ok"), F.col(c)).alias(c) for c in value)).join(per, value, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
f AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS z FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id != y.vec_id WHERE x.z > 0 AND y.z > 0 AND list_dot_product(x.e, y.e) / (x.z * y.z) >= 0.98),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(m.b, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""
