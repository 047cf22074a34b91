"""MinHash near-duplicates: universal hash minima, banding, signature verification, star components.

1. One Arrow pass turns every text into its set of word shingles (64-bit hashes), a 128-bit digest of the set, and
   `bands * rows` minima of functions a*x + b modulo 2**32.
2. Documents with equal sets collapse into one representative: a group of exact copies costs one row from here on.
3. Representatives that agree on all minima of a band share a bucket.  A bucket is never expanded into pairs.  Each band
   picks its own centre of a bucket, and each member keeps its best centre by signature; these pairs are verified on the
   full sets and united.  What is left are buckets that span several components, and of them the stragglers: members of
   all but the bucket's largest component.
4. A bucket of up to `LARGE` members is compared inside one task, stragglers with members of other components by
   signature; rows that agree with another on `loose` of the minima or more meet again with their full sets, and the task
   verifies its pairs, best first, unless verified ones have united their components already.
   Larger buckets that share members form a hot group.  Its members are written once, in files of `CHUNK` rows in the
   shared folder, and its stragglers are a stated query set against all of them: each block of `ASK` stragglers reads the
   files one by one.  So rows grow with the members of buckets, whatever their size, and no pair of different components
   that shares a bucket is left out.
5. Components come from alternating large-star and small-star.

With 32 bands of 4 minima, a pair at a similarity of exactly 0.75 shares no bucket with probability 5e-6, and shows
fewer than 60 % equal minima with probability 1e-4; both fall steeply above 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textvec as tv
from cadenza.llm.arrow import trimmed
from cadenza.llm.components import components
from cadenza.llm.files import Mapped, arrays, put
from cadenza.session import drop, scratch, ship, stored

#: Buckets with more members than this become parts of hot groups.
LARGE = 1024
#: Rows of a file of a hot group, and stragglers that are compared with a group's files together.
CHUNK, ASK = 1024, 512
#: A list of candidate ids up to this length (8 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function over a set of 64-bit hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * a + b).min(axis=0), out=out)
    return out


def document_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a batch."""
    for block in tv.blocks(column):
        g, bounds = tv.shingles(block.hashes(), block.offsets, k)
        for i in range(block.n):
            s = np.sort(g[bounds[i] : bounds[i + 1]])
            yield block.first + i, s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _digest(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return _signed(int(s.sum(dtype=np.uint64)))


SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("keys", pa.binary())])
SIGNED_DDL = "id long, n long, d1 long, d2 long, sig binary, keys binary"


def _sign(k: int, bands: int, rows: int, seed: int):
    def run(batches):
        a, b = _coefficients(bands * rows, seed)
        salt = tv.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            out = {f.name: [] for f in SIGNED}
            out["id"] = batch.column(0)
            for _, s in document_sets(batch.column(1), k):
                out["n"].append(len(s))
                out["d1"].append(_digest(s))
                with np.errstate(over="ignore"):
                    out["d2"].append(_signed(int(tv.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))))
                if not len(s):
                    out["sig"].append(None)
                    out["keys"].append(None)
                    continue
                m = minima(s, a, b)
                key = salt.copy()
                for row in m.reshape(bands, rows).T.astype(np.uint64):
                    key = tv.mix(key + row)
                out["sig"].append((m >> np.uint32(16)).astype(np.uint16).tobytes())
                out["keys"].append(key.tobytes())
            yield pa.RecordBatch.from_arrays([out["id"].cast(pa.int64()), *(pa.array(out[f.name], f.type) for f in list(SIGNED)[1:])], schema=SIGNED)

    return run


def _unpack_keys(batches):
    for batch in batches:
        keys = batch.column("keys")
        per = len(keys[0].as_py()) // 8 if len(keys) else 1
        flat = np.frombuffer(b"".join(keys.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column("id").to_numpy(), per)), pa.array(np.tile(np.arange(per, dtype=np.int32), len(keys)))], names=["key", "id", "band"])


def _sets(k: int):
    def run(batches):
        for batch in batches:
            sets = [s for _, s in document_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "d1", "blob"])

    return run


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=-1)


def _estimate(batches):
    """Minima on which the two signatures agree."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16) for c in ("sig_a", "sig_b"))
        n = max(1, batch.num_rows)
        same = _agree(x.reshape(n, -1), y.reshape(n, -1)) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same.astype(np.int32))], names=["a", "b", "same"])


def _linked(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """Is the Jaccard similarity of two sorted sets num / den or more?"""
    if len(p) > len(q):
        p, q = q, p
    if len(p) * den < num * len(q):
        return False
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return den * both >= num * (len(p) + len(q) - both)


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(batch.column("blob_a"), batch.column("blob_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches, columns: list[str], work):
    """work(table) of each run of rows with equal `columns`, which are sorted; one group is held at a time."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = np.stack([batch.column(c).to_numpy() for c in columns])
        edges = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(mark[:, lo].tolist())
            if rest and now != last:
                yield from work(pa.Table.from_batches(rest))
                rest = []
            last = now
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield from work(pa.Table.from_batches(rest))


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _candidates(t: pa.Table, loose: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one bucket that may be linked, and their agreement.

    One at least is a straggler, the components differ, the signatures agree on `loose` minima or more, and the bucket is
    the first that they share.
    """
    lone, comp = t.column("straggler").to_numpy(), t.column("comp").to_numpy()
    sig, keys = _matrix(t.column("sig"), np.uint16), _matrix(t.column("keys"), np.int64)
    band = int(np.argmax(keys[0] == t.column("key")[0].as_py()))
    none = np.zeros(0, np.int64)
    left, right, agree = [none], [none], [none]
    for x in np.flatnonzero(lone):
        hit = np.flatnonzero((comp != comp[x]) & (~lone | (np.arange(len(lone)) > x)))
        same = _agree(sig[hit], sig[x])
        hit, same = hit[same >= loose], same[same >= loose]
        first = ~(keys[hit, :band] == keys[x, :band]).any(axis=1)
        left.append(np.full(int(first.sum()), x))
        right.append(hit[first])
        agree.append(same[first])
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


def _survivors(loose: int):
    """The rows of each bucket that have a candidate."""

    def work(t: pa.Table):
        left, right, _ = _candidates(t, loose)
        if len(left):
            yield from t.take(pa.array(np.unique(np.concatenate([left, right])))).to_batches()

    return lambda batches: _groups(batches, ["key"], work)


class _Union:
    """Components that links have united, and the links that did so."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)
        self.links.append((x, y))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.links:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*self.links, strict=True)], names=["a", "b"])


def _settle(loose: int, num: int, den: int):
    """Links between the components of each bucket: its candidates, best first, verified unless already united."""

    def work(t: pa.Table):
        left, right, agree = _candidates(t, loose)
        comp, blobs = t.column("comp").to_pylist(), t.column("blob")
        sets: dict[int, np.ndarray] = {}
        done = _Union()
        for k in np.argsort(-agree, kind="stable"):
            a, b = int(left[k]), int(right[k])
            if done.root(comp[a]) == done.root(comp[b]):
                continue
            for x in (a, b):
                if x not in sets:
                    sets[x] = np.frombuffer(blobs[x].as_py(), np.uint64)
            if _linked(sets[a], sets[b], num, den):
                done.join(comp[a], comp[b])
        yield from done.batches()

    return lambda batches: _groups(batches, ["key"], work)


def _write_chunks(folder: str):
    """Files of a hot group's members; returns one row for each."""

    def work(t: pa.Table):
        grp, j = t.column("grp")[0].as_py(), t.column("j")[0].as_py()
        blobs = t.column("blob").to_pylist()
        parts = {c: t.column(c).to_numpy() for c in ("id", "comp")} | {"straggler": t.column("straggler").to_numpy().astype(np.uint8)}
        parts |= {"sig": _matrix(t.column("sig"), np.uint16).reshape(-1), "set": np.frombuffer(b"".join(blobs), np.uint64), "edge": np.cumsum([0, *(len(x) // 8 for x in blobs)])}
        put(folder, _chunk(grp, j), arrays(parts, {}))
        yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([j], pa.int32()), pa.array([len(blobs)], pa.int64())], names=["grp", "j", "rows"])

    return lambda batches: _groups(batches, ["grp", "j"], work)


def _chunk(grp: int, j: int) -> str:
    return f"group-{grp & (2**64 - 1):016x}-{j:06d}.bin"


def _ask(folder: str, loose: int, num: int, den: int):
    """Links between components, of each block of stragglers with all members of their hot group."""

    def work(t: pa.Table):
        ids, comp, sig, done = t.column("id").to_numpy(), t.column("comp").to_pylist(), _matrix(t.column("sig"), np.uint16), _Union()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("blob").to_pylist()]
        size = np.array([len(x) for x in sets])
        grp = t.column("grp")[0].as_py()
        for j in range(t.column("chunks")[0].as_py()):
            f = Mapped(f"{folder}/{_chunk(grp, j)}")
            other, lone = f.sig.reshape(len(f.id), -1), f.straggler > 0
            per = np.diff(f.edge)
            for x in range(len(ids)):
                low, high = np.minimum(per, size[x]), np.maximum(per, size[x])
                hit = np.flatnonzero((f.comp != comp[x]) & (~lone | (f.id > ids[x])) & (low * den >= num * high))
                same = _agree(other[hit], sig[x])
                hit, same = hit[same >= loose], same[same >= loose]
                for y in hit[np.argsort(-same, kind="stable")].tolist():
                    c = int(f.comp[y])
                    if done.root(comp[x]) != done.root(c) and _linked(sets[x], f.set[f.edge[y] : f.edge[y + 1]], num, den):
                        done.join(comp[x], c)
        yield from done.batches()

    return lambda batches: _groups(batches, ["grp", "i"], work)


def _spans(buckets: DataFrame, comp: DataFrame, large: int) -> DataFrame:
    """(key, id, comp, straggler, hot): the rows of buckets that span components, once each."""
    rows = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    by = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    by = by.groupBy("key").agg(F.count("*").alias("n"), F.sum("c").alias("m"), F.max(F.struct("c", F.negative("comp").alias("k"))).alias("top")).where("n > 1")
    by = by.select("key", F.negative("top.k").alias("major"), (F.col("m") > large).alias("hot"))
    return stored(rows.join(by, "key").select("key", "id", "comp", (F.col("comp") != F.col("major")).alias("straggler"), "hot"), "spans")


def _hot_links(spans: DataFrame, full: DataFrame, tasks: int, loose: int, num: int, den: int) -> DataFrame | None:
    """(a, b): links between the components of hot groups; None if there is no such group.  full: (id, sig, blob)."""
    spark = spans.sparkSession
    hot = spans.where("hot")
    if hot.isEmpty():
        return None
    centre = hot.groupBy("key").agg(F.min("id").alias("c")).hint("rebalance")  # so that the join below can be split
    group = components(hot.join(centre, "key").select(F.col("id").alias("a"), F.col("c").alias("b")))
    rows = stored(hot.select("id", "comp").distinct().hint("rebalance").join(group.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id"), "hot")
    by = rows.groupBy("grp", "comp").agg(F.count("*").alias("c"))
    by = by.groupBy("grp").agg(F.sum("c").alias("m"), F.max(F.struct("c", F.negative("comp").alias("k"))).alias("top"))
    by = stored(by.select("grp", F.negative("top.k").alias("major"), F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"), F.ceil((F.col("m") - F.col("top.c")) / ASK).cast("int").alias("asks")), "groups")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = rows.join(by, "grp").where("asks > 0").withColumn("straggler", F.col("comp") != F.col("major"))
    rows = stored(rows.select("grp", "chunks", own("chunks").alias("j"), own("asks").alias("i"), "straggler", "id", "comp").join(full, "id"), "members")
    folder = scratch(spark, "hot")
    place = rows.select("grp", "j", "id", "comp", "straggler", "sig", "blob").repartition(tasks, "grp", "j").sortWithinPartitions("grp", "j")
    stored(place.mapInArrow(_write_chunks(folder), "grp long, j int, rows long"), "chunks")
    ask = rows.where("straggler").select("grp", "i", "chunks", "id", "comp", "sig", "blob").repartition(tasks, "grp", "i").sortWithinPartitions("grp", "i")
    return stored(ask.mapInArrow(_ask(folder, loose, num, den), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: Fraction = Fraction(3, 4), bands: int = 32, rows: int = 4, loose: float = 0.60, seed: int = 1, large: int = LARGE) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document: its near-duplicate group, named by the group's smallest id.

    Documents are linked when their sets of `shingle`-word windows (A-Z lower-cased; the whole sequence when a document
    has fewer words) have a Jaccard similarity of `threshold` or more, confirmed on the full sets; groups are connected
    components of links.  A null or wordless text has an empty set, is linked with nothing, and is kept.  Rows with equal
    ids are one document, linked where any of its texts is; each comes back, with the number of its own shingles.  A row
    with a null id takes the label of documents with an equal set (and isn't kept), or else null (and is kept).  Other columns are ignored, whatever
    their names.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(d.mapInArrow(trimmed(_sign(shingle, bands, rows, seed)), SIGNED_DDL).withColumn("tag", F.monotonically_increasing_id()), "signed")
    same = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "tag"))).alias("first"), F.count("*").alias("c"))
    same = stored(same.where("c > 1").select("n", "d1", "d2", F.col("first.id").alias("rep"), F.col("first.tag").alias("first")), "same")
    chosen = F.expr("n > 0 and id is not null") & F.coalesce(F.col("tag") == F.col("first"), F.lit(True))
    named = signed.join(same, ["n", "d1", "d2"], "left").withColumn("chosen", chosen)
    keep = lambda c: F.when(F.col("chosen"), F.col(c)).alias(c)
    named = stored(named.select("id", "n", "d1", "d2", F.coalesce("rep", "id").alias("rep"), "chosen", keep("sig"), keep("keys")), "named")
    drop(signed)
    reps = named.where("chosen")
    keyed = reps.select("id", "keys").mapInArrow(_unpack_keys, "key long, id long, band int")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    sigs = reps.select("id", "sig")

    ids = stored(buckets.select("id").distinct(), "candidates")
    listed = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = d.join(listed, "id", "left_semi").mapInArrow(trimmed(_sets(shingle)), "id long, d1 long, blob binary")
    sets = stored(sets.dropDuplicates(["id", "d1"]), "sets")
    num, den = threshold.numerator, threshold.denominator

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.distinct().join(sets.select(F.col("id").alias("b"), F.col("blob").alias("blob_b")), "b")
        x = x.join(sets.select(F.col("id").alias("a"), F.col("blob").alias("blob_a")), "a").select("a", "b", "blob_a", "blob_b")
        return stored(x.mapInArrow(_verify(num, den), "a long, b long"), "links")

    floor = int(np.ceil(loose * bands * rows))
    centre = buckets.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("c"))
    star = buckets.join(centre, "key").where("id != c").select(F.col("id").alias("a"), F.col("c").alias("b")).distinct()
    star = star.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    star = star.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimate, "a long, b long, same int").where(F.col("same") >= floor)
    star = star.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
    comp = components(verified(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    spans = _spans(buckets.select("key", "id"), comp, large)
    rest = spans.where("not hot").select("key", "id", "comp", "straggler").join(reps.select("id", "d1", "sig", "keys"), "id")
    rest = rest.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_survivors(floor), rest.schema)
    rest = stored(rest, "survivors").join(sets, ["id", "d1"]).repartition(tasks, "key").sortWithinPartitions("key")
    rest = stored(rest.mapInArrow(_settle(floor, num, den), "a long, b long"), "links")
    hot = _hot_links(spans, reps.select("id", "d1", "sig").join(sets, ["id", "d1"]), tasks, floor, num, den)
    more = components(rest if hot is None else rest.union(hot))  # between components: few, and none of them hot
    out = named.select("id", "n", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("first"))
    out = out.join(more, F.col("first") == F.col("node"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
