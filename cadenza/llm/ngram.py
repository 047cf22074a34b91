"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Level 1 holds the words: their 64-bit hashes in ascending order (a word's id is its place), and their counts.  Level n > 1
holds the n-grams: `pointers` gives, for each context (the place of its first n - 1 words in level n - 1) in ascending
order, where its successors begin, and the successors' word ids lie in that range in ascending order, coded as
context number * words + id, which makes the whole level one monotone sequence.  A lookup goes from the context to its
range and searches the word's successor there.  An n-gram carries its smoothed log10 probability and, below the highest
level, its context's back-off weight, quantised to 16 bits.

Probabilities are interpolated with Dirichlet priors, P(w | c) = (count(c w) + m * P(w | shorter c)) / (count(c) + m); words
have absolute discounting, and the discounted mass is that of one unknown word.  A context's weight m / (count(c) + m)
depends on its own count only, so every level is built in one pass: counted per task, combined per shard, written.

A level's n-grams are dealt to shards by a hash of the whole n-gram, so that neither a frequent context nor a frequent
word makes a large shard; the number of shards follows the number of tokens.  Workers map the files of the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import eliasfano as ef
from cadenza.llm import textvec as tv
from cadenza.llm.arrow import trimmed
from cadenza.llm.files import arrays, mapped, put
from cadenza.session import scratch, ship, stored

#: The end of a text, as a word's hash; it also stands before a text's first word.
END = np.uint64(0)
ORDER = 3
#: Prior strength by order, from 2 up, chosen by the likelihood of held-out texts (README).
PRIOR = (1000.0, 10.0)
#: N-grams of the highest order (from 3 up) seen less often are left to the order below, unless `least` says otherwise: with
#: 1 all are kept.  What is left out stays in its context's count, so that context's probabilities then sum to less than 1.
LEAST = 2
SHARD_TOKENS = 4_000_000
FLUSH = 3_000_000
#: Bytes of text that a lookup takes together.
BLOCK_BYTES = 3 << 20
#: Tokens that are looked up together at most; longer texts are taken in parts.
PART = 1 << 19
_STEP = 16.0 / 65535
_U = np.uint64


@dataclass
class Level:
    """Files in order; `base` is the place of each file's first n-gram in the level."""

    paths: list[str]
    base: np.ndarray  # one more than paths

    @property
    def n(self) -> int:
        return int(self.base[-1])


@dataclass
class Trie:
    tokens: int
    words: int
    discount: float
    prior: tuple[float, ...]
    levels: list[Level] = field(default_factory=list)

    @property
    def order(self) -> int:
        return len(self.levels)


def _quantise(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-x / _STEP), 0, 65535).astype(np.uint16)


def _value(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * -_STEP


def _codec(f, name: str = "") -> ef.EliasFano:
    if (key := f"_{name}codec") not in f.__dict__:
        f.__dict__[key] = ef.EliasFano(*(getattr(f, name + x) for x in ("low", "vector", "ones")), *(f.meta[name + x] for x in ("n", "width", "first", "top")))
    return f.__dict__[key]


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _gram_shard(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return ((tv.mix(context.astype(_U) * _U(0x9E3779B97F4A7C15) + word.astype(_U)) >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of an ascending array: only values that are there cost anything."""
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(x[a]), a, b


def find_words(t: Trie, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (or -1) and counts (or 0) of ascending hashes."""
    level = t.levels[0]
    ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
    for k, a, b in _runs(_word_shard(h, len(level.paths))):
        f = mapped(level.paths[k])
        at = _codec(f).find(h[a:b])
        ok = at >= 0
        ids[a:b][ok] = at[ok] + level.base[k]
        counts[a:b][ok] = f.counts[at[ok]]
    return ids, counts


def counts_of(t: Trie, ids: np.ndarray) -> np.ndarray:
    """Counts of ids in any order."""
    level = t.levels[0]
    out = np.empty(len(ids), np.int64)
    shard = np.searchsorted(level.base, ids, "right") - 1
    order = np.argsort(shard.astype(np.uint16) if len(level.paths) <= 1 << 16 else shard, kind="stable")
    for k, a, b in _runs(shard[order]):
        m = order[a:b]
        out[m] = mapped(level.paths[k]).counts[ids[m] - level.base[k]]
    return out


def find_grams(t: Trie, n: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in level n (or -1), quantised probabilities, and quantised weights of the n-grams as contexts."""
    level, contexts = t.levels[n - 1], t.levels[n - 2].n + 1
    place, prob, weight = np.full(len(word), -1, np.int64), np.zeros(len(word), np.uint16), np.zeros(len(word), np.uint16)
    shard = _gram_shard(context, word, len(level.paths))
    if len(level.paths) * contexts < 1 << 63:
        order = np.argsort(shard * contexts + context)
    else:
        order = np.lexsort((context, shard))
    for k, a, b in _runs(shard[order]):
        if level.base[k] == level.base[k + 1]:
            continue
        f, m = mapped(level.paths[k]), order[a:b]
        c = context[m]  # ascending
        new = np.concatenate(([True], c[1:] != c[:-1]))
        number = _codec(f, "contexts_").find(c[new])
        begin, end = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        held = np.flatnonzero(number >= 0)
        begin[held], end[held] = (x.astype(np.int64) for x in _codec(f, "pointers_").access_pairs(number[held]))
        own = np.cumsum(new) - 1
        there = np.flatnonzero(number[own] >= 0)
        m, own = m[there], own[there]
        at = _codec(f).find(number[own].astype(_U) * _U(t.words) + word[m].astype(_U), begin[own], end[own])
        hit = np.flatnonzero(at >= 0)
        m, at = m[hit], at[hit]
        place[m], prob[m] = at + level.base[k], f.prob[at]
        if "weight" in f.places:
            weight[m] = f.weight[at]
    return place, prob, weight


def word_logs(t: Trie, counts: np.ndarray) -> np.ndarray:
    unknown = t.discount * t.words / t.tokens
    return np.log10(np.where(counts > 0, np.maximum(counts - t.discount, 1e-9), max(unknown * t.tokens, 1e-9)) / t.tokens)


def _streams(block: tv.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens, each with its end, and where each document begins."""
    n = block.counts() + 1
    bounds = np.zeros(block.n + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    h = np.full(int(bounds[-1]), END, _U)
    word = np.ones(len(h), bool)
    word[bounds[1:] - 1] = False
    x = block.hashes()
    h[word] = np.where(x == END, _U(1), x)
    return h, bounds


@dataclass
class Walk:
    """What the trie knows of each token of a block: ids, counts, and the log10 probability with the longest context."""

    bounds: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    logs: np.ndarray
    places: np.ndarray  # in the highest level so far, of the n-gram that ends at the token


def walk(t: Trie, block: tv.Block) -> Walk:
    """All of a block at once."""
    h, bounds = _streams(block)
    return _walk(t, h, bounds, np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds)))


def walks(t: Trie, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, Walk]]:
    """(begin, skip, walk) of parts of at most `PART` tokens; of a walk's tokens the first `skip` belong to the part before."""
    number = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))  # a token's place in its document
    for begin in range(0, len(h), PART):
        lo = max(0, begin - t.order)
        end = min(len(h), begin + PART)
        yield begin, begin - lo, _walk(t, h[lo:end], bounds, number[lo:end])


def _walk(t: Trie, h: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> Walk:
    u, inverse = np.unique(h, return_inverse=True)
    ids, counts = (x[inverse] for x in find_words(t, u))
    logs = word_logs(t, counts)
    end_id = int(find_words(t, np.array([END]))[0][0])
    places, weights = ids, np.log10(t.prior[0] / (np.maximum(counts, 0) + t.prior[0])) if t.prior else np.zeros(len(h))
    for n in range(2, t.order + 1):
        context, weight = np.empty_like(places), np.empty(len(h))
        context[:1], weight[:1] = -1, 0.0
        context[1:], weight[1:] = places[:-1], weights[:-1]
        start = first == 0
        if n == 2:
            context[start] = end_id
            weight[start] = np.log10(t.prior[0] / (int(counts_of(t, np.array([end_id]))[0]) + t.prior[0])) if end_id >= 0 else 0
        else:
            context[start] = -1
        has = context >= 0
        ask = np.flatnonzero(has & (ids >= 0))
        place, prob, back = find_grams(t, n, context[ask], ids[ask])
        logs = np.where(has, logs + weight, logs)
        hit = place >= 0
        logs[ask[hit]] = _value(prob[hit])
        places = np.full(len(h), -1, np.int64)
        places[ask] = place
        weights = np.zeros(len(h))
        weights[ask] = _value(back)
    return Walk(bounds, ids, counts, logs, places)


class _Counter:
    """Counts of keys, of `keys` columns, in one task, combined when they grow; further columns follow from the key."""

    def __init__(self, keys: int = 1):
        self.keys, self.raw, self.held, self.size = keys, [], None, 0

    def add(self, *cols: np.ndarray) -> None:
        self.raw.append(cols)
        self.size += len(cols[0])

    def fold(self) -> None:
        """Combine what was added; `size` is then the number of distinct keys."""
        cols = [np.concatenate(x) for x in zip(*self.raw, strict=True)] if self.raw else []
        self.raw = []
        if len(cols) == 1:
            x = np.sort(cols[0])
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
            cols = [x[at], np.diff(np.append(at, len(x)))]
        elif cols:
            cols = combine([*cols, np.ones(len(cols[0]), np.int64)], self.keys)
        if cols:
            self.held = cols if self.held is None else combine([np.concatenate(x) for x in zip(self.held, cols, strict=True)], self.keys)
        self.size = len(self.held[0]) if self.held is not None else 0

    def take(self) -> list[np.ndarray] | None:
        self.fold()
        out, self.held, self.size = self.held, None, 0
        return out


def combine(cols: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Sum the last column by the first `keys`, ascending; those between are equal where these are."""
    order = np.argsort(cols[0]) if keys == 1 else np.lexsort((cols[1], cols[0]))
    by = [c[order] for c in cols[:keys]]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in by], axis=0)
    at = np.flatnonzero(new)
    return [*(k[at] for k in by), *(c[order[at]] for c in cols[keys:-1]), np.add.reduceat(cols[-1][order], at) if len(at) else cols[-1][:0]]


def _squeeze(cols: list[np.ndarray], keys: int) -> bytes:
    """Columns, ascending keys as differences, byte by byte apart, compressed."""
    parts = []
    for i, c in enumerate(cols):
        c = c.astype(np.int64)
        d = np.diff(c, prepend=np.int64(0)) if i < keys else c
        parts.append(d.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(cols[0]).to_bytes(8, "little"), *parts]))


def _unsqueeze(blob: bytes, columns: int, keys: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out = int.from_bytes(raw[:8], "little"), []
    for i in range(columns):
        d = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * i).reshape(8, n).T).view(np.int64).reshape(-1)
        out.append(np.cumsum(d) if i < keys else d)
    return out


def _emit(cols: list[np.ndarray], keys: int, shard: np.ndarray, shards: int):
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")  # so keys stay ascending
    for k, a, b in _runs(shard[order]):
        m = order[a:b]
        if len(m):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_squeeze([c[m] for c in cols], keys)], pa.binary())], names=["shard", "blob"])


def _count_words(shards: int):
    def run(batches):
        c = _Counter()

        def out():
            if cols := c.take():
                yield from _emit([cols[0].view(np.int64), cols[1]], 1, _word_shard(cols[0], shards), shards)

        for batch in batches:
            for block in tv.blocks(batch.column(0), BLOCK_BYTES):
                c.add(_streams(block)[0])
                if c.size > FLUSH:
                    c.fold()
                    if c.size > FLUSH // 2:
                        yield from out()
        yield from out()

    return run


def _write_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        k = table.column("shard")[0].as_py()
        cols = [_unsqueeze(b.as_py(), 2, 1) for b in table.column("blob")]
        h, n = combine([np.concatenate([c[0] for c in cols]).view(_U), np.concatenate([c[1] for c in cols])], 1)
        parts, meta = ef.encode(h)
        kind = np.uint32 if n.max() < 1 << 32 else np.uint64
        path = put(folder, f"words-{k:06d}.bin", arrays(parts | {"counts": n.astype(kind)}, meta))
        return pa.table({"shard": pa.array([k], pa.int32()), "path": [path], "n": [len(h)], "tokens": [int(n.sum())], "ones": [int((n == 1).sum())], "twos": [int((n == 2).sum())]})

    return run


def _packed(t: Trie, n: int) -> bool:
    """Can a context's place in level n - 1 and a word share one 64-bit key?"""
    return (t.levels[n - 2].n + 1) * (t.words + 1) < 1 << 63


def _count_grams(t: Trie, n: int, shards: int):
    """Counts of n-grams; from n = 3 up with the quantised probability of the order below, which the walk has found anyway."""

    def run(batches):
        packed = _packed(t, n)
        c = _Counter(1 if packed else 2)

        def out():
            if cols := c.take():
                a, b = (x.astype(np.int64) for x in ((cols[0] // _U(t.words), cols[0] % _U(t.words)) if packed else cols[:2]))
                yield from _emit([cols[0].view(np.int64), *cols[1:]], c.keys, _gram_shard(a, b, shards), shards)

        end_id = int(find_words(t, np.array([END]))[0][0])
        for batch in batches:
            for block in tv.blocks(batch.column(0), BLOCK_BYTES):
                h, bounds = _streams(block)
                new = np.zeros(len(h), bool)
                new[bounds[:-1]] = True
                for begin, skip, w in walks(t, h, bounds):
                    context = np.full_like(w.places, -1)
                    context[1:] = w.places[:-1]
                    context[new[begin - skip : begin - skip + len(context)]] = end_id if n == 2 else -1
                    context[:skip] = -1
                    ok = context >= 0
                    key = (context[ok].astype(_U) * _U(t.words) + w.ids[ok].astype(_U),) if packed else (context[ok], w.ids[ok])
                    c.add(*key, *((_quantise(w.logs[ok]),) if n > 2 else ()))
                    if c.size > FLUSH:
                        c.fold()
                        if c.size > FLUSH // 2:
                            yield from out()
        yield from out()

    return run


def _write_grams(t: Trie, n: int, folder: str, last: bool, least: int):
    def run(table: pa.Table) -> pa.Table:
        k = table.column("shard")[0].as_py()
        keys = 1 if _packed(t, n) else 2
        width = keys + 1 + (n > 2)
        cols = [_unsqueeze(b.as_py(), width, keys) for b in table.column("blob")]
        cols = combine([np.concatenate([c[i] for c in cols]) for i in range(width)], keys)
        count, below = cols[-1], cols[keys] if n > 2 else None
        if keys == 1:
            context = (cols[0].view(_U) // _U(t.words)).astype(np.int64)
            word = (cols[0].view(_U) % _U(t.words)).astype(np.int64)
        else:
            context, word = cols[:2]
        del cols
        if least > 1:
            some = count >= least
            context, word, count, below = context[some], word[some], count[some], below[some]
        new = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        held, number = context[begin], np.cumsum(new) - 1
        m = t.prior[n - 2]
        if n == 2:
            total, low = counts_of(t, held), 10.0 ** word_logs(t, counts_of(t, word))
        else:
            total, low = _totals(t, held), 10.0 ** _value(below)
        prob = np.log10((count + m * low) / (total[number] + m))
        parts, meta = ef.encode(number.astype(_U) * _U(t.words) + word.astype(_U))
        for name, x in (("contexts_", held), ("pointers_", np.append(begin, len(context)))):
            p, q = ef.encode(x, name)
            parts |= p
            meta |= q
        parts["prob"] = _quantise(prob)
        if not last:
            parts["weight"] = _quantise(np.log10(t.prior[n - 1] / (count + t.prior[n - 1])))
        path = put(folder, f"grams{n}-{k:06d}.bin", arrays(parts, meta))
        return pa.table({"shard": pa.array([k], pa.int32()), "path": [path], "n": [len(word)]})

    return run


def _totals(t: Trie, places: np.ndarray) -> np.ndarray:
    """Counts of ascending places of level 2 as contexts, which their weights give."""
    level, weight = t.levels[1], np.empty(len(places))
    for k, a, b in _runs(np.searchsorted(level.base, places, "right") - 1):
        weight[a:b] = _value(mapped(level.paths[k]).weight[places[a:b] - level.base[k]])
    return t.prior[1] * (10.0**-weight - 1)


def build(texts: DataFrame, text_col: str = "text", *, order: int = ORDER, prior: tuple[float, ...] = PRIOR, least: int = LEAST, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """A trie of the n-grams of the texts (null: empty), up to order 3.  Every text counts; nothing is sampled.

    With least=1 it has all of them; above that, trigrams seen less often are counted but not stored.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark = texts.sparkSession
    ship(spark)
    folder = scratch(spark, "trie")
    d = texts.select(F.col(text_col).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def level(rows: DataFrame, writer, schema: str) -> tuple[Level, list]:
        made = stored(rows.groupBy("shard").applyInArrow(writer, schema), "level").orderBy("shard").collect()  # one row per file
        return Level([r.path for r in made], np.concatenate(([0], np.cumsum([r.n for r in made]))).astype(np.int64)), made

    shards = max(1, tasks // 4)
    rows = d.mapInArrow(trimmed(_count_words(shards)), "shard int, blob binary")
    first, made = level(rows, _write_words(folder), "shard int, path string, n long, tokens long, ones long, twos long")
    if len(made) not in (0, shards):  # an empty shard has no file: its neighbour's range is its own
        paths = {r.shard: r for r in made}
        empty = put(folder, "words-empty.bin", arrays(ef.encode(np.zeros(0, _U))[0] | {"counts": np.zeros(0, np.uint32)}, ef.encode(np.zeros(0, _U))[1]))
        first = Level([paths[k].path if k in paths else empty for k in range(shards)], np.concatenate(([0], np.cumsum([paths[k].n if k in paths else 0 for k in range(shards)]))).astype(np.int64))
    tokens, ones, twos = (sum(getattr(r, x) for r in made) for x in ("tokens", "ones", "twos"))
    discount = min(0.9, ones / (ones + 2 * twos)) if ones else 0.5
    t = Trie(tokens, first.n, discount, prior[: order - 1], [first] if made else [])
    for n in range(2, (order if made else 0) + 1):
        shards = max(1, -(-tokens // shard_tokens))
        rows = d.mapInArrow(trimmed(_count_grams(t, n, shards)), "shard int, blob binary")
        new, made = level(rows, _write_grams(t, n, folder, n == order, least if n > 2 else 1), "shard int, path string, n long")
        if len(made) != shards:
            paths = {r.shard: r for r in made}
            new = Level([paths[k].path if k in paths else "" for k in range(shards)], np.concatenate(([0], np.cumsum([paths[k].n if k in paths else 0 for k in range(shards)]))).astype(np.int64))
        t.levels.append(new)
    return t


SCORES = "id long, n_tokens long, n_known long, base_score double, score double"


def _score(t: Trie):
    def run(batches):
        for batch in batches:
            parts = []
            for block in tv.blocks(batch.column(1), BLOCK_BYTES):
                h, bounds = _streams(block)
                known, logs, base = np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h))
                for begin, skip, w in walks(t, h, bounds) if t.levels else ():  # if nothing was learnt, one unknown word has all probability
                    part = slice(begin, begin + len(w.ids) - skip)
                    known[part], logs[part] = w.counts[skip:] > 0, w.logs[skip:]
                    base[part] = np.log10((w.counts[skip:] + 1) / (t.tokens + 1 * (t.words + 1)))
                parts.append((np.diff(bounds), *(np.add.reduceat(x, bounds[:-1], dtype=y) for x, y in ((known, np.int64), (base, float), (logs, float)))))
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(float)), pa.array(cols[3].astype(float))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(t: Trie, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per row, the scores being log10 probabilities of the whole text.

    A null text is empty: its only token is the end.  Null and repeated ids come back.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(trimmed(_score(t)), SCORES).withColumnRenamed("id", id_col)


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, parts: int = 7, part: int = 2, **how) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(id as text) mod `parts` isn't `part` (null ids are learnt)."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
    t = build(docs.where(~held), text_col, **how)
    s = score(t, docs, id_col, text_col)
    return s.select(id_col, held.alias("held_out"), "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")
