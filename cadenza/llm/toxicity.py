"""Toxicity: a bag of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5, with its boundaries) and of itself, so an unseen
misspelling shares most of its vectors with the word it disguises.  A window's score is the softmax of the mean of its
words, and a text's score is that of its most toxic window of `WINDOW` words (or of all its words, if fewer), so a few words
count in a text of any length.  Training starts from whole texts and goes on with each text's highest window.

Since averaging and the softmax's logit are linear, a trained model is one number per n-gram bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import textvec as tv
from cadenza.llm.arrow import add_columns
from cadenza.llm.learning import collected, labelled, learnt

BUCKETS = 1 << 17
DIM = 8
WINDOW = 3
#: Labelled rows that are learnt from at most, chosen by a hash of their id.
MAX_ROWS = 6000


def subwords(block: tv.Block, start: np.ndarray, end: np.ndarray, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's n-grams, word by word, and each word's range of them."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = end - start
    at = np.zeros(n + 1, np.int64)
    np.cumsum(size + 2, out=at[1:])
    data = np.full(int(at[-1]), 60, np.uint8)  # <word>
    data[at[1:] - 1] = 62
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(at[:-1] + 1, size) + inner] = block.data[np.repeat(start, size) + inner]
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.searchsorted(at, chars, "right") - 1
    edge = np.append(chars, len(data))
    owner, first, last = [np.arange(n)], [at[:-1]], [at[1:]]
    for k in range(low, high + 1):
        if len(chars) >= k:
            j = np.flatnonzero(word[: len(chars) - k + 1] == word[k - 1 :])
            owner.append(word[j])
            first.append(chars[j])
            last.append(edge[j + k])
    owner, first, last = (np.concatenate(x) for x in (owner, first, last))
    whole = tv.Block(0, n, data, at[:-1], at[1:], at[:-1], at[1:], np.arange(n + 1))
    bucket = (whole.span_hashes(first, last, True) % np.uint64(BUCKETS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=bounds[1:])
    return bucket[order], bounds


def best_windows(values: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the highest mean of `width` words in a row, and where that window begins and ends."""
    run = np.concatenate(([0.0], np.cumsum(values)))
    n = np.diff(offsets)
    take = np.minimum(n, width)
    per = np.where(n > 0, n - take + 1, 0)
    best, first = np.zeros(len(n)), offsets[:-1].copy()
    full = np.flatnonzero(per)
    if len(full):
        bounds = np.zeros(len(full) + 1, np.int64)
        np.cumsum(per[full], out=bounds[1:])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per[full]) + np.repeat(offsets[full], per[full])
        wide = np.repeat(take[full], per[full])
        mean = (run[at + wide] - run[at]) / wide
        top = np.maximum.reduceat(mean, bounds[:-1])
        hit = np.flatnonzero(mean == np.repeat(top, per[full]))
        which = np.searchsorted(bounds, hit, "right") - 1
        one = np.unique(which, return_index=True)[1]
        best[full], first[full] = top, at[hit[one]]
    return best, first, first + take


@dataclass
class Model:
    """A bucket's part of the logit, the bias, and the logit of a text without words."""

    weights: np.ndarray
    bias: float

    def to_bytes(self) -> bytes:
        return np.float64(self.bias).tobytes() + self.weights.astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        return cls(np.frombuffer(raw, "<f4", -1, 8), float(np.frombuffer(raw, "<f8", 1)[0]))

    def words(self, block: tv.Block) -> np.ndarray:
        """Every word's mean weight."""
        h = block.hashes()
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        bucket, bounds = subwords(block, block.start[one], block.end[one])
        value = np.add.reduceat(self.weights[bucket].astype(float), bounds[:-1]) / np.diff(bounds) if len(one) else np.zeros(0)
        return value[inverse]

    def score(self, block: tv.Block) -> np.ndarray:
        best, _, _ = best_windows(self.words(block), block.offsets)
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -30, 30)))


def _index(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers, the buckets of each distinct word, where they begin, and where each text begins."""
    hashes, offsets, known, names = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], []
    total, seen = 0, np.zeros(0, np.uint64)
    for b in tv.blocks(pa.array([t or "" for t in texts], pa.large_string())):
        h = b.hashes()
        hashes.append(h)
        offsets.append(b.offsets[1:] + total)
        total += len(h)
        u, one = np.unique(h, return_index=True)
        new = ~np.isin(u, seen, assume_unique=True)
        seen = np.union1d(seen, u[new])
        known.append(u[new])
        names += [b.data[b.start[i] : b.end[i]].tobytes() for i in one[new]]
    u, one = np.unique(np.concatenate(known), return_index=True)
    bucket, per = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(one), 10_000):
        words = pa.array([b" ".join(names[k] for k in one[i : i + 10_000])], pa.binary())
        b = next(tv.blocks(words))
        x, edges = subwords(b, b.start, b.end)
        bucket.append(x)
        per.append(np.diff(edges))
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(per))))
    return np.searchsorted(u, np.concatenate(hashes)).astype(np.int32), np.concatenate(bucket), bounds, np.concatenate(offsets)


def _highest(weights: np.ndarray, word: np.ndarray, bucket: np.ndarray, bounds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's highest window begins and ends; words and texts are taken in parts."""
    value = np.empty(len(bounds) - 1, np.float32)
    for i in range(0, len(value), 20_000):
        edge = bounds[i : i + 20_001]
        value[i : i + 20_000] = np.add.reduceat(weights[bucket[edge[0] : edge[-1]]], edge[:-1] - edge[0]) / np.diff(edge)
    first, last = offsets[:-1].copy(), offsets[1:].copy()
    for i in range(0, len(first), 200):
        edge = offsets[i : i + 201]
        _, a, b = best_windows(value[word[edge[0] : edge[-1]]], edge - edge[0])
        first[i : i + 200], last[i : i + 200] = a + edge[0], b + edge[0]
    return first, last


def train(texts: list[str | None], labels: list[int], seed: int = 1, warm: int = 6, epochs: int = 10, rate: float = 0.3, batch: int = 128) -> Model:
    """Fit embeddings and softmax by Adagrad: `warm` passes over random windows, then `epochs` over each text's highest.

    A text of label 1 counts for as many as make both labels weigh the same in the first phase, half as many later.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    word, bucket, bounds, offsets = _index(texts)
    if len(set(labels)) < 2 or not len(word):
        p = (y.sum() + 0.5) / (len(y) + 1.5)  # without evidence a text is no toxic one
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    per = np.diff(bounds)
    e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.7, (DIM, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    ge, gw, gc = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)

    def step(first: np.ndarray, last: np.ndarray, target: np.ndarray) -> None:
        nonlocal w, c
        size = last - first
        open_ = np.concatenate(([0], np.cumsum(size)))
        ids = word[np.arange(open_[-1]) - np.repeat(open_[:-1], size) + np.repeat(first, size)]
        doc, n = np.repeat(np.arange(len(first)), size), per[ids]
        begin = np.concatenate(([0], np.cumsum(n)))
        part = bucket[np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(bounds[ids], n)]
        vec = np.add.reduceat(e[part], begin[:-1], axis=0) / n[:, None]
        mean = np.add.reduceat(vec, open_[:-1], axis=0) / size[:, None]
        z = mean @ w + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(first)), target] -= 1
        p /= len(first)
        dv = np.repeat(((p @ w.T) / size[:, None])[doc] / n[:, None], n, axis=0)
        hit, back = np.unique(part, return_inverse=True)
        de = np.stack([np.bincount(back, dv[:, k], len(hit)) for k in range(DIM)], axis=1).astype(np.float32)
        ge[hit] += (de**2).sum(axis=1)
        e[hit] -= rate * de / np.sqrt(ge[hit])[:, None]
        dw, dc = mean.T @ p, p.sum(axis=0)
        gw[...] += dw**2
        gc[...] += dc**2
        w = (w - rate * 0.3 * dw / np.sqrt(gw)).astype(np.float32)
        c = (c - rate * 0.3 * dc / np.sqrt(gc)).astype(np.float32)

    n = np.diff(offsets)
    zero, one_ = np.flatnonzero((n > 0) & (y == 0)), np.flatnonzero((n > 0) & (y == 1))
    ratio = max(1.0, len(zero) / max(1, len(one_)))
    for epoch in range(warm + epochs):
        often = int(round(ratio if epoch < warm else max(1.0, ratio / 2)))
        order = rng.permutation(np.concatenate([zero, np.repeat(one_, often)]))
        if epoch >= warm:
            first, last = _highest(e @ (w[:, 1] - w[:, 0]), word, bucket, bounds, offsets)
            first, last = first[order], last[order]
        else:
            take = np.minimum(n[order], WINDOW)
            first = offsets[:-1][order] + np.floor(rng.random(len(order)) * (n[order] - take + 1)).astype(np.int64)
            last = first + take
        for i in range(0, len(order), batch):
            step(first[i : i + batch], last[i : i + batch], y[order[i : i + batch]])
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(c[1] - c[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_rows: int = MAX_ROWS, parts: int = 5, part: int = 0) -> Model:
    """Learn in this process from at most `max_rows` labelled documents, none with crc32(id as text) mod `parts` equal to `part`."""
    return train(*collected(labelled(docs, labels, id_col, text_col, label_col, max_rows, parts, part)))


def fit_in_task(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_rows: int = MAX_ROWS, parts: int = 5, part: int = 0) -> Model:
    """As `fit`, in one task of an executor: the driver gets the weights only."""
    rows = labelled(docs, labels, id_col, text_col, label_col, max_rows, parts, part)
    return Model.from_bytes(learnt(rows, lambda texts, y: train(texts, y).to_bytes()))


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def _score(model: Model):
    def run(arrays: list[pa.Array]) -> list[np.ndarray]:
        parts = [model.score(b) for b in tv.blocks(arrays[0])]
        return [np.concatenate(parts) if parts else np.zeros(0)]

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns and `score`, 0 to 1, of each whole text; a null or empty text gets the score of no evidence."""
    return add_columns(docs, [text_col], SCORE, _score, model, keep=keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) per row.

    Labels are learnt from rows whose crc32(id as text) mod 5 isn't 0.  A null id is held out null.  Without both labels to learn from,
    every score is the share of label 1, smoothed toward a third.  Rows with equal ids are scored one by one; other columns are ignored.
    """
    s = score(docs.select(id_col, text_col), fit_in_task(docs, labels, id_col, text_col, max_rows=max_rows), text_col, keep=[id_col])
    held = F.crc32(F.col(id_col).cast("string")) % 5 == 0
    return s.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def acceptable(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with docs' columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    kept = score(docs.toDF(*names), model, names[docs.columns.index(text_col)]).where(F.col("score") < threshold)
    return kept.select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))
