"""Quality: a linear-chain conditional random field over the lines of a text.

A line (with a word in it) is described by binned shares of letters, symbols, capitals, repeats and so on, of its own and
of its neighbours.  The field labels each line good or bad; forward-backward gives each line's marginal, and a text's
quality is the mean of its lines' marginals of good, weighted by their lengths.  Both passes are scans of 2 x 2 matrices
over all lines of a block at once: a text's first line has a matrix of rank one, which forgets what came before.

Labels are known of texts only.  Lines start with their text's label; after each of `rounds` fits, lines of bad texts that
the field finds good are taken as good, but for each such text's worst line.
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

#: Labelled rows that are learnt from at most, chosen by a hash of their id.
MAX_ROWS = 5000
_BINS = np.array([0.0, 0.02, 0.06, 0.15, 0.35, 0.6])
_LENGTHS = np.array([1, 3, 8, 20, 60, 200])
_KINDS = {
    "upper": [*range(65, 91)], "digit": [*range(48, 58)], "symbol": [ord(c) for c in "#*$%&|<>@^~=+_/\\{}[]"], "bang": [33, 63],
    "stop": [ord(c) for c in ".,;:"], "quote": [ord(c) for c in "\"'()-"], "bar": [124],
}
_TABLES = np.zeros((len(_KINDS), 256), bool)
for _i, _k in enumerate(_KINDS.values()):
    _TABLES[_i, _k] = True


@dataclass
class Lines:
    """Lines that hold a word, or one empty line of a text without words: features (active columns), weights, owners."""

    active: np.ndarray  # lines x features per line, indices
    weight: np.ndarray
    owner: np.ndarray
    n: int

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([True], self.owner[1:] != self.owner[:-1]))

    @property
    def last(self) -> np.ndarray:
        return np.concatenate((self.owner[1:] != self.owner[:-1], [True]))


PER_LINE = len(_KINDS) + 4
WIDTH = len(_BINS) + 2
#: Own, previous and next line's features, and a bias.
FEATURES = 3 * PER_LINE * WIDTH + 1


def lines_of(b: tv.Block) -> Lines:
    start, end, owner = b.lines()
    words = np.searchsorted(b.start, end) - np.searchsorted(b.start, start)
    full = words > 0
    bare = np.ones(b.n, bool)
    bare[owner[full]] = False
    full |= bare[owner] & np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else full
    start, end, owner, words = start[full], end[full], owner[full], words[full]
    size = np.maximum(end - start, 1)
    shares = []
    for table in _TABLES:
        shares.append(tv.sums(table[b.data], start, end) / size)
    h = b.hashes()
    again = np.zeros(len(h), bool)
    for k in range(1, 5):
        again[k:] |= h[k:] == h[:-k]
    run = np.concatenate(([0], np.cumsum(again)))
    w0 = np.searchsorted(b.start, start)
    n = np.maximum(words, 1)
    inner = np.minimum(w0 + 1, w0 + words)
    shares.append((run[w0 + words] - run[inner]) / n)
    # words whose last byte is none of letters, digits, "." and ",": decorated words
    ends = b.data[b.end - 1] if len(b.end) else np.zeros(0, np.uint8)
    odd = np.concatenate(([0], np.cumsum(_TABLES[2][ends] | _TABLES[3][ends])))
    shares.append((odd[w0 + words] - odd[w0]) / n)
    bins = [np.where(x > 0, np.searchsorted(_BINS, x, "left"), 0) for x in shares]
    bins += [np.searchsorted(_LENGTHS, words, "right"), np.searchsorted(np.array([2, 4, 6, 9, 14, 30]), size / n, "right")]
    own = np.stack(bins, axis=1) + np.arange(PER_LINE) * WIDTH
    fresh = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    before, after = np.full_like(own, -1), np.full_like(own, -1)
    before[1:][~fresh[1:]] = own[:-1][~fresh[1:]] + PER_LINE * WIDTH
    after[:-1][~fresh[1:]] = own[1:][~fresh[1:]] + 2 * PER_LINE * WIDTH
    active = np.concatenate([own, before, after, np.full((len(own), 1), FEATURES - 1)], axis=1)
    return Lines(active, np.where(words > 0, end - start, 1).astype(float), owner, b.n)


def _scan(m: np.ndarray) -> np.ndarray:
    """Running products m[0] ... m[t] of 2 x 2 matrices, each scaled to a largest entry of 1."""
    m, step = m.copy(), 1
    while step < len(m):
        x = m[:-step] @ m[step:]
        m[step:] = x / x.max(axis=(1, 2), keepdims=True)
        step *= 2
    return m


@dataclass
class Model:
    """weights: of `good` over `bad` per feature; trans[i, j]: from label i to j."""

    weights: np.ndarray
    trans: np.ndarray

    def to_bytes(self) -> bytes:
        return np.concatenate([self.trans.reshape(-1), self.weights]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        x = np.frombuffer(raw, "<f8")
        return cls(x[4:], x[:4].reshape(2, 2))

    def passes(self, x: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward messages and the matrices of all lines."""
        w = np.append(self.weights, 0.0)  # index -1: no neighbour
        good = w[x.active].sum(axis=1) / 2
        emit = np.exp(np.clip(np.stack([-good, good], axis=1), -30, 30))
        m = np.exp(self.trans)[None] * emit[:, None, :]
        m[x.first] = emit[x.first][:, None, :]
        m /= m.max(axis=(1, 2), keepdims=True)
        alpha = _scan(m)[:, 0, :]
        n = np.ones_like(m)
        n[:-1][~x.last[:-1]] = m[1:][~x.last[:-1]]
        beta = np.transpose(_scan(np.transpose(n[::-1], (0, 2, 1))), (0, 2, 1))[::-1].sum(axis=2)
        return alpha / alpha.sum(axis=1, keepdims=True), beta / beta.sum(axis=1, keepdims=True), m

    def marginals(self, x: Lines) -> np.ndarray:
        """Each line's probability of being good."""
        if not len(x.owner):
            return np.zeros(0)
        a, b, _ = self.passes(x)
        p = a * b
        return p[:, 1] / p.sum(axis=1)

    def score(self, block: tv.Block) -> np.ndarray:
        x = lines_of(block)
        good = self.marginals(x)
        return np.bincount(x.owner, good * x.weight, block.n) / np.maximum(np.bincount(x.owner, x.weight, block.n), 1e-300)


def _fit(x: Lines, y: np.ndarray, start: Model, steps: int, ridge: float) -> Model:
    """Maximum conditional likelihood by Adam over all lines at once."""
    theta = np.concatenate([start.weights, start.trans.reshape(-1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.flatnonzero(~x.first)
    seen = np.bincount(y[inner - 1] * 2 + y[inner], minlength=4).astype(float)
    hot, cols = x.active >= 0, x.active
    for t in range(1, steps + 1):
        model = Model(theta[:-4], theta[-4:].reshape(2, 2))
        a, b, mat = model.passes(x)
        p = a * b
        good = p[:, 1] / p.sum(axis=1)
        g = np.bincount(cols[hot], np.broadcast_to((y - good)[:, None], cols.shape)[hot], FEATURES)
        pair = a[inner - 1][:, :, None] * mat[inner] * b[inner][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        grad = (np.concatenate([g, seen - pair.sum(axis=0).reshape(-1)]) - ridge * theta) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def train(texts: list[str | None], labels: list[int], rounds: int = 3, steps: int = 60, ridge: float = 1.0) -> Model:
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        w = np.zeros(FEATURES)
        w[-1] = np.log(p / (1 - p))
        return Model(w, np.zeros((2, 2)))
    parts, at = [], 0
    for b in tv.blocks(pa.array([t or "" for t in texts], pa.large_string())):
        x = lines_of(b)
        parts.append((x.active, x.weight, x.owner + at))
        at += b.n
    x = Lines(*(np.concatenate([p[i] for p in parts]) for i in range(3)), at)
    line = y[x.owner]
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    for k in range(rounds):
        model = _fit(x, line, model, steps, ridge)
        if k < rounds - 1:
            good = model.marginals(x)
            worst = np.lexsort((good, x.owner))
            worst = worst[np.concatenate(([True], x.owner[worst][1:] != x.owner[worst][:-1]))]
            line = np.where(y[x.owner] == 1, 1, (good > 0.5).astype(np.int64))
            line[worst] = y[x.owner[worst]]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_rows: int = MAX_ROWS, parts: int = 5, part: int = 0) -> Model:
    """Learn in this process from at most `max_rows` labelled documents, none with crc32(id as text) mod `parts` equal to `part`."""
    return train(*collected(labelled(docs, labels, id_col, text_col, label_col, max_rows, parts, part)))


def fit_in_task(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_rows: int = MAX_ROWS, parts: int = 5, part: int = 0) -> Model:
    """As `fit`, in one task of an executor: the driver gets the weights only."""
    rows = labelled(docs, labels, id_col, text_col, label_col, max_rows, parts, part)
    return Model.from_bytes(learnt(rows, lambda texts, y: train(texts, y).to_bytes()))


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def _score(model: Model):
    def run(arrays: list[pa.Array]) -> list[np.ndarray]:
        parts = [model.score(b) for b in tv.blocks(arrays[0])]
        return [np.clip(np.concatenate(parts), 0, 1) if parts else np.zeros(0)]

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns and `score`, 0 to 1, of each whole text; a null or wordless text is one line without words."""
    return add_columns(docs, [text_col], SCORE, _score, model, keep=keep)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) per row.

    Labels are learnt from rows whose crc32(id as text) mod 5 isn't 0; a null id is held out null.  Without both labels to
    learn from, every line's probability is the smoothed share of label 1.  Rows with equal ids are scored one by one;
    other columns are ignored.
    """
    s = score(docs.select(id_col, text_col), fit_in_task(docs, labels, id_col, text_col, max_rows=max_rows), text_col, keep=[id_col])
    held = F.crc32(F.col(id_col).cast("string")) % 5 == 0
    return s.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
