"""Hierarchical navigable small-world graphs in numpy, built and searched in lockstep over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M = 16
BUILD_BEAM = 48
BATCH = 256
SPARE = 4
#: (query, node) pairs whose links are followed together.
FRONT = 1 << 14
_NONE = np.int32(-1)


def _choose(sims: np.ndarray, pair: np.ndarray, most: int) -> np.ndarray:
    """Order of each row's candidates (best first, -inf: none): diverse ones, then the best of the rest; `most` at most.

    A candidate is diverse when it is nearer to the query than to any candidate chosen before it.
    """
    rows, n = sims.shape
    valid = np.isfinite(sims)
    near = np.full((rows, n), -np.inf, np.float32)
    chosen = np.zeros((rows, n), bool)
    count = np.zeros(rows, np.int64)
    for j in range(n):
        ok = valid[:, j] & (sims[:, j] > near[:, j]) & (count < most)
        chosen[:, j] = ok
        count += ok
        near[ok] = np.maximum(near[ok], pair[ok, j])
    key = np.where(chosen, 0, np.where(valid, 1, 2)) * n + np.arange(n)
    order = np.argsort(key, axis=1)[:, :most]
    return np.where(np.take_along_axis(valid, order, axis=1), order, -1)


@dataclass
class Layer:
    nodes: np.ndarray  # global numbers of its nodes, in order of insertion
    links: np.ndarray  # local numbers, -1: none
    degree: np.ndarray
    size: int = 0


def search(vectors: np.ndarray, layer: Layer, queries: np.ndarray, entry: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search in one layer: (local numbers, similarities), best first, and the visited flags."""
    q, n = len(queries), layer.size
    seen = np.zeros((q, n), bool)
    stamp = np.zeros((q, n), np.int32)
    ids = np.full((q, beam), _NONE)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    row = np.arange(q)
    ids[:, 0] = entry
    sims[:, 0] = np.einsum("qd,qd->q", queries, vectors[layer.nodes[entry]])
    done[:, 0] = False
    seen[row, entry] = True
    live = row
    while len(live):
        rank = np.argsort(done[live], axis=1, kind="stable")[:, :width]
        open_ = ~np.take_along_axis(done[live], rank, axis=1)
        at = np.take_along_axis(ids[live], rank, axis=1)
        done[live[:, None], rank] = True
        near = layer.links[np.where(open_, at, 0)]
        near = np.where(open_[:, :, None], near, -1).reshape(len(live), -1)
        who, what = np.nonzero(near >= 0)
        node = near[who, what]
        fresh = ~seen[live[who], node]
        who, node = who[fresh], node[fresh]
        number = np.arange(len(who), dtype=np.int32)
        stamp[live[who], node] = number
        one = stamp[live[who], node] == number
        who, node = who[one], node[one]
        if len(who):
            seen[live[who], node] = True
            value = np.einsum("nd,nd->n", queries[live[who]], vectors[layer.nodes[node]])
            per = np.bincount(who, minlength=len(live))
            place = np.arange(len(who)) - np.repeat(np.cumsum(per) - per, per)
            width_new = int(per.max())
            more_ids = np.full((len(live), width_new), _NONE)
            more_sims = np.full((len(live), width_new), -np.inf, np.float32)
            more_ids[who, place], more_sims[who, place] = node, value
            all_ids, all_sims = np.concatenate([ids[live], more_ids], axis=1), np.concatenate([sims[live], more_sims], axis=1)
            all_done = np.concatenate([done[live], more_ids < 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_sims, all_done))
        live = live[(~done[live]).any(axis=1)]
    return ids, sims, seen


class Graph:
    """`vectors` are unit vectors in single precision; layers[0] holds all of them."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(1 - rng.random(n)) / np.log(M)).astype(int)
        height = np.minimum(height, 5)
        layers = []
        for k in range(int(height.max()) + 1 if n else 1):
            nodes = np.flatnonzero(height >= k)
            layers.append(Layer(nodes, np.full((len(nodes), 2 * M if k == 0 else M), _NONE), np.zeros(len(nodes), np.int64)))
        g = cls(vectors, layers)
        at = [0] * len(layers)
        i = 0
        while i < n:
            j = min(n, i + min(BATCH, max(16, i)))
            batch = np.arange(i, j)
            new = [np.searchsorted(x.nodes, batch[height[batch] >= k]) for k, x in enumerate(layers)]
            entries = g._descend(vectors[batch], stop=0) if layers[0].size else None
            for k in reversed(range(len(layers))):
                if len(new[k]):
                    own = np.flatnonzero(height[batch] >= k)
                    g._insert(k, new[k], None if entries is None or layers[k].size == 0 else entries[k][own])
                at[k] += len(new[k])
            for k, x in enumerate(layers):
                x.size = at[k]
            i = j
        g._repair()
        return g

    def _repair(self) -> None:
        """Give every node that no path leads to a link from the nearest node that has one and room for it.

        Pruning full lists can leave a node without a link to it.  Lists of the lowest layer have spare places for this.
        """
        x = self.layers[0]
        x.links = np.concatenate([x.links, np.full((len(x.links), SPARE), _NONE)], axis=1)
        while x.size:
            reached = np.zeros(x.size, bool)
            for k in range(len(self.layers)):  # a search can enter at any node of a higher layer
                reached[self.layers[k].nodes if k else [0]] = True
            front = np.flatnonzero(reached)
            while len(front):
                near = np.unique(x.links[front])
                near = near[near >= 0]
                front = near[~reached[near]]
                reached[front] = True
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            lost = lost[:BATCH]
            ids, sims, _ = search(self.vectors, x, self.vectors[lost], self._descend(self.vectors[lost], stop=0)[0], min(BUILD_BEAM, x.size))
            for node, near in zip(lost.tolist(), ids.tolist(), strict=True):
                for v in near:
                    free = np.flatnonzero(x.links[v] < 0) if v >= 0 and reached[v] else []
                    if len(free):
                        x.links[v, free[0]] = node
                        break
                else:  # all lists near it are full: widen all
                    x.links = np.concatenate([x.links, np.full((len(x.links), SPARE), _NONE)], axis=1)
                    x.links[next((v for v in near if v >= 0 and reached[v]), 0), -SPARE] = node

    def _descend(self, queries: np.ndarray, stop: int) -> list[np.ndarray]:
        """An entry point in every layer for each query: greedily, from the highest layer that has nodes."""
        out: list[np.ndarray] = [np.zeros(len(queries), np.int64) for _ in self.layers]
        node = None
        for k in reversed(range(stop, len(self.layers))):
            x = self.layers[k]
            if not x.size:
                continue
            entry = np.zeros(len(queries), np.int64) if node is None else np.searchsorted(x.nodes[: x.size], node)
            out[k] = entry
            if k > stop:
                ids, _, _ = search(self.vectors, x, queries, entry, 4, 1)
                node = x.nodes[ids[:, 0]]
        return out

    def _insert(self, k: int, new: np.ndarray, entry: np.ndarray | None) -> None:
        x, v = self.layers[k], self.vectors
        own = v[x.nodes[new]]
        inner = own @ own.T
        np.fill_diagonal(inner, -np.inf)
        ids, sims = np.broadcast_to(new, inner.shape), inner.astype(np.float32)
        if entry is not None:
            got, value, _ = search(v, x, own, entry, BUILD_BEAM)
            ids, sims = np.concatenate([got, ids], axis=1), np.concatenate([value, sims], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        vec = v[x.nodes[np.maximum(ids, 0)]]
        pick = _choose(sims, vec @ vec.transpose(0, 2, 1), M)
        width = pick.shape[1]
        x.links[new, :width] = np.where(pick >= 0, np.take_along_axis(ids, np.maximum(pick, 0), axis=1), -1)
        x.degree[new] = (pick >= 0).sum(axis=1)
        a, b = np.nonzero(x.links[new, :width] >= 0)
        self._back(x, x.links[new[a], b], new[a])

    def _back(self, x: Layer, to: np.ndarray, extra: np.ndarray) -> None:
        """Add links from `to` to `extra`; a full list keeps its diverse and best ones."""
        known = (x.links[to] == extra[:, None]).any(axis=1)
        order = np.argsort(to[~known], kind="stable")
        to, extra = to[~known][order], extra[~known][order]
        if not len(to):
            return
        u, first, per = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, per)
        cap = x.links.shape[1]
        room = x.degree[u] + per <= cap
        easy = np.repeat(room, per)
        x.links[to[easy], x.degree[to[easy]] + place[easy]] = extra[easy]
        x.degree[u[room]] += per[room]
        hard = u[~room]
        step = 512
        for s in range(0, len(hard), step):
            part = hard[s : s + step]
            index = np.searchsorted(u, part)
            most = int(per[index].max())
            more = np.full((len(part), most), _NONE)
            owner = np.repeat(np.arange(len(part)), per[index])
            more[owner, np.arange(len(owner)) - np.repeat(np.cumsum(per[index]) - per[index], per[index])] = extra[np.isin(to, part)]
            ids = np.concatenate([x.links[part], more], axis=1)
            vec = self.vectors[x.nodes[np.maximum(ids, 0)]]
            sims = np.where(ids >= 0, np.einsum("nd,ncd->nc", self.vectors[x.nodes[part]], vec), -np.inf).astype(np.float32)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * cap]
            ids, sims = np.take_along_axis(ids, top, axis=1), np.take_along_axis(sims, top, axis=1)
            vec = self.vectors[x.nodes[np.maximum(ids, 0)]]
            pick = _choose(sims, vec @ vec.transpose(0, 2, 1), cap)
            x.links[part, : pick.shape[1]] = np.where(pick >= 0, np.take_along_axis(ids, np.maximum(pick, 0), axis=1), -1)
            x.degree[part] = (pick >= 0).sum(axis=1)

    def _inward(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes that link to each node of the lowest layer begin, and those nodes."""
        if not hasattr(self, "inward"):
            x = self.layers[0]
            a, b = np.nonzero(x.links[: x.size] >= 0)
            to = x.links[a, b]
            bounds = np.zeros(x.size + 1, np.int64)
            np.cumsum(np.bincount(to, minlength=x.size), out=bounds[1:])
            self.inward = bounds, a[np.argsort(to, kind="stable")]
        return self.inward

    def within(self, queries: np.ndarray, least: float, beam: int, slack: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of a similarity of `least` (in single precision) or more that the graph leads to.

        The beam finds the neighbourhood; from its nodes above least - slack, links are followed as long as they stay there,
        and backward too: a node whose links from others were pruned still has its own to its nearest.
        """
        who, what = [], []
        base = self.layers[0]
        inward, source = self._inward()
        for i in range(0, len(queries), BATCH):
            q = queries[i : i + BATCH]
            entry = self._descend(q, stop=0)[0]
            ids, sims, seen = search(self.vectors, base, q, entry, min(beam, max(1, base.size)))
            a, b = np.nonzero((ids >= 0) & (sims >= least - slack))
            at, node, value = a, ids[a, b].astype(np.int64), sims[a, b]
            seen[...] = False  # what fell out of the beam may still lie within
            seen[at, node] = True
            front = [(at, node, value)]
            while front:
                at, node, value = front.pop()
                if len(at) > FRONT:  # the rest waits: what is held does not grow with the links of a dense group
                    front.append((at[FRONT:], node[FRONT:], value[FRONT:]))
                    at, node, value = at[:FRONT], node[:FRONT], value[:FRONT]
                hit = value >= least
                who.append((at[hit] + i).astype(np.int32))
                what.append(node[hit].astype(np.int32))
                per = inward[node + 1] - inward[node]
                back = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(inward[node], per)
                at = np.concatenate([np.repeat(at, base.links.shape[1]), np.repeat(at, per)])
                node = np.concatenate([base.links[node].reshape(-1).astype(np.int64), source[back]])
                fresh = np.flatnonzero((node >= 0) & ~seen[at, node])
                code = np.unique(at[fresh] * base.size + node[fresh])
                at, node = code // base.size, code % base.size
                seen[at, node] = True
                value = np.concatenate([np.einsum("nd,nd->n", q[at[s : s + 65536]], self.vectors[node[s : s + 65536]]) for s in range(0, len(at), 65536)]) if len(at) else np.zeros(0, np.float32)
                stay = value >= least - slack
                if stay.any():
                    front.append((at[stay], node[stay], value[stay]))
        return (np.concatenate(who).astype(np.int64), np.concatenate(what).astype(np.int64)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def arrays(self, prefix: str) -> tuple[dict[str, np.ndarray], dict]:
        out = {f"{prefix}v": self.vectors.reshape(-1)}
        for k, x in enumerate(self.layers):
            out |= {f"{prefix}n{k}": x.nodes, f"{prefix}l{k}": x.links.reshape(-1)}
        return out, {f"{prefix}dim": int(self.vectors.shape[1]), f"{prefix}layers": len(self.layers)}

    @classmethod
    def read(cls, f, prefix: str) -> Graph:
        layers = []
        for k in range(f.meta[f"{prefix}layers"]):
            nodes = getattr(f, f"{prefix}n{k}")
            links = getattr(f, f"{prefix}l{k}").reshape(max(len(nodes), 0), -1) if len(nodes) else np.zeros((0, M), np.int32)
            layers.append(Layer(nodes, links, np.zeros(0, np.int64), len(nodes)))
        return cls(getattr(f, f"{prefix}v").reshape(-1, f.meta[f"{prefix}dim"]), layers)
