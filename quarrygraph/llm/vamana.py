"""A directed search graph over one shard of unit vectors: greedy search, relaxed pruning, beam search.

The graph grows in batches that double in size up to BATCH. Each new vector searches the graph so far, keeps of what it
met at most DEGREE diverse neighbours, and is offered to them as a neighbour in turn. A candidate is dropped if an
already kept neighbour is nearer to it, by the factor RELAXED, than the vector itself. All steps work on arrays of many
vectors at once.
"""

from __future__ import annotations

import numpy as np

DEGREE = 28
RELAXED = 1.05
BUILD_WIDTH = 56
BATCH = 256
#: Nodes expanded per search step, and nodes that every search starts from.
EXPAND = 4
STARTS = 8


class Graph:
    def __init__(self, x: np.ndarray, seed: int = 11):
        """``x``: unit vectors, float32, one per row."""
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.out = np.full((n, DEGREE), -1, np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        first = order[: 2 * DEGREE]
        self.starts = order[:STARTS]
        if len(first) > 1:
            cand = np.broadcast_to(first, (len(first), len(first))).copy()
            np.fill_diagonal(cand, -1)
            self.out[first] = self._prune(first, cand)
        at = len(first)
        while at < n:
            new = order[at : at + min(BATCH, at)]
            met, _ = self.search(self.x[new], BUILD_WIDTH, BUILD_WIDTH)
            self.out[new] = self._prune(new, met)
            self._offer(new)
            at += len(new)

    def _prune(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """At most DEGREE diverse of the candidates (-1: none) of each node."""
        x = self.x
        c = np.maximum(cand, 0)
        vec = x[c]
        far = 2 - 2 * np.einsum("ucd,ud->uc", vec, x[nodes])
        far[(cand < 0) | (cand == nodes[:, None])] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
        vec = np.take_along_axis(vec, order[:, :, None], 1)
        apart = (2 - 2 * (vec @ vec.transpose(0, 2, 1))) * (RELAXED * RELAXED)
        alive, kept = np.isfinite(far), np.zeros(far.shape, bool)
        rows = np.arange(len(nodes))
        for _ in range(DEGREE):
            k = alive.argmax(1)
            has = alive[rows, k]
            if not has.any():
                break
            kept[rows[has], k[has]] = True
            alive &= apart[rows, k] > far
            alive[rows, k] = False
        # free slots go to the nearest of what was dropped
        rank = np.where(kept, 0, np.where(np.isfinite(far), 1, 2))
        best = np.argsort(rank, axis=1, kind="stable")[:, :DEGREE]
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        got = np.where(np.take_along_axis(rank, best, 1) < 2, np.take_along_axis(c, best, 1), -1)
        out[:, : got.shape[1]] = got
        return out

    def _offer(self, new: np.ndarray) -> None:
        """Adds the edges back from the neighbours of ``new``, pruning where there is no room."""
        to, who = self.out[new].ravel(), np.repeat(new, DEGREE)
        to, who = to[to >= 0], who[to >= 0]
        while len(to):
            order = np.argsort(to, kind="stable")
            to, who = to[order], who[order]
            nodes, first, count = np.unique(to, return_index=True, return_counts=True)
            nth = np.arange(len(to)) - np.repeat(first, count)
            now = nth < DEGREE
            extra = np.full((len(nodes), min(int(count.max()), DEGREE)), -1, np.int32)
            extra[np.repeat(np.arange(len(nodes)), count)[now], nth[now]] = who[now]
            have = (self.out[nodes] >= 0).sum(1)
            fits = have + np.minimum(count, DEGREE) <= DEGREE
            both = np.concatenate([self.out[nodes], extra], 1)
            if fits.any():
                packed = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable"), 1)
                self.out[nodes[fits]] = packed[:, :DEGREE]
            for lo in range(0, int((~fits).sum()), 1024):
                part = np.flatnonzero(~fits)[lo : lo + 1024]
                self.out[nodes[part]] = self._prune(nodes[part], both[part])
            to, who = to[~now], who[~now]

    def search(self, q: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar nodes found per query with a beam of ``width``, best first, and their cosines (-1, -inf: none)."""
        x, b = self.x, len(q)
        rows = np.arange(b)[:, None]
        ids = np.full((b, width), -1, np.int32)
        sim = np.full((b, width), -np.inf, np.float32)
        todo = np.zeros((b, width), bool)
        n0 = min(len(self.starts), width)
        ids[:, :n0] = self.starts[:n0]
        sim[:, :n0] = q @ x[self.starts[:n0]].T
        todo[:, :n0] = True
        seen = np.zeros((b, len(x) + 1), bool)
        seen[:, self.starts[:n0]] = True
        seen[:, -1] = True
        live = np.arange(b)
        while len(live):
            r = rows[: len(live)]
            s, t = sim[live], todo[live]
            ranked = np.where(t, s, -np.inf)
            pick = np.argpartition(-ranked, EXPAND - 1, axis=1)[:, :EXPAND]
            ok = np.take_along_axis(t, pick, 1)
            going = ok.any(1)
            if not going.all():
                live, s, t, pick, ok = live[going], s[going], t[going], pick[going], ok[going]
                r = rows[: len(live)]
                if not len(live):
                    break
            t[r, pick] = False
            node = ids[live][r, pick]
            near = np.where(ok[:, :, None], self.out[node], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = ~seen[live[:, None], near]
            near = np.where(fresh, near, -1)
            keep = fresh.sum(1).max()
            if keep:
                near = -np.partition(-near, min(keep, near.shape[1] - 1), axis=1)[:, :keep]
                seen[live[:, None], near] = True
                new = np.matmul(x[near], q[live][:, :, None])[:, :, 0]
                new[near < 0] = -np.inf
                all_s, all_i, all_t = np.concatenate([s, new], 1), np.concatenate([ids[live], near], 1), np.concatenate([t, near >= 0], 1)
                top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
                s, ids[live], t = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_t, top, 1)
            sim[live], todo[live] = s, t
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)
