"""A navigable small-world graph over the vectors of one shard, in numpy.

Layers thin out geometrically; a search walks the upper layers greedily and
ends with a beam in the lowest one (Malkov and Yashunin 2018). Vectors are
inserted in batches and queries are searched in batches: all queries of a
batch take a step together, so the work is array work.
"""

from __future__ import annotations

import numpy as np

#: Neighbours a node keeps (twice as many in the lowest layer), and the beam of insertion.
LINKS = 12
BUILD_BEAM = 48
BATCH = 512
#: Beam nodes that a step opens at once.
OPEN = 4


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """Layers from the top (fewest nodes) down; a layer is (nodes, adjacency by position, -1 for none)."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers

    # --- search -----------------------------------------------------------

    def _beam(self, q: np.ndarray, entry: np.ndarray, adj: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes found for each query (-1 fills up) and their cosines, best first."""
        x, (n, _), b = self.x, adj.shape, len(q)
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        opened = np.zeros((b, ef), bool)
        visited = np.zeros((b, n), bool)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("bd,bd->b", q, x[entry])
        visited[np.arange(b), entry] = True
        active = np.arange(b)
        width = min(OPEN, ef)
        while len(active):
            waiting = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
            best = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if ef > width else np.tile(np.arange(ef), (len(active), 1))
            found = np.take_along_axis(waiting, best, 1) > -np.inf
            some = found.any(axis=1)
            active, best, found = active[some], best[some], found[some]
            if not len(active):
                break
            rows = active[:, None]
            cur = np.where(found, ids[rows, best], -1)
            opened[rows, best] |= found
            nb = np.where((cur >= 0)[:, :, None], adj[np.maximum(cur, 0)], -1).reshape(len(active), -1)
            nb.sort(axis=1)
            ok = nb >= 0
            ok[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            safe = np.maximum(nb, 0)
            ok &= ~visited[rows, safe]
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            far = safe[r, c]
            visited[active[r], far] = True
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[active[r]], x[far])
            all_s = np.concatenate([sims[active], s], axis=1)
            all_i = np.concatenate([ids[active], np.where(ok, nb, -1)], axis=1)
            all_o = np.concatenate([opened[active], np.zeros(nb.shape, bool)], axis=1)
            keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[active] = np.take_along_axis(all_s, keep, 1)
            ids[active] = np.where(np.isneginf(sims[active]), -1, np.take_along_axis(all_i, keep, 1))
            opened[active] = np.take_along_axis(all_o, keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _entry(self, q: np.ndarray, stop: int) -> np.ndarray:
        """Where a search of layer ``stop`` starts: the nearest node found in the layers above."""
        at = np.full(len(q), self.layers[0][0][0], np.int64)
        for nodes, adj in self.layers[:stop]:
            at = self._beam(q, at, adj, 4)[0][:, 0]
        return at

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        ef = min(ef, len(self.x))
        out_i, out_s = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
        step = max(16, min(BATCH, (1 << 25) // max(1, len(self.x))))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            out_i[i : i + step], out_s[i : i + step] = self._beam(part, self._entry(part, len(self.layers) - 1), self.layers[-1][1], ef)
        return out_i, out_s

    def flood(self, q: np.ndarray, seeds: np.ndarray, least: float) -> np.ndarray:
        """All nodes with at least this cosine that chains of such nodes join to the seeds."""
        adj, x = self.layers[-1][1], self.x
        seen = np.zeros(len(x), bool)
        seen[seeds] = True
        edge, out = seeds, [seeds]
        while len(edge):
            nb = np.unique(adj[edge])
            nb = nb[nb >= 0]
            nb = nb[~seen[nb]]
            seen[nb] = True
            edge = nb[x[nb] @ q >= least]
            out.append(edge)
        return np.concatenate(out)

    # --- construction -----------------------------------------------------

    @classmethod
    def build(cls, x: np.ndarray, seed: int, links: int = LINKS, ef: int = BUILD_BEAM) -> Graph:
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(int)
        graph = cls(x, [])
        before = np.zeros(0, np.int64)
        for top in range(level.max(), -1, -1):
            # Nodes of the layers above come first, so that a search from above starts in what is built.
            nodes = np.concatenate([before, np.flatnonzero(level == top)])
            degree = 2 * links if top == 0 else links
            adj = np.full((n, degree), -1, np.int64)
            graph.layers.append((nodes, adj))
            done = 1
            while done < len(nodes):
                size = min(BATCH, done, len(nodes) - done)
                new = nodes[done : done + size]
                q = x[new]
                entry = graph._entry(q, len(graph.layers) - 1)
                entry = np.where(np.isin(entry, nodes[:done]), entry, nodes[0])
                near, sims = graph._beam(q, entry, adj, min(ef, done))
                among = q @ q.T
                np.fill_diagonal(among, -np.inf)
                kin = np.argsort(-among, axis=1)[:, : min(links, size - 1)] if size > 1 else np.zeros((size, 0), int)
                ids = np.concatenate([near, new[kin]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(among, kin, 1)], axis=1)
                graph._link(adj, new, ids, sims, links)
                done += size
            before = nodes
        return graph

    def _link(self, adj: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> None:
        """Give each new node diverse neighbours, and them a link back."""
        for row, v in enumerate(new):
            ok = ids[row] >= 0
            chosen = self._diverse(ids[row][ok], sims[row][ok], links)
            adj[v, : len(chosen)] = chosen
        for v in new:
            for w in adj[v][adj[v] >= 0]:
                have = adj[w][adj[w] >= 0]
                if v in have:
                    continue
                if len(have) < adj.shape[1]:
                    adj[w, len(have)] = v
                else:
                    all_ = np.append(have, v)
                    chosen = self._diverse(all_, self.x[all_] @ self.x[w], adj.shape[1])
                    adj[w] = -1
                    adj[w, : len(chosen)] = chosen

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
        """The nearest ids, each nearer to the node than to those taken before; the nearest others fill up."""
        order = np.argsort(-sims, kind="stable")
        ids, sims = ids[order], sims[order]
        if len(ids) <= n:
            return ids
        x = self.x[ids]
        between = x @ x.T
        taken: list[int] = []
        for i in range(len(ids)):
            if all(between[i, j] < sims[i] for j in taken):
                taken.append(i)
                if len(taken) == n:
                    break
        if len(taken) < n:
            rest = [i for i in range(len(ids)) if i not in set(taken)]
            taken += rest[: n - len(taken)]
        return ids[taken]

    # --- as bytes ---------------------------------------------------------

    def pack(self, vectors: bool = True) -> bytes:
        """The graph, with its vectors or without; neighbours are counted from 1, in two bytes where these suffice."""
        import io

        buffer = io.BytesIO()
        arrays = {"n": np.array([len(self.layers)])} | ({"x": self.x} if vectors else {})
        small = np.uint16 if len(self.x) < 1 << 16 else np.uint32
        for i, (nodes, adj) in enumerate(self.layers):
            arrays[f"nodes{i}"] = nodes.astype(small)
            arrays[f"adj{i}"] = ((adj if i == len(self.layers) - 1 else adj[nodes]) + 1).astype(small)
        np.savez(buffer, **arrays)
        return buffer.getvalue()

    @classmethod
    def unpack(cls, data: bytes, x: np.ndarray | None = None) -> Graph:
        """A graph from its bytes; ``x`` are its vectors where they aren't in there."""
        import io

        with np.load(io.BytesIO(data)) as f:
            x, layers = f["x"] if x is None else x, []
            for i in range(int(f["n"][0])):
                nodes, adj = f[f"nodes{i}"].astype(np.int64), f[f"adj{i}"].astype(np.int64) - 1
                if len(adj) != len(x):
                    full = np.full((len(x), adj.shape[1]), -1, np.int64)
                    full[nodes] = adj
                    adj = full
                layers.append((nodes, adj))
        return cls(x, layers)
