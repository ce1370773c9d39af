"""NN-descent and greedy search over the vectors of one shard, in memory.

A shard's graph starts from a forest: trees that cut at the median along random directions. The nodes of a leaf are
compared, and rounds of NN-descent join a sample of the new neighbours of a node, in both directions, with the others,
until few neighbours are new. A query goes down the first levels of the same trees, starts from the closest nodes of the
branch that it comes to in each, and opens the best nodes of its pool until all of them are open.

Products are taken in the type of the vectors, four bytes or eight; ``working`` and ``Graph.tight`` tell where four do.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a node; those that a search follows, with the ones that have the node as theirs.
DEGREE, LINKS = 24, 40
#: Trees of the forest, most nodes of a leaf, and neighbours taken from each leaf.
TREES, LEAF, EARLY = 6, 192, 12
#: Most rounds, new and old members of a local join, offers that a node looks at at once, and share of new ones that ends the rounds.
ROUNDS, NEW, OLD, OFFERS, ENOUGH = 8, 20, 36, 24, 0.1
#: Levels of a tree that a query goes down, nodes it starts from, nodes opened in a step.
LEVELS, STARTS, OPEN = 4, 32, 6
#: Queries of a batch, and elements of a temporary array.
BATCH, BLOCK = 256, 1 << 22
#: Products that differ by less than this share of a node's own may be in the wrong order in four bytes.
CLOSE = 1e-4


def working(x: np.ndarray) -> np.ndarray:
    """The vectors in four bytes a number if that loses nothing and products stay in its range, else in eight."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    size = np.abs(x).max(axis=1, initial=0)
    return short if (short == x).all() and size.max(initial=0) <= 1e15 and size.min(initial=1) >= 1e-15 else x.astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors, all divided by a power of two that brings them near to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(initial=0))[1])


def rows_of(x: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The rows ``at`` (-1: any row) of ``x``; several times faster than by index."""
    flat = at.reshape(-1)
    out = np.empty((len(flat), x.shape[1]), x.dtype) if out is None else out[: len(flat)]
    return np.take(x, flat, axis=0, out=out, mode="clip").reshape(*at.shape, x.shape[1])


def whole(sim: np.ndarray) -> np.ndarray:
    """Integers of four bytes in the order of numbers of four bytes."""
    bits = np.ascontiguousarray(sim).view(np.int32)
    return bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))


def number(bits: np.ndarray) -> np.ndarray:
    """What ``whole`` was made from."""
    return (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.float32)


def best_of(sim: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest of each row, best first, with their codes (int32, not negative)."""
    if sim.dtype == np.float32:  # both fit an integer, and sorting those is several times faster than sorting places
        key = whole(sim).astype(np.int64)
        key <<= 32
        key |= code
        np.negative(key, out=key)
        key.sort(axis=1)
        key = -key[:, :most]
        return number((key >> 32).astype(np.int32)), key.astype(np.int32)
    best = np.argsort(-sim, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(sim, best, 1), np.take_along_axis(code, best, 1)


def distinct(ids: np.ndarray) -> np.ndarray:
    """Each row's ids with -1 for those that stand there once more; not in their order."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def spread(row: np.ndarray, value: np.ndarray, n: int, most: int, none: float = -1) -> np.ndarray:
    """The first ``most`` values of each of ``n`` rows, from values in the order of their rows."""
    out = np.full((n, most), none, value.dtype)
    if len(row):
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
        keep = place < most
        out[row[keep], place[keep]] = value[keep]
    return out


class Forest:
    """Trees of equal depth over the rows of ``x``: ``order`` has the rows of each by leaf, ``cut`` where leaves start."""

    def __init__(self, x: np.ndarray, seed: int = 17):
        rng, n = np.random.default_rng(seed), len(x)
        depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        self.ways, self.at, self.order = [], [], []
        for _ in range(TREES):
            pair = rng.integers(0, n, (2, depth))
            way = (x[pair[0]] - x[pair[1]]).astype(np.float64)  # points of one group part it where a random way may not
            size = np.sqrt(np.einsum("ij,ij->i", way, way))[:, None]
            way = way / np.where(size > 0, size, 1) + 0.5 * rng.normal(size=way.shape) / np.sqrt(x.shape[1])
            along, order, cut, at = x @ way.T, np.arange(n), np.array([0, n]), []
            for level in range(depth):
                cell = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                order = order[np.lexsort((along[order, level], cell))]
                middle = (cut[:-1] + cut[1:]) // 2
                at.append(along[order[middle], level])
                cut = np.append(np.stack([cut[:-1], middle], 1).reshape(-1), n)
            self.ways.append(way)
            self.at.append(at)
            self.order.append(order.astype(np.int32))
            self.cut = cut

    def branches(self, tree: int, q: np.ndarray) -> np.ndarray:
        """The branch of ``LEVELS`` levels that each query comes to."""
        along, branch = q @ self.ways[tree][:LEVELS].T, np.zeros(len(q), np.int64)
        for level, at in enumerate(self.at[tree][:LEVELS]):
            branch = 2 * branch + (along[:, level] >= at[branch])
        return branch


class Graph:
    """The neighbour graph of the rows of ``x``: ``near``, ``sim`` and ``new`` of each node, -1 for none."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, rounds: int = ROUNDS):
        self.x, n = scaled(x), len(x)
        self.forest = Forest(self.x)
        degree = min(degree, n - 1)
        self.near = np.full((n, degree), -1, np.int32)
        self.sim = np.full((n, degree), -np.inf, self.x.dtype)
        self.new = np.zeros((n, degree), bool)
        if degree:
            self.plant()
            for _ in range(rounds):
                if self.descend() <= ENOUGH * n * degree:
                    break
        self.links = distinct(np.concatenate([self.near, self.reverse(self.near >= 0, LINKS - degree, 3)], 1))

    def tight(self) -> bool:
        """Whether there are groups of nodes whose products four bytes cannot tell apart: more of them than a start holds."""
        own = np.einsum("ij,ij->i", self.x, self.x)
        last = self.sim.min(axis=1, initial=np.inf)
        return self.x.dtype == np.float32 and int((np.abs(last - own) <= CLOSE * own).sum()) > STARTS

    def take(self, rows: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """Offer each of the rows the nodes ``ids``, -1 for none."""
        degree = self.near.shape[1]
        step = max(1, BLOCK // (4 * (degree + ids.shape[1])))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            # by node, those that are not new first: of equal nodes the first stays
            code = np.concatenate([2 * self.near[own] + self.new[own], 2 * ids[lo : lo + step] + 1], 1)
            s = np.concatenate([self.sim[own], sim[lo : lo + step]], 1)
            if s.dtype == np.float32:
                key = code.astype(np.int64)
                key <<= 32
                key |= whole(s).view(np.uint32)
                key.sort(axis=1)
                s, code = number(key.astype(np.uint32).view(np.int32)), (key >> 32).astype(np.int32)
            else:
                order = np.argsort(code, axis=1)
                s, code = np.take_along_axis(s, order, 1), np.take_along_axis(code, order, 1)
            node = code >> 1
            s[:, 1:][node[:, 1:] == node[:, :-1]] = -np.inf
            s[node < 0] = -np.inf
            s, code = best_of(s, np.maximum(code, 0), degree)
            there = s > -np.inf
            self.sim[own], self.near[own], self.new[own] = s, np.where(there, code >> 1, -1), there & (code & 1).astype(bool)

    def plant(self) -> None:
        """Neighbours within the leaves."""
        cut = self.forest.cut
        longest = int(np.diff(cut).max())
        k = min(EARLY, longest - 1)
        place = cut[:-1, None] + np.arange(longest)
        inside = place < cut[1:, None]
        step = max(1, BLOCK // (4 * longest * longest))
        code = np.arange(longest, dtype=np.int32)[None]
        for order in self.forest.order:
            for lo in range(0, len(place), step):
                ok = inside[lo : lo + step]
                own = np.where(ok, order[np.minimum(place[lo : lo + step], len(order) - 1)], -1)
                v = rows_of(self.x, own)
                s = v @ v.transpose(0, 2, 1)
                s[np.broadcast_to(~ok[:, None, :], s.shape)] = -np.inf
                s[:, np.arange(longest), np.arange(longest)] = -np.inf
                s, at = best_of(s.reshape(-1, longest), np.broadcast_to(code, (s.shape[0] * longest, longest)), k)
                ids = np.take_along_axis(np.repeat(own, longest, axis=0), at, 1)
                ids[s == -np.inf] = -1
                ok = ok.reshape(-1)
                self.take(own.reshape(-1)[ok], ids[ok], s[ok])

    def reverse(self, which: np.ndarray, most: int, seed: int) -> np.ndarray:
        """A sample of up to ``most`` of the nodes that have a node as theirs by an edge of ``which``, -1 for none."""
        row, place = np.nonzero(which & (self.near >= 0))
        to = self.near[row, place]
        mixed = np.random.default_rng(seed).permutation(len(to))
        order = mixed[np.argsort(to[mixed], kind="stable")]
        return spread(to[order], row[order].astype(np.int32), len(self.near), most)

    def descend(self) -> int:
        """One round of local joins; how many neighbours are new after it."""
        x, seed = self.x, int(self.new.sum())
        there, half = self.near >= 0, min(NEW // 2, self.near.shape[1])
        # a sample of the new ones is joined now, the others later
        lot = np.where(self.new, np.random.default_rng(seed).random(self.near.shape, dtype=np.float32), 2)
        first = np.argpartition(lot, half - 1, axis=1)[:, :half]
        chosen = np.zeros(self.near.shape, bool)
        np.put_along_axis(chosen, first, np.take_along_axis(self.new, first, 1), 1)
        old = there & ~self.new
        new = distinct(np.concatenate([np.where(np.take_along_axis(chosen, first, 1), np.take_along_axis(self.near, first, 1), -1), self.reverse(chosen, NEW - half, seed)], 1))
        olds = distinct(np.concatenate([np.where(old, self.near, -1), self.reverse(old, OLD - self.near.shape[1], seed + 1)], 1))
        self.new &= ~chosen
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = new.shape[1] + olds.shape[1]
        step = max(1, BLOCK // (4 * width * x.shape[1]))
        worst = self.sim.min(axis=1)
        zero, none = np.zeros(1, x.dtype), np.full(1, -np.inf, x.dtype)
        for lo in range(0, len(x), step):
            left = new[lo : lo + step]
            some = (left >= 0).any(axis=1)
            left = left[some]
            if len(left):
                every = np.concatenate([left, olds[lo : lo + step][some]], 1)
                v, n = rows_of(x, every), left.shape[1]
                s = v[:, :n] @ v.transpose(0, 2, 1)
                s[:, np.arange(n), np.arange(n)] = -np.inf
                s += np.where(every >= 0, zero, none)[:, None, :]
                at = np.flatnonzero(s > np.where(left >= 0, worst[left], -none)[:, :, None])
                held.append((left.reshape(-1)[at // width], every.reshape(-1)[at // (n * width) * width + at % width], s.reshape(-1)[at]))
                # new ones have met both ways; the others are told here
                s, rest = np.ascontiguousarray(s[:, :, n:]), every[:, n:]
                s += np.where(left >= 0, zero, none)[:, :, None]
                at = np.flatnonzero(s > np.where(rest >= 0, worst[rest], -none)[:, None, :])
                w = rest.shape[1]
                held.append((np.ascontiguousarray(rest).reshape(-1)[at // (n * w) * w + at % w], left.reshape(-1)[at // w], s.reshape(-1)[at]))
            if sum(len(h[0]) for h in held) > BLOCK or held and lo + step >= len(x):
                to, ids, s = (np.concatenate(h) for h in zip(*held, strict=True))
                held = []
                order = np.argsort((to.astype(np.int64) << 32) - whole(s)) if s.dtype == np.float32 else np.lexsort((-s, to))
                to, ids, s = to[order], ids[order], s[order]
                ok = to != ids
                ok[1:] &= (to[1:] != to[:-1]) | (ids[1:] != ids[:-1])
                to, ids, s = to[ok], ids[ok], s[ok]
                if len(to):
                    rows, dense = np.unique(to, return_inverse=True)
                    self.take(rows, spread(dense, ids, len(rows), OFFERS), spread(dense, s, len(rows), OFFERS, -np.inf))
                    worst = self.sim.min(axis=1)
        return int(self.new.sum())

    def starts(self, q: np.ndarray) -> np.ndarray:
        """The closest nodes of the branches that each query comes to, -1 for none."""
        ids, sim = np.full((len(q), STARTS), -1, np.int32), np.full((len(q), STARTS), -np.inf, q.dtype)
        depth = len(self.forest.at[0])
        cut, q = self.forest.cut[:: 1 << max(0, depth - LEVELS)], scaled(q)
        for tree, order in enumerate(self.forest.order):
            branch = self.forest.branches(tree, q)
            by = np.argsort(branch, kind="stable")
            lo = 0
            for hi in [*(np.flatnonzero(np.diff(branch[by])) + 1).tolist(), len(by)]:
                nodes = order[cut[branch[by[lo]]] : cut[branch[by[lo]] + 1]]
                v = rows_of(self.x, nodes)
                for at in range(lo, hi, BATCH):
                    own = by[at : min(hi, at + BATCH)]
                    s = q[own] @ v.T
                    if tree:
                        found = np.flatnonzero(s > sim[own, -1][:, None])
                        row, s, node = found // len(nodes), s.reshape(-1)[found], nodes[found % len(nodes)]
                        most = min(4 * STARTS, int(np.bincount(row, minlength=1).max()))
                        more, node = spread(row, s, len(own), most, -np.inf), spread(row, node, len(own), most)
                        again = (node[:, :, None] == ids[own][:, None, :]).any(axis=2)
                        more[again] = -np.inf
                        s, node = np.concatenate([sim[own], more], 1), np.concatenate([ids[own], np.maximum(node, 0)], 1)
                    else:
                        k = min(STARTS, len(nodes))
                        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        s, node = np.take_along_axis(s, best, 1), nodes[best]
                    s, node = best_of(s, np.maximum(node, 0), STARTS)
                    sim[own, : s.shape[1]], ids[own, : s.shape[1]] = s, np.where(s > -np.inf, node, -1)
                lo = hi
        return ids

    def search(self, x: np.ndarray, q: np.ndarray, pool: int) -> np.ndarray:
        """The pool of each query, best first, -1 for none. ``x``: the vectors of the nodes, as they are, in the type of ``q``."""
        out = np.full((len(q), pool), -1, np.int32)
        if len(q) and len(x):
            begin = self.starts(q) if len(x) > pool else np.broadcast_to(np.arange(len(x), dtype=np.int32), (len(q), len(x)))
            seen = np.zeros(min(BATCH, len(q)) * len(x), np.uint16)
            for lo in range(0, len(q), BATCH):
                out[lo : lo + BATCH] = self.walk(x, q[lo : lo + BATCH], begin[lo : lo + BATCH], pool, seen)
        return out

    def walk(self, x: np.ndarray, q: np.ndarray, begin: np.ndarray, pool: int, seen: np.ndarray) -> np.ndarray:
        """Greedy search of a batch of queries. ``seen``: zeros, and zeros again at the end, for each query and node."""
        n, buffer = len(x), np.empty((max(OPEN * LINKS, begin.shape[1]), x.shape[1]), x.dtype)
        sim, code = np.full((len(q), pool), -np.inf, q.dtype), np.ones((len(q), pool), np.int32)  # code: node * 2 + opened
        row, node = np.repeat(np.arange(len(q)), begin.shape[1]), begin.reshape(-1)
        live, keys = np.arange(len(q)), []
        while True:
            # a node counts once for a query: of those that stand in one step the last
            there = node >= 0
            row, node = row[there], node[there]
            key = row * n + node
            fresh = np.flatnonzero(seen[key] == 0)
            row, node, key = row[fresh], node[fresh], key[fresh]
            mark = (np.arange(len(key)) % 65535 + 1).astype(np.uint16)
            seen[key] = mark
            once = np.flatnonzero(seen[key] == mark)
            row, node, key = row[once], node[once], key[once]
            keys.append(key)
            s, lo = np.empty(len(node), q.dtype), 0
            for hi in [*(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)] if len(row) else []:
                np.dot(rows_of(x, node[lo:hi], buffer), q[row[lo]], out=s[lo:hi])
                lo = hi
            better = np.flatnonzero(s > sim[row, -1])
            row, node, s = row[better], node[better], s[better]
            if len(row):
                first = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
                rows, count = row[first], np.diff(np.append(first, len(row)))
                dense, most = np.repeat(np.arange(len(rows)), count), int(count.max())
                sims, codes = np.concatenate([sim[rows], np.full((len(rows), most), -np.inf, q.dtype)], 1), np.concatenate([code[rows], np.ones((len(rows), most), np.int32)], 1)
                place = pool + np.arange(len(row)) - first[dense]
                sims[dense, place], codes[dense, place] = s, 2 * node
                sim[rows], code[rows] = best_of(sims, codes, pool)
            todo = (code[live] & 1) == 0
            some = todo.any(axis=1)
            live, todo = live[some], todo[some]
            if not len(live):
                break
            todo &= np.cumsum(todo, axis=1, dtype=np.int16) <= OPEN
            at, place = np.nonzero(todo)
            own = live[at]
            near = self.links[code[own, place] >> 1]
            code[own, place] += 1
            row, node = np.repeat(own, near.shape[1]), near.reshape(-1)
        for key in keys:
            seen[key] = 0
        return np.where(sim > -np.inf, code >> 1, -1)
