"""A trie of globally ordered sets, searched for similar sets.

Sets of hashes are ordered by value, the same order for all. The range of values is cut into equal classes, and a set's path has one
edge per class, labelled with its members there. A search takes a set down the trie with the overlap so far: sets below a
node share it, and a subtree is pruned where even a full overlap of what remains would be too small.
"""

from __future__ import annotations

import numpy as np

#: Members of an edge's label, on average, in the largest set.
EDGE_MEMBERS = 8
#: (set, node) pairs followed at once.
FRONTIER = 1 << 19


def classes(values: np.ndarray, number: int) -> np.ndarray:
    """Class of each value: equal ranges of the 64-bit numbers."""
    return ((values >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64)


def cuts(values: np.ndarray, number: int) -> np.ndarray:
    """Where each class begins in the sorted ``values``; one more entry for the end."""
    return np.searchsorted(classes(values, number), np.arange(number + 1))


class Groups:
    """Union-find over a few places."""

    def __init__(self, start: np.ndarray) -> None:
        _, first, place = np.unique(start, return_index=True, return_inverse=True)
        self.parent = first[place].tolist()

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def names(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


class PrefixTree:
    """Trie over distinct sorted sets (unsigned 64-bit values), for a similarity of ``percent`` / 100."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        sizes = np.array([len(s) for s in sets])
        depth = int(sizes.max()) // EDGE_MEMBERS + 1
        known: dict[bytes, int] = {}
        labels = np.empty((len(sets), depth), dtype=np.int64)
        for i, s in enumerate(sets):
            raw, at = s.tobytes(), (8 * cuts(s, depth)).tolist()
            labels[i] = [known.setdefault(raw[a:b], len(known)) for a, b in zip(at[:-1], at[1:])]
        lengths = np.array([len(k) // 8 for k in known])
        members = np.frombuffer(b"".join(known), dtype=np.uint64)
        distinct, self.members = np.unique(members, return_inverse=True)
        # labels come in order and members ascend in each, so these are sorted
        self.width = max(len(distinct), 1)
        self.keys = np.repeat(np.arange(len(known)), lengths) * self.width + self.members
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        # sets in the order of their paths: those below a node lie side by side
        self.order = np.lexsort(labels.T[::-1])
        self.labels, self.sizes = labels[self.order], sizes[self.order]
        rest = self.sizes.copy()
        self.levels = []
        new = np.zeros(len(sets), dtype=bool)
        new[0] = True
        for level in range(depth):
            own = self.labels[:, level]
            new[1:] |= own[1:] != own[:-1]
            first = np.flatnonzero(new)
            rest = rest - lengths[own]
            self.levels.append((first, own[first], np.minimum.reduceat(self.sizes, first), np.maximum.reduceat(rest, first)))
        self.rests = self.sizes[:, None] - np.cumsum(lengths[self.labels], axis=1)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common members of the labels ``a`` and ``b``, pair by pair."""
        out = np.where(a == b, self.lengths[a], 0)
        differ = np.flatnonzero((a != b) & (self.lengths[a] > 0) & (self.lengths[b] > 0))
        if len(differ):
            a, b = a[differ], b[differ]
            n = self.lengths[b]
            pair = np.repeat(np.arange(len(b)), n)
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wanted = a[pair] * self.width + self.members[self.starts[b][pair] + inside]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[differ] = np.bincount(pair[self.keys[at] == wanted], minlength=len(b))
        return out

    def similar(self, wanted: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (set, set) of linked sets of different groups, the first of them one of ``wanted``; places are in path order."""
        t, query, node, common = self.percent, wanted, None, np.zeros(len(wanted), dtype=np.int64)
        for level, (first, label, least, rest) in enumerate(self.levels):
            ends = np.append(first[1:], len(self.sizes))
            if node is None:
                begin, number = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(first))
            else:
                begin = np.searchsorted(first, before[node])
                number = np.searchsorted(first, before_ends[node]) - begin
            of = np.repeat(np.arange(len(query)), number)
            node = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + begin[of]
            query, common = query[of], common[of]
            low, high = np.minimum.reduceat(group, first), np.maximum.reduceat(group, first)
            open_ = (low[node] != group[query]) | (high[node] != group[query])
            query, node, common = query[open_], node[open_], common[open_]
            common = common + self.overlap(self.labels[query, level], label[node])
            most = common + np.minimum(self.rests[query, level], rest[node])
            alive = (100 + t) * most >= t * (self.sizes[query] + least[node])
            query, node, common = query[alive], node[alive], common[alive]
            before, before_ends = first, ends
        found = before[node]
        return query, found

    def links(self, group: np.ndarray, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links between sets that ``group`` does not yet hold together, enough to join all groups that links join.

        With ``wanted`` only the links of those sets. Without it, sets of the largest group need no search of their own: a link
        between two groups has an end outside of it."""
        groups, out = Groups(group[self.order]), []
        todo = np.ones(len(self.order), dtype=bool) if wanted is None else wanted[self.order].copy()
        batch = 1
        while True:
            names = groups.names()
            rest = todo & (names != np.bincount(names).argmax()) if wanted is None else todo
            queries = np.flatnonzero(rest)[:batch]
            if not len(queries):
                return [(int(self.order[a]), int(self.order[b])) for a, b in out]
            todo[queries] = False
            out += [(a, b) for a, b in zip(*map(np.ndarray.tolist, self.similar(queries, names))) if groups.join(a, b)]
            batch = max(1, min(8 * batch, FRONTIER // len(self.order)))
