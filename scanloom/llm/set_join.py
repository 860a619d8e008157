"""In-memory Jaccard join of a bounded number of sets: prefix index with skips, answers derived from similar sets."""

from __future__ import annotations

import math

import numpy as np


def needed(n: int, m: int, num: int, den: int) -> int:
    """Least overlap o of sets of n and m elements with den * o >= num * (n + m - o)."""
    return -(-num * (n + m) // (num + den))


class Groups:
    """Union-find over 0..n-1 that keeps the least member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class SetJoin:
    """Links between sets whose Jaccard similarity is at least num / den.

    A set is given by its size and the sorted array of those elements that other sets may hold too; its remaining
    elements count as the rarest.

    Elements are ranked by frequency, rarest first, and a set's prefix is indexed. An index list is cut into blocks
    by set size and each block is ordered by the element's position in its set, so a probe takes, of each block,
    only the front part whose positions still leave enough elements for the overlap, and skips the rest unread.

    Overlaps of a probed set are kept. A later set y that shares most of its elements with a probed set x derives
    its own from them: o(y, z) lies between o(x, z) - |x - y| and o(x, z) + |y - x|, which mostly decides a link;
    where it does not, only the two differences are looked up in z. Pairs already in one group are not compared.
    """

    #: Probed sets whose overlaps are kept, and the share of elements from which on they serve another set.
    KEPT, SIMILAR = 4, 0.6

    def __init__(self, sets: list[np.ndarray], sizes: list[int], num: int, den: int):
        self.num, self.den = num, den
        size = np.array(sizes, np.int64)
        shared = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), shared)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        ranked = rank[element]
        order = np.lexsort((ranked, owner))
        ranked = ranked[order]
        start = np.concatenate([[0], np.cumsum(shared)])
        self.lead = size - shared
        self.ranks = [ranked[start[k] : start[k + 1]] for k in range(len(sets))]
        self.size = size
        self.prefix = np.clip(size - -(-num * size // den) + 1 - self.lead, 0, shared)
        self.band = np.array([int(math.log(max(n, 1)) / math.log(den / num)) for n in size.tolist()], np.int64)
        take = np.concatenate([np.arange(start[k], start[k] + self.prefix[k]) for k in range(len(sets))] or [np.zeros(0, np.int64)])
        at = owner[take] if len(take) else np.zeros(0, np.int64)
        place = take - start[at] + self.lead[at]
        key = ranked[take] * 4096 + self.band[at]
        order = np.lexsort((place, key))
        self.key, self.at, self.place = key[order], at[order], place[order]
        self.list_keys, self.list_from = np.unique(self.key, return_index=True)
        self.list_to = np.append(self.list_from[1:], len(self.key))
        top = int(self.band.max()) + 1 if len(sets) else 0
        self.band_low = np.array([size[self.band == b].min() if (self.band == b).any() else 0 for b in range(top)], np.int64)
        self.band_high = np.array([size[self.band == b].max() if (self.band == b).any() else -1 for b in range(top)], np.int64)

    def candidates(self, x: int) -> np.ndarray:
        """Sets that share a prefix element with x in blocks and positions that leave room for a link."""
        n, b = int(self.size[x]), int(self.band[x])
        out = []
        tokens = self.ranks[x][: self.prefix[x]]
        left = n - int(self.lead[x]) - np.arange(len(tokens))
        for band in range(max(b - 1, 0), min(b + 2, len(self.band_low))):
            high, low = int(self.band_high[band]), int(self.band_low[band])
            if high < 0:
                continue
            least = needed(n, low, self.num, self.den)
            lists = np.searchsorted(self.list_keys, tokens * 4096 + band)
            ok = (lists < len(self.list_keys)) & (left >= least)
            ok[ok] = self.list_keys[lists[ok]] == tokens[ok] * 4096 + band
            for k in lists[ok].tolist():
                a, z = self.list_from[k], self.list_to[k]
                out.append(self.at[a : a + np.searchsorted(self.place[a:z], high - least, "right")])
        found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        m = self.size[found]
        return found[(self.den * m >= self.num * n) & (self.den * n >= self.num * m)]

    def overlap(self, x: int, y: int) -> int:
        return len(np.intersect1d(self.ranks[x], self.ranks[y], assume_unique=True))

    def links(self, groups: Groups, wanted=None):
        """Pairs (x, y) that link, as far as their groups were apart before; joins the groups as it goes.

        wanted(x, ys) may thin out the sets to compare x with.
        """
        kept: list[tuple[int, dict[int, int]]] = []
        for x in np.argsort(self.size, kind="stable").tolist():
            if not self.size[x]:
                continue
            near = self.candidates(x)
            near = near[(self.size[near] < self.size[x]) | ((self.size[near] == self.size[x]) & (near < x))]
            if wanted is not None:
                near = wanted(x, near)
            if not len(near):
                continue
            base, found = self._similar(x, kept), {}
            for y in near.tolist():
                if groups.find(x) == groups.find(y):
                    continue
                least = needed(int(self.size[x]), int(self.size[y]), self.num, self.den)
                o = None
                if base is not None and y in base[1]:
                    known = base[1][y]
                    if known - len(base[2]) >= least:
                        groups.join(x, y)
                        yield x, y
                        continue
                    if known + len(base[3]) < least:
                        continue
                    z = self.ranks[y]
                    o = known - _inside(base[2], z) + _inside(base[3], z)
                else:
                    o = self.overlap(x, y)
                found[y] = o
                if o >= least:
                    groups.join(x, y)
                    yield x, y
            if found:
                kept.append((x, found))
                del kept[: -self.KEPT]

    def _similar(self, x: int, kept):
        """A probed set that shares most elements with x: (it, its overlaps, its elements not in x, x's not in it)."""
        for r, overlaps in reversed(kept):
            if len(overlaps) >= 4 and self.den * min(self.size[r], self.size[x]) >= self.num * max(self.size[r], self.size[x]):
                common = np.isin(self.ranks[x], self.ranks[r], assume_unique=True)
                if common.sum() >= self.SIMILAR * self.size[x]:
                    return r, overlaps, np.setdiff1d(self.ranks[r], self.ranks[x], assume_unique=True), self.ranks[x][~common]
        return None


def _inside(few: np.ndarray, many: np.ndarray) -> int:
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return int((many[at] == few).sum()) if len(many) else 0
