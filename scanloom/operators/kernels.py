"""Sequential image steps on one dense grid, as NumPy functions. One scan (or tile) is one call of a grouped map."""

from __future__ import annotations

import heapq

import numpy as np

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def dense(rows, cols, values, shape, fill=0):
    out = np.full(shape, fill, np.asarray(values).dtype if np.ndim(values) else type(values))
    out[np.asarray(rows), np.asarray(cols)] = values
    return out


def component_labels(mask: np.ndarray, neighbours=EIGHT) -> np.ndarray:
    """Labels 1..k of connected cells in order of their first cell, row by row; 0 where the mask is unset."""
    out = np.zeros(mask.shape, np.int64)
    height, width = mask.shape
    n = 0
    for r, c in zip(*np.nonzero(mask), strict=True):
        if out[r, c]:
            continue
        n += 1
        out[r, c] = n
        stack = [(int(r), int(c))]
        while stack:
            y, x = stack.pop()
            for dy, dx in neighbours:
                v, u = y + dy, x + dx
                if 0 <= v < height and 0 <= u < width and mask[v, u] and not out[v, u]:
                    out[v, u] = n
                    stack.append((v, u))
    return out


def flood(cost: np.ndarray, seeds: np.ndarray, mask: np.ndarray, neighbours=FOUR) -> np.ndarray:
    """Watershed by priority flood: cells join the seed that reaches them first, lowest cost and then oldest first."""
    out = np.where(mask, seeds, 0).astype(np.int64)
    height, width = cost.shape
    heap = [(float(cost[r, c]), k, int(r), int(c)) for k, (r, c) in enumerate(zip(*np.nonzero(out), strict=True))]
    age = len(heap)
    heapq.heapify(heap)
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for dy, dx in neighbours:
            v, u = r + dy, c + dx
            if 0 <= v < height and 0 <= u < width and mask[v, u] and not out[v, u]:
                out[v, u] = out[r, c]
                heapq.heappush(heap, (float(cost[v, u]), age, v, u))
                age += 1
    return out


def raised(field: np.ndarray, h: float) -> np.ndarray:
    """Greyscale reconstruction by dilation (8 neighbours) of field - h under field."""
    out = field - h
    heap = [(-float(out[r, c]), r, c) for r in range(field.shape[0]) for c in range(field.shape[1])]
    heapq.heapify(heap)
    while heap:
        value, r, c = heapq.heappop(heap)
        if -value < out[r, c]:
            continue
        for dy, dx in EIGHT:
            v, u = r + dy, c + dx
            if 0 <= v < field.shape[0] and 0 <= u < field.shape[1]:
                level = min(-value, float(field[v, u]))
                if level > out[v, u]:
                    out[v, u] = level
                    heapq.heappush(heap, (-level, v, u))
    return out


def h_maxima(field: np.ndarray, h: float) -> np.ndarray:
    """Regional maxima of the h-reconstruction whose height over their surroundings is at least h."""
    base = raised(field, h)
    flat = component_labels_by_value(base)
    height, width = base.shape
    top = np.ones(flat.max() + 1, bool)
    for dy, dx in EIGHT:
        a = base[max(0, -dy) : height - max(0, dy), max(0, -dx) : width - max(0, dx)]
        b = base[max(0, dy) : height - max(0, -dy), max(0, dx) : width - max(0, -dx)]
        l = flat[max(0, -dy) : height - max(0, dy), max(0, -dx) : width - max(0, dx)]
        top[l[b > a + 1e-9]] = False
    return top[flat] & (field - base >= h - 1e-9)


def component_labels_by_value(field: np.ndarray) -> np.ndarray:
    out = np.full(field.shape, -1, np.int64)
    n = 0
    for r in range(field.shape[0]):
        for c in range(field.shape[1]):
            if out[r, c] >= 0:
                continue
            stack, value = [(r, c)], field[r, c]
            out[r, c] = n
            while stack:
                y, x = stack.pop()
                for dy, dx in EIGHT:
                    v, u = y + dy, x + dx
                    if 0 <= v < field.shape[0] and 0 <= u < field.shape[1] and out[v, u] < 0 and abs(field[v, u] - value) <= 1e-9:
                        out[v, u] = n
                        stack.append((v, u))
            n += 1
    return out


def thinned(mask: np.ndarray) -> np.ndarray:
    """Skeleton by the two-pass thinning of Zhang and Suen."""
    img = np.pad(mask.astype(np.uint8), 1)
    while True:
        gone = 0
        for first in (True, False):
            p = [img[1 + dy : img.shape[0] - 1 + dy, 1 + dx : img.shape[1] - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            around = sum(x.astype(int) for x in p)
            turns = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            last = (n & e & s) | (e & s & w) if first else (n & e & w) | (n & s & w)
            cut = (img[1:-1, 1:-1] == 1) & (around >= 2) & (around <= 6) & (turns == 1) & (last == 0)
            img[1:-1, 1:-1][cut] = 0
            gone += int(cut.sum())
        if not gone:
            return img[1:-1, 1:-1].astype(bool)


def graph_roots(nodes, edges) -> dict:
    """Least node reachable from each node of a small graph."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in up}
