"""Exact earth mover's distance of two clouds with uniform mass and Euclidean ground cost."""

from __future__ import annotations

import math

import numpy as np


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost perfect matching of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = 1 + int(np.where(free, low[1:], np.inf).argmin())
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def ground(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def _flow(cost: np.ndarray) -> float:
    """Transport of lcm / n units per row to lcm / m per column, by repeated cheapest augmentation."""
    n, m = cost.shape
    unit = math.lcm(n, m)
    supply, demand = np.full(n, unit // n), np.full(m, unit // m)
    flow, pu, pv = np.zeros((n, m), np.int64), np.zeros(n), np.zeros(m)
    while supply.any():
        # Dijkstra from all rows with supply, on reduced costs.
        dr, dc = np.where(supply > 0, 0.0, np.inf), np.full(m, np.inf)
        fr, fc = np.full(n, -1), np.full(m, -1)
        seen_r, seen_c = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            r, c = np.where(seen_r, np.inf, dr), np.where(seen_c, np.inf, dc)
            i, j = int(r.argmin()), int(c.argmin())
            if min(r[i], c[j]) == np.inf:
                break
            if r[i] <= c[j]:
                seen_r[i] = True
                d = dr[i] + np.maximum(0, cost[i] + pu[i] - pv)
                up = ~seen_c & (d < dc)
                dc[up], fc[up] = d[up], i
            else:
                seen_c[j] = True
                if demand[j] > 0:
                    break
                d = dc[j] + np.maximum(0, pv[j] - pu - cost[:, j])
                up = ~seen_r & (d < dr) & (flow[:, j] > 0)
                dr[up], fr[up] = d[up], j
        best = dc[j]
        pu += np.minimum(dr, best)
        pv += np.minimum(dc, best)
        path, amount, x = [], int(demand[j]), j
        while True:
            i = fc[x]
            path.append((i, x, 1))
            if fr[i] < 0:
                amount = min(amount, int(supply[i]))
                break
            x = fr[i]
            amount = min(amount, int(flow[i, x]))
            path.append((i, x, -1))
        for p, q, sign in path:
            flow[p, q] += sign * amount
        supply[i] -= amount
        demand[j] -= amount
    return float((flow * cost).sum() / unit)


def lower_bound(cost: np.ndarray) -> float:
    """No transport is cheaper than every unit's nearest counterpart, from either side."""
    return max(float(cost.min(1).mean()), float(cost.min(0).mean()))


def emd(a: np.ndarray, b: np.ndarray, cap: float = math.inf) -> float:
    """min(EMD, cap); the transport problem is not solved where the bound already reaches the cap. Empty clouds are infinitely far."""
    if not len(a) or not len(b):
        return cap
    cost = ground(a, b)
    if lower_bound(cost) >= cap:
        return cap
    exact = float(cost[np.arange(len(a)), assignment(cost)].mean()) if len(a) == len(b) else _flow(cost)
    return min(exact, cap)


def emd_top_k(query: np.ndarray, clouds: list[np.ndarray], k: int) -> tuple[list[tuple[int, float]], int]:
    """The ``k`` nearest clouds (position, distance) and how many transport problems were solved: clouds are tried by lower bound until it exceeds the k-th distance."""
    bounds = [lower_bound(ground(query, c)) if len(c) and len(query) else math.inf for c in clouds]
    best: list[tuple[float, int]] = []
    solved = 0
    for i in np.argsort(bounds, kind="stable"):
        if bounds[i] == math.inf or (len(best) == k and bounds[i] > best[-1][0]):
            break
        best = sorted([*best, (emd(query, clouds[i]), int(i))])[:k]
        solved += 1
    return [(i, d) for d, i in best], solved
