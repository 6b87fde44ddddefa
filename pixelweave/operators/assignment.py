"""Optimal one-to-one assignment on sparse non-negative weights."""

from __future__ import annotations

import numpy as np
import pandas as pd

GRID = 1e-9


def hungarian(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum-weight assignment by shortest augmenting paths.

    Returns the column of each row (-1: none) and the dual prices of rows and columns,
    for which ``u[i] + v[j] >= weight[i, j]`` with equality on matched pairs.
    """
    n, m = weight.shape
    size = max(n, m)
    cost = np.zeros((size, size))
    cost[:n, :m] = -weight
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    row_of = np.zeros(size + 1, np.int64)
    for i in range(1, size + 1):
        row_of[0] = i
        at = 0
        least = np.full(size + 1, np.inf)
        back = np.zeros(size + 1, np.int64)
        done = np.zeros(size + 1, bool)
        while True:
            done[at] = True
            r = row_of[at]
            free = ~done
            free[0] = False
            slack = cost[r - 1] - u[r] - v[1:]
            better = free[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = at
            nxt = int(np.where(free, least, np.inf).argmin())
            delta = least[nxt]
            u[row_of[done]] += delta
            v[done] -= delta
            least[free] -= delta
            at = nxt
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[back[at]]
            at = back[at]
    column = np.full(size, -1)
    column[row_of[1:] - 1] = np.arange(size)
    column = column[:n]
    column[column >= m] = -1
    return column, -u[1 : n + 1], -v[1 : m + 1]


def canonical(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positive weight of the optimum that has the fewest of them; among equals
    the one whose list by (row, column) is the largest, compared from its end.

    That is the order in which the SQL, on one thread, meets equal totals.  A pair costs so
    little that all of them together stay under the grid of 1e-9 (nothing, beyond a hundred
    rows or columns).  Only pairs whose prices are tight can be in another optimum, so
    other choices are tried only there.
    """
    size = max(weight.shape)
    charge = GRID / 2 / size if size <= 100 else 0.0
    near = charge / 4 or GRID
    weight = np.where(weight > 0, np.maximum(weight - charge, weight / 2), 0.0)
    column, u, v = hungarian(weight)
    best = sum(weight[i, j] for i, j in enumerate(column) if j >= 0)
    tight = (weight > 0) & (u[:, None] + v[None, :] - weight <= GRID)
    rows, cols = list(range(weight.shape[0])), list(range(weight.shape[1]))
    if all(tight[i].sum() <= 1 for i in rows) and all(tight[:, j].sum() <= 1 for j in cols):
        return [(i, int(j)) for i, j in enumerate(column) if j >= 0 and weight[i, j] > 0]
    out: list[tuple[int, int]] = []
    fixed = 0.0
    for i in reversed(range(weight.shape[0])):
        rows.remove(i)
        for j in [j for j in reversed(cols) if tight[i, j]]:
            rest_cols = [c for c in cols if c != j]
            rest = weight[np.ix_(rows, rest_cols)]
            more = 0.0
            if rest.size:
                c, _, _ = hungarian(rest)
                more = sum(rest[a, b] for a, b in enumerate(c) if b >= 0)
            if abs(fixed + weight[i, j] + more - best) <= near:
                out.append((i, j))
                fixed += weight[i, j]
                cols = rest_cols
                break
    return out[::-1]


def components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component number of each edge of a bipartite graph."""
    _, ai = np.unique(a, return_inverse=True)
    _, bi = np.unique(b, return_inverse=True)
    label = np.arange(ai.max() + bi.max() + 2)
    bi = bi + ai.max() + 1
    while True:
        low = np.minimum(label[ai], label[bi])
        before = label.copy()
        np.minimum.at(label, ai, low)
        np.minimum.at(label, bi, low)
        label = label[label]
        if (label == before).all():
            return label[ai]


def assign_field(edges: pd.DataFrame) -> pd.DataFrame:
    """Optimal pairs of one field of view: ``(fov, la, lb, iou)`` edges in and out."""
    if not len(edges):
        return edges
    edges = edges.sort_values(["la", "lb"], kind="stable")
    part = components(edges["la"].to_numpy(), edges["lb"].to_numpy())
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
    every_a, every_b, iou = (edges[c].to_numpy() for c in ("la", "lb", "iou"))
    keep = []
    for own in np.split(order, starts[1:]):
        if len(own) == 1:
            keep += [k for k in own if iou[k] > 0]
            continue
        la, i = np.unique(every_a[own], return_inverse=True)
        lb, j = np.unique(every_b[own], return_inverse=True)
        weight = np.zeros((len(la), len(lb)))
        weight[i, j] = iou[own]
        at = dict(zip(zip(i.tolist(), j.tolist()), own))
        keep += [at[p] for p in canonical(weight)]
    return edges.iloc[keep]
