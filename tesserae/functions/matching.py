"""Sequence similarity and least-cost matching, as Arrow functions for the survivors of cheaper filters."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from tesserae.functions import arrow


@arrow("double")
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matched share of two texts (strings or arrays), popular elements included."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, list(a), list(b), autojunk=False).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def assignment(costs: np.ndarray) -> list[int]:
    """Column of each row in the matching of least total cost (square matrices).

    Successive shortest augmenting paths with potentials: every step settles the
    nearest column until a free one is reached, all rows of it vectorised.
    """
    n = len(costs)
    row_of, u, v = np.full(n, -1), np.zeros(n), np.zeros(n)
    for start in range(n):
        near, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, far, last = start, 0.0, -1
        reached = []
        while True:
            slack = far + costs[row] - u[row] - v
            better = ~done & (slack < near)
            near[better], via[better] = slack[better], last
            last = int(np.argmin(np.where(done, np.inf, near)))
            far = near[last]
            done[last] = True
            reached.append(last)
            if row_of[last] < 0:
                break
            row = row_of[last]
        u[start] += far
        for c in reached[:-1]:
            u[row_of[c]] += far - near[c]
        for c in reached:
            v[c] += near[c] - far
        while last >= 0:  # shift the matching along the path
            before = via[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    out = [0] * n
    for c, r in enumerate(row_of):
        out[r] = c
    return out


#: Pairs of colours further apart than this are never matched.
FAR, FORBIDDEN = 2.0, 1e9


@arrow("struct<mean:double,most:double,matching:array<int>>")
def matched_distance(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Mean and greatest distance of two colour lists (arrays of OKLab 6-vectors) in their least-cost matching."""
    rows = []
    for a, b in zip(left, right, strict=True):
        x, y = np.array([list(r) for r in a], float), np.array([list(r) for r in b], float)
        d = x[:, None] - y[None]
        worst = np.sqrt(np.maximum((d[..., :3] ** 2).sum(-1), (d[..., 3:] ** 2).sum(-1)))
        found = assignment(np.where(worst > FAR, FORBIDDEN, worst))
        own = worst[np.arange(len(x)), found]
        rows.append((own.mean(), own.max(), found))
    return pd.DataFrame(rows, columns=["mean", "most", "matching"])
