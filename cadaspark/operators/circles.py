"""Counts within circles by tiles: Arrow groups of places and of the targets that they can reach.

Inside a tile targets are sorted by strip and position. A circle cuts an interval out of each strip; what lies surely inside is a
difference of running totals, and only targets between the surely-inside and the possibly-inside interval are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STRIP_M = 250.0
SLACK_M = 0.01
# Width that keeps the strips of a tile apart in one sorted array; places taken, and pairs compared, at once.
WIDE, PLACES, PAIRS = float(1 << 20), 256, 1 << 21


def counts_within(px: np.ndarray, py: np.ndarray, gx: np.ndarray, gy: np.ndarray, gw: np.ndarray, radius: float) -> np.ndarray:
    """Sum of the weights ``gw`` of targets within ``radius`` of each place."""
    out = np.zeros(len(px), dtype=np.int64)
    if not len(gx):
        return out
    strip = np.floor(gy / STRIP_M)
    order = np.lexsort((gx, strip))
    gx, gy, gw, strip = gx[order], gy[order], gw[order], strip[order]
    first, last, left, extent = strip[0], strip[-1], gx.min(), np.ptp(gx)
    key = (strip - first) * WIDE + (gx - left)
    before = np.concatenate([[0], np.cumsum(gw)])
    around = np.arange(-int(np.ceil(radius / STRIP_M)) - 1, int(np.ceil(radius / STRIP_M)) + 2)
    for start in range(0, len(px), PLACES):
        x, y = px[start:start + PLACES], py[start:start + PLACES]
        at = np.floor(y / STRIP_M)[:, None] + around
        low = at * STRIP_M - y[:, None]
        near = np.maximum(np.maximum(low, -low - STRIP_M), 0.0)
        far = np.maximum(np.abs(low), np.abs(low + STRIP_M))
        place, column = np.nonzero((near <= radius + SLACK_M) & (at >= first) & (at <= last))
        near, far, base = near[place, column], far[place, column], (at[place, column] - first) * WIDE
        outer = np.sqrt(np.maximum((radius + SLACK_M) ** 2 - near * near, 0.0))
        inner = np.sqrt(np.maximum((radius - SLACK_M) ** 2 - far * far, 0.0))
        middle = x[place] - left
        find = lambda v, side: np.searchsorted(key, base + np.clip(v, -1.0, extent + 1.0), side)
        a, b = find(middle - outer, "left"), find(middle + outer, "right")
        whole = far < radius - SLACK_M
        ia, ib = np.where(whole, find(middle - inner, "left"), a), np.where(whole, find(middle + inner, "right"), a)
        held = np.zeros(len(x), dtype=np.int64)
        np.add.at(held, place, before[ib] - before[ia])
        starts, lengths, owner = np.concatenate([a, ib]), np.concatenate([ia - a, b - ib]), np.concatenate([place, place])
        some = lengths > 0
        starts, lengths, owner = starts[some], lengths[some], owner[some]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, total, PAIRS)), [len(ends)]]))
        for i, j in zip(cuts, cuts[1:]):
            size = lengths[i:j]
            target = np.arange(size.sum()) + np.repeat(starts[i:j] - (np.cumsum(size) - size), size)
            mine = np.repeat(owner[i:j], size)
            dx, dy = x[mine] - gx[target], y[mine] - gy[target]
            hit = np.sqrt(dx * dx + dy * dy) <= radius
            np.add.at(held, mine[hit], gw[target[hit]])
        out[start:start + PLACES] = held
    return out


def tile_counts(places: pa.Table, targets: pa.Table, radii: list[float]) -> pa.Table:
    """lat, lng and within_0, within_1, ... of the places (lat, lng, e, n) of a tile with its targets (e, n, w)."""
    px, py = (places.column(k).to_numpy() for k in ("e", "n"))
    gx, gy, gw = (targets.column(k).to_numpy() for k in ("e", "n", "w"))
    known = np.isfinite(px) & np.isfinite(py)
    columns = {"lat": places.column("lat"), "lng": places.column("lng")}
    for i, radius in enumerate(radii):
        found = np.zeros(len(px), dtype=np.int64)
        found[known] = counts_within(px[known], py[known], gx, gy, gw, radius)
        columns[f"within_{i}"] = pa.array(found)
    return pa.table(columns)
