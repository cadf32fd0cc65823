"""Farthest vertex pair of each ring by convex hulls that merge.

A ring is cut into chunks of its vertices; each chunk gives the corners of its own hull, and the corners of all chunks together give
those of the ring. Among the corners the farthest partner of each is found by the monotony of farthest corners along a convex
outline (divide and conquer), so no pair of all vertices is formed. Lengths are compared in whole millimetres; of equally long
pairs the one with the earliest vertices is taken. A ring whose vertices coincide gives its first vertex twice.

Python runs in Arrow batches over rows that Spark has dealt out and sorted; a task holds one chunk or the corners of one ring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
# Up to so many corners all distances are looked at in one matrix.
SMALL = 64


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of distinct points, in order around it."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order
    px, py = x[order].tolist(), y[order].tolist()

    def half(steps: range) -> list[int]:
        out: list[int] = []
        for i in steps:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (px[b] - px[a]) * (py[i] - py[a]) - (py[b] - py[a]) * (px[i] - px[a]) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    n = len(order)
    lower, upper = half(range(n)), half(range(n - 1, -1, -1))
    return order[np.array(lower[:-1] + upper[:-1])]


def _length(x: np.ndarray, y: np.ndarray, i, j) -> np.ndarray:
    return np.sqrt((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]))


def farthest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance from each corner of a convex outline, given in order, to the corner farthest from it."""
    n = len(x)
    if n <= SMALL:
        return _length(x, y, np.arange(n)[:, None], np.arange(n)[None, :]).max(axis=1)
    out = np.zeros(n)
    # corner i looks at i + 1 to i + n - 1 on the outline laid out twice; the farthest one never moves back as i grows
    waiting = [(0, n - 1, 1, 2 * n - 2)]
    while waiting:
        low, high, first, last = waiting.pop()
        i = (low + high) // 2
        seen = np.arange(max(first, i + 1), min(last, i + n - 1) + 1)
        d = _length(x, y, i, seen % n)
        best = int(seen[d.argmax()])
        out[i] = d.max()
        if low < i:
            waiting.append((low, i - 1, first, best))
        if i < high:
            waiting.append((i + 1, high, best, last))
    return out


def _millimetres(d: np.ndarray) -> np.ndarray:
    return np.floor(d * 1000 + 0.5)


def farthest_pair(seq: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Places of the first of the longest pairs among the corners of a hull, the earlier vertex first."""
    if len(seq) == 1:
        return 0, 0
    reach = _millimetres(farthest(x, y))
    longest = reach.max()
    ends = np.flatnonzero(reach == longest)
    first = int(ends[seq[ends].argmin()])
    partners = np.flatnonzero((_millimetres(_length(x, y, first, np.arange(len(seq)))) == longest) & (seq > seq[first]))
    return first, int(partners[seq[partners].argmin()])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to tables of whole groups; rows of a group follow one another in the first ``keys`` columns."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if waiting:
            before = waiting[-1]
            if any(before.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
                yield work(pa.Table.from_batches(waiting))
                waiting = []
        if len(changes):
            waiting.append(batch.slice(0, int(changes[-1])))
            yield work(pa.Table.from_batches(waiting))
            waiting = [batch.slice(int(changes[-1]))]
        else:
            waiting.append(batch)
    if waiting:
        yield work(pa.Table.from_batches(waiting))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _groups(*keys: np.ndarray) -> list[slice]:
    changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    bounds = [0, *changes.tolist(), len(keys[0])]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def _distinct(x: np.ndarray, y: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Places of distinct points, each where it comes first."""
    order = np.lexsort((seq, y, x))
    new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
    return order[new]


def longest_pairs(metric: DataFrame) -> DataFrame:
    """run_id, zone, seq, seq2, (e, n) and (qe, qn) of the farthest vertices of each ring of (run_id, zone, seq, e, n)."""
    fields = ["run_id", "zone", "seq", "e", "n"]
    types = {"run_id": "bigint", "zone": "int", "seq": "bigint", "e": "double", "n": "double"}
    rows = metric.select(*[F.col(f).cast(types[f]) for f in fields]).where("run_id IS NOT NULL AND zone IS NOT NULL AND NOT isnan(e) AND NOT isnan(n)")
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK))

    def corners(table: pa.Table) -> pa.RecordBatch:
        run, chunk, seq, e, n = _columns(table, "run_id", "chunk", "seq", "e", "n")
        found = []
        for g in _groups(run, chunk):
            some = _distinct(e[g], n[g], seq[g])
            found.append(g.start + some[hull(e[g][some], n[g][some])])
        return table.select(fields).take(np.concatenate(found)).combine_chunks().to_batches()[0]

    def pairs(table: pa.Table) -> pa.RecordBatch:
        run, zone, seq, e, n = _columns(table, *fields)
        picked = []
        for g in _groups(run):
            some = _distinct(e[g], n[g], seq[g])
            outline = some[hull(e[g][some], n[g][some])]
            i, j = farthest_pair(seq[g][outline], e[g][outline], n[g][outline])
            picked.append((g.start + outline[i], g.start + outline[j]))
        i, j = np.array(picked).T
        return pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (run[i], zone[i], seq[i], seq[j], e[i], n[i], e[j], n[j])],
            ["run_id", "zone", "seq", "seq2", "e", "n", "qe", "qn"],
        )

    dealt = rows.select("run_id", "chunk", "zone", "seq", "e", "n").repartition("run_id", "chunk").sortWithinPartitions("run_id", "chunk")
    parts = dealt.mapInArrow(lambda b: _grouped(b, 2, corners), ", ".join(f"{f} {types[f]}" for f in fields))
    merged = parts.repartition("run_id").sortWithinPartitions("run_id")
    schema = "run_id bigint, zone int, seq bigint, seq2 bigint, e double, n double, qe double, qn double"
    return merged.mapInArrow(lambda b: _grouped(b, 1, pairs), schema)
