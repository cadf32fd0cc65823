"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected in ``CURVES`` random ways to ``AXES`` dimensions; each projection is shifted by a random offset and
ordered along a Hilbert curve. Each order is cut into buckets of about equal numbers of rows, and a query is compared, by its
true distance, with the rows of its own bucket and of ``REACH`` buckets on either side. What all curves find is merged and ranked.

The projections are scaled on at most about ``SAMPLE`` rows (taken by a hash of the id); every row is indexed. Buckets are a share of
the rows, since the neighbours of a vector without low-dimensional structure lie within a share of an order and not within a number
of places. A bucket with many rows (many copies of one vector) is dealt to several tasks, so a task holds a bounded block.

Edge cases: a vector that is null, zero, of another length than most or that holds a null or non-finite component takes no part;
an empty table gives an empty result; with few rows every row is compared; equal distances go to the smaller id; rows that repeat
an id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.sources.scratch import keep

CURVES, AXES, BITS = 16, 8, 5
BUCKETS, REACH = 80, 2
LEAST_BUCKET = 256
BLOCK_ROWS = 16_384
SAMPLE = 10_000
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer grid points [row, axis], each axis of ``bits`` bits (at most 63 in all)."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, -1, -1):
        low = (1 << level) - 1
        for i in range(axes):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[i] ^= swap
            x[0] ^= np.where(upper, low, swap)
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> level & 1)
    return key


class Orders:
    """Rotations, shifts and grid of all curves."""

    def __init__(self, sample: np.ndarray, dimension: int) -> None:
        axes = min(AXES, dimension)
        rng = np.random.default_rng(SEED)
        self.turns = [np.linalg.qr(rng.normal(size=(dimension, axes)))[0] for _ in range(CURVES)]
        self.shifts = rng.uniform(0, 1, (CURVES, axes))
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(dimension)
        spread = [(sample - self.mean) @ t for t in self.turns] if len(sample) else []
        self.scales = [max(float(p.std()), 1e-12) for p in spread] or [1.0] * CURVES

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """[row, curve]; the grid covers three deviations around the mean and the shift moves it by up to one."""
        out = np.zeros((len(vectors), CURVES), dtype=np.int64)
        side = 1 << BITS
        for c, (turn, scale) in enumerate(zip(self.turns, self.scales, strict=True)):
            p = ((vectors - self.mean) @ turn) / scale
            grid = np.clip((p + 3 + self.shifts[c]) / 7 * side, 0, side - 1)
            out[:, c] = hilbert_keys(np.floor(grid), BITS)
        return out


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their dimension."""
    v = F.col(vector).cast("array<double>")
    fine = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = sizes[0]["n"] if sizes else 1
    return fine.where(F.size("v") == dimension), dimension


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _top(query_id: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int) -> list[tuple]:
    """For each query its ``k`` nearest rows of a block: (query, row, distance)."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, base = ids[order], base[order]
    for q, x in zip(query_id, queries, strict=True):
        far = np.sqrt(((base - x) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        first = np.argsort(far, kind="stable")[:k]
        out += [(q, ids[i], far[i]) for i in first if np.isfinite(far[i])]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the ``k`` nearest rows found for each query.

    ``is_query`` is a condition on ``id``.
    """
    rows, dimension = usable(vectors, key, vector)
    total = rows.count()
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < share).orderBy("id").toPandas()
    orders = Orders(np.array(picked["v"].tolist(), dtype=np.float64).reshape(-1, dimension), dimension)
    buckets = int(min(BUCKETS, max(1, total // LEAST_BUCKET)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = orders.keys(_matrix(batch.column(1), dimension))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), CURVES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "v", "q", "keys"])

    schema = "id bigint, v array<double>, q boolean, keys array<bigint>"
    table = keep(rows.select("id", "v", is_query.alias("q")).mapInArrow(keyed, schema), "curve-keys")
    steps = [i / buckets for i in range(1, buckets)]
    cuts = np.zeros((CURVES, len(steps)), dtype=np.int64)
    if steps:
        spread = table.select(F.posexplode("keys").alias("c", "key")).groupBy("c")
        for r in spread.agg(F.percentile_approx("key", steps, 20_000).alias("p")).collect():
            # copies of one vector fill several quantiles with one cut: without repeats, REACH counts filled buckets only
            distinct = np.unique(r["p"])
            cuts[r["c"]] = np.iinfo(np.int64).max
            cuts[r["c"], : len(distinct)] = distinct

    def places(batch: pa.RecordBatch) -> np.ndarray:
        keys = batch.column("keys").flatten().to_numpy().reshape(-1, CURVES)
        return np.stack([np.searchsorted(cuts[c], keys[:, c], side="left") for c in range(CURVES)], axis=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (places(batch) + np.arange(CURVES) * buckets).ravel()
            n = np.bincount(cell, minlength=CURVES * buckets)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["cell", "n"])

    counts = table.select("keys").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    parts = np.ones(CURVES * buckets, dtype=np.int64)
    for r in counts.collect():  # one number for each bucket of each curve
        parts[r["cell"]] = -(-r["n"] // BLOCK_ROWS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch)
            ids, asks = batch.column("id").to_numpy(), batch.column("q").to_numpy(zero_copy_only=False)
            row, curve = np.divmod(np.arange(at.size), CURVES)
            cell = curve * buckets + at.ravel()
            salt = (ids[row] * 2654435761 >> 7) % parts[cell]
            out = [(cell, salt, row, np.zeros(len(row), dtype=bool))]
            for step in range(-REACH, REACH + 1):
                near = at + step
                r, c = np.nonzero(asks[:, None] & (near >= 0) & (near < buckets))
                where = c * buckets + near[r, c]
                times = parts[where]
                each = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
                out.append((np.repeat(where, times), each, np.repeat(r, times), np.ones(times.sum(), dtype=bool)))
            cell, salt, row, query = (np.concatenate(x) for x in zip(*out, strict=True))
            for start in range(0, len(row), 20_000):
                part = slice(start, start + 20_000)
                source = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[part]), pa.array(salt[part]), pa.array(query[part]), batch.column("id").take(source),
                     batch.column("v").take(source)],
                    ["cell", "salt", "q", "id", "v"],
                )

    def ranked(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        query = block.column("q").to_numpy(zero_copy_only=False)
        ids = block.column("id").to_numpy()
        v = _matrix(block.column("v").chunk(0), dimension) if block.num_rows else np.zeros((0, dimension))
        found = _top(ids[query], v[query], ids[~query], v[~query], k)
        return pa.table(
            {
                "query_id": pa.array([int(q) for q, _, _ in found], pa.int64()),
                "vec_id": pa.array([int(i) for _, i, _ in found], pa.int64()),
                "score": pa.array([float(d) for _, _, d in found], pa.float64()),
            }
        )

    blocks = table.mapInArrow(dealt, "cell bigint, salt bigint, q boolean, id bigint, v array<double>")
    found = blocks.groupBy("cell", "salt").applyInArrow(ranked, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
