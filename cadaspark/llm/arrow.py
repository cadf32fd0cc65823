"""Arrow helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows per batch that a task hands back; only bounds memory, never results.
SLICE_ROWS = 512
SLICE_CHARS = 4_000_000


def release() -> None:
    """Hand what a finished task has freed back to the system: Spark keeps its Python workers, and each would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_index: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds few rows and, unless a single text is longer, few characters."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(text_index)).fill_null(0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_CHARS, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def int_lists(packed: list[bytes]) -> pa.ListArray:
    """A list<int32> array from one packed little-endian buffer per row."""
    offsets = np.zeros(len(packed) + 1, dtype=np.int64)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_text(
    df: DataFrame,
    text: str,
    carry: list[str],
    schema: str,
    build: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
) -> DataFrame:
    """Run a per-text function in Arrow batches: output columns are ``carry``, then those of ``schema``.

    ``build`` runs once per task and returns a function from a list of texts to Arrow columns with a value per text.
    """
    narrow = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias(fresh(df, "text_to_map")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    last = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        names: list[str] = []
        for batch in slices(batches, last):
            columns = work(batch.column(last).to_pylist())
            names = names or [f.strip().split(" ")[0].strip("`") for f in _fields(schema)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], [*carry, *names])
        del work
        release()

    return narrow.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]
