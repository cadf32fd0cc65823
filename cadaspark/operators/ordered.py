"""Ordered analytics that survive one very long group.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here every key is cut into
chunks by a monotone ``chunk`` column; windows run inside (key, chunk), and only one row per chunk
travels through the per-key window that stitches chunks together. The exchange on (key, chunk) is
shared by the rows and by the per-chunk summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.sources.scratch import large

CHUNK_ROWS = 4096


def seq_chunk(seq: str = "seq") -> Column:
    """Chunk number for a dense sequence."""
    return F.floor(F.col(seq) / F.lit(CHUNK_ROWS)).cast("long")


def running_sums(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums of several expressions per key, in ``order``."""
    part = df.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*key, "_chunk").orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = part.select("*", *[F.sum(c).over(inner).alias(f"_loc_{o}") for o, c in sums.items()])
    totals = local.groupBy(*key, "_chunk").agg(
        *[F.sum(c).alias(f"_tot_{o}") for o, c in sums.items()]
    )
    before = Window.partitionBy(*key).orderBy("_chunk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *key, "_chunk", *[F.sum(f"_tot_{o}").over(before).alias(f"_base_{o}") for o in sums]
    )
    joined = local.join(large(bases), [*key, "_chunk"])
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(f"_base_{o}").isNull(), F.col(f"_loc_{o}"))
            .otherwise(F.col(f"_base_{o}") + F.col(f"_loc_{o}"))
            .alias(o)
            for o in sums
        ],
    )


def with_row_number(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, out: str = "seq", start: int = 0
) -> DataFrame:
    """Dense numbering per key in ``order``."""
    numbered = running_sums(df, key, order, chunk, {out: F.lit(1).cast("long")})
    return numbered.withColumn(out, F.col(out) - 1 + start)


def _neighbour(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, cols: list[str], out: str, ahead: bool
) -> DataFrame:
    part = df.withColumn("_chunk", chunk)
    asc = [F.col(o).asc() if ahead else F.col(o).desc() for o in order]
    inner = Window.partitionBy(*key, "_chunk").orderBy(*asc)
    local = part.select(
        "*",
        F.row_number().over(inner).alias("_rn"),
        F.lead(F.struct(*cols)).over(inner).alias("_next"),
    )
    heads = local.filter("_rn = 1").select(*key, "_chunk", F.struct(*cols).alias("_head"))
    across = Window.partitionBy(*key).orderBy(F.col("_chunk").asc() if ahead else F.col("_chunk").desc())
    heads = heads.select(*key, "_chunk", F.lead("_head").over(across).alias("_across"))
    joined = local.join(large(heads), [*key, "_chunk"])
    return joined.select(*df.columns, F.coalesce("_next", "_across").alias(out))


def with_next(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, cols: list[str], out: str = "nxt"
) -> DataFrame:
    """Attach a struct of ``cols`` from the following row of the key (null on the last row)."""
    return _neighbour(df, key, order, chunk, cols, out, ahead=True)


def with_previous(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, cols: list[str], out: str = "prev"
) -> DataFrame:
    """Attach a struct of ``cols`` from the preceding row of the key (null on the first row)."""
    return _neighbour(df, key, order, chunk, cols, out, ahead=False)
