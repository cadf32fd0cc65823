"""Ordered analytics by a scan over range partitions, with one carry row from partition to partition.

Rows are dealt out by ranges of (key, order), so a key of any size spreads over as many tasks as its rows need, whatever its density
in time; the sorted ranges are written once. Windows run inside (range, key). A key that goes on from one range to the next is
completed from two summary rows a range: what a range ends with is carried to those that begin with the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.sources.scratch import keep

PLACE = (1 << 33) - 1


def scan(
    df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None,
    previous: dict[str, list[str]] | None = None, following: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``df`` with inclusive running sums per key and structs of columns of the previous and the following row of the key.

    ``sums`` maps a new column to what is summed (never null), ``previous`` and ``following`` to the columns taken over. ``order``
    should tell rows apart: rows that agree on it stay in one range.
    """
    c = F.col
    sums, previous, following = sums or {}, previous or {}, following or {}
    ranged = df.select("*", *[v.alias(f"_v_{o}") for o, v in sums.items()]).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))
    placed = keep(ranged.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), "ordered-ranges")
    group = Window.partitionBy("_part", *key).orderBy("_at")
    running = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        "*",
        *[F.sum(f"_v_{o}").over(running).alias(f"_sum_{o}") for o in sums],
        *[F.lag(F.struct(*cols)).over(group).alias(f"_prev_{o}") for o, cols in previous.items()],
        *[F.lead(F.struct(*cols)).over(group).alias(f"_next_{o}") for o, cols in following.items()],
    )
    carried = F.broadcast(_carries(placed, key, sums, previous, following))  # one row a range
    joined = local.join(carried, "_part")
    mine = F.struct(*key)
    goes_on, ends_open = mine.eqNullSafe(c("_first_key")), mine.eqNullSafe(c("_last_key"))
    return joined.select(
        *df.columns,
        *[(c(f"_sum_{o}") + F.when(goes_on, F.coalesce(f"_base_{o}", F.lit(0))).otherwise(0)).alias(o) for o in sums],
        *[F.coalesce(f"_prev_{o}", F.when(goes_on & (c("_at") == 0), c(f"_before.{o}"))).alias(o) for o in previous],
        *[F.coalesce(f"_next_{o}", F.when(ends_open & (c("_at") == c("_last")), c(f"_after.{o}"))).alias(o) for o in following],
    )


def _carries(placed: DataFrame, key: list[str], sums: dict, previous: dict, following: dict) -> DataFrame:
    """Per range: its first and last key, the last place, and what comes in from earlier ranges and from the next one."""
    c = F.col
    taken = {**previous, **following}
    row = F.struct(*[F.struct(*cols).alias(o) for o, cols in taken.items()]) if taken else F.struct(F.lit(0).alias("none"))
    groups = placed.groupBy("_part", *key).agg(
        F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.min_by(row, "_at").alias("head"), F.max_by(row, "_at").alias("tail"),
        *[F.sum(f"_v_{o}").alias(f"_v_{o}") for o in sums],
    )
    whole = F.struct(F.struct(*key).alias("key"), "head", "tail", "hi", *[f"_v_{o}" for o in sums])
    ends = keep(groups.groupBy("_part").agg(F.min_by(whole, "lo").alias("first"), F.max_by(whole, "hi").alias("last")), "range-ends")
    sides = [
        ends.select(
            "_part", F.lit(kind).alias("kind"), F.to_json(f"{side}.key", {"ignoreNullFields": "false"}).alias("name"),
            c(f"{side}.{edge}").alias("row"), *[F.when(F.lit(kind == 1), c(f"{side}._v_{o}")).alias(f"_v_{o}") for o in sums],
        )
        for kind, side, edge in ((0, "first", "head"), (1, "last", "tail"))
    ]
    line = Window.partitionBy("name").orderBy("_part", "kind")
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    linked = sides[0].unionByName(sides[1]).select(
        "_part", "kind",
        *[F.sum(f"_v_{o}").over(earlier).alias(f"_base_{o}") for o in sums],
        F.last(F.when(c("kind") == 1, c("row")), True).over(earlier).alias("_before"),
        F.first(F.when(c("kind") == 0, c("row")), True).over(later).alias("_after"),
    )
    told = linked.groupBy("_part").agg(
        *[F.max(F.when(c("kind") == 0, c(f"_base_{o}"))).alias(f"_base_{o}") for o in sums],
        F.first(F.when(c("kind") == 0, c("_before")), True).alias("_before"),
        F.first(F.when(c("kind") == 1, c("_after")), True).alias("_after"),
    )
    return told.join(ends.select("_part", c("first.key").alias("_first_key"), c("last.key").alias("_last_key"), c("last.hi").alias("_last")), "_part")
