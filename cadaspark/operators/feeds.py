"""Registry feeds: one common shape, then a priority merge by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enumerations, merge priority and source confidence.
TITLE_TYPES = ["C_OF_O", "DEED", "CUSTOMARY", "UNKNOWN"]
TITLE_STATUSES = ["ACTIVE", "DISPUTED", "REVOKED", "UNKNOWN"]
PRIORITY = {"offline_raster": 0, "mock_registry": 1, "state_lis": 2, "nlir": 3}
CONFIDENCE = {"offline_raster": 0.85, "mock_registry": 0.70, "state_lis": 0.90, "nlir": 0.90}
UPPERCASING = ["state_lis", "nlir"]

FIELDS = ["title_exists", "title_type", "title_number", "title_status", "acquisition_flag", "zoning_class",
          "permitted_uses", "lga_confirmed"]


def _known(value: Column, allowed: list[str], fold: Column) -> Column:
    folded = F.when(fold, F.upper(value)).otherwise(value)
    return F.when(folded.isin(allowed), folded)


def feed_normalise(raw: DataFrame) -> DataFrame:
    """Source records -> common columns; unknown enumeration values become null.

    The live registries fold case, the local one does not. Rows whose status is not ``ok`` carry no
    record, only the status.
    """
    c = F.col
    fold = c("adapter_id").isin(UPPERCASING)
    ok = c("status") == "ok"
    live = ok & (c("adapter_id") != "offline_raster")
    conf = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return raw.select(
        "run_id", "adapter_id", "status", "priority",
        F.when(live, c("title_type").isNotNull()).alias("title_exists"),
        F.when(live, _known(c("title_type"), TITLE_TYPES, fold)).alias("title_type"),
        F.when(live, c("title_number")).alias("title_number"),
        F.when(live, _known(c("title_status"), TITLE_STATUSES, fold)).alias("title_status"),
        F.when(live, c("acquisition_flag")).alias("acquisition_flag"),
        F.when(live, c("zoning_class")).alias("zoning_class"),
        F.when(
            live,
            F.when(c("permitted_text") == "", F.array().cast("array<string>")).otherwise(F.split("permitted_text", ",")),
        ).alias("permitted_uses"),
        F.when(live, c("lga_confirmed")).alias("lga_confirmed"),
        live.alias("source_verified"),
        F.when(ok, F.try_element_at(conf, c("adapter_id"))).otherwise(0.0).alias("feed_confidence"),
    )


def feed_merge(feeds: DataFrame) -> DataFrame:
    """Per field, the value of the highest-priority feed that has one; meta from the latest record.

    Feeds that failed or found nothing take no part, except that a failure raises ``fallback_used``.
    ``max_by`` combines map-side, so no group is ever gathered.
    """
    c = F.col
    ok = c("status") == "ok"

    def last(field: str) -> Column:
        present = c(field).isNotNull()
        if field == "permitted_uses":
            present = present & (F.size(field) > 0)
        return F.max_by(c(field), F.when(ok & present, c("priority"))).alias(field)

    return feeds.groupBy("run_id").agg(
        F.max_by("adapter_id", F.when(ok, c("priority"))).alias("adapter_id"),
        F.max_by("feed_confidence", F.when(ok, c("priority"))).alias("feed_confidence"),
        F.coalesce(F.bool_or(ok & c("source_verified")), F.lit(False)).alias("source_verified"),
        F.bool_or(~c("status").isin("ok", "no_record")).alias("fallback_used"),
        *[last(f) for f in FIELDS],
    )


def feed_fallback(feeds: DataFrame) -> DataFrame:
    failed = ~F.col("status").isin("ok", "no_record")
    return feeds.groupBy("run_id").agg(
        F.bool_or(failed).alias("fallback_used"), F.count_if(failed).alias("failed_sources")
    )


def null_feed(parcels: DataFrame, matched: DataFrame) -> DataFrame:
    """Every parcel keeps a row; without a record it is the empty, unverified one."""
    c = F.col
    joined = parcels.join(matched, ["lat", "lng"], "left")
    missing = c("record_id").isNull()
    return joined.select(
        "parcel_id",
        c("record_id").alias("title_number"),
        F.when(missing, "No registry data available").otherwise("Mock Registry (local JSON)").alias("source_name"),
        (~missing).alias("feed_active"),
        F.when(missing, 0.0).otherwise(0.7).alias("feed_confidence"),
        (~missing).alias("source_verified"),
    )
