"""Table-level governance: phrase reports, credential overlap, allow lists, audit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import textrules
from cadaspark.functions.numeric import rnd
from cadaspark.operators.carried import scan

def prohibited_phrases(reports: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per phrase found in each text field."""
    unpivoted = reports.select(
        key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
    )
    return unpivoted.select(key, "x.field", F.explode(textrules.phrases_found(F.col("x.text"))).alias("phrase"))


def credential_overlap(owners: DataFrame) -> DataFrame:
    """Owners of a channel that share a credential, or cannot be shown not to.

    ``owners``: owner, channel, hash_1, hash_2, two_keys (channels with one key ignore hash_2). For
    each owner the number of partners with a matching hash and of partners that stay unknown. The
    counts come from group sizes by inclusion and exclusion, so no pair of owners is ever formed,
    and the partners themselves are the rows with the same hash.
    """
    c = F.col
    rows = owners.select(
        "owner", "channel", c("hash_1").alias("h1"), F.when(c("two_keys"), c("hash_2")).alias("h2"), "two_keys"
    ).withColumn("full", c("h1").isNotNull() & (c("h2").isNotNull() | ~c("two_keys")))
    by_pair = rows.groupBy("channel", "h1", "h2").agg(
        F.count("*").alias("same"), F.count_if("full").alias("same_full")
    )

    def sizes(keys: list[str], tag: str) -> DataFrame:
        known = by_pair.dropna(subset=keys)
        return known.groupBy("channel", *keys).agg(
            F.sum("same").alias(f"n{tag}"), F.sum("same_full").alias(f"f{tag}")
        )

    everyone = by_pair.groupBy("channel").agg(F.sum("same").alias("n"), F.sum("same_full").alias("nf"))
    joined = (
        rows.join(everyone, "channel")
        .join(sizes(["h1"], "1"), ["channel", "h1"], "left")
        .join(sizes(["h2"], "2"), ["channel", "h2"], "left")
        .join(sizes(["h1", "h2"], "12"), ["channel", "h1", "h2"], "left")
    )

    def partners(prefix: str) -> Column:
        zero = F.lit(0)
        total = F.coalesce(c(f"{prefix}1"), zero) + F.coalesce(c(f"{prefix}2"), zero) - F.coalesce(c(f"{prefix}12"), zero)
        return F.greatest(total - 1, zero)

    matching = partners("n")
    proven_other = F.when(c("full"), c("nf") - 1 - partners("f")).otherwise(0)
    out = joined.select(
        "channel", "owner", matching.alias("matching_partners"),
        (c("n") - 1 - matching - proven_other).alias("unknown_partners"),
    )
    reason = F.when(c("matching_partners") > 0, "matching-token").when(c("unknown_partners") > 0, "unknown-token")
    return out.withColumn("reason", reason).filter("reason IS NOT NULL")


def parse_allow_list(raw: DataFrame, column: str) -> DataFrame:
    """(allowed) from comma-separated lists: trimmed, without blanks, each id once."""
    parts = raw.select(F.explode(F.split(column, ",")).alias("part")).select(F.btrim("part").alias("allowed"))
    return parts.filter("allowed <> ''").distinct()


def allow_list_filter(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Keep rows whose id is in ``allowed`` (allowed string); an empty list keeps everything."""
    if allowed.isEmpty():
        return rows
    return rows.join(allowed, F.col(column).cast("string") == F.col("allowed"), "left_semi")


def audit_log_stats(events: DataFrame) -> DataFrame:
    """Per sandbox: how often it went down, how it came back and for how long.

    ``events``: sandbox, action, ts, event_id. A down period ends at the next up or automatic
    restore; a second down before that starts a new period.
    """
    c = F.col
    turning = events.filter(c("action").isin("shields_down", "shields_up", "shields_auto_restore"))
    linked = scan(turning, ["sandbox"], ["ts", "event_id"], following={"nxt": ["action", "ts"]})
    ended = (c("action") == "shields_down") & (c("nxt.action") != "shields_down")
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    seconds = F.when(ended, (micros(c("nxt.ts")) - micros(c("ts"))) / 1e6)
    periods = linked.withColumn("seconds", seconds).groupBy("sandbox").agg(
        F.count_if(c("action") == "shields_down").alias("downs"),
        F.count_if(c("action") == "shields_up").alias("ups"),
        F.count_if(c("action") == "shields_auto_restore").alias("auto_restores"),
        F.count("seconds").alias("closed_periods"),
        rnd(F.avg("seconds"), 2).alias("mean_down_s"),
        rnd(F.max("seconds"), 2).alias("max_down_s"),
    )
    failed = events.groupBy("sandbox").agg(F.count_if(c("action") == "shields_up_failed").alias("failed_ups"))
    return failed.join(periods, "sandbox", "left").fillna(0, ["downs", "ups", "auto_restores", "closed_periods"])
