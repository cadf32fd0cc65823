"""Hosts against lists of networks and names that are read as data.

An address lies in a network of length n when their first n bits agree, so each list row is one key (length, leading bits) and an address
looks up one key for each length that the list holds: an equi-join, however long the list. Names are looked up by every domain suffix of
a host. The longest network or name wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import textrules


def leading_bits(number: Column, length: Column) -> Column:
    """The first ``length`` bits of a 32-bit address."""
    return F.call_function("shiftright", number.cast("bigint"), (F.lit(32) - length).cast("int"))


def parse_networks(lists: DataFrame, network: str = "network") -> DataFrame:
    """(length, bits, network) of IPv4 networks such as 10.0.0.0/8 or single addresses; anything else is left out, bits beyond the length ignored."""
    c = F.col
    number = textrules.v4_number(F.substring_index(network, "/", 1))
    length = F.when(F.instr(network, "/") > 0, F.substring_index(network, "/", -1).try_cast("int")).otherwise(32)
    known = lists.select(c(network).alias("network"), number.alias("number"), length.alias("length")).where("number IS NOT NULL AND length BETWEEN 0 AND 32")
    return known.groupBy("length", leading_bits(c("number"), c("length")).alias("bits")).agg(F.min("network").alias("network"))


def listed(hosts: DataFrame, networks: DataFrame, names: DataFrame, key: str = "id", host: str = "host") -> DataFrame:
    """key, host and ``listed_by``: the longest network (network) or name (name) that holds the host, null if none does."""
    c = F.col
    bare = F.lower(F.regexp_replace(host, r"\.$", ""))
    nets = parse_networks(networks)
    lengths = [r["length"] for r in nets.select("length").distinct().collect()]  # at most 33
    places = hosts.select(bare.alias("bare")).distinct()
    numbered = places.select("bare", textrules.v4_number(c("bare")).alias("number"))
    probes = numbered.where("number IS NOT NULL").withColumn("length", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    by_net = probes.withColumn("bits", leading_bits(c("number"), c("length"))).join(nets, ["length", "bits"]).select(
        "bare", F.struct(c("length").alias("size"), c("network").alias("by")).alias("found")
    )
    labels = F.split("bare", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    given = names.select(F.lower(F.btrim("name")).alias("suffix")).where("suffix <> ''").distinct()
    by_name = numbered.where("number IS NULL AND bare <> ''").select("bare", F.explode(suffixes).alias("suffix")).join(given, "suffix").select(
        "bare", F.struct(F.length("suffix").alias("size"), c("suffix").alias("by")).alias("found")
    )
    best = by_net.unionByName(by_name).groupBy("bare").agg(F.max("found").alias("found"))
    return hosts.withColumn("bare", bare).join(best, "bare", "left").select(key, host, c("found.by").alias("listed_by"))
