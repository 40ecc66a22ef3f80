"""Facets, freshness, place counts, totals and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.status import live_status
from listinglake.functions.text import split_list


def value_facet(df: DataFrame, values: Column, n: int = 20) -> DataFrame:
    """Listings for each value of an array column, the most frequent first."""
    counts = df.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(n)


def eligibility_facet(df: DataFrame, n: int = 20) -> DataFrame:
    """Values are trimmed before they are counted."""
    return value_facet(df, split_list(F.lower("eligibility")), n)


def count_facets(df: DataFrame, conflict: Column) -> DataFrame:
    """All conditional counts in one pass."""
    return df.agg(
        F.count_if(F.col("mode") == "online").alias("online"),
        F.count_if(F.col("mode").isin("offline", "hybrid")).alias("in_person"),
        F.count_if(F.col("prize_amount") > 0).alias("with_prize"),
        F.count_if(F.col("deadline_ts").isNotNull()).alias("with_deadline"),
        F.count_if(conflict).alias("conflicts"),
    )


def freshness(df: DataFrame) -> DataFrame:
    """Latest check for each source, and under (all) overall."""
    return df.rollup("source").agg(F.max("last_verified_at").alias("last_verified")).select(F.coalesce("source", F.lit("(all)")).alias("source"), "last_verified")


def freshness_line(df: DataFrame) -> DataFrame:
    """The latest check of all and the sources it is over, in one row; each source is a row before the list is made."""
    each = df.where("source is not null").groupBy("source").agg(F.max("last_verified_at").alias("t"))
    return each.agg(F.max("t").alias("last_verified"), F.array_sort(F.collect_list("source")).alias("sources"))


def top_places(df: DataFrame, places: DataFrame, now: Column, n: int = 8) -> DataFrame:
    """Open and total counts of listings that are not closed. ``places``: city_key, place."""
    live = df.withColumn("status", live_status(F.col("deadline_ts"), F.col("opens_ts"), now)).where("status != 'closed'")
    counts = live.groupBy("city_key").agg(F.count_if(F.col("status") == "open").alias("open_count"), F.count(F.lit(1)).alias("total_count"))
    return counts.join(places, "city_key").select("place", "open_count", "total_count").orderBy(F.desc("open_count"), F.desc("total_count"), "place").limit(n)


def places_with_events(df: DataFrame, places: DataFrame, now: Column) -> DataFrame:
    status = live_status(F.col("deadline_ts"), F.col("opens_ts"), now)
    counts = df.groupBy("city_key").agg(F.count(F.lit(1)).alias("event_count"), F.count_if(status == "open").alias("open_count"))
    joined = places.join(counts, "city_key", "left").na.fill(0, ["event_count", "open_count"])
    return joined.where("event_count > 0").select("place", "event_count", "open_count")


def pipeline_totals(df: DataFrame, conflict: Column, now: Column) -> DataFrame:
    status = live_status(F.col("deadline_ts"), F.col("opens_ts"), now)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "open").alias("open"),
        F.count_if(status == "closed").alias("closed"),
        F.count_if(~status.isin("open", "closed")).alias("other"),
        F.count_if(conflict).alias("conflicts"),
        F.count_if(F.col("deadline_ts").isNull()).alias("missing_deadline"),
        F.count_if(F.date_trunc("day", F.col("last_verified_at")) == F.date_trunc("day", now)).alias("updated_today"),
    )


def histograms(df: DataFrame, **columns: Column) -> DataFrame:
    """Counts by value of several columns in one pass: (facet, value, n)."""
    named = df.select(*[c.cast("string").alias(n) for n, c in columns.items()])
    sets = named.groupingSets([[n] for n in columns], *columns)
    k = len(columns)
    facet = F.lit(None).cast("string")
    for i, n in enumerate(columns):
        facet = F.when(F.col("g") == ((1 << k) - 1) ^ (1 << (k - 1 - i)), n).otherwise(facet)
    counted = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    value = F.lit(None).cast("string")
    for n in columns:
        value = F.when(F.col("facet") == n, F.col(n)).otherwise(value)
    return counted.withColumn("facet", facet).select("facet", value.alias("value"), "n")


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
