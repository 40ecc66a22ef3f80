"""Upserts as joins that give the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.functions.status import live_status


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep: tuple[str, ...] = (), old_first: tuple[str, ...] = ()) -> DataFrame:
    """``target`` with ``updates`` over it. Columns in ``keep`` stay as they were in rows that exist; in ``old_first`` an
    old value goes before a new one; in all others a row in ``updates`` replaces the old value.

    Keys must not repeat in either table.
    """
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    u = updates.select(*keys, F.struct(*[c for c in updates.columns if c not in keys]).alias("_new"))
    both = t.join(u, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in updates.columns:
            out.append(F.col(f"_old.{c}").alias(c))
        elif c in old_first:
            out.append(F.coalesce(f"_old.{c}", f"_new.{c}").alias(c))
        elif c in keep:
            out.append(F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c))
        else:
            out.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c))
    return both.select(*out)


def replace_rows(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh``, and those of ``target`` whose keys are not in it."""
    return target.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def provenance_or_title(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """Provenance (event_id, field, value, source, confidence) with a ``title`` row for each (event, source) of ``listings`` that has none.

    ``listings``: event_id, source, title. Of several listings of one source the smallest title stands; without a title there is no row.
    """
    bare = listings.where("title is not null").groupBy("event_id", "source").agg(F.min("title").alias("value"))
    without = bare.join(rows.select("event_id", "source").distinct(), ["event_id", "source"], "left_anti")
    return rows.unionByName(without.select("event_id", F.lit("title").alias("field"), "value", "source", F.lit("source_confirmed").alias("confidence")))


def geocode_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache (key, latitude, longitude, found) after further answers (key, latitude, longitude); an empty answer is kept, so that it is not asked again.

    An answer with coordinates replaces what is cached; an empty one enters only where nothing is cached yet. Of several answers for a
    key one with coordinates goes first, then the smallest.
    """
    answered = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    best = answers.where("key is not null").groupBy("key").agg(F.min(F.when(answered, F.struct("latitude", "longitude"))).alias("a"))
    asked = best.select("key", F.col("a.latitude").alias("latitude"), F.col("a.longitude").alias("longitude"), F.col("a").isNotNull().alias("found"))
    news = asked.join(cache.select("key"), "key", "left_anti").unionByName(asked.where("found").join(cache.select("key"), "key", "left_semi"))
    return merge_upsert(cache, news, ["key"])


def place_upsert(places: DataFrame, updates: DataFrame) -> DataFrame:
    """State, country and metro: new before old; coordinates: old before new."""
    old, new = places.alias("o"), updates.alias("n")
    both = old.join(new, F.col("o.place_key") == F.col("n.place_key"), "full_outer")
    first = lambda c, a, b: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return both.select(first("place_key", "o", "n"), first("state", "n", "o"), first("metro", "n", "o"), first("latitude", "o", "n"), first("longitude", "o", "n"))


def accepted_and_rejected(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required values, and the others with ``reason``: the first that lacks."""
    lacks = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), c) for c in required]
    tagged = df.withColumn("reason", F.coalesce(*lacks))
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def status_changes(df: DataFrame, now: str, later: str) -> DataFrame:
    """Listings whose status differs between two instants."""
    at = lambda t: live_status(F.col("deadline_ts"), F.col("opens_ts"), F.lit(t).cast("timestamp"))
    return df.select("listing_id", at(now).alias("old_status"), at(later).alias("new_status")).where("old_status != new_status")
