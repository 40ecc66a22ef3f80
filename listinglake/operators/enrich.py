"""Joins that complete listings: details, coordinates, provenance, source catalogue, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.geo import valid

# What kind of place a geocoder's answer is, the best for a settlement's own point first.
GEOCODE_RANK = {
    "city": 0, "town": 1, "municipality": 1, "village": 2, "borough": 2, "county": 3, "state": 4, "district": 5, "city_district": 5, "locality": 6,
    "suburb": 6, "neighbourhood": 7, "quarter": 7, "other": 8,
}
CONFIDENCE_RANK = {"verified": 0, "source_confirmed": 1, "partially_verified": 2, "inferred": 3, "unknown": 4}


def rank(c: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(len(ranks)))


def with_details(listings: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A detail page's values go before the listing's; without a page the confidence is lower."""
    d = details.select(F.col(key), F.lit(True).alias("_page"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = listings.join(d, key, "left")
    out = joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
    return out.withColumn("confidence", F.when(F.col("_page"), "source_confirmed").otherwise("partially_verified")).drop("_page", *[f"_{f}" for f in fields])


def best_geocode(candidates: DataFrame) -> DataFrame:
    """One candidate per place key by kind; points that are none are left out. ``candidates``: place_key, feature, latitude, longitude."""
    kind = F.when(F.col("feature").isin(*GEOCODE_RANK), F.col("feature")).otherwise("other")
    candidates = candidates.where(valid(F.col("latitude"), F.col("longitude")))
    best = F.min(F.struct(rank(kind, GEOCODE_RANK).alias("r"), F.col("latitude"), F.col("longitude"), F.col("feature")))
    return candidates.groupBy("place_key").agg(best.alias("b")).select("place_key", "b.feature", "b.latitude", "b.longitude")


def with_coordinates(listings: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Coordinates of listings that have none: the venue's where it is known, else the place's.

    ``listings``: venue_key, place_key, latitude, longitude; ``geocodes``: place_key, latitude, longitude, where a null
    pair is the remembered answer that nothing was found.
    """
    side = lambda n: geocodes.select(F.col("place_key").alias(f"{n}_key"), F.col("latitude").alias(f"_{n}_lat"), F.col("longitude").alias(f"_{n}_lon"))
    joined = listings.join(side("venue"), "venue_key", "left").join(side("place"), "place_key", "left")
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    by = lambda c: F.when(F.col("_venue_lat").isNotNull(), F.col(f"_venue_{c}")).otherwise(F.col(f"_place_{c}"))
    found = joined.withColumns({"_lat": F.when(known, F.col("latitude")).otherwise(by("lat")), "_lon": F.when(known, F.col("longitude")).otherwise(by("lon"))})
    return found.select(*[c for c in listings.columns if c not in ("latitude", "longitude")], F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"))


def provenance(listings: DataFrame, fields: list[str], confidence: Column) -> DataFrame:
    """(event_id, listing_id, source, field, value, confidence, retrieved_at) of every value that is there."""
    wide = listings.select("event_id", "listing_id", "source", confidence.alias("confidence"), F.col("last_verified_at").alias("retrieved_at"), *[F.col(f).cast("string").alias(f) for f in fields])
    long = wide.unpivot(["event_id", "listing_id", "source", "confidence", "retrieved_at"], fields, "field", "value")
    return long.where("value is not null and value != ''")


def best_provenance(rows: DataFrame) -> DataFrame:
    """The most reliable row of each (event_id, field), of these the newest."""
    order = F.struct(rank(F.col("confidence"), CONFIDENCE_RANK).alias("r"), (-F.unix_micros(F.col("retrieved_at").cast("timestamp"))).alias("t"), F.col("listing_id"), F.col("source"), F.col("value"), F.col("confidence"))
    return rows.groupBy("event_id", "field").agg(F.min(order).alias("b")).select("event_id", "field", "b.value", "b.confidence", "b.source", "b.listing_id")


def distinct_conflicts(long: DataFrame) -> DataFrame:
    """(event_id, field, values): fields of which an event has several values; the values sorted, each once."""
    values = long.select("event_id", "field", "value").distinct().groupBy("event_id", "field").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return values.where(F.size("values") > 1)


def source_catalog(catalog: DataFrame, health: DataFrame, counts: DataFrame) -> DataFrame:
    """Every source with its class and number of records. ``catalog``: source, enabled."""
    joined = catalog.join(health.select("source", "consecutive_failures", "runs"), "source", "left").join(counts.select("source", "records"), "source", "left")
    n = F.col("consecutive_failures")
    state = F.when(~F.col("enabled"), "disabled").when(F.col("runs").isNull(), "unknown").when(n >= 3, "failing").when(n > 0, "degraded").otherwise("healthy")
    return joined.select("source", "enabled", state.alias("health"), F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def run_summary(before: DataFrame, batch: DataFrame, required: list[str]) -> DataFrame:
    """Per source: records of a batch that are new, that replace one, and that are rejected. Key: source, source_record_id."""
    sound = F.lit(True)
    for c in required:
        sound = sound & F.col(c).isNotNull()
    old = before.select("source", "source_record_id", F.lit(True).alias("_old")).distinct()
    tagged = batch.withColumn("_sound", sound).join(old, ["source", "source_record_id"], "left")
    return tagged.groupBy("source").agg(
        F.count_if(F.col("_sound") & F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_sound") & F.col("_old").isNotNull()).alias("updated"), F.count_if(~F.col("_sound")).alias("rejected")
    )


def zone_offset(ts: Column, zone: Column) -> Column:
    """Minutes that a zone's clock is ahead of UTC at an instant."""
    return ((F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)) / 60).cast("int")


def date_conflict(a: Column, b: Column) -> Column:
    """Whether two instants are more than a day apart."""
    return F.coalesce(F.abs(F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) > 86_400, F.lit(False))


def run_rows(records: DataFrame, key: list[str], at: Column, ok: Column) -> DataFrame:
    """A log row for each run: its records, accepted and rejected ones, seconds from the first to the last and an error where some were rejected."""
    counted = records.groupBy(*key).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.round((F.max(F.unix_micros(at.cast("timestamp"))) - F.min(F.unix_micros(at.cast("timestamp")))) / 1e6).alias("seconds")
    )
    return counted.withColumn("error", F.when(F.col("rejected") > 0, "rejected records"))
