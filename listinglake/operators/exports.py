"""Rows and documents for publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sitemap(listings: DataFrame, places: DataFrame, status: Column, most_places: int = 200, most_listings: int = 2000) -> DataFrame:
    """(loc, priority): the root, places that have listings, listings that are not closed.

    ``places``: place, event_count; ``listings``: listing_id, slug.
    """
    root = places.sparkSession.createDataFrame([("/", 1.0)], "loc string, priority double")
    top = places.where("event_count > 0").orderBy(F.desc("event_count"), "place").limit(most_places)
    of_places = top.select(F.concat(F.lit("/city/"), F.replace(F.lower("place"), F.lit(" "), F.lit("-"))).alias("loc"), F.lit(0.8).alias("priority"))
    live = listings.withColumn("_s", status).where("_s != 'closed'").orderBy("listing_id").limit(most_listings)
    of_listings = live.select(F.concat(F.lit("/event/"), "slug").alias("loc"), F.when(F.col("_s") == "open", 0.7).otherwise(0.5).alias("priority"))
    return root.unionByName(of_places).unionByName(of_listings)


def event_documents(listings: DataFrame) -> DataFrame:
    """(listing_id, document): a schema.org Event as JSON; what is not known is left out."""
    where = F.when(F.col("mode") != "online", F.struct(F.lit("Place").alias("@type"), F.col("city_key").alias("name")))
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"),
        F.date_format("start_ts", "yyyy-MM-dd").alias("startDate"), where.alias("location"),
    )
    return listings.select("listing_id", F.to_json(doc).alias("document"))


def item_lists(listings: DataFrame, group: str, n: int = 20) -> DataFrame:
    """(group, items): ItemList entries of a group's first n listings by id; Spark keeps only those before the shuffle."""
    k = F.row_number().over(Window.partitionBy(group).orderBy("listing_id"))
    top = listings.select(group, "listing_id", "title").withColumn("position", k).where(F.col("position") <= n)
    return top.groupBy(group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: F.struct(x["position"].alias("position"), x["title"].alias("name")))).alias("items"))


def prize_text(amount: Column, currency: Column) -> Column:
    return F.when(amount > 0, F.concat_ws(" ", currency, F.regexp_replace(F.format_number(amount.cast("decimal(18,2)"), 2), r"\.00$", "")))


def team_text(least: Column, most: Column) -> Column:
    one = lambda n: F.concat(n.cast("string"), F.when(n == 1, " member").otherwise(" members"))
    return (
        F.when(least.isNull() & most.isNull(), None).when(most.isNull(), F.concat(F.lit("at least "), one(least))).when(least.isNull(), F.concat(F.lit("up to "), one(most)))
        .when(least == most, one(least)).otherwise(F.concat(least.cast("string"), F.lit("–"), one(most)))
    )
