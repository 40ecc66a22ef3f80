"""Place names: registry tables, resolution, metro expansion and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglake import refdata
from listinglake.functions.text import normal_key


def default_places(spark: SparkSession) -> DataFrame:
    rows = [(i, *p[:5], list(p[5])) for i, p in enumerate(refdata.PLACES)]
    return spark.createDataFrame(rows, "position int, name string, state string, country string, metro string, locality boolean, aliases array<string>")


def registry(places: DataFrame) -> DataFrame:
    """Of places with one key the first by position stays."""
    keyed = places.withColumn("place_key", normal_key(F.col("name")))
    n = F.row_number().over(Window.partitionBy("place_key").orderBy("position"))
    return keyed.withColumn("_n", n).where("_n = 1").drop("_n")


def place_keys(places: DataFrame) -> DataFrame:
    """(key, rank, position, place_key, metro): a place's own name ranks before its aliases."""
    own = places.select(F.col("place_key").alias("key"), F.lit(1).alias("rank"), "position", "place_key", "metro")
    other = places.select(F.explode("aliases").alias("alias"), "position", "place_key", "metro").select(normal_key(F.col("alias")).alias("key"), F.lit(2).alias("rank"), "position", "place_key", "metro")
    return own.unionByName(other)


def bare_place(text: Column) -> Column:
    """The key without trailing region and country: a one-word place keeps only its word where all the rest is a region."""
    tails = sorted({*refdata.REGION_NAMES, *refdata.COUNTRY_NAMES}, key=lambda t: (-len(t), t))
    ends = "|".join(sorted(refdata.COUNTRY_NAMES, key=lambda t: (-len(t), t)))
    key = normal_key(text)
    for _ in range(2):
        key = F.regexp_replace(key, rf"^(\S+) (?:{'|'.join(tails)})$", "$1")
        key = F.regexp_replace(key, rf"^(.+) (?:{ends})$", "$1")
    return key


def resolve_places(texts: DataFrame, places: DataFrame, text_col: str = "place_text") -> DataFrame:
    """(place_text, place_key, metro, match) of each distinct text: name, alias, or a known place beside qualifiers.

    Compound names are sought by their starts and ends of as many words as the registry's names have, so every step
    is an equi join. A slug ("navi-mumbai") has the key of its name, so it is found by that step.
    """
    reg = registry(places)
    keys = place_keys(reg)
    sizes = range(1, longest_name(keys) + 1)
    base = texts.select(F.col(text_col).alias("place_text")).distinct().withColumns({"raw": normal_key(F.col("place_text")), "bare": bare_place(F.col("place_text"))})
    words = F.split("bare", " ")
    n = F.size(words)
    part = lambda a, size: F.struct(F.array_join(F.slice(words, a, size), " ").alias("key"), F.array_except(words, F.slice(words, a, size)).alias("rest"))
    cuts = [F.when(n > k, part(F.lit(1), k)) for k in sizes] + [F.when(n > k, part(n - k + 1, k)) for k in sizes]
    fits = lambda c: c.isNotNull() & F.forall(c["rest"], lambda t: t.isin(refdata.PLACE_QUALIFIERS))
    tries = F.array(
        F.struct(F.col("bare").alias("key"), F.lit(0).alias("step")),
        F.struct(F.col("raw").alias("key"), F.lit(1).alias("step")),
        *[F.when(fits(c), F.struct(c["key"].alias("key"), F.lit(4).alias("step"))) for c in cuts],
    )
    asked = base.select("place_text", F.explode(F.array_compact(tries)).alias("t")).select("place_text", F.col("t.key").alias("key"), F.col("t.step").alias("step"))
    hits = asked.join(keys, "key")
    order = F.struct(F.when(F.col("step") < 4, 0).otherwise(1), "rank", "step", "position")
    best = hits.groupBy("place_text").agg(F.min(F.struct(order.alias("o"), F.col("place_key"), F.col("metro"), F.when((F.col("step") == 4) | (F.col("rank") == 2), "alias").otherwise("exact").alias("match"))).alias("b"))
    joined = base.select("place_text").join(best, "place_text", "left")
    return joined.select("place_text", F.col("b.place_key").alias("place_key"), F.col("b.metro").alias("metro"), F.coalesce("b.match", F.lit("unknown")).alias("match"))


def metro_keys(places: DataFrame) -> DataFrame:
    """(place_key, keys): all names and aliases of a place and of the other places of its metro."""
    keys = place_keys(registry(places))
    own = keys.where("rank = 1").select("place_key", "metro")
    near = own.join(keys.where("metro is not null").select("key", "metro"), "metro").select("place_key", "key").union(keys.select("place_key", "key"))
    return near.groupBy("place_key").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def suggest(places: DataFrame, typed: str, n: int = 8) -> DataFrame:
    """Places for a typed beginning: whole name, start, alias start, inside, alias inside; localities a little lower."""
    reg = registry(places).withColumn("alias_keys", F.transform("aliases", normal_key))
    q, key = F.lit(typed.strip().lower()), F.col("place_key")
    size = F.length("place_key")
    any_alias = lambda test: F.exists("alias_keys", test)
    score = (
        F.when(key == q, 100.0).when(key.startswith(q), 80 - size / 10).when(any_alias(lambda a: a.startswith(q)), 75.0)
        .when(F.contains(key, q), 60 - size / 20).when(any_alias(lambda a: F.contains(a, q)), 50.0)
    )
    ranked = reg.withColumn("score", score - F.when(F.col("locality"), 8).otherwise(0)).where("score is not null")
    return ranked.select("name", "score").orderBy(F.desc("score"), "name").limit(n)


def longest_name(keys: DataFrame) -> int:
    """Words of the longest key; one number reaches the driver."""
    return keys.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0


def by_state(names: DataFrame, places: DataFrame) -> DataFrame:
    """(name, state, place_key, exact) of each distinct name and state: the place of that name in that state (no state: without one), else one in any state; towns before localities."""
    known = place_keys(places.withColumn("place_key", normal_key(F.col("name")))).where("rank = 1").select("key", "position")
    rows = places.select("position", F.col("state").alias("place_state"), "locality").join(known, "position")
    asked = names.select("name", "state").distinct().withColumn("key", bare_place(F.col("name")))
    same = F.col("state").eqNullSafe(F.col("place_state"))
    best = asked.join(rows, "key").groupBy("name", "state").agg(F.min(F.struct((~same).alias("other"), F.col("locality"), F.col("position"), F.col("key"))).alias("b"))
    joined = asked.alias("a").join(best.alias("b"), F.col("a.name").eqNullSafe(F.col("b.name")) & F.col("a.state").eqNullSafe(F.col("b.state")), "left")
    return joined.select("a.name", "a.state", F.col("b.b.key").alias("place_key"), (~F.col("b.b.other")).alias("exact"), F.col("b.b.position").alias("position"))


def inherit_metro(names: DataFrame, places: DataFrame, name_col: str = "name") -> DataFrame:
    """(name, metro) of unlisted localities whose name starts or ends with a known place's: the first place by position.

    Starts and ends of as many words as known names have are joined by equality, so no pair of names and places is tried twice.
    """
    known = registry(places).where("metro is not null").select(F.col("place_key").alias("key"), "metro", "position")
    base = names.select(F.col(name_col).alias("name")).distinct().withColumn("words", F.split(normal_key(F.col("name")), " "))
    n = F.size("words")
    ends = [F.when(n > k, F.array_join(F.slice("words", start, k), " ")) for k in range(1, longest_name(known) + 1) for start in (F.lit(1), n - k + 1)]
    asked = base.select("name", F.explode(F.array_distinct(F.array_compact(F.array(*ends)))).alias("key"))
    return asked.join(known, "key").groupBy("name").agg(F.min(F.struct("position", "metro"))["metro"].alias("metro"))
