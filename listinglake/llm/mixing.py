"""Operator 13: mixing sources to target weights by capped water-filling.

Sources share a budget by their weights. None gives more than a number of passes over itself: what it would have to
give beyond that is shared anew among the others, in proportion to their weights, until all are within their bounds.
A source's target is then met by whole passes over all its documents and one more pass over some of them, taken in an
order that a seed decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglake.llm.common import table, written
from listinglake.operators.order import numbered, parts

#: A word is what stands between blanks.
WORDS = r"[^\x20\x09-\x0D]+"


def water_filled(sources: DataFrame, budget: float, epochs: int) -> DataFrame:
    """Adds ``target`` to sources (size, weight): the sources' shares of the budget by weight, none above ``epochs`` times its size.

    Each round clamps what is above at the last round's level and shares the rest among the others. A round is one
    aggregate; three numbers of it reach the driver. The level only rises, so it ends with the last clamp; a budget above all
    bounds clamps every source.
    """
    cap, weight = F.col("size") * epochs, F.col("weight")
    rest, free = budget, sources.agg(F.sum("weight")).first()[0] or 0
    clamped = -1
    while free:
        above = cap * free <= F.lit(float(rest)) * weight
        held, n, left = sources.agg(F.sum(F.when(above, cap)), F.count_if(above), F.sum(F.when(~above, weight))).first()
        rest, free = budget - (held or 0), left or 0
        if n == clamped:
            break
        clamped = n
    share = F.lit(float(rest)) * weight / F.lit(float(free or 1))
    return sources.withColumn("target", F.least(cap.cast("double"), share) if free else cap.cast("double"))


def mixed(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", group_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(id, source, size, source_size, target, repeats) of every row of docs.

    size: words of the text. ``weights`` go to the sources in the order of their names by code point, null last, and
    start anew when they end. ``share`` of all sizes is the budget. ``repeats``: how often the mix takes the
    row, from 0 to ``epochs``. A source's rows come up by a hash of seed and id; one is taken once more if its middle lies within
    what whole passes leave, so a source's sum misses its target by half a row's size at most.

    Null and empty texts have size 0; they are repeated like others and add nothing. Rows of one id stand together; equal ones
    are interchangeable. Other columns are not read. An empty table gives no rows.

    Sizes are counted once and written. Running sums go over even parts of one order, so a source that holds a third
    of all rows is many tasks' work. Only DataFrame functions.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("source"), size.alias("size")))
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("size")).withColumn("last", F.col("source").isNull()))
    ranked = numbered(sums, ["last", "source"])
    own = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    sources = written(ranked.select(F.col("at").alias("no"), "source", "size", own.cast("long").alias("weight")))
    budget = share * (sources.agg(F.sum("size")).first()[0] or 0)
    filled = written(water_filled(sources, budget, epochs))

    known = filled.select("no", F.col("source").alias("of"), F.col("size").alias("source_size"), "target")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("whole", whole)
    placed = parts(joined.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))), ["no", "key", "id", "size"])
    in_part = placed.groupBy("part", "no").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = written(in_part.select("part", "no", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")))
    so_far = F.sum("size").over(Window.partitionBy("part", "no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    run = placed.withColumn("so_far", so_far).join(before, ["part", "no"])
    left = F.col("target") - F.col("whole") * F.col("source_size")
    middle: Column = (F.col("before") + F.col("so_far")) * 2 - F.col("size")
    repeats = F.col("whole") + F.when((F.col("whole") < epochs) & (middle <= left * 2) & (left > 0), 1).otherwise(0)
    return run.select(F.col("id").alias(id_col), F.col("source").alias(group_col), "size", "source_size", "target", repeats.cast("int").alias("repeats"))


def mixture(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs (of unique, given ids) as often as the mix takes them, with ``epoch`` from 1; an existing column of that name is replaced."""
    taken = mixed(docs, id_col=id_col, **options).select(F.col(f"`{id_col}`").alias("_id"), F.col("repeats").alias("_n"))
    rows = docs.drop("epoch").join(taken.where("_n > 0"), F.col(f"`{id_col}`") == F.col("_id"))
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_id", "_n")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def oracle() -> str:
    """The same in SQL; the level is looked up among those of all possible numbers of clamped sources instead of being approached."""
    return r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
    o AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS k, sum(n) OVER () AS total, sum(w) OVER () AS weights FROM s),
    c AS (SELECT k, 3.0 * n / w AS ratio, total - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      weights - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM o),
    level AS (SELECT rest, free FROM c WHERE CAST(rest AS DOUBLE) / free <= ratio ORDER BY k LIMIT 1),
    t AS (SELECT source, n, least(CAST(3 * n AS DOUBLE), coalesce((SELECT CAST(rest AS DOUBLE) * w / CAST(free AS DOUBLE) FROM level), CAST(3 * n AS DOUBLE))) AS target FROM s),
    p AS (SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n)) ELSE 0 END AS whole FROM t),
    r AS (SELECT doc_id, size, n, target, whole, sum(size) OVER (PARTITION BY p.source ORDER BY md5(concat('mix:', doc_id)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, n AS source_size, target,
      CAST(size * (whole + CASE WHEN whole < 3 AND target > whole * n AND 2 * so_far - size <= 2 * (target - whole * n) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
