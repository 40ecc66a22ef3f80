"""The listing view over the star-schema tables: one listing per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-06-15 00:00:00"

#: The same text runs in Spark (tables filled in as {name}) and in DuckDB.
LISTING_SQL = """
SELECT o.o_orderkey AS listing_id,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'organizer_website' WHEN 1 THEN 'mlh' WHEN 2 THEN 'unstop' WHEN 3 THEN 'devpost' ELSE 'hackerearth' END AS source,
 concat('r', CAST(o.o_orderkey AS STRING)) AS source_record_id,
 concat(p.p_name, ' ', p.p_type, ' Hackathon') AS title,
 c.c_name AS organizer,
 lower(n.n_name) AS city_key,
 lower(r.r_name) AS metro,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(n.n_nationkey AS DOUBLE) * 2.0 + CAST(o.o_orderkey % 10 AS DOUBLE) / 10.0 END AS latitude,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE 60.0 + CAST(n.n_nationkey AS DOUBLE) + CAST(o.o_orderkey % 7 AS DOUBLE) / 10.0 END AS longitude,
 CASE o.o_orderstatus WHEN 'F' THEN 'online' WHEN 'O' THEN 'offline' ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'hybrid' ELSE 'unknown' END END AS mode,
 CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderdate END AS deadline_ts,
 CASE WHEN o.o_orderkey % 7 = 0 THEN 'none' WHEN o.o_orderkey % 3 = 0 THEN 'date_only' ELSE 'instant' END AS deadline_precision,
 CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderdate - INTERVAL '30' DAY END AS opens_ts,
 CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '10' DAY END AS start_ts,
 CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(o.o_orderkey % 3 + 1 AS INT) END AS team_size_min,
 CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE CAST(o.o_orderkey % 3 + 1 + o.o_orderkey % 4 AS INT) END AS team_size_max,
 concat(lower(p.p_type), ',', split_part(p.p_name, ' ', 1), ',', split_part(p.p_name, ' ', 2)) AS themes_csv,
 concat(lower(c.c_mktsegment), ', ', lower(o.o_orderpriority)) AS eligibility,
 concat(CASE o.o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'react' WHEN 2 THEN 'rust' ELSE 'java' END, ',', lower(p.p_brand)) AS technologies_csv,
 concat('Hall ', CAST(o.o_orderkey % 9 AS STRING), ', ', n.n_name, ', ', r.r_name) AS location_text,
 CASE WHEN o.o_orderkey % 7 = 0 THEN 'unknown' WHEN o.o_orderkey % 4 = 0 THEN 'verified' WHEN o.o_orderkey % 4 = 1 THEN 'inferred' WHEN o.o_orderkey % 3 = 0 THEN 'partially_verified' ELSE 'source_confirmed' END AS deadline_confidence,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_totalprice END AS prize_amount,
 CASE o.o_orderkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'unknown' END AS free_or_paid,
 CASE WHEN o.o_orderkey % 3 = 1 THEN CAST(o.o_orderkey % 500 AS DOUBLE) ELSE NULL END AS registration_fee,
 o.o_orderdate - INTERVAL '45' DAY AS last_verified_at
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey JOIN {part} p ON p.p_partkey = o.o_orderkey % 200"""

TABLES = ("orders", "customer", "nation", "region", "part")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = dict(zip(TABLES, tables(spark, sf_dir, *TABLES), strict=True))
    view = spark.sql(LISTING_SQL, **frames)
    return view.withColumns({"themes": F.split("themes_csv", ","), "technologies": F.split("technologies_csv", ","), "description": F.lit(None).cast("string"), "now": F.lit(NOW).cast("timestamp")})


def listing_cte() -> str:
    """For DuckDB: L with the same columns, themes and technologies as lists."""
    own = LISTING_SQL.format(**{t: t for t in TABLES})
    return f"WITH L AS (SELECT *, string_split(themes_csv, ',') AS themes, string_split(technologies_csv, ',') AS technologies, TIMESTAMP '{NOW}' AS now FROM ({own}))"
