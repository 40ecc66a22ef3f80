"""Registered listing queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake import refdata
from listinglake.functions import geo, similarity, status, text
from listinglake.operators import dedupe, enrich, exports, facets, merge, milestones, places, search, sinks, stats
from listinglake.plans.listings import NOW, TABLES, listing_cte, listings, tables
from listinglake.sources import feeds
from listinglake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
CTE = listing_cte()
LIVE = "CASE WHEN deadline_ts IS NULL THEN 'unknown' WHEN deadline_ts <= now THEN 'closed' WHEN opens_ts > now THEN 'upcoming' ELSE 'open' END"
DIST = f"2 * {refdata.EARTH_KM} * asin(least(1.0, sqrt(power(sin(radians(({{lat2}}) - ({{lat1}})) / 2), 2) + cos(radians({{lat1}})) * cos(radians({{lat2}})) * power(sin(radians(({{lon2}}) - ({{lon1}})) / 2), 2))))"


def at() -> Column:
    """The instant that all listing queries take as the present."""
    return F.lit(NOW).cast("timestamp")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def over_listings(sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """A query of the listing view alone; ``sql`` reads it as L."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        run: Query = lambda spark, sf_dir: f(listings(spark, sf_dir))
        FOUND[f.__name__] = (run, f"{CTE} {sql}")
        return run

    return add


# ---- status and grade


@over_listings(f"SELECT source, {LIVE} AS status, count(*) AS n FROM L GROUP BY ALL")
def live_status_hist(df):
    return df.groupBy("source", status.live_status(F.col("deadline_ts"), F.col("opens_ts"), at()).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@over_listings("""SELECT listing_id, CASE WHEN deadline_ts IS NULL THEN 'unknown' WHEN deadline_precision = 'date_only' THEN
  CASE WHEN date_trunc('day', deadline_ts) + INTERVAL '86399999' MILLISECOND >= now THEN 'open' ELSE 'closed' END
  WHEN deadline_ts <= now THEN 'closed' WHEN opens_ts > now THEN 'upcoming' ELSE 'open' END AS status,
  CASE WHEN deadline_precision = 'date_only' THEN date_trunc('day', deadline_ts) + INTERVAL '86399999' MILLISECOND ELSE deadline_ts END AS effective,
  CASE WHEN deadline_ts IS NULL THEN 'no deadline published' WHEN deadline_precision = 'date_only' THEN 'date without a time; open until the day ends' END AS note FROM L""")
def status_note(df):
    s = status.full_status(F.col("deadline_ts"), F.col("deadline_precision"), F.col("opens_ts"), at())
    return df.select("listing_id", s.alias("s")).select("listing_id", "s.*")


@over_listings("""SELECT listing_id, CASE WHEN deadline_precision = 'date_only' THEN date_trunc('day', deadline_ts) + INTERVAL '86399' SECOND ELSE deadline_ts END AS comparable_ts,
  CASE WHEN deadline_ts IS NULL THEN 'none' WHEN deadline_precision = 'date_only' THEN 'date_only' ELSE 'instant' END AS guessed FROM L""")
def comparable_ts(df):
    iso = F.when(F.col("deadline_precision") == "date_only", F.date_format("deadline_ts", "yyyy-MM-dd")).otherwise(F.date_format("deadline_ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return df.select("listing_id", status.comparable(F.col("deadline_ts"), F.col("deadline_precision")).alias("comparable_ts"), status.precision_of(iso).alias("guessed"))


CONFIDENCE = "CASE listing_id % 6 WHEN 0 THEN 'inferred' WHEN 1 THEN 'unknown' WHEN 2 THEN 'source_confirmed' ELSE 'verified' END"


@over_listings(f"""SELECT listing_id, CASE WHEN listing_id % 13 = 0 THEN 'partially_verified' WHEN deadline_ts IS NULL THEN 'unknown'
  WHEN {CONFIDENCE} IN ('inferred', 'unknown') THEN 'partially_verified' WHEN source = 'hackerearth' THEN 'partially_verified'
  WHEN deadline_precision = 'instant' AND {CONFIDENCE} = 'verified' THEN 'verified' ELSE 'source_confirmed' END AS quality,
  CASE WHEN {CONFIDENCE} = 'inferred' THEN 'inferred' WHEN {CONFIDENCE} = 'unknown' THEN 'unclear' ELSE 'stated' END AS basis,
  CAST((organizer IS NOT NULL)::INT + (deadline_ts IS NOT NULL)::INT + (opens_ts IS NOT NULL)::INT + (start_ts IS NOT NULL)::INT + (prize_amount IS NOT NULL)::INT AS INTEGER) AS populated FROM L""")
def quality_grade(df):
    c = F.expr(CONFIDENCE)
    g = status.grade(F.col("deadline_ts"), F.col("listing_id") % 13 == 0, c, F.lit("registration_deadline"), F.col("deadline_precision"), F.col("source"))
    full = sum((F.col(x).isNotNull().cast("int") for x in ("organizer", "deadline_ts", "opens_ts", "start_ts", "prize_amount")), F.lit(0))
    return df.select("listing_id", g.alias("quality"), status.basis(c).alias("basis"), full.alias("populated"))


@over_listings(f"""SELECT listing_id, now + to_hours(CASE WHEN deadline_ts <= now THEN 168 WHEN deadline_ts <= now + INTERVAL '2' DAY THEN 1 WHEN deadline_ts <= now + INTERVAL '7' DAY THEN 3
  WHEN deadline_ts <= now + INTERVAL '30' DAY THEN 12 WHEN deadline_ts IS NOT NULL THEN 24 WHEN start_ts > now AND start_ts <= now + INTERVAL '7' DAY THEN 12 WHEN start_ts > now THEN 48
  WHEN {LIVE} = 'open' THEN 24 WHEN {LIVE} = 'upcoming' THEN 12 WHEN {LIVE} = 'closed' THEN 168 ELSE 48 END) AS next_check FROM L""")
def next_verification(df):
    s = status.live_status(F.col("deadline_ts"), F.col("opens_ts"), at())
    return df.select("listing_id", status.next_check(F.col("deadline_ts"), F.col("start_ts"), s, at()).alias("next_check"))


@over_listings("""SELECT listing_id, coalesce(t <= now, false) AS expired, CASE WHEN t > now THEN s // 86400 ELSE 0 END::BIGINT AS days, CASE WHEN t > now THEN s % 86400 // 3600 ELSE 0 END::BIGINT AS hours,
  CASE WHEN t > now THEN s % 3600 // 60 ELSE 0 END::BIGINT AS minutes, CASE WHEN t > now THEN s % 60 ELSE 0 END::BIGINT AS seconds,
  CASE WHEN t IS NULL THEN 'unknown' WHEN t <= now THEN 'none' WHEN s // 86400 >= 7 THEN 'comfortable' WHEN s // 86400 >= 2 THEN 'soon' ELSE 'critical' END AS urgency,
  CASE WHEN t IS NULL THEN 'Deadline not specified' WHEN t <= now THEN 'Registration closed' WHEN s >= 86400 THEN concat(s // 86400, CASE WHEN s // 86400 = 1 THEN ' day left' ELSE ' days left' END)
   WHEN s >= 3600 THEN concat(s // 3600, CASE WHEN s // 3600 = 1 THEN ' hour left' ELSE ' hours left' END) WHEN s >= 60 THEN concat(s // 60, CASE WHEN s // 60 = 1 THEN ' minute left' ELSE ' minutes left' END)
   ELSE concat(s, CASE WHEN s = 1 THEN ' second left' ELSE ' seconds left' END) END AS label
  FROM (SELECT *, CAST(epoch(t) - epoch(now) AS BIGINT) AS s FROM (SELECT *, CASE WHEN deadline_precision = 'date_only' THEN date_trunc('day', deadline_ts) + INTERVAL '86399' SECOND ELSE deadline_ts END AS t FROM L))""")
def countdown(df):
    c = status.countdown(status.comparable(F.col("deadline_ts"), F.col("deadline_precision")), at())
    return df.select("listing_id", c.alias("c")).select("listing_id", "c.*")


# ---- search

RANK = f"CASE {LIVE} WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END, deadline_ts ASC NULLS LAST, start_ts ASC NULLS LAST, last_verified_at DESC NULLS LAST, title, listing_id"


def page(p: search.SearchParams, where: str, order: str = RANK, columns: str = "listing_id, source, title", name: str = "", offset: int = 0):
    """A registered page of a search with its SQL condition."""
    run: Query = lambda spark, sf_dir: search.search(listings(spark, sf_dir), p, at()).select(*columns.split(", "))
    live = f"{LIVE} = 'open'" if p.open_only else f"{LIVE} <> 'closed'"
    FOUND[name] = (run, f"{CTE} SELECT {columns} FROM L WHERE {live} AND {where} ORDER BY {order} LIMIT {p.rows} OFFSET {offset}")


def all_matches(p: search.SearchParams, where: str, name: str):
    """All listings that a search finds."""
    run: Query = lambda spark, sf_dir: search.filtered(listings(spark, sf_dir), p, at()).select("listing_id")
    live = f"{LIVE} = 'open'" if p.open_only else f"{LIVE} <> 'closed'"
    FOUND[name] = (run, f"{CTE} SELECT listing_id FROM L WHERE {live} AND {where}")


P = search.SearchParams
TEAM = "coalesce(team_size_min <= 3, true) AND coalesce(team_size_max >= 2, true)"
page(P(team_min=2, team_max=3), TEAM, name="search_default")
page(P(open_only=True, page=3, limit=50), "true", name="search_open", offset=100)
all_matches(P(team_min=2, team_max=3), TEAM, "search_team_overlap")
all_matches(P(team_size=4), "coalesce(team_size_min <= 4, true) AND coalesce(team_size_max >= 4, true)", "search_team_size")
all_matches(P(mode="offline", free_only=True, prize_only=True), "mode IN ('offline', 'hybrid') AND (free_or_paid = 'free' OR registration_fee IS NULL OR registration_fee = 0) AND prize_amount > 0", "search_mode_money")
all_matches(P(mode="online", paid_only=True), "mode = 'online' AND free_or_paid = 'paid'", "search_online_paid")
all_matches(P(themes=("economy", "standard"), eligibility=("BUILDING", "urgent")), "list_has_any(themes, ['economy', 'standard']) AND (contains(lower(eligibility), 'building') OR contains(lower(eligibility), 'urgent'))", "search_taxonomy")
all_matches(P(event_from=datetime(1998, 7, 1), event_to=datetime(1998, 9, 1), q=" Customer#00 "), "start_ts >= TIMESTAMP '1998-07-01' AND start_ts <= TIMESTAMP '1998-09-01' AND (contains(lower(title), 'customer#00') OR contains(lower(organizer), 'customer#00'))", "search_dates_text")
all_matches(P(city_keys=("india", "japan"), metro="asia"), "(city_key IN ('india', 'japan') OR metro = 'asia')", "search_place_metro")
all_matches(P(city_keys=("india", "japan")), "city_key IN ('india', 'japan')", "search_place_exact")

LAT, LON, KM = 24.0, 72.0, 300.0
HERE = DIST.format(lat1=LAT, lon1=LON, lat2="latitude", lon2="longitude")
NEAR = f"(latitude IS NULL OR {HERE} <= {KM})"
all_matches(P(latitude=LAT, longitude=LON, radius_km=KM), NEAR, "search_radius")
page(P(latitude=LAT, longitude=LON, radius_km=KM, sort="distance", limit=100), NEAR, f"{HERE} ASC NULLS LAST, deadline_ts ASC NULLS LAST, listing_id", "listing_id, deadline_ts", "sort_distance")
page(P(sort="deadline", limit=100), "true", "deadline_ts ASC NULLS LAST, listing_id", "listing_id, deadline_ts", "sort_deadline")
page(P(sort="event_date", limit=100), "true", "start_ts ASC NULLS LAST, listing_id", "listing_id, start_ts", "sort_event_date")
page(P(sort="prize", limit=100), "true", "prize_amount DESC NULLS LAST, listing_id", "listing_id, prize_amount", "sort_prize")
page(P(sort="recently_updated", limit=100), "true", "last_verified_at DESC NULLS LAST, listing_id", "listing_id, last_verified_at", "sort_recent")


@over_listings(f"SELECT listing_id, city_key FROM L WHERE {LIVE} <> 'closed' AND mode = 'online' AND prize_amount > 0 ORDER BY {RANK} LIMIT 12")
def online_section(df):
    return search.online_companion(df, P(city_keys=("india",), metro="asia", prize_only=True), at()).select("listing_id", "city_key")


@query(f"""{CTE}, o AS (SELECT s_suppkey AS origin_id, CAST(n_nationkey AS DOUBLE) * 2.0 + CAST(s_suppkey % 10 AS DOUBLE) / 10.0 AS la,
  60.0 + CAST(n_nationkey AS DOUBLE) + CAST(s_suppkey % 7 AS DOUBLE) / 10.0 AS lo FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT origin_id, count(*) AS n, round(min(d), 3) AS nearest, round(max(d), 3) AS furthest FROM
 (SELECT origin_id, {DIST.format(lat1="la", lon1="lo", lat2="latitude", lon2="longitude")} AS d FROM o, L WHERE latitude IS NOT NULL) WHERE d <= 55.5 GROUP BY origin_id""")
def radius_join_many(spark, sf_dir):
    supplier, nation = tables(spark, sf_dir, "supplier", "nation")
    n = F.col("n_nationkey").cast("double")
    origins = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("origin_id"), (n * 2.0 + (F.col("s_suppkey") % 10).cast("double") / 10.0).alias("origin_lat"), (n + 60.0 + (F.col("s_suppkey") % 7).cast("double") / 10.0).alias("origin_lon")
    )
    found = search.radius_counts(origins, listings(spark, sf_dir).select("latitude", "longitude"), 55.5)
    return found.select("origin_id", "n", F.round("nearest", 3).alias("nearest"), F.round("furthest", 3).alias("furthest"))


@over_listings("SELECT listing_id, title FROM L WHERE listing_id = 33")
def point_lookup(df):
    return df.where("listing_id = 33").select("listing_id", "title")


SAVED = "SELECT CAST(o_orderkey + 100 AS BIGINT) AS listing_id FROM orders WHERE o_orderkey % 97 = 1"


def _saved(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.where("o_orderkey % 97 = 1").select((F.col("o_orderkey") + 100).alias("listing_id"))


@query(f"{CTE} SELECT listing_id, title FROM L WHERE listing_id IN ({SAVED})")
def saved_found(spark, sf_dir):
    return listings(spark, sf_dir).join(_saved(spark, sf_dir), "listing_id", "left_semi").select("listing_id", "title")


@query(f"{CTE} SELECT count(*) AS missing FROM ({SAVED}) s WHERE NOT EXISTS (SELECT 1 FROM L WHERE L.listing_id = s.listing_id)")
def saved_missing(spark, sf_dir):
    return _saved(spark, sf_dir).join(listings(spark, sf_dir), "listing_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@over_listings(f"""SELECT listing_id, next_check FROM (SELECT listing_id, last_verified_at + to_hours(CASE WHEN {LIVE} = 'open' THEN 24 ELSE 168 END) AS next_check FROM L) t
  WHERE next_check <= TIMESTAMP '{NOW}' ORDER BY next_check, listing_id LIMIT 25""")
def verification_queue(df):
    s = status.live_status(F.col("deadline_ts"), F.col("opens_ts"), at())
    due = F.col("last_verified_at") + F.when(s == "open", F.expr("INTERVAL '24' HOUR")).otherwise(F.expr("INTERVAL '168' HOUR"))
    return df.select("listing_id", due.alias("next_check")).where(F.col("next_check") <= at()).orderBy("next_check", "listing_id").limit(25)


# ---- facets and totals


@over_listings("SELECT value, count(*) AS n FROM (SELECT listing_id, unnest(list_distinct(themes)) AS value FROM L) GROUP BY value ORDER BY n DESC, value LIMIT 20")
def facet_themes(df):
    return facets.value_facet(df, F.col("themes"))


@over_listings("SELECT value, count(*) AS n FROM (SELECT DISTINCT listing_id, trim(v) AS value FROM (SELECT listing_id, unnest(string_split(lower(eligibility), ',')) AS v FROM L)) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 20")
def facet_eligibility(df):
    return facets.eligibility_facet(df)


@over_listings("""SELECT count(*) FILTER (WHERE mode = 'online') AS online, count(*) FILTER (WHERE mode IN ('offline', 'hybrid')) AS in_person, count(*) FILTER (WHERE prize_amount > 0) AS with_prize,
  count(*) FILTER (WHERE deadline_ts IS NOT NULL) AS with_deadline, count(*) FILTER (WHERE listing_id % 13 = 0) AS conflicts FROM L""")
def facet_counts(df):
    return facets.count_facets(df, F.col("listing_id") % 13 == 0)


@over_listings("SELECT coalesce(source, '(all)') AS source, max(last_verified_at) AS last_verified FROM L GROUP BY ROLLUP (source)")
def freshness(df):
    return facets.freshness(df)


PLACES = "SELECT lower(n_name) AS city_key, n_name AS place FROM nation"


def _places(spark, sf_dir):
    return tables(spark, sf_dir, "nation")[0].select(F.lower("n_name").alias("city_key"), F.col("n_name").alias("place"))


@query(f"{CTE} SELECT place, count(*) FILTER (WHERE s = 'open') AS open_count, count(*) AS total_count FROM (SELECT city_key, {LIVE} AS s FROM L) t JOIN ({PLACES}) p USING (city_key) WHERE s <> 'closed' GROUP BY place ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8")
def top_places(spark, sf_dir):
    return facets.top_places(listings(spark, sf_dir), _places(spark, sf_dir), at())


@query(f"{CTE} SELECT place, count(s) AS event_count, count(*) FILTER (WHERE s = 'open') AS open_count FROM ({PLACES}) p LEFT JOIN (SELECT city_key, {LIVE} AS s FROM L) t USING (city_key) GROUP BY place HAVING count(s) > 0")
def places_with_events(spark, sf_dir):
    return facets.places_with_events(listings(spark, sf_dir), _places(spark, sf_dir), at())


@over_listings(f"""SELECT count(*) AS total, count(*) FILTER (WHERE s = 'open') AS open, count(*) FILTER (WHERE s = 'closed') AS closed, count(*) FILTER (WHERE s NOT IN ('open', 'closed')) AS other,
  count(*) FILTER (WHERE listing_id % 13 = 0) AS conflicts, count(*) FILTER (WHERE deadline_ts IS NULL) AS missing_deadline,
  count(*) FILTER (WHERE date_trunc('day', last_verified_at) = date_trunc('day', now)) AS updated_today FROM (SELECT *, {LIVE} AS s FROM L)""")
def pipeline_totals(df):
    return facets.pipeline_totals(df, F.col("listing_id") % 13 == 0, at())


@over_listings("SELECT source, count(*) AS n FROM L GROUP BY source")
def by_source(df):
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@over_listings(f"""SELECT 'status' AS facet, {LIVE} AS value, count(*) AS n FROM L GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM L GROUP BY ALL UNION ALL SELECT 'mode', mode, count(*) FROM L GROUP BY ALL
  UNION ALL SELECT 'located', CAST(latitude IS NOT NULL AS VARCHAR), count(*) FROM L GROUP BY ALL""")
def histograms(df):
    s = status.live_status(F.col("deadline_ts"), F.col("opens_ts"), at())
    return facets.histograms(df, status=s, source=F.col("source"), mode=F.col("mode"), located=F.col("latitude").isNotNull())


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in (*TABLES, "supplier", "lineitem", "events")))
def table_counts(spark, sf_dir):
    names = (*TABLES, "supplier", "lineitem", "events")
    return facets.table_counts(dict(zip(names, tables(spark, sf_dir, *names), strict=True)))


@query("""SELECT l_orderkey AS listing_id, string_agg(concat(l_linenumber, ':', l_suppkey), ',' ORDER BY l_linenumber, l_suppkey) AS links, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def link_lists(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    text_of = F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return lineitem.groupBy(F.col("l_orderkey").alias("listing_id")).agg(text_of.alias("links"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS listing_id, sum(CASE WHEN l_quantity > 25 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END)::DECIMAL(18,2) AS prize_total,
  sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END)::DECIMAL(18,2) AS fee_total FROM lineitem GROUP BY l_orderkey""")
def prize_array_sum(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    lists = lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_quantity") > 25, money("l_extendedprice"))).alias("prizes"), F.collect_list(F.when(F.col("l_returnflag") == "R", money("l_quantity"))).alias("fees")
    )
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("decimal(18,2)"), lambda s, x: (s + x).cast("decimal(18,2)")))
    return lists.select(F.col("l_orderkey").alias("listing_id"), total("prizes").alias("prize_total"), total("fees").alias("fee_total"))


# ---- run log

RUNS = "SELECT event_id AS run_id, CAST(user_id % 50 AS BIGINT) AS source, ts AS started, event_type <> 'error' AS ok, value AS duration FROM events"


def _runs(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 50).alias("source"), F.col("ts").alias("started"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"))


@query(f"""WITH r AS ({RUNS}), g AS (SELECT source, max(row(started, run_id)) FILTER (WHERE ok) AS good, max(started) FILTER (WHERE ok) AS last_ok, max(started) FILTER (WHERE NOT ok) AS last_error, count(*) AS runs,
  arg_max(duration, row(started, run_id)) FILTER (WHERE ok) AS last_duration FROM r GROUP BY source),
f AS (SELECT r.source, count(*) AS n FROM r JOIN g USING (source) WHERE NOT ok AND (good IS NULL OR row(started, run_id) > good) GROUP BY r.source)
SELECT g.source, last_ok, last_error, coalesce(n, 0) AS consecutive_failures, last_duration, runs, CASE WHEN coalesce(n, 0) >= 3 THEN 'failing' WHEN coalesce(n, 0) > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM g LEFT JOIN f USING (source)""")
def source_health(spark, sf_dir):
    return stats.source_health(_runs(spark, sf_dir))


@query(f"""WITH r AS ({RUNS}), i AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY source ORDER BY started, run_id) AS island FROM r)
SELECT run_id, source, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source, island ORDER BY started, run_id) AS failures FROM i""")
def running_failures(spark, sf_dir):
    return stats.running_failures(_runs(spark, sf_dir)).select("run_id", "source", "failures")


@query(f"WITH r AS ({RUNS}) SELECT run_id, source, started FROM r ORDER BY started DESC, run_id DESC LIMIT 25")
def last_run(spark, sf_dir):
    return stats.last_runs(_runs(spark, sf_dir)).select("run_id", "source", "started")


@query()
def interval_gate(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return jobs.interval_gate(events.select("user_id", "ts", "event_id"), "user_id", 3600.0)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return jobs.windowed_counts(*tables(spark, sf_dir, "events"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- text


def nk(x: str) -> str:
    return f"trim(regexp_replace(replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[''`’]', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    noise = ", ".join(f"'{w}'" for w in refdata.TITLE_NOISE)
    return f"list_filter(string_split({nk(x)}, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^(19|20)[0-9]{{2}}$') AND NOT regexp_matches(t, '^v[0-9]+$') AND t NOT IN ({noise}))"


SLUG = f"CASE WHEN {nk('title')} = '' THEN 'hackathon' ELSE substr(replace({nk('title')}, ' ', '-'), 1, 70) END"


@query(f"SELECT doc_id, md5({nk('text')}) AS key_md5, length({nk('text')}) AS key_length FROM documents")
def normalize_key(spark, sf_dir):
    key = text.normal_key(F.col("text"))
    return tables(spark, sf_dir, "documents")[0].select("doc_id", F.md5(key).alias("key_md5"), F.length(key).cast("long").alias("key_length"))


@over_listings(f"SELECT listing_id, CASE WHEN n = 1 THEN base ELSE concat(base, '-', n) END AS slug FROM (SELECT listing_id, {SLUG} AS base, row_number() OVER (PARTITION BY {SLUG} ORDER BY listing_id) AS n FROM L)")
def unique_slug(df):
    return merge.unique_slugs(df, "listing_id", F.col("title")).withColumnRenamed("id", "listing_id")


URL_ID = r"concat(lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '')), lower(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')))"


@query(f"SELECT page_id, CASE WHEN length({URL_ID}) >= 9 THEN {URL_ID} END AS url_id FROM pages")
def url_identity(spark, sf_dir):
    return tables(spark, sf_dir, "pages")[0].select("page_id", text.url_identity(F.col("url")).alias("url_id"))


@query(r"""SELECT page_id, CASE WHEN q = '' THEN h ELSE concat(h, '?', q) END AS canonical FROM (SELECT page_id, regexp_extract(u, '^([^?]*)', 1) AS h,
  array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS q
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))""")
def canonical_url(spark, sf_dir):
    return tables(spark, sf_dir, "pages")[0].select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query()
def html_text(spark, sf_dir):
    body = text.html_text(F.col("html"))
    return tables(spark, sf_dir, "pages")[0].select("page_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("text_md5"))


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_title(spark, sf_dir):
    return tables(spark, sf_dir, "pages")[0].select("page_id", text.html_title(F.col("html")).alias("title"))


@query()
def html_meta(spark, sf_dir):
    rows = tables(spark, sf_dir, "pages")[0].select("page_id", F.explode(text.html_meta(F.col("html"))))
    return rows.select("page_id", "key", "value")


@query()
def event_pages(spark, sf_dir):
    return feeds.event_pages(tables(spark, sf_dir, "pages")[0]).select("source_record_id", "title", "url", "mode")


KEYWORDS = ("he", "er", "the of", "license", "en la", "java")


@query("SELECT doc_id, array_to_string(list_filter([{}], lambda k: contains(lower(text), k)), ',') AS tags FROM documents".format(", ".join(f"'{k}'" for k in KEYWORDS)))
def keyword_tags(spark, sf_dir):
    return tables(spark, sf_dir, "documents")[0].select("doc_id", F.array_join(text.keyword_tags(F.col("text"), KEYWORDS), ",").alias("tags"))


PRIZE_TEXT = "concat('Total prize pool of ₹ ', CAST(o_orderkey % 900 + 1 AS VARCHAR), CASE o_orderkey % 3 WHEN 0 THEN ' lakh' WHEN 1 THEN 'k' ELSE '' END, ' for a team of ', CAST(o_orderkey % 3 + 1 AS VARCHAR), '-', CAST(o_orderkey % 4 + 3 AS VARCHAR), '.')"


@query("""SELECT o_orderkey, CAST((o_orderkey % 900 + 1) * CASE o_orderkey % 3 WHEN 0 THEN 100000 WHEN 1 THEN 1000 ELSE 1 END AS DECIMAL(18,2)) AS amount, 'INR' AS currency,
  CAST(o_orderkey % 3 + 1 AS INTEGER) AS least, CAST(o_orderkey % 4 + 3 AS INTEGER) AS most FROM orders""")
def prize_and_team_text(spark, sf_dir):
    said = tables(spark, sf_dir, "orders")[0].select("o_orderkey", F.expr(PRIZE_TEXT.replace("VARCHAR", "STRING")).alias("t"))
    both = said.select("o_orderkey", text.prize(F.col("t")).alias("p"), text.team_size(F.col("t")).alias("s"))
    return both.select("o_orderkey", "p.amount", "p.currency", "s.least", "s.most")


# ---- milestones

def _spread(spark, sf_dir):
    """Orders over all cores: reading dates costs far more than moving two columns, and the file is one split."""
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_orderdate").repartition(spark.sparkContext.defaultParallelism)


@query("""SELECT o_orderkey AS id, 'registration_deadline' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders UNION ALL
  SELECT o_orderkey, 'idea_submission_deadline', strftime(o_orderdate + INTERVAL '3' DAY, '%Y-%m-%d') FROM orders UNION ALL
  SELECT o_orderkey, 'result_announcement', concat(strftime(o_orderdate + INTERVAL '9' DAY, '%Y-%m-%d'), 'T23:45:00+05:30') FROM orders UNION ALL
  SELECT o_orderkey, 'unknown', strftime(o_orderdate + INTERVAL '1' DAY, '%Y-%m-%d') FROM orders""")
def milestones_from_text(spark, sf_dir):
    orders = _spread(spark, sf_dir)
    day = lambda n, p: F.date_format(F.date_add("o_orderdate", n), p)
    said = F.concat(
        F.lit("Registration deadline: "), day(0, "yyyy-MM-dd"), F.lit(" ; Idea submission: "), day(3, "d MMM yyyy"), F.lit("\nResults announcement on "), day(9, "MMMM d, yyyy"),
        F.lit(" 11:45 PM IST\nRegistration and submission deadline "), day(1, "dd/MM/yyyy"),
    )
    # A day and a month of 12 or less read day first, which is how the text was written.
    return milestones.extract_milestones(orders.select("o_orderkey", said.alias("text")), "o_orderkey").select("id", "kind", "iso")


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS registration_deadline, strftime(o_orderdate + INTERVAL '3' DAY, '%Y-%m-%d') AS submission FROM orders""")
def milestone_pick(spark, sf_dir):
    orders = _spread(spark, sf_dir)
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "d MMMM yyyy")
    said = F.concat(F.lit("Register before "), day(0), F.lit("; register by "), day(1), F.lit(" | concept submission "), day(2), F.lit(" | project submission "), day(3))
    picked = milestones.first_of_each(milestones.extract_milestones(orders.select("o_orderkey", said.alias("text")), "o_orderkey"))
    return picked.select("id", "registration_deadline", "submission")


@over_listings("""SELECT listing_id, label, happens_at FROM (SELECT listing_id, unnest(['opens', 'deadline', 'start']) AS label, unnest([opens_ts, deadline_ts, start_ts]) AS happens_at FROM L) WHERE happens_at IS NOT NULL""")
def milestone_timeline(df):
    wide = df.select("listing_id", F.col("opens_ts").alias("opens"), F.col("deadline_ts").alias("deadline"), F.col("start_ts").alias("start"))
    return wide.unpivot(["listing_id"], ["opens", "deadline", "start"], "label", "happens_at").where("happens_at is not null")


@over_listings("""SELECT listing_id, CASE WHEN deadline_ts IS NULL THEN NULL ELSE concat(CAST(day(t) AS VARCHAR), strftime(t, ' %B %Y, %I:%M %p')) END AS shown FROM (SELECT *, deadline_ts + to_minutes(CAST(CASE source WHEN 'unstop' THEN 330 WHEN 'mlh' THEN -300 ELSE 0 END AS BIGINT)) AS t FROM L)""")
def wall_clock(df):
    offset = F.when(F.col("source") == "unstop", 330).when(F.col("source") == "mlh", -300).otherwise(0)
    return df.select("listing_id", status.wall_clock(F.col("deadline_ts"), offset).alias("shown"))


# ---- duplicates

# Every pair of different sources that one organiser has, or that takes place in one city or online within two days of a start or
# one of a deadline: others cannot reach 75 points, as different organisers of the view share one word of three.
PAIRS = """u AS (SELECT x.listing_id AS i, y.listing_id AS j, x.source AS si, y.source AS sj FROM L x JOIN L y ON x.organizer = y.organizer UNION ALL
  SELECT x.listing_id, y.listing_id, x.source, y.source FROM L x JOIN L y ON x.city_key = y.city_key AND (abs(epoch(x.start_ts) - epoch(y.start_ts)) <= 172800 OR abs(epoch(x.deadline_ts) - epoch(y.deadline_ts)) <= 86400) UNION ALL
  SELECT x.listing_id, y.listing_id, x.source, y.source FROM L x JOIN L y ON x.mode = y.mode AND x.mode = 'online' AND (abs(epoch(x.start_ts) - epoch(y.start_ts)) <= 172800 OR abs(epoch(x.deadline_ts) - epoch(y.deadline_ts)) <= 86400)),
pairs AS (SELECT DISTINCT i AS a, j AS b FROM u WHERE i < j AND si <> sj)"""


JACC = "CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(ta), list_distinct(tb))) / len(list_distinct(list_concat(ta, tb))) END"
SIM = f"""CASE WHEN ka = '' OR kb = '' THEN 0.0 WHEN ka = kb THEN 1.0 WHEN len(ta) > 0 AND array_to_string(ta, ' ') = array_to_string(tb, ' ') THEN 0.97
  WHEN length(ka) >= 4 AND (contains(ka, kb) OR contains(kb, ka)) THEN 0.9 WHEN {JACC} = 0 THEN 0.0
  ELSE least(1.0, greatest({JACC}, greatest(0.0, 1 - least(levenshtein(ka, kb), 6) / greatest(length(ka), length(kb))) * 0.9)) END"""
SCORED = f"""s AS (SELECT a, b, x.organizer AS oa, y.organizer AS ob, x.city_key = y.city_key OR (x.mode = 'online' AND y.mode = 'online') AS place, abs(epoch(x.start_ts) - epoch(y.start_ts)) / 86400.0 AS sd, abs(epoch(x.deadline_ts) - epoch(y.deadline_ts)) / 86400.0 AS dd,
  {nk("regexp_replace(x.title, '[-'']', '', 'g')")} AS ka, {nk("regexp_replace(y.title, '[-'']', '', 'g')")} AS kb, {tokens_sql("x.title")} AS ta, {tokens_sql("y.title")} AS tb
  FROM pairs JOIN L x ON x.listing_id = a JOIN L y ON y.listing_id = b),
z AS (SELECT a, b, {SIM} AS sim, oa = ob AS same_org, place, sd, dd FROM s),
pts AS (SELECT a, b, sim, CASE WHEN sim >= 0.9 THEN 50 WHEN sim >= 0.75 THEN 35 WHEN sim >= 0.55 THEN 20 WHEN sim >= 0.35 THEN 8 ELSE 0 END + CASE WHEN same_org THEN 25 ELSE 0 END + CASE WHEN place THEN 20 ELSE 0 END
  + CASE WHEN sd <= 2 THEN 20 WHEN dd <= 1 THEN 15 ELSE 0 END AS points FROM z)"""


@query(f"{CTE}, {PAIRS}, {SCORED} SELECT a, b FROM pts WHERE points >= 75")
def candidate_pairs(spark, sf_dir):
    """Of the candidates, the pairs that are the same event: none of all pairs may be missing."""
    return dedupe.duplicate_pairs(listings(spark, sf_dir), scored=False)


@query(f"{CTE}, {PAIRS}, {SCORED} SELECT a, b, round(sim, 6) AS title_sim, CAST(points AS INTEGER) AS points, points >= 75 AS duplicate FROM pts WHERE points >= 75")
def pair_score(spark, sf_dir):
    return dedupe.duplicate_pairs(listings(spark, sf_dir)).select("a", "b", F.round("title_sim", 6).alias("title_sim"), F.col("points").cast("int").alias("points"), F.lit(True).alias("duplicate"))


@query()
def duplicate_groups(spark, sf_dir):
    return dedupe.duplicate_groups(listings(spark, sf_dir))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_copy_groups(spark, sf_dir):
    return dedupe.exact_copies(tables(spark, sf_dir, "documents")[0], "doc_id", F.col("text"))


# ---- merge and sinks

FIELDS = ("title", "city_key", "mode", "deadline_ts")
TRUST = "CASE source WHEN 'organizer_website' THEN 5 WHEN 'hackerearth' THEN 3 ELSE 4 END"
EVENT = "listing_id // 8"


def _events(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("event_id", F.expr("listing_id div 8"))


REPORTS = " UNION ALL ".join(f"SELECT {EVENT} AS event_id, listing_id, source, {TRUST} AS trust, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM L WHERE {f} IS NOT NULL" for f in FIELDS)
RECONCILED = f"""v AS (SELECT event_id, field, value, max(trust) AS trust, arg_min(row(listing_id, source), row(-trust, listing_id)) AS best FROM ({REPORTS}) GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY event_id, field ORDER BY trust DESC, best[1]) AS n, count(*) OVER (PARTITION BY event_id, field) AS n_values,
  count(*) OVER (PARTITION BY event_id, field, trust) AS ties FROM v)"""


@query(f"{CTE}, {RECONCILED} SELECT event_id, field, value, n_values, ties > 1 AS conflict, CASE WHEN ties = 1 THEN best[2] END AS chosen_source FROM w WHERE n = 1")
def reconcile_fields(spark, sf_dir):
    return merge.reconcile(merge.reports(_events(spark, sf_dir), "event_id", list(FIELDS)))


@query(f"""{CTE}, {RECONCILED} SELECT event_id, deadline, precision, confidence, source FROM (SELECT {EVENT} AS event_id, CAST(deadline_ts AS VARCHAR) AS deadline, deadline_precision AS precision, L.source,
  deadline_confidence AS confidence,
  row_number() OVER (PARTITION BY {EVENT} ORDER BY CASE deadline_confidence WHEN 'verified' THEN 0 WHEN 'source_confirmed' THEN 1 WHEN 'partially_verified' THEN 2 WHEN 'inferred' THEN 3 ELSE 4 END, -{TRUST.replace("source", "L.source")}, listing_id) AS r
  FROM L JOIN w ON w.event_id = {EVENT} AND w.field = 'deadline_ts' AND w.n = 1 AND w.value = CAST(deadline_ts AS VARCHAR)) WHERE r = 1""")
def deadline_meta(spark, sf_dir):
    return merge.deadline_meta(_events(spark, sf_dir), "event_id")


@query(f"""{CTE}, t AS (SELECT {EVENT} AS event_id, last_verified_at, listing_id, CASE WHEN listing_id % 3 = 0 THEN [] ELSE themes END AS th FROM L),
newest AS (SELECT event_id, arg_max(th, row(last_verified_at, listing_id)) AS own FROM t GROUP BY event_id), u AS (SELECT event_id, string_agg(v, ',' ORDER BY v) AS every FROM (SELECT DISTINCT event_id, unnest(th) AS v FROM t) GROUP BY event_id)
SELECT event_id, CASE WHEN len(own) > 0 THEN array_to_string(own, ',') ELSE coalesce(every, '') END AS themes FROM newest LEFT JOIN u USING (event_id)""")
def merged_themes(spark, sf_dir):
    some = _events(spark, sf_dir).withColumn("themes", F.when(F.col("listing_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("themes")))
    return merge.merged_lists(some, "event_id", "themes").withColumn("themes", F.array_join("themes", ","))


@query(f"""{CTE}, o AS (SELECT listing_id, title, mode, last_verified_at AS first_seen FROM L WHERE listing_id % 3 <> 0), n AS (SELECT listing_id, upper(title) AS title, city_key AS mode, now AS first_seen FROM L WHERE listing_id % 2 = 0)
SELECT coalesce(n.listing_id, o.listing_id) AS listing_id, CASE WHEN n.listing_id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(o.mode, n.mode) AS mode,
  CASE WHEN o.listing_id IS NOT NULL THEN o.first_seen ELSE n.first_seen END AS first_seen FROM o FULL JOIN n ON o.listing_id = n.listing_id""")
def upsert_events(spark, sf_dir):
    df = listings(spark, sf_dir)
    old = df.where("listing_id % 3 != 0").select("listing_id", "title", "mode", F.col("last_verified_at").alias("first_seen"))
    new = df.where("listing_id % 2 = 0").select("listing_id", F.upper("title").alias("title"), F.col("city_key").alias("mode"), F.col("now").alias("first_seen"))
    return sinks.merge_upsert(old, new, ["listing_id"], keep=("first_seen",), old_first=("mode",))


@query(f"{CTE} SELECT {EVENT} AS event_id, source, title FROM L WHERE listing_id % 2 = 0 UNION ALL SELECT {EVENT}, source, title FROM L WHERE listing_id % 2 = 1 AND ({EVENT}, source) NOT IN (SELECT ({EVENT}, source) FROM L WHERE listing_id % 2 = 0)")
def replace_provenance(spark, sf_dir):
    rows = _events(spark, sf_dir).select("listing_id", "event_id", "source", "title")
    return sinks.replace_rows(rows.where("listing_id % 2 = 1").drop("listing_id"), rows.where("listing_id % 2 = 0").drop("listing_id"), ["event_id", "source"])


@query("""WITH o AS (SELECT lower(n_name) AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS state, CAST(n_nationkey AS DOUBLE) AS la FROM nation WHERE n_nationkey < 18),
n AS (SELECT lower(n_name) AS k, concat('new ', n_name) AS state, CASE WHEN n_nationkey % 3 = 0 THEN 99.0 END AS la FROM nation WHERE n_nationkey > 6)
SELECT coalesce(o.k, n.k) AS place_key, coalesce(n.state, o.state) AS state, coalesce(o.la, n.la)::DOUBLE AS latitude FROM o FULL JOIN n ON o.k = n.k""")
def place_upsert(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    base = nation.select(F.lower("n_name").alias("place_key"), "n_name", "n_nationkey", F.lit(None).cast("string").alias("metro"), F.lit(None).cast("double").alias("longitude"))
    old = base.where("n_nationkey < 18").withColumns({"state": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), "latitude": F.col("n_nationkey").cast("double")})
    new = base.where("n_nationkey > 6").withColumns({"state": F.concat(F.lit("new "), "n_name"), "latitude": F.when(F.col("n_nationkey") % 3 == 0, 99.0)})
    return sinks.place_upsert(old, new).select("place_key", "state", "latitude")


@over_listings(f"""SELECT * FROM (SELECT listing_id, {LIVE} AS old_status, CASE WHEN deadline_ts IS NULL THEN 'unknown' WHEN deadline_ts <= TIMESTAMP '1998-07-15' THEN 'closed' WHEN opens_ts > TIMESTAMP '1998-07-15' THEN 'upcoming' ELSE 'open' END AS new_status FROM L) WHERE old_status <> new_status""")
def status_changes(df):
    return sinks.status_changes(df, NOW, "1998-07-15 00:00:00")


@over_listings("SELECT listing_id, CASE WHEN deadline_ts IS NULL THEN 'deadline_ts' WHEN start_ts IS NULL THEN 'start_ts' ELSE 'prize_amount' END AS reason FROM L WHERE deadline_ts IS NULL OR start_ts IS NULL OR prize_amount IS NULL")
def rejected_split(df):
    return sinks.accepted_and_rejected(df, ["deadline_ts", "start_ts", "prize_amount"])[1].select("listing_id", "reason")


@query("SELECT user_id AS source_record_id, event_type AS source, min(event_id) AS event_id FROM events GROUP BY ALL")
def feed_dedupe(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select(F.col("event_type").alias("source"), F.col("user_id").alias("source_record_id"), "event_id")
    return feeds.once_each(rows, [F.col("event_id")])


# ---- places


@query()
def place_resolution(spark, sf_dir):
    """Customers' nations as city texts beside known places, all resolved."""
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    known = F.array(*[F.lit(p[0]) for p in refdata.PLACES])
    name = F.get(known, (F.col("c_custkey") % len(refdata.PLACES)).cast("int"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit(" urban district"))).when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit(", India"))).otherwise(F.col("n_name"))
    texts = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(said.alias("place_text"))
    return places.resolve_places(texts, places.default_places(spark))


# ---- completion and exports


@query(f"""{CTE} SELECT listing_id, coalesce(d.organizer, L.organizer) AS organizer, coalesce(d.prize, prize_amount) AS prize_amount, CASE WHEN d.listing_id IS NULL THEN 'partially_verified' ELSE 'source_confirmed' END AS confidence
  FROM L LEFT JOIN (SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS organizer, o_totalprice + 1 AS prize FROM orders WHERE o_orderkey % 2 = 0) d USING (listing_id)""")
def detail_override(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    details = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("listing_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("organizer"), (F.col("o_totalprice") + 1).alias("prize_amount"))
    return enrich.with_details(listings(spark, sf_dir), details, "listing_id", ["organizer", "prize_amount"]).select("listing_id", "organizer", "prize_amount", "confidence")


GEO = """SELECT CAST(s_nationkey AS VARCHAR) AS place_key, CASE s_suppkey % 4 WHEN 0 THEN 'country' WHEN 1 THEN 'city' WHEN 2 THEN 'village' ELSE 'suburb' END AS feature, CAST(s_suppkey % 97 AS DOUBLE) AS latitude, CAST(s_suppkey % 90 AS DOUBLE) AS longitude FROM supplier"""
BEST_GEO = f"""SELECT place_key, feature, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY CASE feature WHEN 'city' THEN 0 WHEN 'village' THEN 2 WHEN 'suburb' THEN 6 ELSE 8 END, latitude, longitude) AS r FROM ({GEO}) WHERE latitude BETWEEN -90 AND 90 AND NOT (latitude = 0 AND longitude = 0)) WHERE r = 1"""


def _geocodes(spark, sf_dir):
    n = F.col("s_suppkey") % 4
    feature = F.when(n == 0, "country").when(n == 1, "city").when(n == 2, "village").otherwise("suburb")
    return tables(spark, sf_dir, "supplier")[0].select(F.col("s_nationkey").cast("string").alias("place_key"), feature.alias("feature"), (F.col("s_suppkey") % 97).cast("double").alias("latitude"), (F.col("s_suppkey") % 90).cast("double").alias("longitude"))


@query(BEST_GEO)
def geocode_pick(spark, sf_dir):
    return enrich.best_geocode(_geocodes(spark, sf_dir))


@query(f"""WITH g AS ({BEST_GEO}), c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 25 AS VARCHAR) END AS venue_key, CAST(c_nationkey AS VARCHAR) AS place_key, CASE WHEN c_custkey % 5 = 0 THEN 1.5 END::DOUBLE AS latitude FROM customer)
SELECT c_custkey, coalesce(c.latitude, v.latitude, p.latitude) AS latitude, CASE WHEN c.latitude IS NOT NULL THEN 2.5 WHEN v.latitude IS NOT NULL THEN v.longitude ELSE p.longitude END::DOUBLE AS longitude
FROM c LEFT JOIN g v ON v.place_key = venue_key LEFT JOIN g p ON p.place_key = c.place_key""")
def coordinates_backfill(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    given = F.col("c_custkey") % 5 == 0
    rows = customer.select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 25).cast("string")).alias("venue_key"), F.col("c_nationkey").cast("string").alias("place_key"),
        F.when(given, 1.5).alias("latitude"), F.when(given, 2.5).alias("longitude"),
    )
    return enrich.with_coordinates(rows, enrich.best_geocode(_geocodes(spark, sf_dir))).select("c_custkey", "latitude", "longitude")


PROVENANCE = " UNION ALL ".join(f"SELECT {EVENT} AS event_id, listing_id, source, {CONFIDENCE} AS confidence, last_verified_at AS t, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM L WHERE {f} IS NOT NULL" for f in ("title", "mode", "eligibility"))


def _provenance(spark, sf_dir):
    return enrich.provenance(_events(spark, sf_dir), ["title", "mode", "eligibility"], F.expr(CONFIDENCE))


@query(f"""{CTE} SELECT event_id, field, value, confidence, source, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id, field ORDER BY CASE confidence WHEN 'verified' THEN 0 WHEN 'source_confirmed' THEN 1 WHEN 'inferred' THEN 3 ELSE 4 END, t DESC, listing_id) AS r FROM ({PROVENANCE})) WHERE r = 1""")
def best_provenance(spark, sf_dir):
    return enrich.best_provenance(_provenance(spark, sf_dir))


@query(f"{CTE} SELECT event_id, field, string_agg(value, '|' ORDER BY value) AS vals FROM (SELECT DISTINCT event_id, field, value FROM ({PROVENANCE})) GROUP BY ALL HAVING count(*) > 1")
def conflict_lists(spark, sf_dir):
    return enrich.distinct_conflicts(_provenance(spark, sf_dir)).select("event_id", "field", F.array_join("values", "|").alias("vals"))


@query(f"""WITH r AS ({RUNS}), g AS (SELECT source, max(row(started, run_id)) FILTER (WHERE ok) AS good FROM r GROUP BY source), f AS (SELECT g.source, count(*) FILTER (WHERE NOT ok AND (good IS NULL OR row(started, run_id) > good)) AS n, count(*) AS runs FROM r JOIN g USING (source) GROUP BY g.source)
SELECT s.source, s.enabled, CASE WHEN NOT enabled THEN 'disabled' WHEN runs IS NULL THEN 'unknown' WHEN n >= 3 THEN 'failing' WHEN n > 0 THEN 'degraded' ELSE 'healthy' END AS health, coalesce(records, 0) AS records
FROM (SELECT s_suppkey AS source, s_suppkey % 7 <> 0 AS enabled FROM supplier) s LEFT JOIN f USING (source) LEFT JOIN (SELECT c_custkey % 60 AS source, count(*) AS records FROM customer GROUP BY 1) c USING (source)""")
def source_catalog(spark, sf_dir):
    supplier, customer = tables(spark, sf_dir, "supplier", "customer")
    catalog = supplier.select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 7 != 0).alias("enabled"))
    counts = customer.groupBy((F.col("c_custkey") % 60).alias("source")).agg(F.count(F.lit(1)).alias("records"))
    return enrich.source_catalog(catalog, stats.source_health(_runs(spark, sf_dir)), counts)


@query(f"""{CTE} SELECT source, count(*) FILTER (WHERE start_ts IS NOT NULL AND listing_id % 3 = 0) AS inserted, count(*) FILTER (WHERE start_ts IS NOT NULL AND listing_id % 3 <> 0) AS updated, count(*) FILTER (WHERE start_ts IS NULL) AS rejected FROM L WHERE listing_id % 2 = 0 GROUP BY source""")
def run_summary(spark, sf_dir):
    df = listings(spark, sf_dir)
    return enrich.run_summary(df.where("listing_id % 3 != 0"), df.where("listing_id % 2 = 0"), ["title", "start_ts"])


@over_listings("SELECT listing_id, CASE WHEN prize_amount > 0 THEN concat('USD ', regexp_replace(printf('%,.2f', prize_amount), '\\.00$', '')) END AS prize, CASE WHEN team_size_min IS NULL AND team_size_max IS NULL THEN NULL WHEN team_size_max IS NULL THEN concat('at least ', team_size_min, CASE WHEN team_size_min = 1 THEN ' member' ELSE ' members' END) WHEN team_size_min IS NULL THEN concat('up to ', team_size_max, CASE WHEN team_size_max = 1 THEN ' member' ELSE ' members' END) WHEN team_size_min = team_size_max THEN concat(team_size_min, CASE WHEN team_size_min = 1 THEN ' member' ELSE ' members' END) ELSE concat(team_size_min, '–', team_size_max, ' members') END AS team FROM L")
def display_text(df):
    return df.select("listing_id", exports.prize_text(F.col("prize_amount"), F.lit("USD")).alias("prize"), exports.team_text(F.col("team_size_min"), F.col("team_size_max")).alias("team"))


@over_listings("SELECT listing_id, coalesce(abs(epoch(deadline_ts) - epoch(start_ts)) > 86400, false) AS conflict FROM L")
def date_conflicts(df):
    return df.select("listing_id", enrich.date_conflict(F.col("deadline_ts"), F.col("start_ts")).alias("conflict"))


@query(f"""{CTE}, p AS (SELECT place, count(s) AS n FROM ({PLACES}) p JOIN (SELECT city_key, {LIVE} AS s FROM L) t USING (city_key) GROUP BY place ORDER BY n DESC, place LIMIT 200),
e AS (SELECT listing_id, {LIVE} AS s, replace({nk("title")}, ' ', '-') AS slug FROM L WHERE {LIVE} <> 'closed' ORDER BY listing_id LIMIT 2000)
SELECT '/' AS loc, 1.0::DOUBLE AS priority UNION ALL SELECT concat('/city/', replace(lower(place), ' ', '-')), 0.8 FROM p UNION ALL SELECT concat('/event/', substr(slug, 1, 70)), CASE WHEN s = 'open' THEN 0.7 ELSE 0.5 END FROM e""")
def sitemap(spark, sf_dir):
    df = listings(spark, sf_dir)
    s = status.live_status(F.col("deadline_ts"), F.col("opens_ts"), at())
    return exports.sitemap(df.withColumn("slug", text.slug(F.col("title"))), facets.places_with_events(df, _places(spark, sf_dir), at()), s)


@over_listings("""SELECT listing_id, concat('{"@context":"https://schema.org","@type":"Event","name":"', title, '"', CASE WHEN start_ts IS NOT NULL THEN concat(',"startDate":"', strftime(start_ts, '%Y-%m-%d'), '"') ELSE '' END, CASE WHEN mode <> 'online' THEN concat(',"location":{"@type":"Place","name":"', city_key, '"}') ELSE '' END, '}') AS document FROM L""")
def event_documents(df):
    return exports.event_documents(df)


@over_listings("""SELECT city_key, concat('[', string_agg(concat('{"position":', r, ',"name":"', title, '"}'), ',' ORDER BY r), ']') AS items FROM (SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY listing_id) AS r FROM L) WHERE r <= 20 GROUP BY city_key""")
def item_lists(df):
    return exports.item_lists(df, "city_key")


@query("SELECT event_id, CAST(date_diff('minute', ts, timezone('UTC', timezone('America/New_York', ts AT TIME ZONE 'UTC') AT TIME ZONE 'UTC')) AS INTEGER) AS offset_minutes FROM events")
def zone_offsets(spark, sf_dir):
    return tables(spark, sf_dir, "events")[0].select("event_id", enrich.zone_offset(F.col("ts").cast("timestamp"), F.lit("America/New_York")).alias("offset_minutes"))


def queries() -> dict[str, Query]:
    from listinglake import queries_detail as queries_detail  # registers further ones
    from listinglake import queries_jobs as queries_jobs

    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from listinglake import queries_detail as queries_detail
    from listinglake import queries_jobs as queries_jobs

    return {k: sql for k, (_, sql) in FOUND.items() if sql}
