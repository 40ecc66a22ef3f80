"""Registered queries of details: result rows, merged events, feeds, typed dates, places and audits, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglake import refdata
from listinglake.functions import geo, status, text
from listinglake.operators import enrich, facets, links, merge, milestones, places, search, stats
from listinglake.plans.listings import NOW, listings, tables
from listinglake.queries import CTE, EVENT, HERE, LAT, LIVE, LON, PLACES, PROVENANCE, RANK, RUNS, P, _events, _places, _provenance, _runs, all_matches, at, over_listings, query
from listinglake.sources import feeds

# ---- search

all_matches(P(technologies=("python", "brand#3")), "list_has_any(technologies, ['python', 'brand#3'])", "search_technologies")
all_matches(P(city_keys=("nation_3", "hall 4"), metro="none"), "(city_key IN ('nation_3', 'hall 4') OR contains(lower(location_text), 'nation_3') OR contains(lower(location_text), 'hall 4'))", "search_location_text")
all_matches(P(latitude=LAT, longitude=LON), f"(latitude IS NULL OR {HERE} <= 50)", "search_default_radius")
FIJI = HERE.replace(str(LON), "179.9").replace(str(LAT), "-17.0")
MOVED = "(SELECT *, longitude - 60 + CASE WHEN longitude < 72 THEN 168 ELSE -192 END AS lo, latitude - 40 AS la FROM L)"


@query(f"{CTE} SELECT listing_id FROM (SELECT listing_id, la AS latitude, lo AS longitude, deadline_ts, opens_ts, now FROM {MOVED}) WHERE {LIVE} <> 'closed' AND (latitude IS NULL OR {FIJI} <= 900)")
def search_across_date_line(spark, sf_dir):
    moved = F.col("longitude") - 60 + F.when(F.col("longitude") < 72, 168).otherwise(-192)
    df = listings(spark, sf_dir).withColumns({"longitude": moved, "latitude": F.col("latitude") - 40})
    return search.filtered(df, P(latitude=-17.0, longitude=179.9, radius_km=900), at()).select("listing_id")


@over_listings("SELECT value, count(*) AS n FROM (SELECT listing_id, unnest(list_distinct(technologies)) AS value FROM L) GROUP BY value ORDER BY n DESC, value LIMIT 20")
def facet_technologies(df):
    return facets.value_facet(df, F.col("technologies"))


@over_listings(f"SELECT count(*) AS total FROM L WHERE {LIVE} <> 'closed' AND prize_amount > 0 AND mode = 'online'")
def filtered_total(df):
    return search.total(df, P(prize_only=True, mode="online"), at())


@query(f"""{CTE}, s AS (SELECT listing_id, mode FROM L WHERE {LIVE} <> 'closed' AND city_key = 'nation_7' AND mode <> 'online' ORDER BY {RANK} LIMIT 20),
o AS (SELECT listing_id, mode FROM L WHERE {LIVE} <> 'closed' AND mode = 'online' ORDER BY {RANK} LIMIT 12) SELECT 'city' AS section, * FROM s UNION ALL SELECT 'online', * FROM o""")
def search_sections(spark, sf_dir):
    there, online = search.sections(listings(spark, sf_dir), P(city_keys=("nation_7",)), at())
    return there.select(F.lit("city").alias("section"), "listing_id", "mode").union(online.select(F.lit("online"), "listing_id", "mode"))


@over_listings(f"""SELECT listing_id, source, source_record_id, title, organizer, location_text, city_key, metro, latitude, longitude, mode, deadline_ts, deadline_precision, deadline_confidence, opens_ts, start_ts, team_size_min,
  team_size_max, array_to_string(CASE WHEN listing_id % 5 = 0 THEN [] ELSE themes END, '|') AS themes, array_to_string(technologies, '|') AS technologies, eligibility, prize_amount, free_or_paid, registration_fee, last_verified_at,
  CASE WHEN deadline_ts IS NULL THEN 'unknown' WHEN deadline_precision = 'date_only' THEN CASE WHEN date_trunc('day', deadline_ts) + INTERVAL '86399999' MILLISECOND >= now THEN 'open' ELSE 'closed' END
  WHEN deadline_ts <= now THEN 'closed' WHEN opens_ts > now THEN 'upcoming' ELSE 'open' END AS status, CASE WHEN latitude IS NOT NULL THEN round({HERE}, 1) END AS distance_km
  FROM L WHERE {LIVE} <> 'closed' AND (latitude IS NULL OR {HERE} <= 300) ORDER BY {RANK} LIMIT 100""")
def search_rows(df):
    p = P(latitude=LAT, longitude=LON, radius_km=300.0, limit=100)
    shown = search.shaped(search.search(df.withColumn("themes", F.when(F.col("listing_id") % 5 != 0, F.col("themes"))), p, at()), p, at())
    return shown.withColumns({c: F.array_join(c, "|") for c in ("themes", "technologies")}).drop("themes_csv", "technologies_csv", "description", "now")


# ---- events and their links


@query(f"{CTE} SELECT count(*) AS merged FROM (SELECT {EVENT} AS e FROM L GROUP BY 1 HAVING count(DISTINCT source_record_id) > 1)")
def merged_event_count(spark, sf_dir):
    records = _events(spark, sf_dir).groupBy("event_id").agg(F.count_distinct("source_record_id").alias("n"))
    return records.agg(F.count_if(F.col("n") > 1).alias("merged"))


@query(f"{CTE} SELECT count(DISTINCT place) AS places FROM ({PLACES}) p JOIN L USING (city_key)")
def places_count(spark, sf_dir):
    return facets.places_with_events(listings(spark, sf_dir), _places(spark, sf_dir), at()).agg(F.count(F.lit(1)).alias("places"))


@query("""SELECT x.l_orderkey AS event_id, x.l_linenumber AS link, count(y.l_linenumber) AS others, min(y.l_suppkey) AS least_source FROM lineitem x
  LEFT JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND NOT (x.l_linenumber = y.l_linenumber AND x.l_suppkey = y.l_suppkey) GROUP BY x.l_orderkey, x.l_linenumber, x.l_suppkey, x.rowid""".replace(", x.rowid", ""))
def sibling_links(spark, sf_dir):
    """Of each link the event's other links."""
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    return links.sibling_links(lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("link"), F.col("l_suppkey").alias("source")))


AUDIT = f"""a AS (SELECT {EVENT} AS event_id, string_agg(concat(source, ':', source_record_id), ',' ORDER BY source, source_record_id) AS snapshots, count(*) AS n, max(last_verified_at) AS checked FROM L
  WHERE {EVENT} IN (SELECT {EVENT} FROM L WHERE source = 'unstop') AND {EVENT} IN (SELECT {EVENT} FROM L WHERE {LIVE} = 'open') GROUP BY 1)"""


@query(f"{CTE}, {AUDIT} SELECT event_id, snapshots, n FROM a ORDER BY checked DESC, event_id LIMIT 25")
def audit_snapshots(spark, sf_dir):
    """Snapshots of the 25 freshest events that are open and known to one source."""
    df = _events(spark, sf_dir)
    live = status.live_status(F.col("deadline_ts"), F.col("opens_ts"), at())
    wanted = df.where("source = 'unstop'").select("event_id").join(df.where(live == "open").select("event_id"), "event_id", "left_semi").distinct()
    held = F.array_sort(F.collect_list(F.struct("source", "source_record_id")))
    some = df.join(wanted, "event_id", "left_semi").groupBy("event_id").agg(held.alias("s"), F.count(F.lit(1)).alias("n"), F.max("last_verified_at").alias("checked"))
    text_of = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["source"], x["source_record_id"])), ",")
    return some.orderBy(F.desc("checked"), "event_id").limit(25).select("event_id", text_of.alias("snapshots"), "n")


@query(f"{CTE} SELECT DISTINCT place FROM ({PLACES}) p WHERE length(place) % 2 = 0 AND city_key IN (SELECT city_key FROM L WHERE latitude IS NULL)")
def places_without_coordinates(spark, sf_dir):
    unknown = _places(spark, sf_dir).where("length(place) % 2 = 0")  # the others count as known
    return unknown.join(listings(spark, sf_dir).where("latitude is null"), "city_key", "left_semi").select("place").distinct()


@query(f"{CTE} SELECT field, value, source, listing_id FROM ({PROVENANCE}) WHERE event_id = 12 ORDER BY field, t DESC, listing_id")
def provenance_history(spark, sf_dir):
    rows = _provenance(spark, sf_dir).where("event_id = 12")
    return rows.orderBy("field", F.desc("retrieved_at"), "listing_id").select("field", "value", "source", "listing_id")


BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, field ORDER BY CASE confidence WHEN 'verified' THEN 0 WHEN 'source_confirmed' THEN 1 WHEN 'inferred' THEN 3 ELSE 4 END, t DESC, listing_id) AS r FROM ({PROVENANCE})) WHERE r = 1)"


@query(f"{CTE} SELECT L.listing_id, p.source AS said_by, p.confidence FROM L LEFT JOIN {BEST} p ON p.event_id = {EVENT} AND p.field = CASE WHEN L.listing_id % 2 = 0 THEN 'mode' ELSE 'deadline' END".replace(f"p.event_id = {EVENT}", "p.event_id = L.listing_id // 8"))
def milestone_provenance(spark, sf_dir):
    """Each listing's fact beside the best row that tells where its event's value comes from; none for facts without provenance."""
    best = enrich.best_provenance(_provenance(spark, sf_dir)).select("event_id", "field", F.col("source").alias("said_by"), "confidence")
    facts = _events(spark, sf_dir).select("listing_id", "event_id", F.when(F.col("listing_id") % 2 == 0, "mode").otherwise("deadline").alias("field"))
    return facts.join(best, ["event_id", "field"], "left").select("listing_id", "said_by", "confidence")


# ---- merged events

SNAPSHOT = ["title", "organizer", "location_text", "city_key", "mode", "deadline_ts", "opens_ts", "start_ts", "team_size_min", "team_size_max", "eligibility", "themes", "technologies", "prize_amount", "free_or_paid", "registration_fee", "deadline_precision", "deadline_confidence"]


def canon(f: str) -> str:
    if f in ("themes", "technologies"):
        return f"array_to_string({f}, ', ')"
    if f in ("prize_amount", "registration_fee"):
        return f"regexp_replace(CAST(CAST({f} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"
    return f"strftime({f}, '%Y-%m-%dT%H:%M:%S')" if f.endswith("_ts") else f"nullif(trim(CAST({f} AS VARCHAR)), '')"


@over_listings(f"SELECT listing_id, source, {', '.join(f'{canon(f)} AS {f}' for f in SNAPSHOT)} FROM L")
def snapshots(df):
    return merge.snapshots(df, SNAPSHOT)


TRUSTED = "CASE source WHEN 'organizer_website' THEN 5 WHEN 'hackerearth' THEN 3 ELSE 4 END"
LONG = " UNION ALL ".join(f"SELECT {EVENT} AS event_id, listing_id, source, {TRUSTED} AS trust, '{f}' AS field, {canon(f)} AS value FROM L" for f in SNAPSHOT)
WON = f"""v AS (SELECT event_id, field, value, max(trust) AS trust, arg_min(listing_id, row(-trust, listing_id)) AS first FROM ({LONG}) WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY event_id, field ORDER BY trust DESC, first) AS n, count(*) OVER (PARTITION BY event_id, field, trust) > 1 AS conflict FROM v)"""


@query(f"""{CTE}, {WON} SELECT event_id, {", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in SNAPSHOT)}, coalesce(bool_or(conflict) FILTER (WHERE field = 'deadline_ts'), false) AS deadline_conflict,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE conflict AND field <> 'deadline_ts'), '') AS field_conflicts FROM w WHERE n = 1 GROUP BY event_id""")
def merged_events(spark, sf_dir):
    merged = merge.merged_events(_events(spark, sf_dir), "event_id", SNAPSHOT)
    return merged.withColumn("field_conflicts", F.array_join("field_conflicts", ","))


@query(f"""{CTE}, {WON} SELECT event_id, field, string_agg(said, '|' ORDER BY t DESC, value, source) AS said FROM (SELECT DISTINCT x.event_id, x.field, x.value, x.source, x.trust AS t, concat(x.value, '@', x.source) AS said
  FROM ({LONG}) x JOIN w ON w.event_id = x.event_id AND w.field = x.field AND w.n = 1 AND w.conflict WHERE x.field IN ('mode', 'city_key') AND x.value IS NOT NULL) GROUP BY ALL""")
def conflict_details(spark, sf_dir):
    found = merge.conflict_details(_events(spark, sf_dir), "event_id", ["mode", "city_key"])
    return found.select("event_id", "field", F.array_join(F.transform("values", lambda x: F.concat_ws("@", x["value"], x["source"])), "|").alias("said"))


@query(f"{CTE}, s AS (SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN 'x' ELSE city_key END AS base FROM L), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY listing_id) AS n FROM s) SELECT listing_id AS id, CASE WHEN n = 1 THEN replace(base, '_', '-') ELSE concat(replace(base, '_', '-'), '-', n) END AS slug FROM n")
def crowded_slugs(spark, sf_dir):
    """A third of all rows share one base."""
    df = listings(spark, sf_dir)
    return merge.unique_slugs(df, "listing_id", F.when(F.col("listing_id") % 3 == 0, "x").otherwise(F.col("city_key")))


# ---- status, grade and dates

CONF = "deadline_confidence"


@over_listings(f"""SELECT listing_id, CASE WHEN listing_id % 13 = 0 THEN 'sources disagree about the deadline' WHEN deadline_ts IS NULL THEN CASE WHEN n >= 6 THEN 'no deadline is published' ELSE 'very little is published' END
  WHEN {CONF} = 'inferred' THEN 'deadline inferred from the submission deadline' WHEN {CONF} = 'unknown' THEN 'deadline text is ambiguous' WHEN source <> 'hackerearth' AND deadline_precision = 'instant' AND {CONF} = 'verified' THEN concat('deadline is a field of ', source)
  WHEN source <> 'hackerearth' THEN concat('deadline published without a time by ', source) ELSE concat('deadline read from a page of ', source) END AS reason, n AS populated
  FROM (SELECT *, CAST(2 + (opens_ts IS NOT NULL)::INT + (start_ts IS NOT NULL)::INT + (prize_amount IS NOT NULL)::INT + (team_size_min IS NOT NULL)::INT + (team_size_max IS NOT NULL)::INT AS INTEGER) AS n FROM L)""")
def grade_reasons(df):
    n = status.populated_fields("title", "organizer", "opens_ts", "start_ts", "prize_amount", "team_size_min", "team_size_max")
    why = status.grade_reason(F.col("deadline_ts"), F.col("listing_id") % 13 == 0, F.col(CONF), F.lit("registration_deadline"), F.col("deadline_precision"), F.col("source"), n)
    return df.select("listing_id", why.alias("reason"), n.alias("populated"))


@over_listings("""SELECT listing_id, CASE WHEN deadline_ts IS NULL THEN 'Not specified' WHEN deadline_precision = 'date_only' THEN concat(day(deadline_ts), strftime(deadline_ts, ' %B %Y'), ' — time not specified') ELSE concat(day(t), strftime(t, ' %B %Y, %I:%M %p')) END AS shown,
  CASE listing_id % 4 WHEN 0 THEN 'IST' WHEN 1 THEN 'UTC' WHEN 2 THEN 'UTC+02:00' ELSE 'PDT' END AS label FROM (SELECT *, timezone('America/New_York', deadline_ts AT TIME ZONE 'UTC') AS t FROM L)""")
def deadline_in_zone(df):
    n = F.col("listing_id") % 4
    label = status.zone_label(F.when(n == 1, "UTC+00:00").when(n == 2, "UTC+02:00").when(n == 3, "PDT"), F.when(n == 0, 330).when(n == 1, 0).when(n == 2, 120).otherwise(-420))
    return df.select("listing_id", status.shown_in_zone(F.col("deadline_ts").cast("timestamp"), F.col("deadline_precision"), "America/New_York").alias("shown"), label.alias("label"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T18:05:00-07:00') WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT09:30:00+05:30') END AS iso FROM orders""")
def strict_dates(spark, sf_dir):
    n, day = F.col("o_orderkey") % 5, lambda p: F.date_format("o_orderdate", p)
    said = F.when(n == 0, day("d MMMM yyyy")).when(n == 1, day("MMM d, yyyy")).when(n == 2, F.concat(day("MMMM d yyyy"), F.lit(" @ 6:05 pm PDT"))).when(n == 3, F.concat(F.lit("on "), day("d MMM yyyy"))).otherwise(F.concat(day("yyyy-MM-dd"), F.lit("T09:30:00+05:30")))
    return tables(spark, sf_dir, "orders")[0].select("o_orderkey", milestones.strict_date(said, 1998).alias("iso"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL '20' DAY, '%Y-%m-%d') AS submission_deadline FROM orders")
def submission_window(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    said = F.concat(F.date_format("o_orderdate", "MMM dd"), F.lit(" - "), F.date_format(F.date_add("o_orderdate", 20), "MMM dd, yyyy"))
    return feeds.window_end(orders.select("o_orderkey", said.alias("span")), "o_orderkey", "span")


@query("SELECT o_orderkey AS id, concat(strftime(o_orderdate, '%Y-%m-%d'), 'T23:45:00-07:00') AS submission_deadline, 'verified' AS confidence FROM orders WHERE o_orderkey % 4 <> 0")
def page_deadlines(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("<p>Deadline: "), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" @ 11:45pm PDT</p>"))).otherwise("<p>No dates yet, 3 prizes</p>")
    html = F.concat(F.lit("<html><body><h1>Event</h1><p>Founded 1 May 1990</p>"), line, F.lit("<p>Deadline passed? Write to us.</p></body></html>"))
    return feeds.page_deadline(orders.select("o_orderkey", html.alias("html")), "o_orderkey")


BLOCK = "regexp_matches(b, '[0-9]') AND (" + " OR ".join(f"contains(lower(b), '{w}')" for w in text.SCHEDULE_WORDS) + ")"


@query(f"""SELECT doc_id, md5(CASE WHEN len(k) > 0 THEN array_to_string(k[1:120], chr(10)) ELSE substr(text, 1, 20000) END) AS blocks_md5 FROM
  (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda b: trim(b, ' ')), lambda b: {BLOCK}) AS k FROM documents)""")
def schedule_blocks(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")[0]
    return docs.select("doc_id", F.md5(text.schedule_blocks(F.col("text"))).alias("blocks_md5"))


# ---- places, points and texts

OWN = ", ".join(f"({k}, '{p[0]}', {'NULL' if p[1] is None else repr(p[1])})" for k, p in enumerate(refdata.PLACES))


@query(f"""WITH p(k, name, place_state) AS (VALUES {OWN}), a AS (SELECT DISTINCT name, place_state, k, CASE c_custkey % 3 WHEN 0 THEN place_state WHEN 1 THEN 'Elsewhere' END AS state FROM customer JOIN p ON k = c_custkey % {len(refdata.PLACES)})
SELECT name, state, state IS NOT DISTINCT FROM place_state AS exact, CAST(k AS INTEGER) AS position FROM a""")
def state_match(spark, sf_dir):
    known = F.array(*[F.struct(F.lit(p[0]).alias("name"), F.lit(p[1]).cast("string").alias("state")) for p in refdata.PLACES])
    one = F.get(known, (F.col("c_custkey") % len(refdata.PLACES)).cast("int"))
    n = F.col("c_custkey") % 3
    names = tables(spark, sf_dir, "customer")[0].select(one["name"].alias("name"), F.when(n == 0, one["state"]).when(n == 1, "Elsewhere").alias("state"))
    return places.by_state(names, places.default_places(spark)).select("name", "state", "exact", "position")


@over_listings("SELECT listing_id, coalesce(la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0), false) AS valid FROM (SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN 0 ELSE latitude * 2.5 END AS la, CASE WHEN listing_id % 3 = 0 THEN 0 ELSE longitude * 2 END AS lo FROM L)")
def valid_points(df):
    third = F.col("listing_id") % 3 == 0
    return df.select("listing_id", F.coalesce(geo.valid(F.when(third, 0).otherwise(F.col("latitude") * 2.5), F.when(third, 0).otherwise(F.col("longitude") * 2)), F.lit(False)).alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN concat('Eligibility: ', lower(o_orderpriority), ' teams') END AS eligibility, concat(substr(o_orderpriority, 1, 1), ' ', upper(substr(o_orderpriority, 3, 1)), replace(lower(substr(o_orderpriority, 4)), ' ', ''), ' Of ', CAST(o_orderkey AS VARCHAR)) AS shown FROM orders")
def spoken_texts(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    said = F.concat(F.lit("Join us. "), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Eligibility: "), F.lower("o_orderpriority"), F.lit(" teams. "))).otherwise(""), F.lit("Thanks."))
    slug = F.concat(F.regexp_replace(F.lower("o_orderpriority"), " ", ""), F.lit("-of-"), F.col("o_orderkey").cast("string"))
    return orders.select("o_orderkey", text.eligibility(said).alias("eligibility"), text.display_name(slug).alias("shown"))


@query("""SELECT event_id, concat('{"event_type":"', event_type, '","n":', user_id, '}') AS document FROM events""")
def clean_documents(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    dirty = F.concat("event_type", F.lit("\x00"))
    return events.select("event_id", text.clean_json(F.struct(dirty.alias("event_type"), F.col("user_id").alias("n"))).alias("document"))


@over_listings(f"SELECT listing_id FROM L WHERE source <> 'mlh' OR start_ts IS NULL OR start_ts > TIMESTAMP '{NOW}' - INTERVAL '30' DAY")
def recent_listings(df):
    return feeds.recent(df, F.when(F.col("source") == "mlh", "ended"), F.col("start_ts"), at()).select("listing_id")


@query("SELECT page_id, 'kind' AS key, CAST(page_id % 7 AS VARCHAR) AS value FROM pages UNION ALL SELECT page_id, 'og:title', concat('Page ', page_id) FROM pages")
def meta_tags(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    tags = F.concat(F.lit("<META content='"), (F.col("page_id") % 7).cast("string"), F.lit("' name=\"Kind\"><meta property=\"og:title\" content=\"Page "), F.col("page_id").cast("string"), F.lit("\"><meta name='kind' content='later'>"), F.col("html"))
    return pages.select("page_id", F.explode(text.html_meta(tags)))


# ---- runs

STATUS = "CASE WHEN run_id % 9 = 0 THEN 'skipped' WHEN run_id % 11 = 0 THEN 'running' WHEN ok THEN 'ok' ELSE 'failed' END"


@query(f"WITH r AS ({RUNS}) SELECT max(started) FILTER (WHERE s <> 'skipped') AS last_run, max(started) FILTER (WHERE s IN ('ok', 'failed', 'running')) AS last_attempt FROM (SELECT *, {STATUS} AS s FROM r)")
def last_start(spark, sf_dir):
    return stats.last_start(_runs(spark, sf_dir).withColumn("status", F.expr(STATUS)))


@query(f"WITH r AS ({RUNS}) SELECT source, date_trunc('day', started)::TIMESTAMP AS run_day, count(*) AS records, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected, round(epoch(max(started)) - epoch(min(started))) AS seconds, CASE WHEN bool_or(NOT ok) THEN 'rejected records' END AS error FROM r GROUP BY 1, 2")
def run_log(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("run_day", F.date_trunc("day", "started"))
    return enrich.run_rows(runs, ["source", "run_day"], F.col("started"), F.col("ok"))
