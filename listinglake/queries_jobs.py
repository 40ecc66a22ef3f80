"""Registered queries of whole jobs: crawls in turn, slugs beside taken ones, runs, gates, links and pages, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglake import refdata
from listinglake.functions import text
from listinglake.operators import crawl, facets, merge, sinks, stats
from listinglake.operators.order import written
from listinglake.plans.listings import listings, tables
from listinglake.queries import CTE, EVENT, FOUND, PAIRS, SCORED, URL_ID, _events, nk, over_listings, query
from listinglake.sources import feeds

RECURSIVE = CTE.replace("WITH", "WITH RECURSIVE", 1)

# ---- slugs


def slugs_sql(name: str, rows: str, taken: str = "SELECT NULL AS slug WHERE false") -> str:
    """CTEs that end in ``name`` (id, slug) for rows (id, base), of which no slug is among the taken ones."""
    return f"""{name}_s AS ({rows}), {name}_o AS (SELECT DISTINCT slug FROM ({taken}) WHERE slug IS NOT NULL), {name}_u AS (SELECT base AS slug FROM {name}_s UNION SELECT slug FROM {name}_o),
    {name}_p AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 2 + CASE WHEN base IN (SELECT slug FROM {name}_o) THEN 1 ELSE 0 END AS place FROM {name}_s),
    {name}_t AS (SELECT regexp_replace(slug, '-[0-9]+$', '') AS base, CAST(regexp_extract(slug, '-([1-9][0-9]*)$', 1) AS BIGINT) AS t FROM {name}_u WHERE regexp_matches(slug, '-[1-9][0-9]{{0,17}}$')),
    {name}_g AS (SELECT base, t - 1 - row_number() OVER (PARTITION BY base ORDER BY t) AS gap FROM {name}_t WHERE t >= 2),
    {name} AS (SELECT id, CASE WHEN place < 0 THEN base ELSE concat(base, '-', place + 2 + (SELECT count(*) FROM {name}_g g WHERE g.base = p.base AND g.gap <= p.place)) END AS slug FROM {name}_p p)"""


def base_sql(text: str) -> str:
    return f"CASE WHEN {nk(text)} = '' THEN 'hackathon' ELSE substr(replace({nk(text)}, ' ', '-'), 1, 70) END"


FOUND["unique_slug"] = (FOUND["unique_slug"][0], f"{CTE}, {slugs_sql('x', f'SELECT listing_id AS id, {base_sql("title")} AS base FROM L')} SELECT id AS listing_id, slug FROM x")

TAKEN = "SELECT concat('nation-', s_suppkey) AS slug FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'nation' UNION ALL SELECT 'nation-7'"
CROWD = "CASE WHEN listing_id % 3 = 0 THEN 'nation' WHEN listing_id % 3 = 1 THEN replace(city_key, '_', '-') ELSE concat('nation-', listing_id % 90) END"


@query(f"{CTE}, {slugs_sql('x', f'SELECT listing_id AS id, {CROWD} AS base FROM L', TAKEN)} SELECT id AS listing_id, slug FROM x")
def slugs_beside_taken(spark, sf_dir):
    """A third of all rows share one base, of which every second number is taken by old slugs and further ones by other rows' bases."""
    supplier, df = tables(spark, sf_dir, "supplier")[0], listings(spark, sf_dir)
    taken = supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("nation-"), F.col("s_suppkey").cast("string")).alias("slug"))
    taken = taken.union(spark.range(1).select(F.explode(F.array(F.lit("nation"), F.lit("nation-7")))))
    third = F.col("listing_id") % 3
    base = F.when(third == 0, "nation").when(third == 1, F.col("city_key")).otherwise(F.concat(F.lit("nation-"), (F.col("listing_id") % 90).cast("string")))
    return merge.unique_slugs(df, "listing_id", base, taken).withColumnRenamed("id", "listing_id")


# ---- crawls


def closure(name: str, nodes: str, edges: str) -> str:
    """(id, g): of every node the ids that edges lead to; the least g is its component."""
    return f"{name} AS ({nodes} UNION SELECT y, g FROM {name} JOIN (SELECT a AS x, b AS y FROM {edges} UNION ALL SELECT b, a FROM {edges}) ON x = id)"


EDGES = f"{PAIRS}, {SCORED}, e AS (SELECT a, b FROM pts WHERE points >= 75)"
FOUND["duplicate_groups"] = (FOUND["duplicate_groups"][0], f"{RECURSIVE}, {EDGES}, {closure('r', 'SELECT listing_id AS id, listing_id AS g FROM L', 'e')} SELECT id, min(g) AS group_id FROM r GROUP BY id")

TITLE = base_sql("arg_min(title, listing_id)")


@query(f"""{RECURSIVE}, {EDGES}, e1 AS (SELECT a, b FROM e WHERE a % 3 <> 0 AND b % 3 <> 0),
{closure("r1", "SELECT listing_id AS id, listing_id AS g FROM L WHERE listing_id % 3 <> 0", "e1")}, {closure("r2", "SELECT listing_id AS id, listing_id AS g FROM L", "e")},
c1 AS (SELECT id, min(g) AS old FROM r1 GROUP BY id), c2 AS (SELECT id, min(g) AS g FROM r2 GROUP BY id),
c AS (SELECT id AS listing_id, old, coalesce(min(old) OVER (PARTITION BY g), min(id) OVER (PARTITION BY g)) AS event_id, min(old) OVER (PARTITION BY g) IS NULL AS founded FROM c2 LEFT JOIN c1 USING (id)),
{slugs_sql("first", f"SELECT old AS id, {TITLE} AS base FROM c JOIN L USING (listing_id) WHERE old IS NOT NULL GROUP BY old")},
{slugs_sql("second", f"SELECT event_id AS id, {TITLE} AS base FROM c JOIN L USING (listing_id) WHERE founded GROUP BY event_id", "SELECT slug FROM first")}
SELECT listing_id, event_id, CASE WHEN old IS NULL THEN 'inserted' WHEN listing_id % 15 = 1 THEN 'updated' WHEN old <> event_id THEN 'merged' ELSE 'kept' END AS action, slug
FROM c JOIN (SELECT * FROM first UNION ALL SELECT * FROM second) s ON s.id = event_id""")
def two_crawls(spark, sf_dir):
    """Two thirds of the listings, then the others together with some that are known: every listing's event, what the second crawl did and the event's slug."""
    df = listings(spark, sf_dir)
    one = written(crawl.merge_crawl(None, df.where("listing_id % 3 != 0")))
    two = crawl.merge_crawl(one, df.where("listing_id % 3 = 0 or listing_id % 15 = 1"))
    two = written(two)
    slugs = crawl.event_slugs(two, crawl.event_slugs(one))
    return two.join(slugs, "event_id").select("listing_id", "event_id", "action", "slug")



# ---- gates and runs

FOUND["interval_gate"] = (
    FOUND["interval_gate"][0],
    """WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    u AS (SELECT user_id, ts AS t, ts AS own, CAST(NULL AS TIMESTAMP) AS asks FROM e UNION ALL SELECT user_id, ts + INTERVAL 1 HOUR, NULL, ts FROM e),
    n AS (SELECT user_id, asks AS ts, next_ts FROM (SELECT *, min(own) OVER (PARTITION BY user_id ORDER BY t, asks IS NULL ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_ts FROM u) WHERE asks IS NOT NULL AND next_ts IS NOT NULL),
    g AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT n.user_id, next_ts FROM g JOIN n ON n.user_id = g.user_id AND n.ts = g.ts)
    SELECT e.user_id, e.ts, e.event_id FROM e JOIN g ON e.user_id = g.user_id AND e.ts = g.ts""",
)


@query("""WITH r AS (SELECT user_id % 5 AS source, ts AS logged, event_id AS entry, event_type IN ('view', 'click') AS starts, CASE WHEN event_type = 'error' THEN concat('exit ', event_id % 3) END AS error, value FROM events WHERE event_type <> 'signup'),
n AS (SELECT *, count(*) FILTER (WHERE starts) OVER (PARTITION BY source ORDER BY logged, entry) AS run FROM r),
g AS (SELECT source, run, min(logged) FILTER (WHERE starts) AS started, min(logged) FILTER (WHERE NOT starts) AS finished, arg_min(coalesce(error, ''), row(logged, entry)) FILTER (WHERE NOT starts) AS error, arg_min(value, row(logged, entry)) FILTER (WHERE NOT starts) AS records FROM n WHERE run > 0 GROUP BY ALL)
SELECT CAST(source AS BIGINT) AS source, run, started, finished, epoch_us(finished) / 1e6 - epoch_us(started) / 1e6 AS seconds, nullif(error, '') AS error, records,
 CASE WHEN finished IS NULL THEN CASE WHEN run = max(run) OVER (PARTITION BY source) THEN 'running' ELSE 'interrupted' END WHEN error = '' THEN 'ok' ELSE 'failed' END AS status FROM g""".replace("epoch_us(finished) / 1e6 - epoch_us(started) / 1e6", "(epoch_us(finished) - epoch_us(started)) / 1e6"))
def paired_runs(spark, sf_dir):
    """Runs by their start and finish rows: how long they took, what failed them, which were interrupted and which still run."""
    (events,) = tables(spark, sf_dir, "events")
    log = events.where("event_type != 'signup'").select(
        (F.col("user_id") % 5).alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("entry"), F.when(F.col("event_type").isin("view", "click"), "start").otherwise("finish").alias("kind"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("exit "), (F.col("event_id") % 3).cast("string"))).alias("error"), F.col("value").alias("records"),
    )
    return stats.paired_runs(log, ("records",))


# ---- spans


@query("""WITH s AS (SELECT l_orderkey, l_partkey % 40 AS s, CAST(l_quantity AS INTEGER) % 9 AS l, l_linenumber AS n FROM lineitem),
o AS (SELECT l_orderkey, list({'s': s, 'e': s + l, 'k': CAST(n AS VARCHAR)} ORDER BY s, -l, n) FILTER (WHERE l > 0) AS spans FROM s GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(list_reduce(list_concat([{'s': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'k': ''}], spans), lambda a, x: CASE WHEN x.s >= a.e THEN {'s': x.s, 'e': x.e, 'k': concat(a.k, ',', x.k)} ELSE a END).k, '') AS picked FROM o""")
def span_picks(spark, sf_dir):
    """Of an order's overlapping spans those that a pass from left to right keeps."""
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    span = F.struct((F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_quantity").cast("int") % 9).alias("length"), F.col("l_linenumber").alias("n"))
    picked = text.picked_spans(F.col("spans"))
    held = lineitem.groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    return held.select("l_orderkey", F.array_join(F.transform(picked, lambda x: F.concat(F.lit(","), x["n"].cast("string"))), "").alias("picked"))


# ---- pages

PIECES = "regexp_extract_all(coalesce(html, ''), '" + text.piece_pattern("").replace("'", "''") + "', 0)"
_shown = f"array_to_string(list_transform({PIECES}, lambda x: CASE WHEN NOT starts_with(x, '<') OR x = '<' THEN x WHEN regexp_matches(x, '{text.LINE_END}') THEN chr(10) ELSE '' END), '')"
for _entity, _char in text.ENTITIES:
    _shown = f"replace({_shown}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
BODY = rf"trim(regexp_replace(regexp_replace({_shown}, '[ \t\x{{00a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"
FOUND["html_text"] = (FOUND["html_text"][0], f"SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {BODY} AS t FROM pages)")


def _attribute(tag: str, names: str) -> str:
    quoted = rf"""regexp_extract({tag}, '(?is)[\s"''/](?:{names})\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return f"""regexp_replace({quoted}, '^["'']|["'']$', '', 'g')"""


FOUND["html_meta"] = (
    FOUND["html_meta"][0],
    rf"""WITH m AS (SELECT page_id, unnest(list_filter({PIECES}, lambda x: regexp_matches(x, '(?i)^<meta\b'))) AS tag FROM pages), k AS (SELECT page_id, row_number() OVER () AS n, lower({_attribute("tag", "name|property|itemprop")}) AS key, {_attribute("tag", "content")} AS value FROM m)
    SELECT page_id, key, arg_min(value, n) AS value FROM k WHERE key <> '' GROUP BY page_id, key""",
)
HEADING = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '')"
MODE = r"CASE WHEN regexp_matches(lower(t), '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches(lower(t), '\b(online|virtual)\b') THEN 'online' WHEN regexp_matches(lower(t), '\b(venue|in person|on site)\b') THEN 'offline' ELSE 'unknown' END"
FOUND["event_pages"] = (
    FOUND["event_pages"][0],
    f"""SELECT coalesce(CASE WHEN length({URL_ID}) >= 9 THEN {URL_ID} END, url) AS source_record_id, trim(coalesce({HEADING}, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''))) AS title, canonical AS url, {MODE} AS mode
    FROM (SELECT *, {BODY} AS t FROM pages) p JOIN ({FOUND["canonical_url"][1]}) c USING (page_id)""",
)


# ---- sinks

LINK = "source, source_record_id, title, mode, deadline_ts, last_verified_at AS retrieved_at, listing_id % 7 AS first_seen"


@query(f"""{CTE}, o AS (SELECT {LINK} FROM L WHERE listing_id % 3 <> 0), n AS (SELECT source, source_record_id, concat(title, ' II') AS title, mode, deadline_ts + INTERVAL 1 DAY AS deadline_ts, last_verified_at + INTERVAL 2 DAY AS retrieved_at, listing_id % 5 AS first_seen FROM L WHERE listing_id % 2 = 0)
SELECT source, source_record_id, coalesce(n.title, o.title) AS title, coalesce(n.mode, o.mode) AS mode, CASE WHEN n.source IS NULL THEN o.deadline_ts ELSE n.deadline_ts END AS deadline_ts, coalesce(n.retrieved_at, o.retrieved_at) AS retrieved_at,
  CASE WHEN o.source IS NULL THEN n.first_seen ELSE o.first_seen END AS first_seen FROM o FULL OUTER JOIN n USING (source, source_record_id)""".replace("WHEN n.source IS NULL", "WHEN n.title IS NULL").replace("WHEN o.source IS NULL", "WHEN o.title IS NULL"))
def upsert_links(spark, sf_dir):
    """Listing links with a list of columns that a new retrieval refreshes, nulls included, and one that stays."""
    df = listings(spark, sf_dir).withColumn("retrieved_at", F.col("last_verified_at"))
    columns = ["source", "source_record_id", "title", "mode", "deadline_ts", "retrieved_at"]
    old = df.where("listing_id % 3 != 0").select(*columns, (F.col("listing_id") % 7).alias("first_seen"))
    later = df.withColumns({"title": F.concat("title", F.lit(" II")), "deadline_ts": F.col("deadline_ts") + F.expr("INTERVAL 1 DAY"), "retrieved_at": F.col("retrieved_at") + F.expr("INTERVAL 2 DAY")})
    new = later.where("listing_id % 2 = 0").select(*columns, (F.col("listing_id") % 5).alias("first_seen"))
    return sinks.merge_upsert(old, new, ["source", "source_record_id"], keep=("first_seen",))


@query("""SELECT coalesce(n.s_suppkey, o.s_suppkey) AS place_key, coalesce(n.s_name, o.s_name) AS name, CASE WHEN n.s_suppkey IS NOT NULL THEN n.nation ELSE o.nation END AS nation FROM (SELECT s_suppkey, s_name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 3 <> 0) o
  FULL OUTER JOIN (SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey + 1 END AS nation FROM supplier WHERE s_suppkey % 2 = 0) n ON n.s_suppkey = o.s_suppkey""")
def seed_registry(spark, sf_dir):
    """The registry seeded again: every column of a seeded place is the seed's, also where that is null."""
    place = tables(spark, sf_dir, "supplier")[0].select(F.col("s_suppkey").alias("place_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    seed = place.where("place_key % 2 = 0").select("place_key", F.upper("name").alias("name"), F.when(F.col("place_key") % 4 != 0, F.col("nation") + 1).alias("nation"))
    return sinks.merge_upsert(place.where("place_key % 3 != 0"), seed, ["place_key"])


@query("""WITH c AS (SELECT c_name AS key, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey * 1.5 END AS latitude, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey * 2.5 END AS longitude, c_custkey % 10 <> 0 AS found FROM customer WHERE c_custkey % 2 = 0),
a AS (SELECT c_name AS key, max(CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey * 1.25 END) AS latitude, max(CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey * 2.25 END) AS longitude FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_name)
SELECT key, CASE WHEN a.latitude IS NOT NULL THEN a.latitude ELSE c.latitude END AS latitude, CASE WHEN a.latitude IS NOT NULL THEN a.longitude ELSE c.longitude END AS longitude, coalesce(a.latitude IS NOT NULL OR c.found, false) AS found FROM c FULL OUTER JOIN a USING (key)""")
def geocode_cache(spark, sf_dir):
    """Answers of a geocoder put into its cache; half of them repeated by an empty one, some empty alone."""
    customer = tables(spark, sf_dir, "customer")[0].withColumnRenamed("c_name", "key")
    at = lambda known, la, lo: {"latitude": F.when(known, F.col("c_nationkey") * la).cast("double"), "longitude": F.when(known, F.col("c_nationkey") * lo).cast("double")}
    known, answered = F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 9 != 0
    cache = customer.where("c_custkey % 2 = 0").withColumns(at(known, 1.5, 2.5)).select("key", "latitude", "longitude", known.alias("found"))
    asked = customer.where("c_custkey % 3 = 0")
    answers = asked.withColumns(at(answered, 1.25, 2.25)).select("key", "latitude", "longitude")
    return sinks.geocode_cache(cache, answers.union(asked.withColumns(at(F.lit(False), 0.0, 0.0)).select("key", "latitude", "longitude")))


@query(f"""{CTE}, p AS (SELECT {EVENT} AS event_id, 'mode' AS field, max(mode) AS value, source, 'verified' AS confidence FROM L WHERE listing_id % 3 = 0 GROUP BY {EVENT}, source), t AS (SELECT {EVENT} AS event_id, 'title' AS field, min(title) AS value, source, 'source_confirmed' AS confidence FROM L GROUP BY {EVENT}, source)
SELECT * FROM p UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.event_id = t.event_id AND p.source = t.source)""")
def default_provenance(spark, sf_dir):
    """A title row for every event and source without provenance."""
    df = _events(spark, sf_dir)
    rows = df.where("listing_id % 3 = 0").groupBy("event_id", "source").agg(F.max("mode").alias("value"))
    held = rows.select("event_id", F.lit("mode").alias("field"), "value", "source", F.lit("verified").alias("confidence"))
    return sinks.provenance_or_title(held, df.select("event_id", "source", "title"))


@over_listings("SELECT max(last_verified_at) AS last_verified, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM L")
def freshness_line(df):
    return facets.freshness_line(df).withColumn("sources", F.array_join("sources", ","))


# ---- places

_known = ", ".join(f"({k}, '{p[0]}', {'NULL' if p[3] is None else repr(p[3])})" for k, p in enumerate(refdata.PLACES))
FOUND["place_resolution"] = (
    FOUND["place_resolution"][0],
    f"""WITH p(k, name, metro) AS (VALUES {_known}), c AS (SELECT c_custkey % 3 AS n, n_name, name, metro FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN p ON k = c_custkey % {len(refdata.PLACES)})
    SELECT DISTINCT CASE n WHEN 0 THEN concat(name, ' urban district') WHEN 1 THEN concat(name, ', India') ELSE n_name END AS place_text, CASE WHEN n < 2 THEN lower(name) END AS place_key, CASE WHEN n < 2 THEN metro END AS metro,
     CASE n WHEN 0 THEN 'alias' WHEN 1 THEN 'exact' ELSE 'unknown' END AS match FROM c""",
)


# ---- feeds


def _payloads(spark, sf_dir):
    """Payloads of the first feed's shape: a page for each customer, a listing for each order, a prize for each line."""
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    key, day = F.col("o_orderkey"), lambda n: F.date_add(F.col("o_orderdate").cast("date"), n)
    prizes = lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("rank"), (F.col("l_linenumber") % 3 * 100).cast("double").alias("cash"), F.lit("INR").alias("currency"))).alias("prizes"))
    told = F.when(key % 2 == 0, F.concat(F.lit("<p>Hackathon ends on "), F.date_format(day(F.lit(6)), "d MMMM yyyy"), F.lit("</p>"))).otherwise("<p>Soon</p>")
    named = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"))
    item = F.struct(
        key.alias("id"), F.when(key % 11 != 0, F.concat(F.lit(" Event "), key.cast("string"))).alias("title"), told.alias("details"), F.concat(F.lit("https://e.example/"), key.cast("string")).alias("public_url"),
        F.element_at(F.array(F.lit("online"), F.lit("Offline"), F.lit("moon")), (key % 3 + 1).cast("int")).alias("region"), F.when(key % 5 != 0, F.date_format(day((key % 4 + 5).cast("int")), "yyyy-MM-dd")).alias("end_date"), (key % 2 == 1).alias("isPaid"),
        F.struct(F.lit("Org").alias("name")).alias("organisation"),
        F.struct(F.date_format(day(F.lit(-9)), "d MMM yyyy").alias("start_regn_dt"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:00+05:30")).alias("end_regn_dt"), (key % 3 + 1).cast("int").alias("min_team_size"), F.lit(5).alias("max_team_size")).alias("regnRequirements"),
        F.struct(F.concat(F.lit("City "), (key % 7).cast("string")).alias("city"), F.lit("State").alias("state"), F.struct(F.lit("Land").alias("name")).alias("country")).alias("address_with_country_logo"),
        F.array(named("Students", "eligible"), named("AI", "domain"), named("ai", "domain"), named("Graduates", "eligible")).alias("filters"), F.array(F.struct(F.lit("Python").alias("skill")), F.struct(F.lit("Python").alias("skill")), F.struct(F.lit(None).cast("string").alias("skill"))).alias("required_skills"),
        F.coalesce("prizes", F.array().cast("array<struct<rank:string,cash:double,currency:string>>")).alias("prizes"),
        F.when(key % 4 != 0, F.array(F.struct((key % 4 * 10).cast("double").alias("amount"), F.lit(True).alias("required")), F.struct(F.lit(None).cast("double").alias("amount"), F.lit(False).alias("required")))).otherwise(F.array(F.struct(F.lit(None).cast("double").alias("amount"), F.lit(False).alias("required")))).alias("payment_services"),
    )
    each = orders.join(prizes, key == F.col("l_orderkey"), "left").select("o_custkey", item.alias("i"))
    return each.groupBy("o_custkey").agg(F.collect_list("i").alias("data")).select(F.struct("data").alias("data"))


FEED = """p AS (SELECT l_orderkey, sum(l_linenumber % 3 * 100) AS prize FROM lineitem GROUP BY l_orderkey),
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, concat('Event ', o_orderkey) AS title, CASE o_orderkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'unknown' END AS mode, strftime(o_orderdate - INTERVAL 9 DAY, '%Y-%m-%d') AS opens_at,
 concat(strftime(o_orderdate, '%Y-%m-%d'), 'T23:59:00+05:30') AS deadline, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + to_days(CAST(o_orderkey % 4 + 5 AS INTEGER)), '%Y-%m-%d') WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') END AS "end",
 o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AND abs(o_orderkey % 4 - 1) > 1 AS clash, CASE WHEN prize > 0 THEN CAST(prize AS DECIMAL(18,2)) END AS prize_amount, CASE WHEN prize > 0 THEN 'INR' END AS prize_currency, 'ai' AS themes, 'Python' AS technologies, 'Students, Graduates' AS eligibility,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 4 * 10 AS DECIMAL(18,2)) END AS registration_fee, CASE WHEN o_orderkey % 4 <> 0 THEN 'paid' WHEN o_orderkey % 2 = 0 THEN 'free' ELSE 'unknown' END AS free_or_paid, CAST(o_orderkey % 3 + 1 AS INTEGER) AS team_size_min,
 concat('City ', o_orderkey % 7) AS city, 'State' AS state, 'Land' AS country, 'Org' AS organizer FROM orders LEFT JOIN p ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0)"""


@query(f"WITH {FEED} SELECT * FROM f")
def feed_rows(spark, sf_dir):
    """Raw listings of a nested feed: typed dates, prize and fee sums, filters by kind, an end that field and text name differently."""
    rows = feeds.feed_a(_payloads(spark, sf_dir), 1998)
    said = ["source_record_id", "title", "mode", "opens_at", "deadline", "end", "prize_amount", "prize_currency", "eligibility", "registration_fee", "free_or_paid", "team_size_min", "city", "state", "country", "organizer"]
    return rows.select(*said, F.coalesce(F.size("field_conflicts") > 0, F.lit(False)).alias("clash"), F.array_join("themes", ",").alias("themes"), F.array_join("technologies", ",").alias("technologies"))


TOLD = " UNION ALL ".join(
    f"""SELECT source_record_id, '{c}' AS field, CAST("{c}" AS VARCHAR) AS value, {"CASE WHEN clash THEN 'partially_verified' ELSE 'verified' END" if c == "end" else "'verified'"} AS confidence FROM f WHERE "{c}" IS NOT NULL"""
    for c in feeds.TOLD
    if c not in ("start", "submission_deadline")
)


@query(f"WITH {FEED} SELECT 'unstop' AS source, * FROM ({TOLD})")
def feed_provenance(spark, sf_dir):
    """Where every field of the feed's listings comes from, and how sure it is."""
    return feeds.listing_provenance(feeds.feed_a(_payloads(spark, sf_dir), 1998))
