"""Publishers' feeds and pages as tables of raw listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglake.functions import text as tx
from listinglake.operators import milestones
from listinglake.operators.order import written

#: What every source gives; further columns are allowed.
RAW_COLUMNS = [
    "source", "source_record_id", "title", "organizer", "url", "location_text", "mode", "deadline_text", "start_text", "end_text", "prize_amount", "prize_currency", "themes",
    "description", "city", "state", "country", "opens_at", "deadline", "start", "end", "submission_deadline", "deadline_confidence", "team_size_min", "team_size_max", "eligibility",
    "technologies", "prize_details", "free_or_paid", "registration_fee", "field_conflicts", "registration_url",
]
KINDS = {
    "prize_amount": "decimal(18,2)", "registration_fee": "decimal(18,2)", "themes": "array<string>", "technologies": "array<string>", "team_size_min": "int", "team_size_max": "int",
    "field_conflicts": "array<struct<field:string,values:array<string>,resolved_from:string,note:string>>",
}

FEED_A = "data struct<data:array<struct<id:long,title:string,details:string,public_url:string,region:string,end_date:string,isPaid:boolean,organisation:struct<name:string>,regnRequirements:struct<start_regn_dt:string,end_regn_dt:string,min_team_size:int,max_team_size:int>,address_with_country_logo:struct<city:string,state:string,country:struct<name:string>>,filters:array<struct<name:string,type:string>>,required_skills:array<struct<skill:string>>,prizes:array<struct<rank:string,cash:double,currency:string>>,payment_services:array<struct<amount:double,required:boolean>>>>>, _corrupt_record string"
FEED_B = "hackathons array<struct<id:long,title:string,displayed_location:struct<icon:string,location:string>,open_state:string,url:string,submission_period_dates:string,themes:array<struct<id:long,name:string>>,prize_amount:string,organization_name:string>>, _corrupt_record string"
EVENT_C = "array<struct<id:string,slug:string,name:string,status:string,startsAt:string,endsAt:string,url:string,websiteUrl:string,formatType:string,venueAddress:struct<city:string,state:string,country:string>>>"


@dataclass(frozen=True)
class SourceSpec:
    """A publisher: how its payload is read and turned into raw listings."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    normalize: Callable[..., DataFrame]  # (payloads, year of the retrieval) -> raw listings
    enabled: bool = True
    note: str = ""


def raw(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The raw listing columns, null where a source has no value."""
    null = F.lit(None)
    return df.select(F.lit(source).alias("source"), *[columns.get(c, null).cast(KINDS.get(c, "string")).alias(c) for c in RAW_COLUMNS[1:]])


def first_dates(df: DataFrame, key: str, text_col: str, year: int | None = None) -> DataFrame:
    """df with ``said``: a map of the first date of each kind that a text names, for a key that is unique."""
    found = milestones.extract_milestones(df.select(key, text_col), key, text_col, year).where("kind != 'unknown'")
    first = found.groupBy("id", "kind").agg(F.min(F.struct("segment", "position", "iso"))["iso"].alias("iso"))
    maps = first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "iso"))).alias("said"))
    return df.join(maps, df[key] == maps["id"], "left").drop("id")


#: A table of at most so many short texts is sent to all tasks.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def window_end(df: DataFrame, key: str, text_col: str, year: int | None = None) -> DataFrame:
    """(id, submission_deadline): the last date of a range's text."""
    found = milestones.extract_milestones(df.select(key, text_col), key, text_col, year)
    return found.groupBy("id").agg(F.max(F.struct("segment", "position", "iso"))["iso"].alias("submission_deadline"))


def page_deadline(pages: DataFrame, key: str, html_col: str = "html", year: int | None = None) -> DataFrame:
    """(id, submission_deadline, confidence): the first date of a page's lines that speak of a deadline."""
    lines = F.filter(F.split(tx.html_text(F.col(html_col)), r"\v+"), lambda x: F.contains(F.lower(x), F.lit("deadline")))
    said = pages.select(key, F.array_join(lines, "\n").alias("said"))
    found = milestones.extract_milestones(said, key, "said", year)
    return found.groupBy("id").agg(F.min(F.struct("segment", "position", "iso"))["iso"].alias("submission_deadline"), F.lit("verified").alias("confidence"))


def end_conflict(structured: Column, told: Column, source: str) -> Column:
    """A conflict of the event's end where the field and the text differ by more than a day; the field is kept."""
    values = F.array(structured, told)
    one = F.struct(F.lit("hackathon_end").alias("field"), values.alias("values"), F.lit(source).alias("resolved_from"), F.lit("The field and the description name different dates.").alias("note"))
    far = F.abs(F.unix_seconds(F.try_to_timestamp(structured)) - F.unix_seconds(F.try_to_timestamp(told))) > 86_400
    return F.when(far, F.array(one))


def prize_lines(prizes: Column) -> Column:
    """Rank and amount of every prize, a part each."""
    said = lambda p: F.concat(F.coalesce(p["rank"], F.lit("Prize")), F.lit(":"), F.coalesce(F.concat(F.lit(" "), F.coalesce(p["currency"], F.lit("")), F.format_number(F.when(p["cash"] > 0, p["cash"]), 0)), F.lit("")))
    return F.nullif(F.array_join(F.transform(prizes, said), " | "), F.lit(""))


def fee_total(payments: Column) -> Column:
    """Sum of the amounts that are given; null where none is."""
    given = F.filter(F.transform(payments, lambda p: p["amount"]), lambda x: x.isNotNull())
    return F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda s, x: s + x))


def cash_prizes(prizes: Column) -> tuple[Column, Column]:
    """Sum of the positive amounts, null without any, and the first one's currency."""
    paid = F.filter(prizes, lambda p: p["cash"] > 0)
    total = F.aggregate(paid, F.lit(0.0), lambda s, p: s + p["cash"])
    return F.when(F.size(paid) > 0, total), F.get(paid, F.lit(0))["currency"]


def feed_a(df: DataFrame, year: int | None = None) -> DataFrame:
    """A row for each listing. ``year``: that of the retrieval, for dates that name none. Of a description the first 6,000 characters are kept, as in all feeds of this kind."""
    i = df.select(F.explode("data.data").alias("i")).where("i.id is not null and i.title is not null")
    i = i.withColumn("description", F.substring(tx.html_text(F.col("i.details")), 1, 6000))
    # The description names the event's days, which the payload does not. Texts repeat, and reading dates costs the most: each is read once.
    dated = ("i.end_date", "i.regnRequirements.start_regn_dt", "i.regnRequirements.end_regn_dt")
    texts = written(i.select(F.explode(F.array(*[F.struct(F.lit(c == "i.details").alias("long"), F.col(c).alias("text")) for c in ("i.details", *dated)])).alias("t")).select("t.*").where("text rlike '[0-9]'").distinct())
    long = texts.where("long").select(F.md5("text").alias("key"), F.substring(tx.html_text(F.col("text")), 1, 6000).alias("description"))
    told = written(first_dates(long, "key", "description", year).where("said is not null").select("key", "said"))
    i = i.withColumn("key", F.when(F.col("i.details").rlike("[0-9]"), F.md5("i.details"))).join(few(told), "key", "left")
    dates = written(texts.where("not long").select("text", milestones.strict_date(F.col("text"), year).alias("iso")).where("iso is not null"))
    if dates.count() <= FEW:
        for k, c in enumerate(dated):
            i = i.join(few(dates.select(F.col("text").alias(f"text_{k}"), F.col("iso").alias(f"iso_{k}"))), F.col(c) == F.col(f"text_{k}"), "left").drop(f"text_{k}")
        iso = lambda c: F.col(f"iso_{dated.index(c)}")
    else:
        iso = lambda c: milestones.strict_date(F.col(c), year)
    end, told_end = iso("i.end_date"), F.element_at("said", F.lit("hackathon_end"))
    fee = fee_total(F.col("i.payment_services"))
    of = lambda kind: F.filter("i.filters", lambda f: f["type"] == kind)
    amount, currency = cash_prizes(F.col("i.prizes"))
    spoken = tx.prize(tx.html_text(F.col("i.details")))
    place = F.concat_ws(", ", "i.address_with_country_logo.city", "i.address_with_country_logo.state", "i.address_with_country_logo.country.name")
    domains = F.array_distinct(F.transform(of("domain"), lambda f: F.lower(f["name"])))
    return raw(
        i, "unstop", source_record_id=F.col("i.id"), title=F.trim("i.title"), organizer=F.col("i.organisation.name"), url=tx.http_only(F.col("i.public_url")), location_text=place,
        mode=F.when(F.lower("i.region").isin("online", "offline", "hybrid"), F.lower("i.region")).otherwise("unknown"), deadline_text=F.col("i.regnRequirements.end_regn_dt"),
        start_text=F.col("i.regnRequirements.start_regn_dt"), end_text=F.col("i.end_date"), prize_amount=F.coalesce(amount.cast("decimal(18,2)"), spoken["amount"]),
        prize_currency=F.coalesce(currency, spoken["currency"]), themes=domains, description=F.col("description"), city=F.col("i.address_with_country_logo.city"),
        state=F.col("i.address_with_country_logo.state"), country=F.col("i.address_with_country_logo.country.name"), opens_at=iso("i.regnRequirements.start_regn_dt"),
        deadline=iso("i.regnRequirements.end_regn_dt"), start=F.element_at("said", F.lit("hackathon_start")), end=F.coalesce(end, told_end), deadline_confidence=F.when(iso("i.regnRequirements.end_regn_dt").isNotNull(), "verified"),
        team_size_min=F.col("i.regnRequirements.min_team_size"), team_size_max=F.col("i.regnRequirements.max_team_size"), eligibility=F.nullif(F.array_join(F.transform(of("eligible"), lambda f: f["name"]), ", "), F.lit("")),
        technologies=F.array_distinct(F.array_compact(F.transform("i.required_skills", lambda s: s["skill"]))), prize_details=F.coalesce(prize_lines(F.col("i.prizes")), F.when(spoken.isNotNull(), F.lit("from the description"))),
        free_or_paid=F.when(fee > 0, "paid").when(~F.col("i.isPaid"), "free").otherwise("unknown"), registration_fee=fee, field_conflicts=end_conflict(end, told_end, "unstop"),
    )


def feed_b(df: DataFrame, year: int | None = None) -> DataFrame:
    """A row for each listing; the end of its submission period is inferred to be its deadline."""
    h = df.select(F.explode("hackathons").alias("h")).where("h.id is not null and h.title is not null")
    h = h.withColumns({"key": F.col("h.id"), "span": F.col("h.submission_period_dates")})
    ends = window_end(h.select("key", "span").dropDuplicates(["key"]), "key", "span", year)
    h = h.join(ends, h["key"] == ends["id"], "left").drop("id")
    place = F.col("h.displayed_location.location")
    online = F.coalesce((F.col("h.displayed_location.icon") == "globe") | F.lower(place).rlike("online|worldwide"), F.lit(False))
    parts = F.split(place, ",")
    digits = F.regexp_extract(F.regexp_replace("h.prize_amount", "<[^>]*>", ""), r"([\d,]+(?:\.\d+)?)", 1)
    return raw(
        h, "devpost", source_record_id=F.col("h.id"), title=F.trim("h.title"), organizer=F.col("h.organization_name"), url=tx.http_only(F.col("h.url")), location_text=place,
        mode=F.when(online, "online").otherwise("offline"), deadline_text=F.col("h.submission_period_dates"), submission_deadline=F.col("submission_deadline"),
        deadline=F.col("submission_deadline"), deadline_confidence=F.when(F.col("submission_deadline").isNotNull(), "inferred"), free_or_paid=F.lit("free"),
        city=F.when(~online, F.nullif(F.trim(F.get(parts, 0)), F.lit(""))), state=F.when(~online, F.nullif(F.trim(F.array_join(F.slice(parts, 2, 9), ",")), F.lit(""))),
        prize_currency=F.element_at(tx._lookup(tx.refdata.CURRENCY_SIGNS), F.regexp_extract("h.prize_amount", "([$€£₹¥])", 1)), prize_details=F.nullif(F.trim(F.regexp_replace("h.prize_amount", "<[^>]*>", "")), F.lit("")),
        prize_amount=F.nullif(F.try_to_number(F.regexp_replace(digits, ",", ""), F.lit("999999999999.99")), F.lit(0)), themes=F.transform("h.themes", lambda t: F.lower(t["name"])),
    )


def feed_c(pages: DataFrame, year: int | None = None, html_col: str = "html") -> DataFrame:
    """Events in a script's JSON: upcoming and past ones, else the first of its lists whose items have a slug and a start. Malformed scripts give none."""
    bodies = pages.select(F.explode(F.regexp_extract_all(html_col, F.lit(r"(?is)<script[^>]*>\s*(\{.*?\})\s*</script>"), F.lit(1))).alias("body"))
    lists = [F.coalesce(F.from_json(F.get_json_object("body", f"$.props.{k}"), EVENT_C), F.array().cast(EVENT_C)) for k in ("upcomingEvents", "pastEvents")]
    named = F.concat(*lists)
    # Of other layouts every array in the props is tried.
    other = F.filter(F.transform(F.map_values(F.from_json(F.get_json_object("body", "$.props"), "map<string,string>")), lambda v: F.from_json(v, EVENT_C)), lambda v: F.exists(v, lambda x: x["slug"].isNotNull() & x["startsAt"].isNotNull()))
    e = bodies.select(F.explode(F.when(F.size(named) > 0, named).otherwise(F.coalesce(F.get(other, 0), F.array().cast(EVENT_C)))).alias("e")).where("e.slug is not null and e.startsAt is not null")
    return raw(
        e, "mlh", source_record_id=F.coalesce("e.id", "e.slug"), title=F.trim("e.name"), url=tx.http_only(F.coalesce("e.websiteUrl", "e.url")),
        location_text=F.concat_ws(", ", "e.venueAddress.city", "e.venueAddress.state", "e.venueAddress.country"),
        mode=F.when(F.lower("e.formatType").isin("digital", "online"), "online").when(F.lower("e.formatType") == "hybrid", "hybrid").otherwise("offline"), start_text=F.col("e.startsAt"), end_text=F.col("e.endsAt"),
        start=milestones.strict_date(F.col("e.startsAt"), year), end=milestones.strict_date(F.col("e.endsAt"), year), city=F.col("e.venueAddress.city"), state=F.col("e.venueAddress.state"), country=F.col("e.venueAddress.country"),
    )


def card_list(pages: DataFrame, year: int | None = None, html_col: str = "html") -> DataFrame:
    """One listing per challenge card; its deadline is typed where the text behind the label is a date."""
    cards = pages.select(F.explode(F.regexp_extract_all(html_col, F.lit(r'(?is)<div[^>]*class="[^"]*challenge-card[^"]*"[^>]*>(.*?)(?=<div[^>]*class="[^"]*challenge-card|$)'), F.lit(1))).alias("card"))
    body = tx.html_text(F.col("card"))
    link = F.regexp_extract("card", r'(?is)<a[^>]*href="([^"]+)"', 1)
    title = F.trim(tx.html_text(F.regexp_extract("card", r"(?is)<(?:h\d|span)[^>]*title[^>]*>(.*?)</(?:h\d|span)>", 1)))
    got, told = tx.prize(body), F.nullif(F.trim(F.regexp_extract(body, r"(?i)(?:ends on|closes on|deadline)\s*:?\s*([^\n]+)", 1)), F.lit(""))
    deadline = milestones.strict_date(told, year)
    return raw(
        cards.where(link != ""), "hackerearth", source_record_id=link, title=F.nullif(title, F.lit("")), url=tx.http_only(link),
        mode=F.when(F.lower(body).rlike("offline|venue"), "offline").otherwise("online"), deadline_text=told, deadline=deadline, deadline_confidence=F.when(deadline.isNotNull(), "source_confirmed"),
        prize_amount=got["amount"], prize_currency=got["currency"],
    )


def event_pages(pages: DataFrame, year: int | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Free-form pages, one for each url: the first JSON-LD event, else meta tags and headings, else what the text says under labels."""
    pages = pages.withColumns({"_key": F.coalesce(tx.url_identity(F.col(url_col)), F.col(url_col)), "_body": tx.html_text(F.col(html_col))})
    told = first_dates(pages.where("_key is not null").groupBy("_key").agg(F.min("_body").alias("_body")), "_key", "_body", year).select("_key", "said")
    pages = pages.join(told, "_key", "left")
    # Read once for all the fields that are taken from them.
    pages = pages.withColumns({"_node": F.get(tx.json_ld_events(F.col(html_col)), F.lit(0)), "_meta": tx.html_meta(F.col(html_col)), "_link": tx.registration_link(F.col(html_col))})
    node, meta = F.col("_node"), F.col("_meta")
    body = F.col("_body")
    heading = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html_col, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")), F.lit(""))
    dated = lambda p, kind: F.coalesce(milestones.strict_date(get(p), year), F.element_at("said", F.lit(kind)))
    size = tx.team_size(F.col("_body"))
    get = lambda p: F.get_json_object(node, p)
    title = F.coalesce(get("$.name"), F.element_at(meta, "og:title"), heading, tx.html_title(F.col(html_col)))
    got = tx.prize(body)
    return raw(
        pages, "organizer_website", source_record_id=F.col("_key"), title=F.trim(title), organizer=F.coalesce(get("$.organizer.name"), F.element_at(meta, "og:site_name"), F.element_at(meta, "author")), url=tx.canonical_url(F.col(url_col)),
        location_text=F.coalesce(get("$.location.name"), get("$.location.address.addressLocality")), start_text=get("$.startDate"), end_text=get("$.endDate"),
        mode=F.when(F.lower(body).rlike("\\bhybrid\\b"), "hybrid").when(F.lower(body).rlike("\\b(online|virtual)\\b"), "online").when(F.lower(body).rlike("\\b(venue|in person|on site)\\b"), "offline").otherwise("unknown"),
        deadline=F.element_at("said", F.lit("registration_deadline")), opens_at=F.element_at("said", F.lit("registration_opens")), submission_deadline=F.coalesce(F.element_at("said", F.lit("project_submission_deadline")), F.element_at("said", F.lit("submission_deadline"))),
        start=dated("$.startDate", "hackathon_start"), end=dated("$.endDate", "hackathon_end"), deadline_confidence=F.when(F.element_at("said", F.lit("registration_deadline")).isNotNull(), "source_confirmed"),
        team_size_min=size["least"], team_size_max=size["most"], eligibility=tx.eligibility(body), technologies=tx.keyword_tags(body, tx.refdata.TECH_KEYWORDS),
        prize_amount=got["amount"], prize_currency=got["currency"], themes=tx.keyword_tags(body, tx.refdata.THEME_KEYWORDS), registration_url=F.col("_link"),
    )


def _json(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


SOURCES = {
    s.name: s
    for s in (
        SourceSpec("unstop", _json(FEED_A), feed_a),
        SourceSpec("devpost", _json(FEED_B), feed_b),
        SourceSpec("mlh", _pages, feed_c),
        SourceSpec("hackerearth", _pages, card_list),
        SourceSpec("organizer_website", _pages, event_pages),
    )
}


#: Fields whose origin is told, and those of them that are read from a text rather than from a field of the payload.
TOLD = ("title", "organizer", "mode", "city", "state", "country", "opens_at", "deadline", "start", "end", "submission_deadline", "prize_amount", "eligibility", "registration_fee")
STRUCTURED = ("unstop", "devpost", "mlh")


def listing_provenance(raw_listings: DataFrame) -> DataFrame:
    """(source, source_record_id, field, value, confidence) of every non-empty field of raw listings.

    A deadline has the confidence that its feed gives it. Other fields are "verified" where the publisher's payload has them as fields, and
    "source_confirmed" where they are read from a page; a start is always read from text but in feeds that name it, an end
    in conflict is "partially_verified".
    """
    fields = [F.col(c).cast("string").alias(c) for c in TOLD]
    clash = F.coalesce(F.exists("field_conflicts", lambda c: c["field"] == "hackathon_end"), F.lit(False)).alias("_clash")
    wide = raw_listings.select("source", "source_record_id", F.coalesce("deadline_confidence", F.lit("unknown")).alias("_sure"), clash, F.col("start_text").isNotNull().alias("_dated"), *fields)
    long = wide.unpivot(["source", "source_record_id", "_sure", "_clash", "_dated"], [*TOLD], "field", "value").where("value is not null and value != ''")
    by_page = ~F.col("source").isin(*STRUCTURED) | ((F.col("field") == "start") & ((F.col("source") == "unstop") | ~F.col("_dated")))
    confidence = F.when(F.col("field").isin("deadline", "submission_deadline"), F.col("_sure")).when((F.col("field") == "end") & F.col("_clash"), "partially_verified").when(by_page, "source_confirmed").otherwise("verified")
    return long.select("source", "source_record_id", "field", "value", confidence.alias("confidence"))


def all_listings(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def once_each(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each (source, source_record_id)."""
    n = F.row_number().over(Window.partitionBy("source", "source_record_id").orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def recent(df: DataFrame, status: Column, end: Column, now: Column, days: int = 30) -> DataFrame:
    """Ended listings go once their end is older than ``days``; without a readable end they stay."""
    fresh = F.coalesce(end > now - F.expr(f"INTERVAL '{days}' DAY"), F.lit(True))
    return df.where((status != "ended") | status.isNull() | fresh)
