from datetime import datetime

import pandas as pd
import pytest
from listinglake.functions import geo, similarity, status, text
from listinglake.operators import milestones, places, search, sinks
from listinglake.sources import feeds
from pyspark.sql import functions as F


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_keys_and_slugs(spark):
    assert values(spark, ["Café & Söhne’s  Día", None, "  A--B "], text.normal_key(F.col("x"))) == ["cafe and sohnes dia", "", "a b"]
    assert values(spark, ["AI Hackathon 2026!", "???", None], text.slug(F.col("x"))) == ["ai-hackathon-2026", "hackathon", "hackathon"]
    assert values(spark, ["The Grand AI Hackathon 2026 v2"], text.bare_title(F.col("x"))) == ["ai"]


def test_urls(spark):
    assert values(spark, ["https://www.Unstop.com/O/abc/?x=1#y", "no url", None], text.url_identity(F.col("x"))) == ["unstop.com/o/abc", None, None]
    assert values(spark, ["https://a.org/p?utm_source=x&id=3&ref=z#top"], text.canonical_url(F.col("x"))) == ["https://a.org/p?id=3"]
    assert values(spark, ["https://a.org", "javascript:x", None], text.http_only(F.col("x"))) == ["https://a.org", None, None]


def test_html(spark):
    page = "<html><title> T </title><style>p{}</style><ul><li>A</li><li>B &amp; C</li></ul><script>x</script><meta property='og:title' content='M'></html>"
    assert [x.split("\n") for x in values(spark, [page], text.html_text(F.col("x")))] == [[" T A", "B & C"]] or "B & C" in values(spark, [page], text.html_text(F.col("x")))[0]
    assert values(spark, [page], text.html_meta(F.col("x"))["og:title"]) == ["M"]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Event","name":"E"},{"@type":"Org"}]}</script><script type="application/ld+json">{broken</script>'
    assert values(spark, [ld], F.get_json_object(text.json_ld_events(F.col("x"))[0], "$.name")) == ["E"]
    assert values(spark, [ld], F.size(text.json_ld_events(F.col("x")))) == [1]


def test_amounts_and_teams(spark):
    got = values(spark, ["Prize pool of ₹1,50,000", "worth $5k", "$2 million in prizes", "fee $20", "prize ₹2 lakhs"], text.prize(F.col("x")))
    assert [(float(r["amount"]), r["currency"]) if r else None for r in got] == [(150000, "INR"), (5000, "USD"), (2000000, "USD"), None, (200000, "INR")]
    got = values(spark, ["team of 2-4", "team size up to 5", "at least 3 members", "solo"], text.team_size(F.col("x")))
    assert [tuple(r) if r else None for r in got] == [(2, 4), (1, 5), (3, None), None]


@pytest.mark.parametrize(
    "said, want",
    [
        ("Registration closes on 29 Sep 2026, 11:59 PM IST", [("registration_deadline", "2026-09-29T23:59:00+05:30")]),
        ("Project submission: Sep 30, 2026 @ 11:45pm PDT", [("project_submission_deadline", "2026-09-30T23:45:00-07:00")]),
        ("Register by 28/09/2026", [("registration_deadline", "2026-09-28")]),
        ("Event dates: 7–8 October 2026", [("hackathon_start", "2026-10-07"), ("hackathon_end", "2026-10-08")]),
        ("Registration and submission deadline 1 May 2026", [("unknown", "2026-05-01")]),
        ("31 Feb 2026", []),
        ("Winners announced 2026-10-09T10:00:00+05:30", [("result_announcement", "2026-10-09T10:00:00+05:30")]),
        (None, []),
        ("", []),
    ],
)
def test_milestones(spark, said, want):
    df = spark.createDataFrame([(1, said)], "listing_id long, text string")
    got = milestones.extract_milestones(df, default_year=2026).orderBy("segment", "position", "iso").collect()
    assert [(r["kind"], r["iso"]) for r in got] == want


def test_similarity(spark):
    rows = [("Smart India Hackathon", "Smart India Hackathon 2026"), ("AI Sprint", "AI Sprint"), ("Chennai AI Sprint", "Old Classic"), ("", "x"), (None, None)]
    got = values(spark, rows, similarity.title_similarity(F.col("a"), F.col("b")), "a string, b string")
    assert got == [0.97, 1.0, 0.0, 0.0, 0.0]
    assert values(spark, [("IIT Madras", "iit madras"), ("IIT", "IIT Madras"), (None, "x")], similarity.organizer_similarity(F.col("a"), F.col("b")), "a string, b string") == [1.0, 0.8, 0.0]


def test_status_of_bare_dates(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 26), "date_only"), (datetime(2026, 9, 26), "instant"), (None, "none")], "d timestamp, p string")
    now = F.lit("2026-09-26 12:00:00").cast("timestamp")
    assert [r[0]["status"] for r in df.select(status.full_status(F.col("d"), F.col("p"), F.lit(None).cast("timestamp"), now)).collect()] == ["open", "closed", "unknown"]


def test_search_parameters():
    for bad in ({"mode": "x"}, {"sort": "x"}, {"page": 0}, {"latitude": 1.0}, {"team_size": 0}, {"latitude": 99.0, "longitude": 0.0}):
        with pytest.raises(ValueError):
            search.SearchParams(**bad)
    assert search.SearchParams(limit=1000).rows == 100 and search.SearchParams(team_size=3).team == (3, 3)


def test_radius_join_equals_brute_force(spark):
    o = [(i, -80.0 + 16 * i, -170.0 + 33 * i) for i in range(11)]
    p = [(i, (i * 37 % 170) - 85.0, (i * 53 % 350) - 175.0) for i in range(300)] + [(900, None, None)]
    origins, df = spark.createDataFrame(o, "origin_id long, origin_lat double, origin_lon double"), spark.createDataFrame(p, "listing_id long, latitude double, longitude double")
    got = {(r["origin_id"], r["listing_id"]) for r in search.radius_join(origins, df, 700.0).collect()}
    every = origins.crossJoin(df).where(geo.haversine(F.col("origin_lat"), F.col("origin_lon"), F.col("latitude"), F.col("longitude")) <= 700.0)
    assert got == {(r["origin_id"], r["listing_id"]) for r in every.collect()} and got


def test_places(spark):
    texts = spark.createDataFrame([(x,) for x in ["Chennai, Tamil Nadu, India", "Bombay", "south west mumbai", "Bangalore", "Atlantis", "", "New York, USA", "Delhi"]], "place_text string")
    got = {r["place_text"]: (r["place_key"], r["match"]) for r in places.resolve_places(texts, places.default_places(spark)).collect()}
    assert got["Chennai, Tamil Nadu, India"] == ("chennai", "exact") and got["Bombay"] == ("mumbai", "alias") and got["south west mumbai"] == ("mumbai", "alias")
    assert got["Bangalore"] == ("bengaluru", "alias") and got["Atlantis"] == (None, "unknown") and got["New York, USA"][0] == "new york" and got["Delhi"][0] == "delhi"
    keys = {r["place_key"]: r["keys"] for r in places.metro_keys(places.default_places(spark)).collect()}
    assert {"chennai", "madras", "ambattur"} <= set(keys["ambattur"]) and keys["singapore"] == ["singapore"]
    assert [r["name"] for r in places.suggest(places.default_places(spark), "mum").collect()][:2] == ["Mumbai", "Navi Mumbai"]


def test_metro_inheritance(spark):
    names = spark.createDataFrame([("Chennai Port",), ("Old Navi Mumbai",), ("Pune",), ("Nowhere",), (None,)], "name string")
    assert {r["name"]: r["metro"] for r in places.inherit_metro(names, places.default_places(spark)).collect()} == {"Chennai Port": "chennai", "Old Navi Mumbai": "mumbai"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2")], "k long, v string, first string")
    new = spark.createDataFrame([(2, None, "s9"), (3, "c", "s3")], "k long, v string, first string")
    once = sinks.merge_upsert(old, new, ["k"], keep=("first",))
    twice = sinks.merge_upsert(once, new, ["k"], keep=("first",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", "s1"), (2, None, "s2"), (3, "c", "s3")]


def test_feeds(spark):
    a = spark.read.schema(feeds.FEED_A).json(spark.sparkContext.parallelize(['{"data":{"data":[{"id":1,"title":" X ","region":"online","prizes":[{"cash":10,"currency":"INR"},{"cash":-1}],"filters":[{"name":"AI","type":"domain"}]},{"title":"none"}]}}', "{broken"]))
    (row,) = feeds.feed_a(a).collect()
    assert (row["title"], row["mode"], float(row["prize_amount"]), row["themes"]) == ("X", "online", 10.0, ["ai"])
    b = spark.read.schema(feeds.FEED_B).json(spark.sparkContext.parallelize(['{"hackathons":[{"id":7,"title":"J","url":"https://j.x.com/","displayed_location":{"location":"Online"},"prize_amount":"$<span>5,000</span>"}]}']))
    (row,) = feeds.feed_b(b).collect()
    assert (row["mode"], float(row["prize_amount"])) == ("online", 5000.0)
    c = spark.createDataFrame([('<script>{"props":{"upcomingEvents":[{"slug":"s","name":"N","startsAt":"2026-01-01","formatType":"hybrid"}]}}</script>',), ("<script>{bad}</script>",)], "html string")
    (row,) = feeds.feed_c(c).collect()
    assert (row["source_record_id"], row["mode"]) == ("s", "hybrid")
    d = spark.createDataFrame([('<div class="challenge-card"><a href="/c/1"></a><h3 class="title">Card</h3><p>Ends on: May 3</p></div>',)], "html string")
    (row,) = feeds.card_list(d).collect()
    assert (row["source_record_id"], row["title"], row["deadline_text"]) == ("/c/1", "Card", "May 3")
    merged = feeds.all_listings([feeds.feed_a(a), feeds.feed_b(b), feeds.feed_c(c), feeds.card_list(d)])
    assert merged.columns == feeds.RAW_COLUMNS and merged.count() == 4 and set(feeds.SOURCES) == {"unstop", "devpost", "mlh", "hackerearth", "organizer_website"}


def test_wall_clock(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": [pd.Timestamp("2026-09-29 18:29:00")]}))
    assert df.select(status.wall_clock(F.col("t"), F.lit(330))).first()[0] == "29 September 2026, 11:59 PM"


@pytest.mark.parametrize(
    "said, kinds",
    [
        ("Register before 5 Oct 2026", ["registration_deadline"]),
        ("Last date to register: October 5, 2026", ["registration_deadline"]),
        ("Registration opens on 1 May 2026 | registration closed 9 May 2026", ["registration_opens", "registration_deadline"]),
        ("Apply by 3 Oct 2026; application deadline 4/10/2026", ["application_deadline"] * 2),
        ("Submissions close 2026-10-06", ["project_submission_deadline"]),
        ("Final submission 6 Oct 2026", ["project_submission_deadline"]),
        ("Submission deadline 6 Oct 2026", ["submission_deadline"]),
        ("Submit your idea till 2 Oct 2026", ["idea_submission_deadline"]),
        ("Demo day 9 Oct 2026\nGrand finale 10 Oct 2026\nShortlisting 7 Oct 2026", ["final_presentation", "final_presentation", "shortlisting"]),
        ("Winners are announced 2026-10-12", ["result_announcement"]),
        ("Hackathon starts 7 Oct 2026 ... ends 8 Oct 2026", ["hackathon_start", "hackathon_end"]),
        ("29 Sep 2026 is the registration deadline", ["registration_deadline"]),
        ("Registration and application deadline 1 May 2026", ["unknown"]),
        ("Venue: Hall 12/2 on 5.10.2026", ["unknown"]),
        ("version 1.2.3 and 10-12-20-30 and 2026-13-40", []),
    ],
)
def test_labels(spark, said, kinds):
    df = spark.createDataFrame([(1, said)], "listing_id long, text string")
    assert [r["kind"] for r in milestones.extract_milestones(df, default_year=2026).orderBy("segment", "position", "iso").collect()] == kinds


def test_strict_dates(spark):
    said = ["29 Sep 2026", "Sept 29th, 2026 at 6 pm PDT", "2026-09-29T18:29:00Z", "29/09/2026 11:59 PM UTC+5:30", "09/29/26", "30 Feb 2026", "see 29 Sep 2026", "7 May", None]
    want = ["2026-09-29", "2026-09-29T18:00:00-07:00", "2026-09-29T18:29:00+00:00", "2026-09-29T23:59:00+05:30", "2026-09-29", None, None, "2026-05-07", None]
    assert values(spark, said, milestones.strict_date(F.col("x"), 2026)) == want


def test_eligibility_and_odd_amounts(spark):
    assert values(spark, ["Open to all. Eligibility: students of any year. More", "none", None], text.eligibility(F.col("x"))) == ["Eligibility: students of any year", None, None]
    got = values(spark, ["Pay €10. Cash prize of €2.5 million!", "₹1 crore for the winning team", "prizes soon", "", None], text.prize(F.col("x")))
    assert [(float(r["amount"]), r["currency"]) if r else None for r in got] == [(2_500_000, "EUR"), (10_000_000, "INR"), None, None, None]
    got = values(spark, ["Teams: 3 to 5 people", "a team of up to 4", "minimum of 2 participants", "team of 4", None], text.team_size(F.col("x")))
    assert [tuple(r) if r else None for r in got] == [(3, 5), (1, 4), (2, None), None, None]
