"""The page scanner against html.parser, links, meta tags and JSON-LD graphs; dates without a year; label cases; cleaned JSON; span passes; run logs; links of events."""

import json
import random
from datetime import datetime, timedelta
from html.parser import HTMLParser

import pytest
from listinglake.functions import text
from listinglake.operators import links, milestones, stats
from listinglake.sources import feeds
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


class Plain(HTMLParser):
    """Visible text as a parser tells it."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.hidden += [tag] if tag == self.hidden[0] else []
        elif tag in text.HIDDEN:
            self.hidden.append(tag)
        elif tag in ("br", "hr"):
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if not self.hidden and tag in ("br", "hr"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.clear()
        elif tag in text.LINE_ENDS:
            self.out.append("\n")

    def handle_data(self, data):
        self.out += [] if self.hidden else [data]

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain_text(html):
    parser = Plain()
    parser.feed(html or "")
    parser.close()
    t = "".join(parser.out)
    for entity, char in text.ENTITIES:
        t = t.replace(entity, char)
    t = "".join(" " if c in "\t " else c for c in t)
    while "  " in t:
        t = t.replace("  ", " ")
    while "\n\n\n" in t:
        t = t.replace("\n\n\n", "\n\n")
    return t.strip(" ")


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


TRICKY = [
    '<p title="a > b">one</p><p>two</p>', "<p title='</p>'>x</p>y", "<!-- <p>no</p> <script> -->shown<b>!</b>", '<script>var t="</p>"; if (a<b) x("<div>")</script>after', "<style>p>a{}</style>z",
    "a &amp;lt; b &lt;p&gt; &copy;", "<h1 class=x>T</h1>\n\n\n\n<ul><li>1<li>2</li></ul>", "line<br>line<BR/>line<br class='c'>x<hr>y", "<noscript><p>no</p></noscript><svg><text>no</text></svg>ok", "", None, "plain", "<!DOCTYPE html><html><body>b</body></html>",
    "<script type='a>b'>x<p></script>t", "tab\there  and", "<!-- open -- still --> <td>c</td><th>d</th>", '<a href="x?a=1&b=2">l</a>',
]


def test_text_equals_a_parser(spark, sf_dir):
    rng = random.Random(1)
    bits = ["<p>", "</p>", "word ", '<b a="x>y">', "</b>", "<!-- <p> -->", "<br>", "&amp;", "<div\nid='a>'>", "</div>", "<script>a<b</script>", "<style>q</style>", "\n", "  "]
    pages = TRICKY + ["".join(rng.choice(bits) for _ in range(40)) for _ in range(60)] + ["<p a='" + "x" * 200_000 + ">'>long</p>" + "w " * 300_000, "<i>" * 50_000]
    pages += [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert values(spark, pages, text.html_text(F.col("x"))) == [plain_text(p) for p in pages]


def test_meta_links_and_graphs(spark):
    graph = {"@context": "x", "@graph": [{"@type": "WebPage"}, {"@graph": [{"@type": ["Thing", "Event"], "name": "deep"}]}, [{"@type": "Event", "name": "listed"}]]}
    page = f"""<!-- <meta name="a" content="no"> --><meta content="it's" name="A"><meta property=og:title content='say "x"'><meta name="a" content="later">
      <script>var a='<a href="/register">';</script><a href="/about" title="a > b">About us</a><a class=x href='/go?id=1'>Sign <b>up</b> now</a>
      <script type="application/ld+json">{json.dumps(graph)}</script><script type="application/ld+json">[{{"@type":"Event","name":"first"}}]</script><script type="application/ld+json">{{bad</script>"""
    assert values(spark, [page], text.html_meta(F.col("x"))) == [{"a": "it's", "og:title": 'say "x"'}]
    assert values(spark, [page, '<base href="https://b.org/"><a href="/x">x</a>', "none", None], text.registration_link(F.col("x"))) == ["/go?id=1", "https://b.org/", None, None]
    (found,) = values(spark, [page], text.json_ld_events(F.col("x")))
    assert sorted(json.loads(n)["name"] for n in found) == ["deep", "first", "listed"]
    row = feeds.event_pages(spark.createDataFrame([("https://www.e.org/event/1", page)], "url string, html string"), 2026).first()
    assert row["registration_url"] == "/go?id=1" and row["source_record_id"] == "e.org/event/1"


def test_dates_without_a_year(spark):
    said = "Registration deadline: 5 March"
    one = spark.createDataFrame([(1, said)], "listing_id long, text string")
    assert milestones.extract_milestones(one).count() == 0
    assert [r["iso"] for r in milestones.extract_milestones(one, default_year=2026).collect()] == ["2026-03-05"]
    cards = spark.createDataFrame([('<div class="challenge-card"><a href="/c/1"></a><h3 class="title">Card</h3><p>Ends on: May 3</p></div>',)], "html string")
    assert [feeds.card_list(cards, y).first()["deadline"] for y in (None, 2027)] == [None, "2027-05-03"]


LABELS = {
    "Registration Deadline -> 29 Sep 2026, 11:59 PM IST": "registration_deadline", "PPT Submission -> 5 Oct 2026": "project_submission_deadline", "Offline Round -> 24 Oct 2026": "unknown",
    "Final round 24 Oct 2026": "final_presentation", "Final presentation: 24 Oct 2026": "final_presentation", "Source code submission closes 5 Oct 2026": "project_submission_deadline",
    "Idea submission deadline 5 Oct 2026": "idea_submission_deadline", "Results announced 5 Oct 2026": "result_announcement", "Application deadline 5 Oct 2026": "application_deadline",
    "Hackathon registration closes 5 Oct 2026": "registration_deadline", "Registration is open; the hackathon starts 5 Oct 2026": "hackathon_start", "Date: 5 Oct 2026": "unknown",
    "Submit your great idea before 5 Oct 2026": "idea_submission_deadline", "Short-listing 5 Oct 2026": "shortlisting", "Sign-up closes 5 Oct 2026": "registration_deadline", "The contest concludes 5 Oct 2026": "hackathon_end",
    "Event dates: 30 Sep - 2 Oct 2026": "unknown", "Upload of slides 5 Oct 2026": "project_submission_deadline", "From 5 Oct 2026": "hackathon_start",
}


def test_labels_by_thing_and_phase(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LABELS)], "listing_id long, text string")
    got = {r["id"]: r["kind"] for r in milestones.extract_milestones(df, default_year=2026).where("iso like '%2026-%' and (raw not like '30 Sep%')").collect()}
    assert [got[i] for i in range(len(LABELS))] == [*LABELS.values()]


def test_cleaned_json_keeps_what_is_spelled_out(spark):
    for said, kept in (("a\x00b", "ab"), ("a\\u0000b", "a\\u0000b"), ("a\\\x00b", "a\\b"), ("\\\\u0000", "\\\\u0000"), ("", "")):
        (out,) = values(spark, [said], text.clean_json(F.struct(F.col("x").alias("t"))))
        assert json.loads(out) == {"t": kept}


@pytest.mark.parametrize("seed", range(3))
def test_span_pass(spark, seed):
    rng = random.Random(seed)
    rows = [[(rng.randrange(30), rng.randrange(0, 9), rng.randrange(5)) for _ in range(rng.choice([0, 1, 12]))] for _ in range(40)] + [None]

    def plain(spans):
        out, end = [], -1
        for s in sorted(((a, n, k) for a, n, k in spans if n > 0), key=lambda s: (s[0], -s[1], s[2])):
            if s[0] >= end:
                out.append(s)
                end = s[0] + s[1]
        return out

    got = values(spark, rows, text.picked_spans(F.col("x")), "x array<struct<start:int,length:int,k:int>>")
    assert [None if g is None else [tuple(s) for s in g] for g in got] == [None if r is None else plain(r) for r in rows]


def test_runs_are_paired(spark):
    t = lambda m: T0 + timedelta(minutes=m)
    rows = [("a", t(0), 1, "finish", None, 9), ("a", t(1), 2, "start", None, None), ("a", t(4), 3, "finish", None, 5), ("a", t(5), 4, "finish", "late", 6), ("a", t(6), 5, "start", None, None),
            ("a", t(7), 6, "start", None, None), ("a", t(9), 7, "finish", "boom", 0), ("b", t(3), 8, "start", None, None), (None, t(3), 9, "start", None, None), ("a", t(7), 10, "finish", None, 1)]
    log = spark.createDataFrame(rows, "source string, at timestamp, entry long, kind string, error string, records long").repartition(4)
    got = {(r["source"], r["run"]): (r["seconds"], r["status"], r["error"], r["records"]) for r in stats.paired_runs(log, ("records",)).collect()}
    assert got == {("a", 1): (180.0, "ok", None, 5), ("a", 2): (None, "interrupted", None, None), ("a", 3): (0.0, "ok", None, 1), ("b", 1): (None, "running", None, None)}
    assert stats.paired_runs(log.limit(0)).count() == 0


def test_sibling_links(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(4), rng.choice([7, 8, 9, None])) for _ in range(60)] + [(5, 1, 1)]
    got = [tuple(r) for r in links.sibling_links(spark.createDataFrame(rows, "event_id int, link int, source int")).collect()]
    own = [r for r in rows if r[0] is not None]
    want = []
    for event, link, source in set(own):
        others = [r for r in own if r[0] == event and r[1:] != (link, source)]
        first = min(((r[2] is not None, r[2] or 0) for r in others), default=None)
        want.append((event, link, len(others) * own.count((event, link, source)), None if first is None or not first[0] else first[1]))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    plan = links.sibling_links(spark.createDataFrame(rows, "event_id int, link int, source int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan or "row_number" in plan
