"""Text columns: keys, slugs, urls, HTML text, amounts and tags. All are native expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglake import refdata


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and their base letters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii():
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), "[\\u0300-\\u036f]", "")


def normal_key(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 with single spaces; & reads as and, apostrophes vanish. Null gives the empty key."""
    key = F.lower(without_accents(F.coalesce(c, F.lit(""))))
    key = F.regexp_replace(key, "['`\\u2019]", "")
    key = F.regexp_replace(key, "&", " and ")
    return F.trim(F.regexp_replace(key, "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """Key with hyphens inside words closed up."""
    return normal_key(F.regexp_replace(F.coalesce(c, F.lit("")), "[-'\\u2010-\\u2015]", ""))


def title_tokens(c: Column) -> Column:
    """Telling words of a title: no years, no noise words, no version marks."""
    telling = F.filter(
        F.split(normal_key(c), " "),
        lambda t: (t != "") & ~t.rlike("^(19|20)[0-9]{2}$") & ~t.rlike("^v[0-9]+$") & ~t.isin(refdata.TITLE_NOISE),
    )
    return telling


def bare_title(c: Column) -> Column:
    return F.array_join(title_tokens(c), " ")


def slug(c: Column, longest: int = 70, fallback: str = "hackathon") -> Column:
    text = F.regexp_replace(normal_key(c), " ", "-")
    return F.when(text == "", F.lit(fallback)).otherwise(F.substring(text, 1, longest))


def url_identity(url: Column) -> Column:
    """Host without www. and path without its last slashes, lower-cased; null under nine characters or where it is no url."""
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", ""))
    path = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))
    whole = F.concat(host, path)
    return F.when(F.length(whole) >= 9, whole)


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; the other parameters keep their order."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(plain, r"^([^?]*)", 1)
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")), "&")
    return F.when(kept == "", head).otherwise(F.concat(head, F.lit("?"), kept))


def http_only(url: Column) -> Column:
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url)


#: Elements whose content is no visible text, and those behind which, or at which, a line ends.
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe")
LINE_ENDS = ("p", "li", "ul", "ol", "div", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "section", "article", "header", "footer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def piece_pattern(possessive: str = "+") -> str:
    """What a page consists of, from left to right: comments, hidden elements with their content, tags whose quoted attributes may hold any character, declarations, text, and a lone "<".

    ``possessive``: the mark that forbids going back, where the engine knows one.
    """
    inside = rf"""(?:[^'">]+{possessive}|"[^"]*{possessive}"|'[^']*{possessive}')*{possessive}"""
    hidden = "|".join(rf"<{name}\b{inside}>.*?</{name}\s*>" for name in HIDDEN)
    return rf"(?is)<!--.*?-->|{hidden}|</?[a-z]{inside}>|<[!?][^>]*>|[^<]+|<"


def html_pieces(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(piece_pattern()), F.lit(0))


LINE_END = rf"(?is)^<(?:br|hr)\b[^a-z]*>$|^<(?:br|hr)\s.*>$|^</(?:{'|'.join(LINE_ENDS)})\s*>$"


def html_text(html: Column) -> Column:
    """Visible text: no comments, no hidden elements, a line per block element, entities read, white space collapsed. Null gives the empty text.

    The page is cut into its pieces first, so that what a comment, a script or a quoted attribute holds is never taken for a tag.
    """
    shown = F.transform(html_pieces(html), lambda x: F.when(~F.startswith(x, F.lit("<")) | (x == "<"), x).when(x.rlike(LINE_END), "\n").otherwise(""))
    t = F.array_join(shown, "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, "[ \\t\\u00a0]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def html_title(html: Column) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def attribute(tag: Column, *names: str) -> Column:
    """Value of a tag's first attribute of these names, without its quotes; empty where there is none."""
    said = F.regexp_extract(tag, rf"""(?is)[\s"'/](?:{'|'.join(names)})\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(said, r"""^["']|["']$""", "")


def html_meta(html: Column) -> Column:
    """Map of meta names to contents, the first of a name; name, property and itemprop count alike. Tags in comments and scripts are none."""
    tags = F.filter(html_pieces(html), lambda x: x.rlike(r"(?i)^<meta\b"))
    entries = F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "name", "property", "itemprop")).alias("key"), attribute(t, "content").alias("value")))
    known = F.filter(entries, lambda e: e["key"] != "")
    keys = F.array_distinct(F.transform(known, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(known, lambda e: e["key"] == k)[0]["value"]))


def registration_link(html: Column) -> Column:
    """Target of a page's first link whose target or text speaks of registering, else the page's base; null without either. Links in comments and scripts are none."""
    shown = F.array_join(F.filter(html_pieces(html), lambda x: ~x.rlike(rf"(?i)^<(?:!|\?|(?:{'|'.join(HIDDEN)})\b)")), "")
    anchors = F.regexp_extract_all(shown, F.lit(r"""(?is)<a\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>.*?</a\s*>"""), F.lit(0))
    pairs = F.transform(
        anchors,
        lambda a: F.struct(attribute(F.regexp_extract(a, r"""(?is)^<a\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""", 0), "href").alias("href"), F.lower(F.regexp_replace(a, "(?s)<[^>]*>", "")).alias("text")),
    )
    asks = F.filter(pairs, lambda p: (p["href"] != "") & (F.lower(p["href"]).rlike("regist(er|ration)|apply|sign ?up|submit") | p["text"].rlike("register|apply|sign ?up|join")))
    base = F.regexp_extract(shown, r"""(?is)(<base\b[^>]*>)""", 1)
    return F.coalesce(F.get(asks, 0)["href"], F.nullif(attribute(base, "href"), F.lit("")))


def json_ld_events(html: Column, depth: int = 4) -> Column:
    """Array of JSON texts of schema.org Event nodes in a page's scripts, in the order of the page.

    Arrays and ``@graph``s are opened where they lie within one another, up to ``depth`` deep; a node with a graph stands before the graph's nodes.
    """
    scripts = F.filter(html_pieces(html), lambda x: x.rlike(r"(?is)^<script\b[^>]*application/ld\+json"))
    nodes = F.transform(scripts, lambda x: F.regexp_extract(x, r"(?is)^<script\b[^>]*>(.*)</script\s*>$", 1))
    for _ in range(depth):
        within = lambda n: F.coalesce(F.from_json(F.get_json_object(n, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))
        # A node whose graph was opened stays as itself, without the graph.
        bare = lambda n: F.when(F.size(within(n)) > 0, F.to_json(F.map_filter(F.from_json(n, "map<string,string>"), lambda k, _: k != "@graph"))).otherwise(n)
        nodes = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.from_json(n, "array<string>"), F.concat(F.array(bare(n)), within(n)))))
    return F.filter(nodes, lambda n: F.lower(F.coalesce(F.get_json_object(n, "$['@type']"), F.lit(""))).rlike(r'^(event|\[.*"event".*\])$'))


def keyword_tags(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(low, k))


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


AMOUNT = rf"([{''.join(refdata.CURRENCY_SIGNS)}]) ?(\d[\d,]*(?:\.\d+)?) ?({'|'.join(sorted(refdata.MONEY_UNITS, key=len, reverse=True))})?(?![a-z])"
PRIZE_WORDS = ("prize", "winning", "worth", "award")


def sentences(c: Column) -> Column:
    """Parts between full stops that end a sentence, exclamation and question marks and line ends."""
    return F.split(F.coalesce(c, F.lit("")), r"[.!?](?:\s+|$)|\v+")


def _after(c: Column, words: tuple[str, ...]) -> Column:
    """A lower-case text from the first of the words on; empty where none stands there."""
    places = F.array_compact(F.array(*[F.when(F.instr(c, w) > 0, F.instr(c, w)) for w in words]))
    return F.when(F.size(places) > 0, F.substr(c, F.array_min(places))).otherwise("")


def prize(text: Column) -> Column:
    """struct(amount, currency): of the first sentence with a prize word, the first amount behind that word, else the one before it; unit applied."""
    about = F.filter(F.transform(sentences(text), lambda s: F.lower(s)), lambda s: F.exists(F.array(*map(F.lit, PRIZE_WORDS)), lambda w: F.contains(s, w)) & s.rlike(AMOUNT))
    said = F.get(about, 0)
    behind = _after(said, PRIZE_WORDS)
    where = F.when(behind.rlike(AMOUNT), behind).otherwise(said)
    part = lambda g: F.regexp_extract(where, AMOUNT, g)
    value = F.try_to_number(F.replace(part(2), F.lit(",")), F.lit("999999999999.99"))
    amount = (value * F.coalesce(F.element_at(_lookup(refdata.MONEY_UNITS), part(3)), F.lit(1))).cast("decimal(18,2)")
    return F.when(amount > 0, F.struct(amount.alias("amount"), F.element_at(_lookup(refdata.CURRENCY_SIGNS), part(1)).alias("currency")))


def team_size(text: Column) -> Column:
    """struct(least, most), from the few words behind "team": two numbers are a range, one after a word of limit the most. Else the number before "members"."""
    low = F.lower(F.coalesce(text, F.lit("")))
    behind = F.regexp_extract(low, r"\bteams?\b([^.;\n]{0,40})", 1)
    numbers = F.transform(F.regexp_extract_all(behind, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    linked = behind.rlike(r"\d ?(?:-|–|to) ?\d")
    limited = behind.rlike(r"^[a-z ]*\b(?:up to|upto|max|maximum)\b")
    floor = F.regexp_extract(low, r"\b(?:least|minimum|min)\b[a-z ]*(\d+)[a-z ]*\b(?:member|participant)", 1).try_cast("int")
    size = lambda a, b: F.struct(a.cast("int").alias("least"), b.cast("int").alias("most"))
    return (
        F.when(linked, size(F.get(numbers, 0), F.get(numbers, 1)))
        .when(limited & (F.size(numbers) > 0), size(F.lit(1), F.get(numbers, 0)))
        .when(floor.isNotNull(), size(floor, F.lit(None)))
    )


def eligibility(text: Column, longest: int = 320) -> Column:
    """The first sentence that speaks of eligibility, from that word on."""
    said = F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "[.]"), lambda s: F.contains(F.lower(s), F.lit("eligib"))), 0)
    return F.trim(F.substr(said, F.instr(F.lower(said), "eligib"), F.lit(longest)))


# Words of a schedule.
SCHEDULE_WORDS = ("deadline", "register", "registration", "submit", "submission", "schedule", "important dates", "timeline", "apply", "starts", "ends", "closes")


def schedule_blocks(text: Column, most: int = 120) -> Column:
    """The blocks between empty lines that hold a word of a schedule and a digit; without any, the beginning of the text."""
    blocks = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda b: F.trim(b)), lambda b: b.rlike("[0-9]") & F.exists(F.array(*map(F.lit, SCHEDULE_WORDS)), lambda w: F.contains(F.lower(b), w)))
    return F.when(F.size(blocks) > 0, F.array_join(F.slice(blocks, 1, most), "\n")).otherwise(F.substring(text, 1, 20_000))


def display_name(s: Column) -> Column:
    return F.initcap(F.translate(s, "-", " "))


def split_list(c: Column) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_json(c: Column) -> Column:
    """JSON text of a column without NUL characters and invalid UTF-8. A backslash that a text spells out is written twice, and what follows it stays."""
    return F.make_valid_utf8(F.regexp_replace(F.to_json(c), r"(?<!\\)((?:\\\\)*)\\u0000", "$1"))


def picked_spans(spans: Column) -> Column:
    """Of candidate spans, array of struct(start, length, …), those that a pass from left to right keeps: the earliest, of one start the longest; what overlaps a kept one is dropped.

    Of spans that agree in start and length the smallest by the other fields is kept. Spans without length are dropped, null gives null.
    """
    order = F.array_sort(F.transform(F.filter(spans, lambda x: x["length"] > 0), lambda x: F.struct(x["start"].alias("start"), (-x["length"]).alias("order"), x.alias("span"))))
    kept = F.filter(order, lambda x: F.lit(False))  # an empty array of the same type
    fits = lambda acc, x: F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] - F.try_element_at(acc, F.lit(-1))["order"] <= x["start"], F.lit(True))
    return F.transform(F.aggregate(order, kept, lambda acc, x: F.when(fits(acc, x), F.array_append(acc, x)).otherwise(acc)), lambda x: x["span"])
