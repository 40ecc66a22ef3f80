"""Operator 10: URL filter rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import one_at_a_time, table

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression on the lower-cased url.

    ``tokens``: alternatives; every url that the pattern fits holds all words of one of them as whole tokens, which is
    what the index goes by. So each alternative needs a word.
    """

    pattern: str
    verdict: str
    tokens: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.tokens or not all(re.fullmatch(f"{TOKEN}( {TOKEN})*", t) for t in self.tokens):
            raise ValueError(f"each alternative needs tokens: {self.pattern}")


HOST_RULES = (
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
)

#: In falling priority: the first that fits decides.
PATTERN_RULES = (
    PatternRule(r"^https?://blog\.[^/?#]*/[a-z]+/[0-9]+\.html$", "allow", ("blog html",)),
    PatternRule(r"[?&]utm_source=(feed|rss|mail)(&|$)", "block", ("utm source feed", "utm source rss", "utm source mail")),
    PatternRule(r"[?&]page=[0-9]+&ref=", "block", ("page ref",)),
    PatternRule(r"^https?://m\.[^/?#]*/[a-z]+/[0-9]+(/|$)", "block", ("m",)),
    PatternRule(r"#top$", "allow", ("top",)),
    PatternRule(r"[?&](session|sid|phpsessid)=[0-9a-f]{8,}", "block", ("session", "sid", "phpsessid")),
    PatternRule(r"/(casino|viagra|porn)/", "block", ("casino", "viagra", "porn")),
    PatternRule(r"^https?://www\.[^/?#]*\.example\.[a-z]+/login(/|\?|$)", "block", ("www example login",)),
    PatternRule(r"^https?://(ads?|adserver|banners?)\.", "block", ("ad", "ads", "adserver", "banner", "banners")),
    PatternRule(r"/(cart|checkout|basket)(/|\?|$)", "block", ("cart", "checkout", "basket")),
    PatternRule(r"/wp-(login|admin)\b", "block", ("wp login", "wp admin")),
    PatternRule(r"[?&]replytocom=[0-9]+", "block", ("replytocom",)),
    PatternRule(r"/calendar/[0-9]{4}/[0-9]{2}(/|$)", "block", ("calendar",)),
    PatternRule(r"\.(zip|exe|apk|iso)(\?|#|$)", "block", ("zip", "exe", "apk", "iso")),
    PatternRule(r"/(print|amp)(/|\?|$)", "block", ("print", "amp")),
    PatternRule(r"^https?://docs\.[^/?#]*/", "allow", ("docs",)),
)


def host_and_path(url_col: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ://."""
    rest = F.expr(f"CASE WHEN instr(`{url_col}`, '://') > 0 THEN substring(`{url_col}`, instr(`{url_col}`, '://') + 3) ELSE '' END")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each wanted token, over all rows; as many counts as the rules have literals."""
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{url_col}`), '{TOKEN}', 0)"))).alias("token"))
    found = tokens.where(F.col("token").isin(sorted(wanted))).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in found}


def rule_index(rules: list[tuple[int, PatternRule]], counts: dict[str, int]) -> dict[str, list[tuple[int, str]]]:
    """Number and pattern of each rule, under the rarest token of each of its alternatives."""
    by_token: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for k, r in rules:
        for t in {min(words.split(), key=lambda t: (counts.get(t, 0), t)) for words in r.tokens}:
            by_token[t].append((k, r.pattern))
    return dict(by_token)


def host_index(rules: tuple[HostRule, ...]) -> dict[str, list[tuple[str, str, str]]]:
    """Path, text and verdict of the rules of each host, the longest path first."""
    by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for r in sorted(rules, key=lambda r: (-len(r.path), r.path)):
        by_host[r.host].append((r.path, r.text, r.verdict))
    return dict(by_host)


def longest_rule(index: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """Text and verdict of the longest rule of the host or of a domain above it whose path the url's starts with."""
    best = None
    while host:
        for start, text, verdict in index.get(host, ()):
            if path.startswith(start):
                if best is None or (len(text), best[0]) > (len(best[0]), text):
                    best = (text, verdict)
                break
        host = host.partition(".")[2]
    return best


def applied(
    urls: DataFrame, patterns: tuple[PatternRule, ...], hosts: tuple[HostRule, ...], names: dict[str, str], *, block_rules: int = 50_000
) -> DataFrame:
    """Fills the columns of the first fitting pattern's number (``pattern``) and of the longest host rule's text and verdict (``rule``, ``verdict``).

    ``names``: the names of these columns and of ``url``, ``host`` and ``path``. A url's tokens fetch candidate patterns
    from the index, and only those run; its host and the domains above it fetch host rules. The indexes are broadcast in
    blocks of ``block_rules`` rules; all blocks are used by one Python stage, one at a time for each batch of rows.
    """
    counts = token_counts(urls, names["url"], {t for r in patterns for words in r.tokens for t in words.split()})
    place = {k: urls.columns.index(v) for k, v in names.items()}
    starts = range(0, max(len(patterns), len(hosts), 1), block_rules)
    context = urls.sparkSession.sparkContext
    shared = [context.broadcast((rule_index(list(enumerate(patterns[at : at + block_rules], at)), counts), host_index(hosts[at : at + block_rules]))) for at in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, compiled = re.compile(TOKEN), {}
        for batch in batches:
            first, rule, verdict, url, host, path = (batch.column(place[k]).to_pylist() for k in ("pattern", "rule", "verdict", "url", "host", "path"))
            for block in range(len(shared)):
                with one_at_a_time(shared, block) as (by_token, by_host):
                    for i, u in enumerate(url):
                        found = longest_rule(by_host, host[i], path[i])
                        if found and (rule[i] is None or (len(found[0]), rule[i]) > (len(rule[i]), found[0])):
                            rule[i], verdict[i] = found
                        if u is None or first[i] is not None:
                            continue
                        low = u.translate(LOWER)
                        for k, p in sorted({x for t in set(token.findall(low)) for x in by_token.get(t, ())}):
                            if (compiled.get(p) or compiled.setdefault(p, re.compile(p))).search(low):
                                first[i] = k
                                break
            for k, v, kind in (("pattern", first, pa.int32()), ("rule", rule, pa.string()), ("verdict", verdict, pa.string())):
                batch = batch.set_column(place[k], batch.schema.field(place[k]), pa.array(v, kind))
            yield batch

    return urls.mapInArrow(run, urls.schema)


LOWER = {c: c + 32 for c in range(65, 91)}


def filter_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    *,
    url_col: str = "url",
    default: str = "allow",
    block_rules: int = 50_000,
) -> DataFrame:
    """Adds host, path, rule, pattern_rule (its number) and verdict to each row.

    The longest host rule that fits decides, else the first pattern rule, else ``default``. Null and malformed urls
    have an empty host and path and get the default unless a pattern fits. No row is lost or merged; an empty table
    gives an empty result. Columns of those names in the input are replaced.
    """
    new = ("host", "path", "rule", "pattern_rule", "verdict")
    base = pages.drop(*[c for c in pages.columns if c in new and c != url_col])
    host, path = host_and_path(url_col)
    none = F.lit(None).cast("string")
    base = base.withColumns({"host": host, "path": path, "rule": none, "pattern_rule": F.lit(None).cast("int"), "verdict": none})
    names = {"url": url_col, "host": "host", "path": "path", "pattern": "pattern_rule", "rule": "rule", "verdict": "verdict"}
    out = applied(base, pattern_rules, host_rules, names, block_rules=block_rules)
    by_pattern = F.get(F.array(*[F.lit(r.verdict) for r in pattern_rules]).cast("array<string>"), F.col("pattern_rule"))
    return out.withColumn("verdict", F.coalesce("verdict", by_pattern, F.lit(default)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = [(f"(host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)})", r) for r in sorted(HOST_RULES, key=lambda r: (-len(r.text), r.text))]
    patterns = " ".join(f"WHEN regexp_matches(low, {q(r.pattern)}) THEN {q(r.verdict)}" for r in PATTERN_RULES)
    return f"""
WITH u AS (SELECT page_id, translate(url, '{upper}', '{lower}') AS low,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN {q(r.text)}" for f, r in fits)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN {q(r.verdict)}" for f, r in fits)} {patterns} ELSE 'allow' END AS verdict
FROM h"""
