"""Registration status, grade, next check and countdown of a listing. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglake.refdata import SOURCE_TRUST


def micros(ts: Column) -> Column:
    """Microseconds since 1970; an instant without a zone counts in the session's zone."""
    return F.unix_micros(ts.cast("timestamp"))


def live_status(deadline: Column, opens: Column, now: Column) -> Column:
    """For filters, by the comparable instants alone."""
    return (
        F.when(deadline.isNull(), "unknown").when(deadline <= now, "closed").when(opens > now, "upcoming").otherwise("open")
    )


def precision_of(iso: Column) -> Column:
    return F.when(iso.isNull() | (iso == ""), "none").when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_only").otherwise("instant")


def end_of_day(day: Column, millis: int = 0) -> Column:
    return F.date_trunc("day", day) + F.expr(f"INTERVAL '86399.{millis:03d}' SECOND")


def comparable(ts: Column, precision: Column) -> Column:
    """A date without a time counts until the last second of its day."""
    return F.when(precision == "date_only", end_of_day(ts)).otherwise(ts)


def full_status(deadline: Column, precision: Column, opens: Column, now: Column) -> Column:
    """struct(status, effective, note); for a bare date only its own end decides."""
    last = end_of_day(deadline, 999)
    bare = precision == "date_only"
    status = (
        F.when(deadline.isNull(), "unknown")
        .when(bare, F.when(last >= now, "open").otherwise("closed"))
        .when(deadline <= now, "closed")
        .when(opens > now, "upcoming")
        .otherwise("open")
    )
    note = F.when(deadline.isNull(), "no deadline published").when(bare, "date without a time; open until the day ends")
    return F.struct(status.alias("status"), F.when(bare, last).otherwise(deadline).alias("effective"), note.alias("note"))


def basis(confidence: Column) -> Column:
    return F.when(confidence == "inferred", "inferred").when(confidence.isin("verified", "source_confirmed"), "stated").otherwise("unclear")


def grade(deadline: Column, conflict: Column, confidence: Column, kind: Column, precision: Column, source: Column) -> Column:
    """Data quality: how far the registration deadline can be relied on."""
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TRUST.items() for x in kv]), source), F.lit(0))
    exact = (precision == "instant") & (confidence == "verified")
    return (
        F.when(F.coalesce(conflict, F.lit(False)), "partially_verified")
        .when(deadline.isNull(), "unknown")
        .when((confidence.isin("inferred", "unknown")) | (kind == "unknown"), "partially_verified")
        .when((trust >= 4) & exact, "verified")
        .when(trust >= 4, "source_confirmed")
        .otherwise("partially_verified")
    )


def grade_reason(deadline: Column, conflict: Column, confidence: Column, kind: Column, precision: Column, source: Column, populated: Column) -> Column:
    """Why ``grade`` is what it is."""
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TRUST.items() for x in kv]), source), F.lit(0))
    return (
        F.when(F.coalesce(conflict, F.lit(False)), "sources disagree about the deadline")
        .when(deadline.isNull(), F.when(populated >= 6, "no deadline is published").otherwise("very little is published"))
        .when(confidence == "inferred", "deadline inferred from the submission deadline")
        .when((confidence == "unknown") | (kind == "unknown"), "deadline text is ambiguous")
        .when((trust >= 4) & (precision == "instant") & (confidence == "verified"), F.concat(F.lit("deadline is a field of "), source))
        .when(trust >= 4, F.concat(F.lit("deadline published without a time by "), source))
        .otherwise(F.concat(F.lit("deadline read from a page of "), source))
    )


def populated_fields(*columns: str) -> Column:
    """How many of the columns have a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def shown_in_zone(ts: Column, precision: Column, zone: str) -> Column:
    """An instant on a zone's clock; a date without a time is the same day everywhere."""
    bare = F.concat(F.date_format(ts, "d MMMM yyyy"), F.lit(" — time not specified"))
    local = F.upper(F.date_format(F.from_utc_timestamp(ts, zone), "hh:mm a"))
    return F.when(ts.isNull(), "Not specified").when(precision == "date_only", bare).otherwise(F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "d MMMM yyyy"), F.lit(", "), local))


def zone_label(named: Column, offset_minutes: Column) -> Column:
    """The source's own zone name; where it only says a shift, India's and UTC's are named."""
    plain = named.isNull() | named.rlike(r"^UTC[+-]\d{2}:?\d{2}$")
    return F.when(plain & (offset_minutes == 330), "IST").when(plain & (offset_minutes == 0), "UTC").otherwise(named)


def next_check(deadline: Column, start: Column, status: Column, now: Column) -> Column:
    """When to look again: the nearer the deadline, the sooner."""
    hours = lambda n: now + F.expr(f"INTERVAL '{n}' HOUR")
    left = (micros(deadline) - micros(now)) / 3_600_000_000
    until = (micros(start) - micros(now)) / 3_600_000_000
    return (
        F.when(left <= 0, hours(168)).when(left <= 48, hours(1)).when(left <= 168, hours(3)).when(left <= 720, hours(12)).when(left.isNotNull(), hours(24))
        .when((until > 0) & (until <= 168), hours(12)).when(until > 0, hours(48))
        .when(status == "open", hours(24)).when(status == "upcoming", hours(12)).when(status == "closed", hours(168)).otherwise(hours(48))
    )


def countdown(target: Column, now: Column) -> Column:
    """struct(expired, label, days, hours, minutes, seconds, urgency)."""
    left = F.floor((micros(target) - micros(now)) / 1_000_000)
    open_ = target > now
    part = lambda c: F.when(open_, c).otherwise(0).cast("long")
    days, hours, minutes, seconds = (
        part(F.floor(left / 86400)), part(F.floor(left % 86400 / 3600)), part(F.floor(left % 3600 / 60)), part(left % 60),
    )
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" left"))
    label = (
        F.when(target.isNull(), "Deadline not specified").when(~open_, "Registration closed")
        .when(days >= 1, say(days, "day")).when(hours >= 1, say(hours, "hour")).when(minutes >= 1, say(minutes, "minute")).otherwise(say(seconds, "second"))
    )
    urgency = (
        F.when(target.isNull(), "unknown").when(~open_, "none").when(days >= 7, "comfortable").when(days >= 2, "soon").otherwise("critical")
    )
    return F.struct(
        F.coalesce(~open_, F.lit(False)).alias("expired"), label.alias("label"), days.alias("days"), hours.alias("hours"),
        minutes.alias("minutes"), seconds.alias("seconds"), urgency.alias("urgency"),
    )


def wall_clock(ts: Column, offset_minutes: Column) -> Column:
    """The instant as the source's own clock showed it."""
    return F.date_format(F.timestamp_micros(micros(ts) + offset_minutes.cast("long") * 60_000_000), "d MMMM yyyy, hh:mm a")
