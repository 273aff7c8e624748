"""Time expressions; the session time zone is UTC."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

# Time zone names of mail dates.
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def ts_lit(value: datetime | str | Column) -> Column:
    """A pinned clock value as a timestamp."""
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp(F.lit(text))


def millis(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(c.cast("timestamp"))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Absolute distance in hours as a double; null when either side is missing."""
    return F.abs(millis(a) - millis(b)) / F.lit(3600000.0)


def age_hours(then: Column | str, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (millis(now) - millis(then)) / F.lit(3600000.0))


def to_ts(c: Column | str) -> Column:
    """ISO, mail-style, written-out, slashed or bare-year text as a timestamp; anything else becomes null."""
    t = clean_text(c)
    day = F.regexp_replace(t, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2")
    day = F.regexp_replace(day, "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "$1-$2-$3")
    iso = F.when(day.rlike("^[0-9]{4}(-|T|$)"), F.try_to_timestamp(day))
    mail = F.regexp_replace(t, "^[A-Za-z]{3,9},\\s*", "")
    # Written-out months to three letters, dates without a time to midnight UTC, two-digit years to this century.
    mail = F.regexp_replace(mail, "^([A-Za-z]{3})[a-z]*\\.? ([0-9]{1,2}),? ([0-9]{4})$", "$2 $1 $3")
    mail = F.regexp_replace(mail, "^([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{4})$", "$1 $2 $3 00:00 +0000")
    mail = F.regexp_replace(mail, "^([0-9]{1,2})[ -]([A-Za-z]{3})[ -]([0-9]{2}) ", "$1 $2 20$3 ")
    for name, offset in ZONES.items():
        mail = F.regexp_replace(mail, f"\\s{name}$", f" {offset}")
    return F.coalesce(
        iso,
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm xx")),
    )


def date_range(label: str | None, start: str | None, end: str | None, now: datetime) -> tuple[str, datetime, datetime]:
    """Label, first and last instant (both inclusive) of an archive window."""
    today = now.date()
    if label == "today":
        first = last = today
    elif label == "yesterday":
        first = last = today - timedelta(days=1)
    elif label == "week":
        first, last = today - timedelta(days=6), today
    else:
        return label or "custom", _bound(start or "1970-01-01", False), _bound(end or "2999-12-31", True)
    return label, _bound(first.isoformat(), False), _bound(last.isoformat(), True)


def _bound(text: str, end_of_day: bool) -> datetime:
    if "T" in text:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    day = datetime.combine(date.fromisoformat(text), datetime.min.time())
    return day + timedelta(days=1) - timedelta(milliseconds=1) if end_of_day else day


def within(c: Column | str, first: datetime, last: datetime) -> Column:
    """Inclusive range test that a scan can push down; missing dates fail."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c >= ts_lit(first)) & (c <= ts_lit(last)), F.lit(False))


def order_key(published: str = "published_at", created: str = "created_at", ident: str = "article_id") -> Column:
    """Total article order (date, then id) as one sortable string."""
    at = F.coalesce(F.col(published).cast("timestamp"), F.col(created).cast("timestamp"))
    stamp = F.coalesce(F.date_format(at, "yyyyMMddHHmmssSSS"), F.lit("0" * 17))
    return F.concat(stamp, F.lit("|"), F.col(ident))
