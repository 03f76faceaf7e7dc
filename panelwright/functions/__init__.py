"""Column expressions and small tables that the operators share: dates, texts, hashes, JSON, arrays, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
#: What stands for a missing and for an infinite figure (fixed values).
MISSING, INFINITE, TRUNCATED = "—", "∞", "\n[...truncated...]"
#: Names of query parameters that hold secrets (fixed values).
SECRETS = r"(?i)\b(api_key|apikey|access_token|token|key)=[^&\s]+"


def future_dates(last: DataFrame, horizon: int, frequency: str) -> DataFrame:
    """``(asset, step, dt)``: the ``horizon`` dates after ``last(asset, dt)``.

    These are the anchors (week days, Fridays, month ends, year ends) from the last date on, without the first; so after a date
    that is no anchor itself the first anchor is left out.
    """
    dt = F.col("dt")
    if frequency == "daily":
        days = F.sequence(dt, F.date_add(dt, 2 * horizon + 4))
        anchors = F.filter(days, lambda x: F.weekday(x) < 5)
    elif frequency == "weekly":
        first = F.next_day(F.date_sub(dt, 1), "FRI")
        anchors = F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda i: F.date_add(first, i * 7))
    elif frequency == "monthly":
        anchors = F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda i: F.last_day(F.add_months(F.trunc(dt, "month"), i)))
    elif frequency == "yearly":
        anchors = F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda i: F.make_date(F.year(dt) + i, F.lit(12), F.lit(31)))
    else:
        raise ValueError(frequency)
    return last.select("asset", F.posexplode(F.slice(anchors, 2, horizon)).alias("at", "dt")).select("asset", (F.col("at") + 1).alias("step"), "dt")


def session_date(epoch: Column, zone: Column) -> Column:
    """The exchange's own date of an epoch second; without a zone that of UTC."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch), F.coalesce(zone, F.lit("UTC"))))


def iso_utc(at: Column) -> Column:
    return F.date_format(at, ISO)


def iso_of_compact(stamp: Column) -> Column:
    """ISO form of ``yyyyMMddTHHmmssZ``, empty for anything else."""
    return F.coalesce(iso_utc(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'"))), F.lit(""))


def iso_of_rfc822(stamp: Column) -> Column:
    """ISO form in UTC of ``Tue, 08 Sep 2026 12:00:00 GMT`` or with a numeric offset; anything else stays as it is."""
    plain = F.regexp_replace(F.regexp_replace(stamp, r"^\w{3}, ", ""), r" (GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(iso_utc(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))), stamp)


def redacted_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "$1=***REDACTED***")


def truncated(text: Column, tokens: int) -> Column:
    """At most ``tokens`` tokens of four characters, with a mark where text was cut."""
    return F.when(F.length(text) > 4 * tokens, F.concat(F.substring(text, 1, 4 * tokens), F.lit(TRUNCATED))).otherwise(text)


def as_percent(x: Column, digits: int = 2) -> Column:
    """A share as a percentage, a dash where it is missing."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", F.round(100 * x, digits)), F.lit(MISSING))


def as_ratio(x: Column, digits: int = 2) -> Column:
    """A ratio, a dash where it is missing and a sign for infinity."""
    finite = F.when(x.isNotNull() & ~F.isnan(x), F.format_string(f"%.{digits}f", F.round(x, digits)))
    return F.when(x == float("inf"), INFINITE).otherwise(F.coalesce(finite, F.lit(MISSING)))


def wrapped(tag: str, text: Column) -> Column:
    """``text`` between tags; a closing or opening form of the tag inside it is made harmless."""
    safe = F.regexp_replace(text, f"(?i)<(\\s*/?\\s*{tag})", "&lt;$1")
    return F.concat(F.lit(f"<{tag}>\n"), safe, F.lit(f"\n</{tag}>"))


def names_of(authors: Column, most: int = 3) -> Column:
    """The first ``most`` names, and a note if there are more."""
    shown = F.array_join(F.slice(authors, 1, most), ", ")
    return F.when(F.size(authors) > most, F.concat(shown, F.lit(" et al."))).otherwise(shown)
