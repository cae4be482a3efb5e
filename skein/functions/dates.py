"""Date functions; `as_of` is always a parameter, never the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Seoul"
FORMATS = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")


def published_utc(raw: Column) -> Column:
    """Timestamp of an ISO or RFC-822 text; a text without zone is UTC."""
    rfc = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(raw)] + [F.try_to_timestamp(rfc, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(*tries)


def web_date(raw: Column, formats: Sequence[str] = FORMATS) -> Column:
    """Date of a visible date text; ordinal endings are stripped."""
    plain = F.trim(F.regexp_replace(raw, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in formats])


def url_date(url: Column, pattern: str = r"(\d{4})[/-]?(\d{2})[/-]?(\d{2})") -> Column:
    text = F.concat_ws("-", *[F.regexp_extract(url, pattern, i) for i in (1, 2, 3)])
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def within_window(day: Column, as_of: Column, lookback: int = 3, ahead: int = 1, keep_unknown: bool = True) -> Column:
    """Not older than `lookback` days nor more than `ahead` days in the future."""
    known = day.between(F.date_sub(as_of, lookback), F.date_add(as_of, ahead))
    return F.coalesce(known, F.lit(keep_unknown))


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def edition_date(day: Column, ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Declared edition date, else the local day of sending."""
    return F.coalesce(F.to_date(F.try_to_timestamp(day)), local_day(ts, zone))


def weekly_window(as_of: Column, days: int = 7) -> tuple[Column, Column]:
    """(first, last) day of the last completed week, ending on Sunday."""
    back = (F.weekday(as_of) + 1) % 7
    last = F.date_sub(as_of, F.when(back == 0, 7).otherwise(back).cast("int"))
    return F.date_sub(last, days - 1), last


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def market_reference_day(day: Column) -> Column:
    """Friday of the day's week."""
    return F.date_add(week_start(day), 4)


def gap_days(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def iso_week_label(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def short_label(day: Column, pattern: str = "yy.MM.dd") -> Column:
    return F.date_format(day, pattern)


def replay_clause(query: Column, as_of: Column) -> Column:
    """`when:Nd` of a search query as explicit after and before dates."""
    n = F.coalesce(F.regexp_extract(query, r"when:(\d+)d", 1).try_cast("int"), F.lit(1))
    bounds = F.concat(F.lit("after:"), F.date_sub(as_of, n).cast("string"), F.lit(" before:"), F.date_add(as_of, 1).cast("string"))
    return F.when(query.rlike(r"when:\d+d"), F.regexp_replace(query, r"when:\d+d", bounds)).otherwise(query)


def single_period(text: Column, years: str = r"\b(20\d\d)\b", months: Sequence[str] = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")) -> Column:
    """`year-month` if the text names exactly one of each, else null."""
    low = F.lower(text)
    y = F.array_distinct(F.regexp_extract_all(low, F.lit(years), F.lit(1)))
    m = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"\b({'|'.join(months)})\b"), F.lit(1)))
    return F.when((F.size(y) == 1) & (F.size(m) == 1), F.concat_ws("-", F.get(y, F.lit(0)), F.get(m, F.lit(0))))
