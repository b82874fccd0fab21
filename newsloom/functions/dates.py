"""Publication dates: parsing the accepted text forms, and display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
ISO_WITH_OFFSET = rf"^{_DAY}T{_CLOCK}(?:Z|[+-]\d{{2}}:?\d{{2}})$"
ISO_WITHOUT_OFFSET = rf"^{_DAY}T{_CLOCK}$"
DAY_AND_CLOCK = rf"^{_DAY}\s+{_CLOCK}$"
DAY_ONLY = rf"^{_DAY}$"
FEED_DATE = (
    r"^(?:(?i:mon|tue|wed|thu|fri|sat|sun),\s+)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+"
    r"(\d{1,2}:\d{1,2})(:\d{1,2})?\s+([+-]\d{2}):?(\d{2})$"
)
ZONE_NAME = r"\s+([A-Z]{1,3})$"
# The zone names of feed dates, with their offsets from UTC.
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
# A full day, with or without a time; what a report shows as a date.
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
FRACTION = r"(?<=:\d{2})\.\d{1,9}"


def parse_date(text: Column) -> Column:
    """TIMESTAMP of an accepted date text, NULL for anything else.

    The shape picks the format, so each row is parsed once. A text without an
    offset is UTC.
    """
    iso = (
        F.when(text.rlike(ISO_WITH_OFFSET), F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"))
        .when(text.rlike(ISO_WITHOUT_OFFSET), F.concat(text, F.lit("Z")))
        .when(text.rlike(DAY_AND_CLOCK), F.concat(F.regexp_replace(text, r"\s+", "T"), F.lit("Z")))
        .when(text.rlike(DAY_ONLY), F.concat(text, F.lit("T0:0:0Z")))
    )
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.try_element_at(zones, F.regexp_extract(text, ZONE_NAME, 1))
    feed_text = F.coalesce(F.concat(F.regexp_replace(text, ZONE_NAME, " "), offset), text)
    # Groups that match nothing are empty: a time without seconds has none.
    feed = F.when(
        feed_text.rlike(FEED_DATE),
        F.regexp_replace(F.regexp_replace(feed_text, FEED_DATE, "$1 $2 $3 $4$5 $6$7"), r"( \d+:\d+)( [+-])", "$1:0$2"),
    )
    return F.coalesce(
        F.try_to_timestamp(iso, F.lit("yyyy-M-d'T'H:m:sXXX")),
        F.try_to_timestamp(feed, F.lit("d MMM yyyy H:m:s Z")),
    )


def parse_scraped(text: Column) -> Column:
    """TIMESTAMP of when an article was scraped, its fraction of a second kept.
    The forms are those of :func:`parse_date`."""
    whole = parse_date(F.regexp_replace(text, FRACTION, ""))
    fraction = F.regexp_extract(text, FRACTION, 0)
    micros = F.substring(F.rpad(F.substring(fraction, 2, 9), 6, "0"), 1, 6).try_cast("long")
    return F.timestamp_micros(F.unix_micros(whole) + F.coalesce(micros, F.lit(0)))


def format_day(moment: Column) -> Column:
    return F.date_format(moment, "dd/MM/yyyy")


def format_report_date(text: Column) -> Column:
    """'dd/MM/yyyy à HH:mm' of an ISO date text; other text as it is, also a
    bare time, year or month, which name no day."""
    moment = F.when(text.rlike(ISO_MOMENT), text.try_cast("timestamp"))
    return F.coalesce(
        F.date_format(moment, "dd/MM/yyyy 'à' HH:mm"), text, F.lit("")
    )
