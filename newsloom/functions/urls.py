"""URL checks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: which article and image URLs count as well formed.
ARTICLE_URL = (
    r"^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,63}\.?|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)$"
)
SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def normalize_url(url: Column) -> Column:
    """The URL when it is well formed, else ''."""
    return F.when(url.rlike("(?iU)" + ARTICLE_URL), url).otherwise(F.lit(""))


def has_scheme_and_host(url: Column) -> Column:
    return F.coalesce(url.rlike(SCHEME_AND_HOST), F.lit(False))
