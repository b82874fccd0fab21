"""Column functions. All of them run inside the JVM."""

from newsloom.functions.categories import normalize_categories, parse_categories
from newsloom.functions.dates import format_day, format_report_date, parse_date, parse_scraped
from newsloom.functions.text import (
    clean_html,
    content_first,
    content_text,
    match_name,
    none_if_empty,
    slugify,
    title_case,
    unescape_entities,
)
from newsloom.functions.urls import has_scheme_and_host, normalize_url

__all__ = [
    "clean_html",
    "content_first",
    "content_text",
    "format_day",
    "format_report_date",
    "has_scheme_and_host",
    "match_name",
    "none_if_empty",
    "normalize_categories",
    "normalize_url",
    "parse_categories",
    "parse_date",
    "parse_scraped",
    "slugify",
    "title_case",
    "unescape_entities",
]
