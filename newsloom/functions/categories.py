"""Category lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import clean_html


def parse_categories(json_text: Column) -> Column:
    """ARRAY<STRING> from a landed value: a JSON list, or one bare string."""
    as_list = F.when(json_text.startswith("["), F.from_json(json_text, "array<string>"))
    single = F.when(json_text.isNotNull(), F.array(json_text))
    return F.coalesce(as_list, single)


def normalize_categories(categories: Column) -> Column:
    """Cleaned, distinct, sorted names without blanks; NULL gives an empty list."""
    cleaned = F.filter(F.transform(categories, clean_html), lambda name: name != "")
    return F.coalesce(F.array_sort(F.array_distinct(cleaned)), F.array().cast("array<string>"))
