"""Column functions shared by the operators that stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def whole(text: str | Column = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, WHITESPACE + "+"), lambda word: word != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), use)[0]
