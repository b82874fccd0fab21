"""Points in time. Every relative window is anchored on an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc(as_of: datetime | str) -> datetime:
    """``as_of`` as a naive UTC datetime."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def days_before(as_of: datetime | str, days: int) -> datetime:
    return utc(as_of) - timedelta(days=days)


def day_start(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def instant(moment: datetime | str, dtype: T.DataType | None = None) -> Column:
    """A literal of type ``dtype`` (TIMESTAMP by default). It folds to a
    constant, so comparisons with a column reach the scan."""
    text = utc(moment).isoformat(sep=" ")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(text).cast(dtype)
    return F.lit(text + "Z").cast(T.TimestampType())


def instant_like(df: DataFrame, column: str, moment: datetime | str) -> Column:
    return instant(moment, df.schema[column].dataType)
