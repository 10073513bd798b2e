"""Points in time as columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(at: datetime) -> Column:
    """A timestamp; without an offset it is in the time zone of the session."""
    return F.lit(str(at)).cast("timestamp")
