"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def from_epoch_micros(micros: Column) -> Column:
    """Zone-less timestamp of a number of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Epoch second at which the tumbling bucket of ``ts`` starts."""
    width = seconds * 1_000_000
    micros = epoch_micros(ts)
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(1_000_000)).cast("long")


def age_text(seconds: Column) -> Column:
    """``Ns ago`` / ``Nm ago`` / ``Nh ago`` / ``Nd ago``."""
    def whole(divisor: int) -> Column:
        return F.floor(seconds / F.lit(divisor)).cast("string")

    return (
        F.when(seconds < 60, F.concat(F.greatest(F.lit(1).cast("bigint"), F.floor(seconds)).cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86400), F.lit("d ago")))
    )
