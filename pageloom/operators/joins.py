"""Joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over ``SALTS`` tasks.
HOT_ROWS = 1_000_000
SALTS = 256
# A table of more rows is met in a salted join.
SMALL_ROWS = 50_000

_N, _HOT, _SALT = "__n", "__hot", "__salt"


def hottest(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """The keys to split, from a table of keys and their row counts: all above ``HOT_ROWS``."""
    return counts.where(F.col(n) > HOT_ROWS).select(*on)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys of ``rows`` to split; the counts are combined on the map side."""
    return hottest(rows.groupBy(*on).agg(F.count("*").alias(_N)), on, _N)


def salted_join(
    rows: DataFrame,
    unique: DataFrame,
    on: list[str],
    hot: DataFrame,
    spread_by: Column,
    how: str = "left",
) -> DataFrame:
    """Join many-per-key ``rows`` to a one-per-key table, splitting the ``hot`` keys.

    Only rows of hot keys get a salt, and only hot keys are copied on the unique
    side, so all others are joined as usual. The salt is a hash of row content, not
    a random number: a task run again after a lost executor sends its rows to the
    same place. The marks carry no broadcast hint: Spark sends them to every task
    when their measured bytes allow it, else it splits the skewed mark join itself.
    """
    marks = hot.select(*on).withColumn(_HOT, F.lit(True))
    salt = F.when(F.col(_HOT), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(0)
    copy = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(marks, on, "left").withColumn(_SALT, salt.cast("int")).drop(_HOT)
    copies = unique.join(marks, on, "left").withColumn(_SALT, F.explode(copy)).drop(_HOT)
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def lookup(
    rows: DataFrame,
    unique: DataFrame,
    size: int,
    on: list[str],
    spread_by: Column,
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to a one-per-key table of known ``size``.

    A table of few rows is joined as it is, and Spark broadcasts it if its bytes are
    few too; a larger one is met in a salted join.
    """
    if size <= SMALL_ROWS:
        return rows.join(unique, on, how)
    return salted_join(rows, unique, on, hot_keys(rows, on) if hot is None else hot, spread_by, how)
