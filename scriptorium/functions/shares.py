"""Rows dealt in shares of bounded size, so that what a task sorts and hashes does
not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of the counted table in a share, on average.
SHARE_ROWS = 250_000


def shares_of(table: DataFrame) -> int:
    """The number of shares for what is made of a stored table, from its row count,
    which stands in its files' footers."""
    return max(1, -(-table.count() // SHARE_ROWS))


def dealt(rows: DataFrame, shares: int | None, *keys: str) -> DataFrame:
    """``rows`` in that many shares by ``keys``, all of a key in one; as they are if
    ``shares`` is None.  Spark merges no shares whose number is given."""
    return rows if shares is None else rows.repartition(shares, *keys)
