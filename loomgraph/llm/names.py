"""Names for columns that are added beside a caller's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as it takes that no column of ``df`` has one of them."""
    taken, lead = {c.lower() for c in df.columns}, "__"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]
