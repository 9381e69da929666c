"""The row that holds for a key that was recorded more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, newest: list[str], columns: list[str]) -> DataFrame:
    """Of each key, columns of the row that is greatest by the columns newest, compared in order.

    A null in newest counts as less than any value. Rows with a null key have no key to be
    current for and are left out. Equal rows give one of them. Partial maxima are taken before the
    shuffle, so a key that holds many rows costs no more than any other.
    """
    keep = [c for c in columns if c != key]
    best = F.max_by(F.struct(*keep), F.struct(*newest)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_best.*")
