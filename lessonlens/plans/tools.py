"""Helpers shared by the query definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Two stores with the same ids, which must not be mixed.
DS = ["dataset_id"]
TWO_STORES = "(VALUES ('a'), ('b')) AS st(dataset_id)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that sums taken in another order compare equal; a zero loses its sign."""
    return df.select(*[
        (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])
