"""Pages of sorted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def offset_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of the sorted table; cost grows with offset."""
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows after a key: a pushed-down filter and a top-n."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def numbered_page(df: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    """A page's rows with the envelope total, page, pages and has_more."""
    total = df.agg(F.count("*").alias("total"))
    rows = offset_page(df, order, (page - 1) * limit, limit)
    return rows.join(F.broadcast(total)).withColumns({"page": F.lit(page), "pages": F.ceil(F.col("total") / limit), "has_more": F.lit(page * limit) < F.col("total")})
