"""Record listing, predicate queries, tags and minimisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import sorted_slice


def where_set(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Conjunction of the equality filters that are set; lists mean IN."""
    for name, wanted in filters.items():
        if wanted is not None:
            c = F.col(name)
            df = df.filter(c.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else c == F.lit(wanted))
    return df


def list_records(df: DataFrame, filters: dict[str, object], order: list, limit: int, offset: int = 0) -> DataFrame:
    return sorted_slice(where_set(df, filters), order, offset, limit)


def query_records(df: DataFrame, predicate: str, fields: list[str]) -> DataFrame:
    return df.filter(predicate).select(*fields)


def audit_query(df: DataFrame, filters: dict[str, object], time_col: str, start: str | None, end: str | None, order: list,
                limit: int | None = None, offset: int = 0) -> DataFrame:
    """All filters optional, time bounds inclusive."""
    kind = dict(df.dtypes)[time_col]
    out = where_set(df, filters)
    if start is not None:
        out = out.filter(F.col(time_col) >= F.lit(start).cast(kind))
    if end is not None:
        out = out.filter(F.col(time_col) <= F.lit(end).cast(kind))
    if limit is None:
        return out
    return sorted_slice(out, order, offset, limit)


def find_by_tag(df: DataFrame, tags: str, key: str, value: str) -> DataFrame:
    return df.filter(F.try_element_at(F.col(tags), F.lit(key)) == value)


def metadata_index(df: DataFrame, tags: str, key: str) -> DataFrame:
    """Inverted index as rows (tag, value, key); a value with very many keys stays many rows."""
    return df.select(key, F.explode(tags).alias("tag", "value")).select("tag", "value", key)


def minimise(df: DataFrame, fields: list[str], time_col: str | None = None, precision: str = "hour") -> DataFrame:
    out = df.select(*fields)
    return out.withColumn(time_col, F.date_trunc(precision, time_col)) if time_col else out
