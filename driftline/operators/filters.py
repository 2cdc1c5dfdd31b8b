"""The ``field:v1|v2,field2:v`` filter text of the list queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(text: str | None) -> list[tuple[str, str]]:
    """(field, value) of each part; a part without a value has an empty one."""
    parts = [p.partition(":") for p in (text or "").split(",") if p.strip()]
    return [(field.strip(), value) for field, _, value in parts]


def filtered(df: DataFrame, text: str | None, fields: dict[str, Column]) -> DataFrame:
    """Any of a field's values, and all fields; blank values do not restrict, an unknown field is an error."""
    wanted: dict[str, list[str]] = {}
    for field, value in pairs(text):
        if field.lower() not in fields:
            raise ValueError(f"unknown filter field {field}; use one of {sorted(fields)}")
        if value:
            wanted.setdefault(field.lower(), []).extend(value.split("|"))
    for field, values in wanted.items():
        df = df.where(fields[field].isin(values))
    return df


def last_values(text: str | None, known: list[str]) -> dict[str, str]:
    """One value per field, the last one given; a part without a colon or an unknown field is an error."""
    found: dict[str, str] = {}
    for part in [p for p in (text or "").split(",") if p.strip()]:
        field, colon, value = part.partition(":")
        if not colon:
            raise ValueError(f"invalid filter {part}")
        if field.lower() not in known:
            raise ValueError(f"unknown filter field {field}; use one of {known}")
        found[field.lower()] = value
    return found


def by_columns(names: dict[str, str]) -> dict[str, Column]:
    return {field: F.col(column) for field, column in names.items()}
