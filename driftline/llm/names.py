"""Column names that do not clash."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def every(df: DataFrame, but: str | None = None) -> list[Column]:
    """All columns of ``df``, whatever characters their names have, without ``but``."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if but is None or c.lower() != but.lower()]


def mapped(df: DataFrame, run, fields: list[T.StructField]) -> DataFrame:
    """``df.mapInArrow`` where ``run`` yields lists of arrays, one per field; column names may hold dots and quotes."""
    schema = T.StructType([T.StructField(f"c{n}", f.dataType) for n, f in enumerate(fields)])

    def numbered(batches):
        for arrays in run(batches):
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.toDF(*[f"c{n}" for n in range(len(df.columns))]).mapInArrow(numbered, schema).toDF(*[f.name for f in fields])
