"""The append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name and severity of each event.
EVENT_CODES = [
    (0, "started", "info"), (1, "stopped", "info"), (2, "submitted", "info"), (3, "deleted", "warn"),
    (4, "paired", "info"), (5, "unpaired", "info"), (6, "synced", "info"), (7, "scheduled", "info"),
    (8, "succeeded", "info"), (9, "suspend", "info"), (10, "resumed", "info"), (11, "failed", "error"),
    (12, "skipped", "info"), (13, "killed", "error"), (14, "failedAdmin", "error"),
]
# Event codes each kind of entity may raise.
LEGAL_CODES = {
    "system": [0, 1],
    "cluster": [2, 3, 4, 5, 9],
    "policy": [2, 3, 6, 7, 9, 10],
    "policyinstance": [3, 8, 11, 12, 13],
}


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_CODES, "event_code int, event_name string, event_severity string")


def classify_events(new: DataFrame) -> DataFrame:
    """Adds the severity of each event's code and ``legal``: may this kind of entity raise this code."""
    # 15 fixed rows
    named = new.drop("severity").join(F.broadcast(code_table(new.sparkSession)), "event_code", "left")
    legal = F.lit(False)
    for entity, codes in LEGAL_CODES.items():
        legal = legal | ((F.col("entity_type") == entity) & F.col("event_code").isin(codes))
    return named.withColumnRenamed("event_severity", "severity").withColumn("legal", F.coalesce(legal, F.lit(False)))


def append_events(new: DataFrame, store: str, rejects: str | None = None) -> DataFrame:
    """Append legal events to ``store`` and return the rejected ones, which go to ``rejects`` if given."""
    ready = classify_events(new)
    ready.where("legal").drop("legal", "event_name").write.mode("append").parquet(store)
    refused = ready.where("not legal").drop("legal")
    if rejects:
        refused.write.mode("append").parquet(rejects)
    return refused
