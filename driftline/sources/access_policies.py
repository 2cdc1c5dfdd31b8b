"""Access-policy documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ITEM = ("accesses:array<struct<type:string,isAllowed:boolean>>,users:array<string>,groups:array<string>,"
         "conditions:array<struct<type:string,values:array<string>>>,delegateAdmin:boolean")
SCHEMA = (
    "service string, name string, description string, policyType int, isEnabled boolean, "
    "resources map<string,struct<values:array<string>,isExcludes:boolean,isRecursive:boolean>>, "
    f"policyItems array<struct<{_ITEM}>>, denyPolicyItems array<struct<{_ITEM}>>, "
    f"allowExceptions array<struct<{_ITEM}>>, denyExceptions array<struct<{_ITEM}>>, "
    f"dataMaskPolicyItems array<struct<{_ITEM},dataMaskInfo:struct<dataMaskType:string,valueExpr:string>>>, "
    f"rowFilterPolicyItems array<struct<{_ITEM},rowFilterInfo:struct<filterExpr:string>>>"
)
# Resource that names the dataset, per dataset kind.
RESOURCE_OF = {"FS": "path", "HIVE": "database"}
# Name of the export file, per dataset kind.
EXPORT_FILE = {"FS": "hdfs", "HIVE": "hive"}


def read_access_policies(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=multi_line)


def write_access_policies(policies: DataFrame, folder: str, kind: str) -> str:
    """Write one export per dataset kind and return where it is."""
    path = f"{folder.rstrip('/')}/{EXPORT_FILE[kind]}"
    policies.write.mode("overwrite").json(path)
    return path
