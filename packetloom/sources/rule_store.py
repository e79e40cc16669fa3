"""Versions of a rule table that running streams follow.

A store is a folder with whole rule tables and a commit log of versions. A
version is written in full first and then committed under the next number, so
readers see the old or the new table and two writers cannot both make the same
version: the one that comes second applies its changes to the other's table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from packetloom.operators.rules import apply_rule_changes
from packetloom.schemas import RULE_TABLE
from packetloom.sources.commit_log import create_entry, numbers, read_entry


def _commit(rules: DataFrame, path: str, version: int) -> bool:
    folder = f"tables/{uuid.uuid4().hex}"
    rules.select(*RULE_TABLE.fieldNames()).write.parquet(f"{path}/{folder}")
    return create_entry(rules.sparkSession, f"{path}/versions", version, folder)


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 before the first."""
    return max(numbers(spark, f"{path}/versions"), default=0)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rules of a version; version 0 has none."""
    if version == 0:
        return spark.createDataFrame([], RULE_TABLE)
    folder = read_entry(spark, f"{path}/versions", version)
    if folder is None:
        raise ValueError(f"there is no version {version} of the rules in {path}")
    return spark.read.schema(RULE_TABLE).parquet(f"{path}/{folder}")


def publish_rules(rules: DataFrame, path: str) -> int:
    """Make ``rules`` the newest version and return its number."""
    while True:
        version = current_version(rules.sparkSession, path) + 1
        if _commit(rules, path, version):
            return version


def change_rules(changes: DataFrame, path: str) -> int:
    """Apply adds, deletes and toggles (see ``apply_rule_changes``) to the newest version."""
    spark = changes.sparkSession
    while True:
        version = current_version(spark, path)
        if _commit(apply_rule_changes(read_version(spark, path, version), changes), path, version + 1):
            return version + 1
