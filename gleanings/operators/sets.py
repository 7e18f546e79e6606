"""Unions and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the target, replaced by or joined with those of updates by key."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def replace_group(target: DataFrame, rows: DataFrame, group: str, order: str, written: str = "draft_id") -> DataFrame:
    """All rows of the groups in ``rows`` replaced and numbered anew; a group of which any row is already written stays as it is."""
    refused = target.filter(F.col(written).isNotNull()).select(group).distinct()
    fresh = rows.join(refused, group, "left_anti")
    fresh = fresh.withColumn(order, F.row_number().over(W.partitionBy(group).orderBy(order)).cast(rows.schema[order].dataType))
    return target.join(fresh.select(group).distinct(), group, "left_anti").unionByName(fresh)


def added_count(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows add_if_absent() adds."""
    return rows.join(target.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("added"))


def add_if_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target and those rows whose key it lacks."""
    return target.unionByName(rows.join(target.select(key).distinct(), key, "left_anti"))
