"""Checks of stored data against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def key_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that only one table has; null keys and repetitions are not compared."""
    a = first.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(True))
    b = second.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(True))
    both = a.join(b, key, "full").filter("a is null or b is null")
    return both.select(key, F.when(F.col("a").isNull(), "second").otherwise("first").alias("side"))


def unequal(first: DataFrame, second: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of both tables whose column differs, null being equal to null."""
    b = second.select(key, F.col(column).alias("_other"))
    return first.join(b, key).filter(~F.col(column).eqNullSafe(F.col("_other"))).select(key)


def manifest(files: DataFrame) -> DataFrame:
    """``path, sha256, bytes`` of files read as ``binaryFile``."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_check(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files that are missing or changed: ``path, problem``."""
    have = manifest(files).select("path", F.col("sha256").alias("have"))
    rows = expected.join(have, "path", "left")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("sha256"), "changed")
    return rows.select("path", problem.alias("problem")).filter("problem is not null")


def assert_empty(violations: DataFrame, message: str) -> None:
    """Raises if a check that should find nothing finds something; reads one row at most."""
    first = violations.take(1)
    if first:
        raise AssertionError(f"{message}: {first[0].asDict()}")
