"""Progress of collection: what is pending, what is done, and status updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATES = ("PENDING", "DONE", "FAIL")


def state(status: Column) -> Column:
    """A status without case and outer white space; null stays null."""
    return F.upper(F.trim(status))


def pending(tracker: DataFrame, column: str) -> DataFrame:
    """Rows still to be collected for one experiment; repeated sentences stay."""
    return tracker.filter(state(F.col(column)) == "PENDING")


def backlog(tracker: DataFrame, column: str, sources: DataFrame, done: DataFrame, key: str = "sent_id") -> DataFrame:
    """Distinct pending keys that have a source and no result yet."""
    keys = pending(tracker, column).select(key).filter(F.col(key).isNotNull()).distinct()
    return keys.join(sources.select(key), key, "left_semi").join(done.select(key), key, "left_anti")


def updated(tracker: DataFrame, column: str, results: DataFrame, key: str = "sent_id") -> DataFrame:
    """The tracker with new states of one experiment; keys without a result keep theirs.

    ``results`` has the key and ``status``; of several results of a key the best counts.
    """
    best = results.groupBy(key).agg(F.when(F.bool_or(F.col("status") == "DONE"), "DONE").otherwise(F.max("status")).alias("_new"))
    return tracker.join(best, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def initial(ids: DataFrame, experiments: int = 6, key: str = "sent_id") -> DataFrame:
    """A tracker with every experiment pending; empty, null or repeated ids are an error when it is written."""
    checked = ids.groupBy(key).agg(F.count("*").alias("_n"))
    unique = F.when((F.col("_n") > 1) | F.col(key).isNull() | (F.trim(key) == ""), F.raise_error(F.lit("sentence ids must be unique and not empty"))).otherwise(F.col(key))
    return checked.select(unique.alias(key), *[F.lit("PENDING").alias(f"experiment{n}_status") for n in range(1, experiments + 1)])
