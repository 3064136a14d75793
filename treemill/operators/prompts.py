"""Prompts: building them, and checking stored ones."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treemill.functions import text as tx

DEMONSTRATIONS = 3


def user_message(text: Column, gold: Column) -> Column:
    """First-pass message: the text and its numbered words."""
    return F.concat(F.lit("# text = "), text, F.lit("\n"), tx.token_lines(gold))


def demonstration(text: Column, gold: Column) -> Column:
    """A worked example: input as in a message, output as JSON."""
    return F.concat(F.lit("Input:\n"), user_message(text, gold), F.lit("\n\nOutput:\n"), tx.tokens_json(gold))


def critique_message(text: Column, gold: Column, parse: Column) -> Column:
    """Second-pass message with the first parse."""
    return F.concat(F.lit("Sentence: "), text, F.lit("\n\nTokens:\n"), tx.token_lines(gold), F.lit("\n\nExisting parse:\n"), tx.tokens_json(parse, ascii_only=True))


def short_critique_message(text: Column, parse: Column) -> Column:
    """The same without the list of words."""
    return F.concat(F.lit("# text = "), text, F.lit("\n\nExisting parse:\n"), tx.tokens_json(parse, ascii_only=True))


def system_message(base: Column, blocks: Column) -> Column:
    """Instructions and the demonstrations after them."""
    return F.concat_ws("\n\n", base, F.array_join(blocks, "\n\n"))


def assembled(queries: DataFrame, pool: DataFrame, base: str) -> DataFrame:
    """``query, system``: each query's system message from its retrieved examples in order.

    ``queries`` has ``query, place, key`` and ``pool`` has ``key, block``.
    """
    rows = queries.join(pool, "key")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"])
    return rows.groupBy("query").agg(system_message(F.lit(base), blocks).alias("system"))


def pair_hash(system: Column, user: Column) -> Column:
    """SHA-256 of the two messages with a zero byte between them."""
    return F.sha2(F.concat(system, F.lit("\x00"), user), 256)


def retrieved_texts(system: Column) -> Column:
    """Texts of the demonstrations in a system message."""
    return F.regexp_extract_all(system, F.lit("Input:\n# text = ([^\n]+)"), 1)


def valid_demonstrations(system: str | None, base: str, wanted: int = DEMONSTRATIONS) -> bool:
    """Whether a system message is the base and exactly so many well-formed examples."""
    if system is None or not system.startswith(base + "\n\n"):
        return False
    parts = system[len(base) :].split("\n\nInput:\n# text = ")
    if parts[0] or len(parts) != wanted + 1:
        return False
    for part in parts[1:]:
        _, mark, answer = part.partition("\n\nOutput:\n")
        try:
            found = json.loads(answer) if mark else None
        except ValueError:
            return False
        if not isinstance(found, dict) or not isinstance(found.get("tokens"), list):
            return False
    return True


def demonstration_check(rows: DataFrame, key: str, system: str, base: str) -> DataFrame:
    """``key`` and ``valid`` for every row, in Arrow batches; null messages are not valid."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "valid": [valid_demonstrations(s, base) for s in batch["s"]]})

    return rows.select(F.col(key).alias("key"), F.col(system).alias("s")).mapInPandas(run, f"key {kind}, valid boolean").withColumnRenamed("key", key)


def audit(calls: DataFrame, *by: str) -> DataFrame:
    """Per group: calls, those whose user message is the one built from gold, distinct messages, and whether all match.

    ``calls`` has ``system, user, text, gold``.
    """
    matches = F.coalesce(F.col("user") == user_message(F.col("text"), F.col("gold")), F.lit(False))
    rows = calls.select(*by, matches.alias("m"), pair_hash(F.col("system"), F.col("user")).alias("h"))
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("m").alias("matching"), F.countDistinct("h").alias("distinct_prompts"), F.bool_and("m").alias("all_match"))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order."""
    return rows.orderBy(*order).limit(n)


def last_delivery(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """One row per key, the last by time."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last(time), F.desc_nulls_last(tie)))).filter("_rank = 1").drop("_rank")
