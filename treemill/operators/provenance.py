"""Where stored prompts come from: the messages that can be built again, and which of them a call used."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from treemill.operators import prompts


def base_part(system: Column) -> Column:
    """A system message up to its first example."""
    return F.substring_index(system, "\n\nInput:", 1)


def bases(calls: DataFrame, condition: str) -> DataFrame:
    """``condition, base``: the instructions that most calls of a condition have, ties going to the smaller text."""
    counted = calls.filter("system is not null").groupBy(condition, base_part(F.col("system")).alias("base")).agg(F.count("*").alias("n"))
    return counted.withColumn("_rank", F.row_number().over(W.partitionBy(condition).orderBy(F.desc("n"), "base"))).filter("_rank = 1").select(condition, "base")


@F.pandas_udf(T.BooleanType())
def valid_demonstrations(system: pd.Series, base: pd.Series) -> pd.Series:
    """Whether a system message is its base and exactly three well-formed examples, in Arrow batches."""
    return pd.Series([b is not None and prompts.valid_demonstrations(s, b) for s, b in zip(system, base)])


def records(calls: DataFrame, condition: str, retrieval: tuple[str, ...], critique: str) -> DataFrame:
    """``calls`` with hashes of their messages, what the system message matches, and the template of the user message.

    ``calls`` has ``system, user, gold_text, gold, source_parse, base``.  A critique call
    follows the standard or the short message with the parse that it corrects, another
    call the first-pass message; ``user_template`` is null where none fits.  Null
    messages, gold or source parses fit nothing.
    """
    is_retrieval, is_critique = F.col(condition).isin(*retrieval), F.col(condition) == critique
    standard = prompts.critique_message(F.col("gold_text"), F.col("gold"), F.col("source_parse"))
    short = prompts.short_critique_message(F.col("gold_text"), F.col("source_parse"))
    first = prompts.user_message(F.col("gold_text"), F.col("gold"))
    template = F.when(is_critique, F.when(F.col("user") == standard, "standard_critique").when(F.col("user") == short, "short_critique")).when(F.col("user") == first, "first_pass")
    checked = F.coalesce(valid_demonstrations(F.when(is_retrieval, F.col("system")), F.col("base")), F.lit(False))
    return calls.select(
        "*", F.sha2("system", 256).alias("system_sha256"), F.sha2("user", 256).alias("user_sha256"), prompts.pair_hash(F.col("system"), F.col("user")).alias("prompt_pair_sha256"),
        template.alias("user_template"), (~is_retrieval & F.coalesce(F.col("system") == F.col("base"), F.lit(False))).alias("static_match"), (is_retrieval & checked).alias("retrieval_match"),
    )


def audit(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of ``records`` by group: matches of each kind, distinct messages, and whether every call is verified."""
    count = lambda name: F.count_if(F.col("user_template") == name)
    return rows.groupBy(*by).agg(
        F.count("*").alias("record_count"), F.count_if("static_match").alias("static_system_matches"), F.count_if("retrieval_match").alias("retrieval_template_matches"),
        F.count("user_template").alias("regenerated_user_matches"), count("standard_critique").alias("standard_critique_user_matches"), count("short_critique").alias("short_critique_user_matches"),
        F.countDistinct("system_sha256").alias("unique_system_prompts"), F.countDistinct("user_sha256").alias("unique_user_messages"), F.countDistinct("prompt_pair_sha256").alias("unique_prompt_pairs"),
        F.bool_and(F.col("static_match") | F.col("retrieval_match")).alias("system_verified"), F.bool_and(F.col("user_template").isNotNull()).alias("user_verified"),
    )
