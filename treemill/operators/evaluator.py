"""From stored answers to evaluation records.

An answer is routed by what is wrong with it (API error, nothing stored, no or broken
JSON, other than the wanted fields) or scored against gold.  The strict JSON rules run
in Arrow batches over the answers alone; all else is column expressions, and nothing is
shuffled.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from treemill.functions import tokens as tok
from treemill.operators import answers, trees

# fixed values: beginnings of the messages by status
MESSAGES = {
    "empty": "empty_response: raw_response is null", "no_json": "json_decode_error: No JSON object found in response (no '{' character)",
    "decode_error": "json_decode_error: ", "schema_error": "schema_error: tokens with id, form, upos, head and deprel are wanted",
}
#: Given as types: a worker imports this module without a session that could read a type's text.
_TOKEN = T.StructType([T.StructField(f, T.IntegerType() if f in ("id", "head") else T.StringType()) for f in answers.FIELDS])
_PARSED = T.StructType([T.StructField("status", T.StringType()), T.StructField("tokens", T.ArrayType(_TOKEN)), T.StructField("message", T.StringType())])


def explained(raw: str | None) -> tuple[str, list[dict] | None, str | None]:
    """Status, tokens and message of one answer; a blank one that is stored has no JSON."""
    status, tokens = answers.parse_answer(raw)
    if status == "parsed":
        return status, tokens, None
    if status == "empty" and raw:
        status = "no_json"
    message = MESSAGES[status]
    if status == "decode_error":
        text = (raw or "").strip()
        try:
            json.loads(text[text.find("{") :])
        except (ValueError, RecursionError) as error:
            message += str(error)
    return status, None, message


@F.pandas_udf(_PARSED)
def _explain(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([explained(r) for r in raw], columns=["status", "tokens", "message"])


def counted(gold: Column, exclude_punct: bool) -> Column:
    """The gold tokens that count."""
    return tok.scored(gold) if exclude_punct else gold


def evaluated(calls: DataFrame, raw: str = "raw_response", gold: str = "gold", api_error: str = "api_error", exclude_punct: bool = True) -> DataFrame:
    """``calls`` with ``status, llm_parse, uas, las, exclude_punct, token_errors, structural_warnings, cot_reasoning, validation_error``.

    Scores are rounded to four places, 0 without a token that counts, and null without a
    parse or gold; so are the errors.  An API error comes before all else and leaves the
    answer unread.  Repeated and null rows stay; other columns are kept.
    """
    failed = F.coalesce(F.length(F.col(api_error)) > 0, F.lit(False))
    rows = calls.withColumn("_answer", F.when(~failed, F.col(raw)))
    rows = rows.withColumn("_read", _explain("_answer"))
    rows = rows.withColumn("status", F.when(failed, "api_error").otherwise(F.col("_read.status"))).withColumn("llm_parse", F.when(~failed, F.col("_read.tokens")))
    rows = rows.withColumn("_facts", F.when(F.col("llm_parse").isNotNull(), tok.token_facts(counted(F.col(gold), exclude_punct), F.col("llm_parse"))))
    share = lambda c: F.when(F.col("_facts").isNotNull(), F.bround(F.coalesce(F.try_divide(F.size(F.filter("_facts", lambda x: x[c])), F.size("_facts")), F.lit(0.0)), 4))

    def error(f: Column) -> Column:
        fields = [f["id"].alias("token_id"), f["form"].alias("form"), f["upos"].alias("gold_upos"), f["head"].alias("gold_head"), f["deprel"].alias("gold_deprel")]
        return F.struct(*fields, f["p_head"].alias("pred_head"), f["p_deprel"].alias("pred_deprel"), tok.error_type(f).alias("error_type"))

    errors = F.filter(F.transform("_facts", error), lambda e: e["error_type"].isNotNull())
    readable = F.col("status").isin("parsed", "schema_error")
    return rows.select(
        *calls.columns, "status", "llm_parse", share("uas").alias("uas"), share("las").alias("las"), F.lit(exclude_punct).alias("exclude_punct"), errors.alias("token_errors"),
        trees.root_warnings(F.col("llm_parse")).alias("structural_warnings"), F.when(readable, answers.reasoning_part(F.col("_answer"))).alias("cot_reasoning"),
        F.when(~failed, F.col("_read.message")).alias("validation_error"),
    )


def totals(records: DataFrame, *by: str) -> DataFrame:
    """Outcomes of evaluation records, and the mean of their sentence scores in ten-thousandths."""
    mean = lambda c: F.try_divide(F.sum(F.round(F.col(c) * 10000).cast("long")), F.count(c))
    return records.groupBy(*by).agg(
        F.count("*").alias("total"), F.count("uas").alias("scored"), F.count_if(F.length("validation_error") > 0).alias("validation_errors"), F.count_if(F.length("api_error") > 0).alias("api_errors"),
        F.count_if(F.exists("structural_warnings", lambda w: w.contains("no_root"))).alias("no_root"), mean("uas").alias("mean_uas_bp"), mean("las").alias("mean_las_bp"),
    )
