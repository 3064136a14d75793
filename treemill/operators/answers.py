"""Raw answers: where the JSON begins, what it parses to, and why it does not."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from treemill.functions import text as tx

TOKEN = "struct<id:int,form:string,upos:string,head:int,deprel:string>"
FIELDS = ("id", "form", "upos", "head", "deprel")


def json_part(raw: Column) -> Column:
    """From the first brace to the end of the stripped answer; null without a brace."""
    s = tx.strip(raw)
    return F.when(F.instr(s, "{") > 0, F.substring(s, F.instr(s, "{"), F.length(s)))


def reasoning_part(raw: Column) -> Column:
    """What stands before the first brace, stripped; null if nothing does."""
    s = tx.strip(raw)
    before = tx.strip(F.substring(s, F.lit(1), F.instr(s, "{") - 1))
    return F.when((F.instr(s, "{") > 1) & (before != ""), before)


def whole_number(value: Any) -> int:
    """An integer from a truth value, an integer, a whole float, or a text that reads as one; else an error."""
    if isinstance(value, float):
        if not value.is_integer():
            raise ValueError(value)
        return int(value)
    if isinstance(value, (bool, int, str)):
        return int(value)
    raise ValueError(value)


def parse_answer(raw: str | None) -> tuple[str, list[dict] | None]:
    """Status and tokens: ``empty``, ``no_json``, ``decode_error``, ``schema_error`` or ``parsed``."""
    text = (raw or "").strip()
    if not text:
        return "empty", None
    start = text.find("{")
    if start < 0:
        return "no_json", None
    try:
        found = json.loads(text[start:])
    except (ValueError, RecursionError):
        return "decode_error", None
    tokens = found.get("tokens") if isinstance(found, dict) else None
    if not isinstance(tokens, list):
        return "schema_error", None
    out = []
    try:
        for token in tokens:
            values = [token[f] for f in FIELDS] if isinstance(token, dict) else None
            if values is None:
                return "schema_error", None
            row = {f: whole_number(v) if f in ("id", "head") else v if isinstance(v, str) else str(v) for f, v in zip(FIELDS, values)}
            if max(abs(row["id"]), abs(row["head"])) > 2**31 - 1:
                return "schema_error", None
            out.append(row)
    except (KeyError, TypeError, ValueError, OverflowError):
        return "schema_error", None
    return "parsed", out


def parsed(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """``key, status, tokens`` for every answer, in Arrow batches.

    Built-in JSON functions take trailing text and missing keys; the rules here do not.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse_answer(r) for r in batch["raw"]]
            yield pd.DataFrame({"key": batch["key"], "status": [s for s, _ in found], "tokens": [t for _, t in found]})

    out = rows.select(F.col(key).alias("key"), F.col(raw).alias("raw")).mapInPandas(run, f"key {kind}, status string, tokens array<{TOKEN}>")
    return out.withColumnRenamed("key", key)


def routed(rows: DataFrame, key: str, raw: str, api_error: str) -> DataFrame:
    """``key, status, tokens`` with ``api_error`` before all other statuses."""
    failed = F.length(F.col(api_error)) > 0
    errors = rows.filter(failed).select(key, F.lit("api_error").alias("status"), F.lit(None).cast(f"array<{TOKEN}>").alias("tokens"))
    return parsed(rows.filter(~F.coalesce(failed, F.lit(False))), key, raw).unionByName(errors)
