"""Answers from a chat service as a DataFrame source with an injected client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Client = Callable[[str, str], dict]
ATTEMPTS = 3


def call(client: Client, system: str, user: str, wait: Callable[[float], None] = time.sleep) -> dict:
    """One answer; failures are tried again after one and then two seconds, and the last is kept as an error."""
    error = None
    for attempt in range(ATTEMPTS):
        try:
            found = client(system, user)
            usage = found.get("usage") or {}
            return {"raw_response": found.get("content"), "reasoning_content": found.get("reasoning"), **{k: usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}, "api_error": None, "api_success": True}
        except Exception as failed:  # noqa: BLE001  any failure of the service counts as one
            error = f"{type(failed).__name__}: {failed}"
            if attempt + 1 < ATTEMPTS:
                wait(float(attempt + 1))
    return {"raw_response": None, "reasoning_content": None, "prompt_tokens": None, "completion_tokens": None, "total_tokens": None, "api_error": error, "api_success": False}


ANSWER = "raw_response string, reasoning_content string, prompt_tokens int, completion_tokens int, total_tokens int, api_error string, api_success boolean"


def answered(prompts: DataFrame, key: str, make_client: Callable[[], Client], concurrency: int = 8) -> DataFrame:
    """``key`` and the answer to each row's ``system`` and ``user``; one client a task, at most ``concurrency`` tasks."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = [{"key": k} | call(client, s, u) for k, s, u in zip(batch["key"], batch["system"], batch["user"])]
            yield pd.DataFrame(rows, columns=["key", *[c.split()[0] for c in ANSWER.split(", ")]])

    rows = prompts.select(F.col(key).alias("key"), "system", "user").repartition(concurrency)
    return rows.mapInPandas(run, f"key {kind}, {ANSWER}").withColumnRenamed("key", key)
