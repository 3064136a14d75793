"""Injected models: taggers and sentence encoders, one a task, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Tagger = Callable[[list[str]], list[list[str]]]
Encoder = Callable[[list[str]], list[list[float]]]

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_", re.U)
# fixed values: closed classes of the rule tagger
CLOSED = {
    "DET": "the a an this that these those each every our their its my your his her some any no", "CCONJ": "and or but nor", "SCONJ": "because although while if unless since when", "ADP": "of in on at by for with from to under over near across behind beyond without before after",
    "PRON": "i you he she it we they who which what me him them us", "AUX": "is are was were be been am can could may might must shall should will would do does did have has had", "PART": "not",
}
_TAG = {word: tag for tag, listed in CLOSED.items() for word in listed.split()}


def rule_tagger(texts: list[str]) -> list[list[str]]:
    """A deterministic stand-in for a trained tagger: closed classes, numbers, punctuation, and endings."""

    def tag(word: str) -> str:
        low = word.lower()
        if low in _TAG:
            return _TAG[low]
        if word.isdigit():
            return "NUM"
        if not any(c.isalnum() for c in word):
            return "PUNCT"
        if low.endswith("ly"):
            return "ADV"
        if low.endswith(("ed", "ing")):
            return "VERB"
        return "PROPN" if word[0].isupper() else "ADJ" if low.endswith(("ful", "ous", "y", "ive")) else "NOUN"

    return [[tag(w) for w in _TOKEN.findall(t or "")] for t in texts]


def tagged(rows: DataFrame, key: str, text: str, make_tagger: Callable[[], Tagger] = lambda: rule_tagger) -> DataFrame:
    """``key, text, tags``; null texts have no tags."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = make_tagger()
        for batch in batches:
            yield batch.assign(tags=tagger([t or "" for t in batch["text"]]))

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, text string, tags array<string>")


def encoded(rows: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """``key, text, vectors`` from an injected sentence encoder."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            yield batch.assign(vectors=encoder([t or "" for t in batch["text"]]))

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, text string, vectors array<float>")
