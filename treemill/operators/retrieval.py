"""Similar sentences by tag signature or by vector.

Queries and pool meet in blocks: the pool is dealt to shards and the queries to blocks,
both of bounded size, and each pair of them is one matrix product.  Ties in similarity,
rounded to nine places so that no engine's order of summation decides, go to the smaller
key; equal texts count once and a query's own text never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treemill.plans.session import cut

SHARD_ROWS, BLOCK_ROWS = 50_000, 4_096
#: Queries whose products with a shard are held at once.
AT_ONCE = 64
# fixed values: weights of the parts of a signature
WEIGHTS = {"length": 0.2, "tag": 0.3, "bigram": 0.4, "ratio": 0.1}


def bigrams(tags: Column) -> Column:
    """Neighbouring tags joined by a blank, in order."""
    return F.zip_with(F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))), F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def vocabulary(rows: DataFrame, tags: Column, kind: str) -> DataFrame:
    """``term, place``: distinct tags (``kind='tag'``) or tag pairs, numbered in order.

    A tag set is a closed list, so the few distinct terms fit in one ordered task.
    """
    terms = rows.select(F.explode(tags if kind == "tag" else bigrams(tags)).alias("term")).filter("term is not null").distinct()
    return terms.withColumn("place", F.row_number().over(W.orderBy("term")) - 1)


def vocabularies(rows: DataFrame, tags: Column) -> tuple[list[str], list[str]]:
    """Distinct tags and distinct tag pairs, each in order, from one pass over the rows; a tag set is a closed list, so both are few."""
    each = F.concat(F.transform(tags, lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("term"))), F.transform(bigrams(tags), lambda t: F.struct(F.lit("bigram").alias("kind"), t.alias("term"))))
    found = rows.select(F.explode(each).alias("t")).select("t.*").filter("term is not null").distinct().collect()
    return sorted(r.term for r in found if r.kind == "tag"), sorted(r.term for r in found if r.kind == "bigram")


def ratios(tags: Column) -> dict[str, Column]:
    """The length features and tag ratios of a signature; null for an empty sentence."""
    n = F.size(tags)
    share = lambda *kinds: F.try_divide(F.size(F.filter(tags, lambda t: t.isin(*kinds))), n)
    return {
        "length": n / (n + 10), "punct": share("PUNCT"), "verb": share("VERB", "AUX"), "cconj": share("CCONJ"), "sconj": share("SCONJ"),
        "noun": share("NOUN"), "adp": share("ADP"), "pron": share("PRON"),
    }


def signature(tags: list[str], tag_place: dict[str, int], pair_place: dict[str, int]) -> np.ndarray:
    """Normalised vector of a tag sequence over fixed vocabularies; zeros for an empty one.

    Five length features, tag shares, shares of neighbouring pairs and four ratios, each
    part with its weight.
    """
    n = len(tags)
    out = np.zeros(9 + len(tag_place) + len(pair_place))
    if not n:
        return out
    count = lambda *kinds: sum(t in kinds for t in tags)
    verbs = count("VERB", "AUX")
    out[:5] = np.array([n / (n + 10), count("PUNCT") / n, verbs / n, count("CCONJ") / n, count("SCONJ") / n]) * WEIGHTS["length"]
    at = 5
    for t in tags:
        if t in tag_place:
            out[at + tag_place[t]] += WEIGHTS["tag"] / n
    at += len(tag_place)
    for pair in zip(tags, tags[1:]):
        place = pair_place.get(" ".join(pair))
        if place is not None:
            out[at + place] += WEIGHTS["bigram"] / max(1, n - 1)
    out[-4:] = np.array([count("NOUN") / n, verbs / n, count("ADP") / n, count("PRON") / n]) * WEIGHTS["ratio"]
    size = np.linalg.norm(out)
    return out / size if size else out


def signatures(rows: DataFrame, key: str, text: str, tags: str, tag_terms: list[str], pair_terms: list[str]) -> DataFrame:
    """``key, text, size, vec`` of every row with tags."""
    tag_place, pair_place = {t: n for n, t in enumerate(tag_terms)}, {t: n for n, t in enumerate(pair_terms)}
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signature([t for t in ts if t is not None], tag_place, pair_place) for ts in batch["tags"]]
            yield pd.DataFrame({"key": batch["key"], "text": batch["text"], "size": [len(t) for t in batch["tags"]], "vec": [v.tobytes() for v in found]})

    wanted = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(tags).alias("tags")).filter("tags is not null")
    return wanted.mapInPandas(run, f"key {kind}, text string, size int, vec binary")


def named_entries(rows: DataFrame, key: str, tag_terms: list[str], pair_terms: list[str]) -> DataFrame:
    """``key, dim, value``: the entries of ``signatures`` that are not zero, rounded to nine places."""
    names = np.array(["l1", "l2", "l3", "l4", "l5", *(f"tag{t}" for t in tag_terms), *(f"bigram{t}" for t in pair_terms), "r1", "r2", "r3", "r4"], dtype=object)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, packed in zip(batch["key"], batch["vec"]):
                vector = np.frombuffer(packed, dtype=np.float64)
                at = np.flatnonzero(vector)
                yield pd.DataFrame({"key": own, "dim": names[at], "value": vector[at]})

    entries = rows.select("key", "vec").mapInPandas(run, f"key {kind}, dim string, value double")
    return entries.select(F.col("key").alias(key), "dim", F.round("value", 9).alias("value"))


def unit_rows(rows: DataFrame, key: str, text: str, vector: str) -> DataFrame:
    """``key, text, size, vec`` of every row with a usable vector, which is brought to length 1."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = np.array(batch["v"].tolist(), dtype=np.float64)
            if len(matrix):
                matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.DataFrame({"key": batch["key"], "text": batch["text"], "size": 0, "vec": [v.tobytes() for v in matrix]})

    usable = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(vector).alias("v")).filter("exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x))")
    return usable.mapInPandas(run, f"key {kind}, text string, size int, vec binary")


def top_similar(queries: DataFrame, pool: DataFrame, k: int, window: bool) -> DataFrame:
    """``query, place, key``: the ``k`` most similar pool rows of each query.

    With ``window`` only pool rows whose size differs by at most ``max(3, 0.3 * size)``
    count, unless none does.  Both sides have ``key, text, size, vec``.
    """
    queries, pool = cut(queries), cut(pool)
    shards, blocks = max(1, -(-pool.count() // SHARD_ROWS)), max(1, -(-queries.count() // BLOCK_ROWS))
    dealt = pool.select(F.lit(False).alias("asks"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast(queries.schema["key"].dataType).alias("query"), "key", "text", "size", "vec")
    asked = queries.select(F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.col("key").alias("query"), F.lit(None).cast(pool.schema["key"].dataType).alias("key"), "text", "size", "vec")
    q_kind, p_kind = queries.schema["key"].dataType.simpleString(), pool.schema["key"].dataType.simpleString()

    def one(own: pd.DataFrame) -> pd.DataFrame:
        asks = own["asks"].to_numpy(dtype=bool)
        left, right = own[asks], own[~asks].sort_values("key")
        out: list[tuple] = []
        if len(left) and len(right):
            a = np.frombuffer(b"".join(left["vec"]), dtype=np.float64).reshape(len(left), -1)
            b = np.frombuffer(b"".join(right["vec"]), dtype=np.float64).reshape(len(right), -1)
            sizes, texts, keys = right["size"].to_numpy(), [str(t).strip() for t in right["text"]], right["key"].tolist()
            for n, (query, text, size) in enumerate(zip(left["query"], left["text"], left["size"])):
                if n % AT_ONCE == 0:
                    products = np.round(a[n : n + AT_ONCE] @ b.T, 9)
                close = products[n % AT_ONCE]
                near = np.abs(sizes - size) <= max(3, int(0.3 * size)) if window else np.ones(len(b), dtype=bool)
                for inside in (True, False) if window else (True,):
                    picked = _pick(np.where(near, close, -9.0) if inside else close, texts, str(text).strip(), k)
                    out += [(query, keys[i], texts[i], float(close[i]), inside) for i in picked]
        return pd.DataFrame(out, columns=["query", "key", "text", "close", "inside"])

    found = dealt.unionByName(asked).groupBy("shard", "block").applyInPandas(one, f"query {q_kind}, key {p_kind}, text string, close double, inside boolean")
    order = [F.desc("inside"), F.desc("close"), F.asc("key")]
    kept = found.withColumn("any", F.max("inside").over(W.partitionBy("query"))).filter("inside = any")
    once = kept.withColumn("again", F.row_number().over(W.partitionBy("query", "text").orderBy(*order))).filter("again = 1")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k)
    return placed.select("query", "place", "key")


def _pick(close: np.ndarray, texts: list[str], own: str, k: int) -> list[int]:
    """Places of the best ``k`` of different texts, best first; ties by place; -9 marks what does not count."""
    size = min(len(close), 16 * k)
    while True:
        edge = np.partition(close, len(close) - size)[len(close) - size]
        best = np.flatnonzero(close >= edge)
        best = best[np.lexsort((best, -close[best]))]
        seen, out = {own}, []
        for i in best:
            if close[i] > -9 and texts[i] not in seen:
                seen.add(texts[i])
                out.append(int(i))
                if len(out) == k:
                    return out
        if size == len(close):
            return out
        size = min(len(close), 8 * size)
