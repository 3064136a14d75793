"""Paired bootstrap, Holm's correction, and seeded samples.

A resample never becomes rows of sentences: every sentence gets its weight in each
resample from a hash of seed, resample and draw, and the systems' counts are columns of
that sentence, so one aggregation per resample serves all systems at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treemill.plans.session import cut

#: Up to this many sentences, their counts are one matrix on every executor (under 60 MB for 13 columns); beyond it draws are joined.
MATRIX_ROWS = 500_000
#: Tasks over the resamples, and draws hashed at once (they stay in the cache).
TASKS, BLOCK = 96, 16_384
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(n + 1)) * 2**32) & 0xFFFFFFFF) for n in range(64)]


def drawn(seed: int, resample: Column, draw: Column, n: Column) -> Column:
    """Index from 0 below ``n`` for one draw of one resample, the same on every engine that has MD5."""
    digest = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), resample.cast("string"), draw.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), n.cast("long"))


def weights(numbered: DataFrame, resamples: int, seed: int) -> DataFrame:
    """``b, i, w``: how often sentence ``i`` is drawn in resample ``b``; ``numbered`` has ``i`` and the total ``n``.

    Each sentence makes the draw of its own number in every resample; weights are summed
    before they are joined, so at most one row per sentence and resample is moved.
    """
    each = numbered.select("i", "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    hits = each.select("b", drawn(seed, F.col("b"), F.col("i"), F.col("n")).alias("i"))
    return hits.groupBy("b", "i").agg(F.count("*").alias("w"))


def resample_sums(numbered: DataFrame, columns: list[str], resamples: int, seed: int) -> DataFrame:
    """``resample`` and the resampled sum of each column."""
    values = numbered.select("i", F.struct(*columns).alias("value"))
    joined = weights(numbered, resamples, seed).join(values, "i")
    return joined.groupBy(F.col("b").alias("resample")).agg(*[F.sum(F.col("value")[c] * F.col("w")).alias(c) for c in columns])


def _first_word(message: list[np.ndarray | None], size: int) -> np.ndarray:
    """First word of the MD5 of ``size`` one-block messages, given as their 16 words (None: zero); the last three steps do not touch it."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for n in range(61):
        turn = n // 16
        if turn == 0:
            f, at = d ^ (b & (c ^ d)), n
        elif turn == 1:
            f, at = c ^ (d & (b ^ c)), (5 * n + 1) % 16
        elif turn == 2:
            f, at = b ^ c ^ d, (3 * n + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * n % 16
        f += a
        f += _SINES[n]
        if message[at] is not None:
            f += message[at]
        shift = _SHIFTS[turn][n % 4]
        moved = f << np.uint32(shift)
        f >>= np.uint32(32 - shift)
        moved |= f
        moved += b
        a, d, c, b = d, c, b, moved
    return b + np.uint32(0x67452301)


def _messages(before: int, start: int, stop: int) -> list[np.ndarray | None]:
    """MD5 blocks of the numbers from ``start`` below ``stop`` behind ``before`` bytes left open, as 16 words each."""
    texts = (str(i).encode() for i in range(start, stop))
    blocks = b"".join((bytes(before) + t + b"\x80").ljust(56, b"\0") + (8 * (before + len(t))).to_bytes(8, "little") for t in texts)
    table = np.frombuffer(blocks, "<u4").reshape(-1, 16).T
    return [np.ascontiguousarray(row) if row.any() else None for row in table]


def draws(seed: int, resample: int, n: int, known: dict) -> np.ndarray:
    """What ``drawn`` gives for draws 0 to ``n - 1`` of one resample; ``known`` keeps message blocks between calls."""
    prefix = f"{seed}-{resample}-".encode()
    fixed = np.frombuffer(prefix.ljust(64, b"\0"), "<u4")
    out = np.empty(n, np.int64)
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        key = (len(prefix), start)
        if key not in known:
            known[key] = _messages(len(prefix), start, stop)
        words = [np.full(stop - start, x, np.uint32) if w is None and x else w if not x else w | x for w, x in zip(known[key], fixed)]
        out[start:stop] = _first_word(words, stop - start).byteswap() % n
    return out


def resample_matrix(numbered: DataFrame, columns: list[str], resamples: int, seed: int) -> DataFrame:
    """``resample_sums`` of the same draws without a shuffle: each task draws whole resamples over one matrix of counts.

    More than ``MATRIX_ROWS`` sentences go through ``resample_sums`` itself.
    """
    spark = numbered.sparkSession
    n = numbered.count()
    if n > MATRIX_ROWS or n == 0:
        return resample_sums(numbered, columns, resamples, seed).select(F.col("resample").cast("int").alias("resample"), *[F.col(c).cast("long").alias(c) for c in columns])
    rows = numbered.select("i", *[F.col(c).cast("double").alias(c) for c in columns]).toPandas().sort_values("i")
    values = rows[columns].to_numpy(float)
    there = ~np.isnan(values)
    shared = spark.sparkContext.broadcast((np.nan_to_num(values), None if there.all() else there.astype(float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, present = shared.value
        known: dict = {}
        for batch in batches:
            found = []
            for b in batch["id"]:
                w = np.bincount(draws(seed, int(b), n, known), minlength=n).astype(float)
                sums = w @ counts
                found.append([int(b), *(None if present is not None and k == 0 else int(s) for s, k in zip(sums, w @ present if present is not None else sums))])
            out = pd.DataFrame(found, columns=["resample", *columns])
            yield out.astype({c: "Int64" for c in columns})

    tasks = min(TASKS, resamples, max(spark.sparkContext.defaultParallelism, resamples // 100))
    return spark.range(0, resamples, 1, tasks).mapInPandas(run, "resample int, " + ", ".join(f"{c} long" for c in columns))


def pair_differences(sums: DataFrame, columns: list[str]) -> DataFrame:
    """``resample, first, second, delta`` for each pair of columns."""
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col(a) - F.col(b)).alias("delta")) for n, a in enumerate(columns) for b in columns[n + 1 :]]
    return sums.select("resample", F.explode(F.array(*pairs)).alias("p")).select("resample", "p.*")


def two_sided(deltas: DataFrame, smoothing: str = "add_one", level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """Per pair the number of resamples at or below and at or above 0, p and the percentile interval.

    ``smoothing='add_one'`` gives ``min(1, 2 (c + 1) / (B + 1))``, ``'raw'`` gives ``min(1, 2 c / B)``.
    """
    low, high, n = F.count_if(F.col("delta") <= 0), F.count_if(F.col("delta") >= 0), F.count("*")
    out = deltas.groupBy(*by, "first", "second").agg(
        n.alias("resamples"), low.alias("at_or_below"), high.alias("at_or_above"), F.percentile("delta", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("ci")
    )
    c = F.least("at_or_below", "at_or_above")
    p = 2 * (c + 1) / (F.col("resamples") + 1) if smoothing == "add_one" else 2 * c / F.col("resamples")
    return out.withColumn("p", F.least(F.lit(1.0), p)).withColumn("ci_low", F.col("ci")[0]).withColumn("ci_high", F.col("ci")[1]).drop("ci")


def holm(rows: DataFrame, p: str, key: str | Column, *family: str) -> DataFrame:
    """``holm``: step-down corrected p within each family, ties ordered by ``key``; a family is a few comparisons."""
    key = F.col(key) if isinstance(key, str) else key
    within = W.partitionBy(*family)
    order = within.orderBy(F.col(p), key)
    step = (F.count("*").over(within) - F.row_number().over(order) + 1) * F.col(p)
    return rows.withColumn("_step", F.least(F.lit(1.0), step)).withColumn("holm", F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def harder_half_sample(rows: DataFrame, score: str, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of the lower half by ``score`` (or of the lowest ``2 n``), drawn by a seeded hash.

    Scores are taken to four places, so there are as many as ten thousand for shares; null
    ones come first.  The cut among ties goes by the hash.  The half is found by counts:
    of rows per score, then within the score at the cut of rows per beginning of the
    hash, so nothing but the rows of one such beginning is ever ordered.
    """
    keyed = rows.withColumn("_s", F.coalesce(F.round(F.col(score) * 10_000).cast("long"), F.lit(-(1 << 62)))).withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"))))
    per_score = sorted((r[0], r[1]) for r in keyed.groupBy("_s").count().collect())
    left = max(2 * n, sum(c for _, c in per_score) // 2)
    edge = None
    for value, c in per_score:
        if left < c:
            edge = value
            break
        left -= c
    if edge is None:  # no more rows than wanted
        return keyed.orderBy("_h").limit(n).drop("_s", "_h")
    tied = keyed.filter(F.col("_s") == edge)
    prefix = F.substring("_h", 1, 4)
    mark = ""
    for value, c in sorted((r[0], r[1]) for r in tied.groupBy(prefix).count().collect()):  # at most 65,536
        if left < c:
            mark = value
            break
        left -= c
    last = tied.filter(prefix == mark).orderBy("_h").limit(left)
    pool = keyed.filter((F.col("_s") < edge) | (F.col("_s") == edge) & (prefix < mark)).unionByName(last)
    return pool.orderBy("_h").limit(n).drop("_s", "_h")


def paired_test(values: DataFrame, key: str, resamples: int, seed: int, *by: str) -> DataFrame:
    """The older test of pairs of systems, each on its own sentences: difference of micro scores, raw p, and ``p < 0.05``.

    ``values`` has for each pair (``by``) and sentence (``key``) the tokens ``n`` and the
    right ones of both systems, ``a`` and ``b``; a row that lacks one is an error, as
    both systems must have the same sentences.  Each pair draws as many sentences as it
    has, by the same hashes; nothing is ranked in one task.
    """
    whole = F.when(F.col("n").isNull() | F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("both systems of a pair must have the same sentences"))).otherwise(F.col("n"))
    checked = values.withColumn("n", whole)
    placed = cut(checked.repartitionByRange(*by, key).sortWithinPartitions(*by, key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)))
    # one row a pair and partition: where the pair begins there, and how many of its sentences stand in earlier ones
    spans = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).withColumn("_total", F.sum("_held").over(W.partitionBy(*by))).drop("_held")
    numbered = placed.join(starts, [*by, "_part"]).select(*by, (F.col("_before") + F.col("_at") - F.col("_first")).alias("i"), F.col("_total").alias("total"), "n", "a", "b")
    numbered = cut(numbered)
    largest = numbered.agg(F.max("total")).first()[0]
    if largest is not None and largest <= MATRIX_ROWS:  # a pair's counts fit a task, as in ``resample_matrix``
        kinds = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in by)

        def resampled(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            values = own.sort_values("i")[["n", "a", "b"]].to_numpy(float)
            known: dict = {}
            weights_of = [np.bincount(draws(seed, b, len(values), known), minlength=len(values)) for b in range(resamples)]
            out = pd.DataFrame((np.array(weights_of) @ values).astype(np.int64), columns=["n", "a", "b"])
            return out.assign(resample=np.arange(resamples), **dict(zip(by, key)))[[*by, "resample", "n", "a", "b"]]

        sums = numbered.groupBy(*by).applyInPandas(resampled, f"{kinds}, resample int, n long, a long, b long")
    else:
        each = numbered.select(*by, "i", "total", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
        hits = each.select(*by, "resample", drawn(seed, F.col("resample"), F.col("i"), F.col("total")).alias("i")).groupBy(*by, "resample", "i").agg(F.count("*").alias("w"))
        sums = hits.join(numbered, [*by, "i"]).groupBy(*by, "resample").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "a", "b")])
    score = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    deltas = sums.select(*by, (score("a") - score("b")).alias("delta"))
    low, high = F.count_if(F.col("delta") <= 0), F.count_if(F.col("delta") >= 0)
    p = F.least(F.lit(1.0), 2 * F.least(low, high) / F.count("*"))
    tested = deltas.groupBy(*by).agg(p.alias("p"))
    seen = values.groupBy(*by).agg(F.count("*").alias("sentences"), (F.coalesce(F.try_divide(F.sum("a") - F.sum("b"), F.sum("n")), F.lit(0.0))).alias("difference"))
    return seen.join(tested, list(by)).withColumn("significant", F.col("p") < 0.05)
