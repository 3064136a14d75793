"""Choice of demonstration sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treemill.functions import tokens as tok


def candidates(sentences: DataFrame, held_out: DataFrame, low: int = 8, high: int = 15) -> DataFrame:
    """Every sentence with the facts that decide: length, projectivity, held-out text, labels.

    ``sentences`` has ``sent_id, text, gold``; ``held_out`` has ``text``.  Nulls fail.
    """
    n = F.size(tok.scored(F.col("gold")))
    out = held_out.select(tok.stripped(F.col("text")).alias("key")).filter("key is not null").distinct().withColumn("held", F.lit(True))
    rows = sentences.withColumn("key", tok.stripped(F.col("text"))).join(out, "key", "left")
    labels = tok.base_labels(F.col("gold"))
    target = F.array(*map(F.lit, tok.TARGET_LABELS))
    full = rows.select(
        "sent_id", n.alias("n_tokens"), n.between(low, high).alias("length_ok"), tok.projective(F.col("gold")).alias("projective"), F.coalesce("held", F.lit(False)).alias("held_out"),
        F.array_sort(F.array_intersect(labels, target)).alias("hits"), F.array_sort(F.array_except(target, labels)).alias("missed"),
    )
    return full.withColumn("passes", F.col("length_ok") & F.col("projective") & ~F.col("held_out"))


def best_trio(rows: DataFrame, pool: int = 80) -> DataFrame:
    """The three passing sentences that together cover most target labels, and the labels that they miss.

    The ``pool`` with most labels each are combined; ties go to the first in the order of
    labels covered and then id, which is also the order in which trios are tried.  The
    pool is a documented part of the search, so its combinations are of bounded number.
    """
    n = F.size("hits")
    top = rows.filter("passes").select("sent_id", "hits", n.alias("n")).orderBy(F.desc("n"), "sent_id").limit(pool)
    packed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("key"), "sent_id", "hits"))).alias("all"))
    one = packed.select(F.posexplode("all").alias("i", "x"), "all")
    two = one.select("i", "x", F.posexplode("all").alias("j", "y"), "all").filter("i < j")
    three = two.select("i", "x", "j", "y", F.posexplode("all").alias("k", "z")).filter("j < k")
    union = F.array_union(F.array_union(F.col("x.hits"), F.col("y.hits")), F.col("z.hits"))
    missed = F.array_sort(F.array_except(F.array(*map(F.lit, tok.TARGET_LABELS)), union))
    best = three.select(F.size(union).alias("covered"), F.concat_ws(",", missed).alias("missed"), "i", "j", "k", F.col("x.sent_id").alias("first"), F.col("y.sent_id").alias("second"), F.col("z.sent_id").alias("third"))
    return best.orderBy(F.desc("covered"), "i", "j", "k").limit(1).select("covered", "missed", "first", "second", "third")
