"""Checks of predicted trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treemill.functions import tokens as tok

FLAGS = ("schema_valid", "exact_inventory", "one_root", "legal_heads", "no_self_loop", "acyclic", "tree")


def audit(rows: DataFrame, *keys: str) -> DataFrame:
    """``FLAGS`` for each row's ``llm_parse`` against its ``gold``; a null parse fails them all.

    Null elements break the inventory's size only as far as they are no tokens, and fail
    the checks of heads.  Reachability is looked at only where the other checks hold.
    """
    parse, gold_ids = F.col("llm_parse"), F.array_distinct(F.transform("gold", lambda g: g["id"]))
    objects = F.filter(parse, lambda p: p.isNotNull())
    ids = F.transform(objects, lambda p: p["id"])
    inventory = (
        ~F.exists(ids, lambda i: i.isNull()) & (F.size(ids) == F.size(gold_ids)) & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(ids, gold_ids)) == 0)
    )
    roots = F.size(F.filter(objects, lambda p: p["head"] == 0))
    legal = F.forall(parse, lambda p: F.coalesce((p["head"] == 0) | F.array_contains(gold_ids, p["head"]), F.lit(False)))
    loops = F.forall(parse, lambda p: p.isNotNull() & ~p["head"].eqNullSafe(p["id"]))
    base = rows.filter("gold is not null").select(*keys, "llm_parse", parse.isNotNull().alias("schema_valid"), inventory.alias("i"), (roots == 1).alias("r"), legal.alias("h"), loops.alias("l"))
    false = F.lit(False)
    checked = base.select(
        *keys, "llm_parse", "schema_valid", F.coalesce("i", false).alias("exact_inventory"), F.coalesce(F.col("schema_valid") & F.col("r"), false).alias("one_root"),
        F.coalesce("h", false).alias("legal_heads"), F.coalesce("l", false).alias("no_self_loop"),
    )
    sound = F.col("exact_inventory") & F.col("one_root") & F.col("legal_heads") & F.col("no_self_loop")
    done = checked.withColumn("acyclic", F.when(sound, tok.reaches_root(F.col("llm_parse"))).otherwise(false))
    return done.select(*keys, *FLAGS[:-2], "acyclic", (sound & F.col("acyclic")).alias("tree"))


def root_warnings(tokens: Column) -> Column:
    """``no_root`` or ``multiple_roots: tokens [..]`` for a parse; an empty array for one root or no parse."""
    roots = F.transform(F.filter(tokens, lambda t: t["head"] == 0), lambda t: t["id"].cast("string"))
    many = F.concat(F.lit("multiple_roots: tokens ["), F.array_join(roots, ", "), F.lit("]"))
    none = F.array().cast("array<string>")
    return F.when(tokens.isNull(), none).when(F.size(roots) == 0, F.array(F.lit("no_root"))).when(F.size(roots) > 1, F.array(many)).otherwise(none)
