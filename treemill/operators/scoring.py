"""Records of systems against gold trees: alignment, token facts and their aggregates.

A *record* is one evaluated answer of a system (model and condition) to a sentence.
Token facts are computed within a row by array functions, so scoring itself shuffles
nothing; every report is one aggregation with map-side combination over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treemill.functions import tokens as tok

SYSTEM = ("model_ord", "cond_ord")
#: Systems are replicated into every reference sentence, so their number is checked.
MANY_SYSTEMS = 1_000


def records(evaluations: DataFrame, responses: DataFrame, systems: DataFrame) -> DataFrame:
    """Evaluations with the ordinals of their system; those of no known call or system are left out."""
    calls = responses.select("response_id", "experiment", F.col("model_config.model_name").alias("model_name"))
    rows = evaluations.withColumn("gold", tok.slim("gold")) if "gold" in evaluations.columns else evaluations
    return rows.join(calls, "response_id").join(systems, ["model_name", "experiment"])


def latest(rows: DataFrame) -> DataFrame:
    """One record per system and sentence: the last evaluation, by time and then id."""
    order = W.partitionBy(*SYSTEM, "sent_id").orderBy(F.desc_nulls_last("evaluated_at"), F.desc("eval_id"))
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def reference(evaluations: DataFrame) -> DataFrame:
    """``sent_id, gold``: of each sentence the gold tree of its first evaluation that has one."""
    order = W.partitionBy("sent_id").orderBy("eval_id")
    rows = evaluations.filter("size(gold.id) > 0 and sent_id is not null").select("sent_id", "eval_id", tok.slim("gold").alias("gold"))
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("sent_id", "gold")


def aligned(reference_rows: DataFrame, systems: DataFrame, record_rows: DataFrame, missing: str = "zero") -> DataFrame:
    """Every reference sentence for every system, with the system's parse or null.

    ``record_rows`` has at most one row per system and sentence, as ``latest`` gives.
    ``missing='zero'`` keeps absent records and null parses, which then score nothing;
    ``missing='exclude'`` drops both.  ``present`` tells the two apart.
    """
    known = [r.asDict() for r in systems.select(*SYSTEM).distinct().limit(MANY_SYSTEMS + 1).collect()]
    if len(known) > MANY_SYSTEMS:
        raise ValueError(f"more than {MANY_SYSTEMS} systems")
    every = F.array(*[F.struct(*[F.lit(s[c]).cast("int").alias(c) for c in SYSTEM]) for s in known])
    # a sentence's parses are gathered, at most one a system, so gold trees are shuffled once and not once a system
    parses = record_rows.filter("sent_id is not null").groupBy("sent_id").agg(F.collect_list(F.struct(*SYSTEM, "llm_parse")).alias("_parses"))
    joined = reference_rows.join(parses, "sent_id", "left")
    found = lambda s: F.try_element_at(F.filter("_parses", lambda p: (p["model_ord"] == s["model_ord"]) & (p["cond_ord"] == s["cond_ord"])), F.lit(1))
    each = F.explode(F.transform(every, lambda s: F.struct(s["model_ord"].alias("model_ord"), s["cond_ord"].alias("cond_ord"), found(s).alias("record"))))
    out = joined.select("sent_id", "gold", each.alias("_s")).select(
        "_s.model_ord", "_s.cond_ord", "sent_id", "gold", F.col("_s.record.llm_parse").alias("llm_parse"), F.col("_s.record").isNotNull().alias("present")
    )
    return out if missing == "zero" else out.filter("llm_parse is not null")


def facts(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per scored gold token: the keys and the fields of the fact."""
    return rows.select(*keys, F.explode(tok.token_facts(tok.scored(F.col("gold")), F.col("llm_parse"))).alias("f")).select(*keys, "f.*")


def accuracy(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Counts and attachment scores over token facts."""
    total, uas, las = F.count("*"), F.count_if("uas"), F.count_if("las")
    return rows.groupBy(*by).agg(total.alias("total"), uas.alias("uas_correct"), las.alias("las_correct"), (uas / total).alias("uas"), (las / total).alias("las"))


def sentence_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Per row the number of scored tokens and of right ones, without exploding."""
    f = tok.token_facts(tok.scored(F.col("gold")), F.col("llm_parse"))
    counted = rows.select(*keys, f.alias("f"))
    return counted.select(
        *keys, F.size("f").alias("n_tokens"), F.size(F.filter("f", lambda x: x["uas"])).alias("uas_correct"), F.size(F.filter("f", lambda x: x["las"])).alias("las_correct")
    )


def with_all(counted: DataFrame, column: str, labels: tuple[str, ...], fill: tuple[str, ...], *by: str) -> DataFrame:
    """``counted`` with a row for every label of each group, counts being 0 where it had none."""
    groups = counted.select(*by).distinct() if by else counted.sparkSession.range(1).select()
    every = groups.withColumn(column, F.explode(F.array(*map(F.lit, labels))))
    return every.join(counted, [*by, column], "left").fillna(0, list(fill))


def precision_recall(rows: DataFrame, *by: str) -> DataFrame:
    """Per label true and false positives and negatives, precision, recall and F1.

    A right head and label is a true positive; otherwise the gold label misses one and
    the predicted label, if there is one, is a false positive.  Labels without case.
    """
    sides = F.array(
        F.struct(F.lower("deprel").alias("label"), F.col("las").cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.col("las")).cast("int").alias("fn")),
        F.when(~F.col("las") & F.col("p_deprel").isNotNull(), F.struct(F.lower("p_deprel").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))),
    )
    each = rows.select(*by, F.explode(F.array_compact(sides)).alias("s")).select(*by, "s.*")
    summed = each.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return summed.select(
        "*", F.try_divide("tp", F.expr("tp + fp")).alias("precision"), F.try_divide("tp", F.expr("tp + fn")).alias("recall"),
        F.try_divide(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")).alias("f1"),
    )


def confusions(rows: DataFrame, top: int, *by: str) -> DataFrame:
    """Right head but wrong label: the ``top`` predicted labels of each gold label, by count and then name."""
    wrong = rows.filter("uas and not las").select(*by, F.lower("deprel").alias("gold_label"), F.lower("p_deprel").alias("pred_label"))
    counted = wrong.groupBy(*by, "gold_label", "pred_label").agg(F.count("*").alias("n"))
    order = W.partitionBy(*by, "gold_label").orderBy(F.desc("n"), F.asc_nulls_first("pred_label"))
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def paired(reference_rows: DataFrame, record_rows: DataFrame, first: int, second: int) -> DataFrame:
    """``model_ord, sent_id, gold, first, second``: both conditions' parses of every sentence that both have parsed.

    ``record_rows`` are unlimited records; other conditions leave before anything is ranked.
    """
    rows = latest(record_rows.filter(F.col("cond_ord").isin(first, second)))
    parse = lambda c: F.any_value(F.when(F.col("cond_ord") == c, F.col("llm_parse")), F.lit(True))  # noqa: E731  one record a condition
    both = rows.filter("sent_id is not null and llm_parse is not null").groupBy("model_ord", "sent_id").agg(parse(first).alias("first"), parse(second).alias("second"))
    return both.filter("first is not null and second is not null").join(reference_rows, "sent_id").select("model_ord", "sent_id", "gold", "first", "second")


def churn(pair: DataFrame, *by: str) -> DataFrame:
    """Tokens whose prediction changed between two passes over the same sentences: ``pair`` has ``gold, first, second``."""

    def change(g: Column) -> Column:
        a, b = tok.predicted(F.col("first"), g["id"]), tok.predicted(F.col("second"), g["id"])
        right = [F.coalesce((p["head"] == g["head"]) & tok.label_equal(p["deprel"], g["deprel"]), F.lit(False)) for p in (a, b)]
        same = a["head"].eqNullSafe(b["head"]) & F.lower(F.coalesce(a["deprel"], F.lit(""))).eqNullSafe(F.lower(F.coalesce(b["deprel"], F.lit(""))))
        return F.when(same, "unchanged").when(~right[0] & right[1], "wrong_to_correct").when(right[0] & ~right[1], "correct_to_wrong").otherwise("wrong_to_wrong")

    each = pair.filter("first is not null and second is not null").select(*by, F.transform(tok.scored(F.col("gold")), change).alias("c"))
    count = lambda kind: F.sum(F.size(F.filter("c", lambda x: x == kind))).alias(kind)
    out = each.groupBy(*by).agg(F.count("*").alias("sentences"), F.sum(F.size("c")).alias("tokens"), *[count(k) for k in ("wrong_to_correct", "correct_to_wrong", "wrong_to_wrong")])
    return out.withColumn("changed", F.expr("wrong_to_correct + correct_to_wrong + wrong_to_wrong")).withColumn("net", F.expr("wrong_to_correct - correct_to_wrong"))


def differences(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The first ``limit`` scored tokens of each pair of parses in which either differs from gold."""

    def row(g: Column) -> Column:
        a, b = tok.predicted(F.col("first"), g["id"]), tok.predicted(F.col("second"), g["id"])
        fields = [g["id"].alias("id"), g["form"].alias("form"), g["head"].alias("gold_head"), g["deprel"].alias("gold_deprel")]
        fields += [a["head"].alias("first_head"), a["deprel"].alias("first_deprel"), b["head"].alias("second_head"), b["deprel"].alias("second_deprel")]
        return F.struct(*fields)

    differs = lambda r: ~(
        r["first_head"].eqNullSafe(r["gold_head"]) & r["first_deprel"].eqNullSafe(r["gold_deprel"]) & r["second_head"].eqNullSafe(r["gold_head"]) & r["second_deprel"].eqNullSafe(r["gold_deprel"])
    )
    found = F.slice(F.filter(F.transform(tok.scored(F.col("gold")), row), differs), 1, limit)
    return rows.select(*keys, F.posexplode(found).alias("place", "r")).select(*keys, "place", "r.*")
