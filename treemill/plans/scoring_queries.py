"""Queries that score parses against gold, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from treemill.functions import text as tx, tokens as tok
from treemill.operators import scoring, trees
from treemill.plans.session import table

SYS = ("model_ord", "cond_ord")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.records(table(spark, sf_dir, "model_evaluation"), table(spark, sf_dir, "model_responses"), table(spark, sf_dir, "system_dim"))


def _aligned(spark: SparkSession, sf_dir: str, missing: str = "zero") -> DataFrame:
    rows = scoring.latest(_all(spark, sf_dir).select(*SYS, "sent_id", "llm_parse", "evaluated_at", "eval_id"))
    return scoring.aligned(scoring.reference(table(spark, sf_dir, "model_evaluation")), table(spark, sf_dir, "system_dim"), rows, missing)


def corpus_uas_las(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro scores of every system over all reference tokens; missing answers score nothing."""
    return scoring.accuracy(scoring.facts(_aligned(spark, sf_dir), *SYS), *SYS)


def corpus_scored_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over parsed sentences only, with missed tokens and sentences."""
    f = scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS, "sent_id")
    per = f.groupBy(*SYS, "sent_id").agg(F.count("*").alias("n"), F.count_if("uas").alias("u"), F.count_if("las").alias("l"), F.count_if(~F.col("found")).alias("m"))
    return per.groupBy(*SYS).agg(
        F.sum("n").alias("total"), F.sum("u").alias("uas_correct"), F.sum("l").alias("las_correct"), F.sum("m").alias("missed_tokens"), F.count("*").alias("scored_sentences")
    )


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored tokens and right ones of every evaluation."""
    return scoring.sentence_counts(_all(spark, sf_dir).filter("gold is not null"), "eval_id")


def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment scores of every parsed evaluation; a sentence without scored tokens has 0."""
    n = scoring.sentence_counts(_all(spark, sf_dir).filter("gold is not null and llm_parse is not null"), "eval_id")
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_tokens")), F.lit(0.0))
    return n.select("eval_id", ratio("uas_correct").alias("uas"), ratio("las_correct").alias("las"))


def token_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of token errors of each system, from all parsed evaluations."""
    rows = _all(spark, sf_dir).filter("llm_parse is not null")
    kinds = F.array_compact(F.transform(tok.token_facts(tok.scored(F.col("gold")), F.col("llm_parse")), tok.error_type))
    return rows.select(*SYS, F.explode(kinds).alias("error_type")).groupBy(*SYS, "error_type").agg(F.count("*").alias("n"))


def relation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored tokens of each relation in the reference."""
    rows = scoring.reference(table(spark, sf_dir, "model_evaluation"))
    return rows.select(F.explode(tok.scored(F.col("gold"))).alias("g")).groupBy(F.col("g.deprel").alias("deprel")).agg(F.count("*").alias("support"))


def relation_las(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each relation for every system under the fixed denominator."""
    return scoring.accuracy(scoring.facts(_aligned(spark, sf_dir), *SYS), *SYS, "deprel")


def relation_from_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each relation with 50 tokens or more, from the stored error lists alone."""
    rows = _all(spark, sf_dir).filter("llm_parse is not null and gold is not null")
    kind = lambda g: F.try_element_at(F.filter("token_errors", lambda e: e["token_id"] == g["id"]), F.lit(-1))["error_type"]
    each = rows.select("experiment", F.explode(F.transform(tok.scored(F.col("gold")), lambda g: F.struct(g["deprel"].alias("deprel"), kind(g).alias("kind")))).alias("x"))
    las = F.count_if(F.col("x.kind").isNull())
    uas = F.count_if(F.col("x.kind").isNull() | (F.col("x.kind") == "deprel_only"))
    out = each.groupBy("experiment", F.col("x.deprel").alias("deprel")).agg(F.count("*").alias("total"), uas.alias("uas_correct"), las.alias("las_correct"))
    return out.filter("total >= 50")


def relation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right labels of each relation side by side for the six conditions."""
    f = scoring.facts(_aligned(spark, sf_dir), *SYS)
    return f.filter("las").groupBy("deprel").pivot("cond_ord", list(range(6))).agg(F.count(F.lit(1))).select(
        "deprel", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"las_{c}") for c in range(6)]
    )


def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by sentence length, every bin present; sentences without scored tokens are left out."""
    n = scoring.sentence_counts(_aligned(spark, sf_dir), *SYS)
    binned = n.filter("n_tokens > 0").withColumn("bin", tok.bin_label(F.col("n_tokens"), tok.LENGTH_BINS))
    summed = binned.groupBy(*SYS, "bin").agg(F.count("*").alias("sentences"), *[F.sum(c).alias(c) for c in ("n_tokens", "uas_correct", "las_correct")])
    full = scoring.with_all(summed, "bin", tuple(b[0] for b in tok.LENGTH_BINS), ("sentences", "n_tokens", "uas_correct", "las_correct"), *SYS)
    return full.withColumn("las", F.try_divide("las_correct", "n_tokens"))


def length_bins_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over parsed sentences, those without scored tokens falling into the last bin."""
    n = scoring.sentence_counts(_aligned(spark, sf_dir, "exclude"), *SYS)
    label = F.coalesce(tok.bin_label(F.col("n_tokens"), tok.LENGTH_BINS), F.lit(tok.LENGTH_BINS[-1][0]))
    return n.groupBy(*SYS, label.alias("bin")).agg(F.count("*").alias("sentences"), *[F.sum(c).alias(c) for c in ("n_tokens", "uas_correct", "las_correct")])


def arc_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head accuracy of arcs to the left and to the right, root arcs left out."""
    f = scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS).filter("head <> 0")
    return scoring.accuracy(f, *SYS, F.when(F.col("head") < F.col("id"), "left").otherwise("right").alias("direction")).select(*SYS, "direction", "total", "uas_correct", "uas")


def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head accuracy by arc length, every bin present."""
    f = scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS).filter("head <> 0")
    counted = scoring.accuracy(f, *SYS, tok.bin_label(F.abs(F.col("head") - F.col("id")), tok.ARC_BINS).alias("bin")).select(*SYS, "bin", "total", "uas_correct")
    return scoring.with_all(counted, "bin", tuple(b[0] for b in tok.ARC_BINS), ("total", "uas_correct"), *SYS)


def upos_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by gold part of speech."""
    return scoring.accuracy(scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS), *SYS, "upos")


def genre_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and sentences by genre, the five known genres always present."""
    rows = _aligned(spark, sf_dir, "exclude").withColumn("genre", tok.genre(F.col("sent_id"))).filter(F.col("genre").isin(*tok.GENRES))
    n = scoring.sentence_counts(rows, *SYS, "genre").groupBy(*SYS, "genre").agg(F.count("*").alias("sentences"), *[F.sum(c).alias(c) for c in ("n_tokens", "uas_correct", "las_correct")])
    return scoring.with_all(n, "genre", tok.GENRES, ("sentences", "n_tokens", "uas_correct", "las_correct"), *SYS)


def tree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural flags of every evaluation."""
    return trees.audit(_all(spark, sf_dir), "eval_id")


def reliability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every system: absent and null answers, and how many pass each structural check."""
    rows = _aligned(spark, sf_dir)
    flags = trees.audit(rows, *SYS, "present")
    return flags.groupBy(*SYS).agg(
        F.count("*").alias("sentences"), F.count_if(~F.col("present")).alias("absent"), F.count_if(F.col("present") & ~F.col("schema_valid")).alias("null_parse"),
        *[F.count_if(f).alias(f) for f in trees.FLAGS],
    )


def reliability_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures, root warnings and rates of every system, over all its evaluations."""
    has = lambda w: F.exists("structural_warnings", lambda x: x.contains(w))
    ok = F.col("validation_error").isNull() & F.col("llm_parse").isNotNull()
    n, issue = F.count("*"), F.count_if(F.size("structural_warnings") > 0)
    return _all(spark, sf_dir).groupBy(*SYS).agg(
        n.alias("total"), F.count_if(F.length("api_error") > 0).alias("api_errors"), F.count_if(ok).alias("parse_success"), F.count_if(~ok).alias("parse_failures"),
        F.count_if(has("no_root")).alias("no_root"), F.count_if(has("multiple_roots")).alias("multiple_roots"), issue.alias("any_issue"),
        (F.count_if(ok) / n).alias("parse_success_rate"), F.coalesce(F.try_divide(F.count_if(ok) - issue, F.count_if(ok)), F.lit(0.0)).alias("structural_validity_rate"),
    )


def root_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root warnings computed anew for every parsed evaluation that has one."""
    rows = _all(spark, sf_dir).select("eval_id", trees.root_warnings(F.col("llm_parse")).alias("w"))
    return rows.select("eval_id", F.explode("w").alias("warning"))


def deprel_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each label, per condition, labels of 50 gold tokens or more."""
    f = scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS)
    return scoring.precision_recall(f, "cond_ord").filter("tp + fn >= 50")


def deprel_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five labels each gold label is most often confused with, per condition."""
    return scoring.confusions(scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS), 5, "cond_ord")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions among eight frequent labels as a matrix."""
    f = scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS).filter("uas and not las")
    rows = f.select(F.lower("deprel").alias("gold_label"), F.lower("p_deprel").alias("pred")).filter(F.col("gold_label").isin(*tok.TARGET_LABELS))
    cells = rows.groupBy("gold_label").pivot("pred", list(tok.TARGET_LABELS)).agg(F.count(F.lit(1)))
    return cells.select("gold_label", *[F.coalesce(F.col(c), F.lit(0)).alias(f"as_{c}") for c in tok.TARGET_LABELS])


def _paired(spark: SparkSession, sf_dir: str, first: int, second: int) -> DataFrame:
    rows = _all(spark, sf_dir).select(*SYS, "sent_id", "llm_parse", "evaluated_at", "eval_id")
    return scoring.paired(scoring.reference(table(spark, sf_dir, "model_evaluation")), rows, first, second)


def critique_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the critique pass changed the reasoning pass, per model."""
    return scoring.churn(_paired(spark, sf_dir, 4, 5), "model_ord")


def token_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve tokens in which the two retrieval conditions differ from gold."""
    return scoring.differences(_paired(spark, sf_dir, 2, 3), 12, "model_ord", "sent_id")


def qualitative_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence where the sentence-vector condition gains most over the signature one, the longest
    sentence on which the latter gets nothing right, and the one that the critique breaks most."""
    rows = _aligned(spark, sf_dir, "exclude")
    n = scoring.sentence_counts(rows, *SYS, "sent_id")
    by = {c: n.filter(F.col("cond_ord") == c).select("model_ord", "sent_id", "n_tokens", F.col("las_correct").alias(f"las_{c}")) for c in (2, 3)}
    pair = by[2].join(by[3].drop("n_tokens"), ["model_ord", "sent_id"]).filter("n_tokens > 0")
    gain = pair.filter("las_3 > las_2").select(F.lit("semantic_gain").alias("pick"), (F.col("las_3") - F.col("las_2")).alias("key"), "n_tokens", "model_ord", "sent_id")
    zero = pair.filter("las_2 = 0").select(F.lit("syntax_failure").alias("pick"), F.lit(0).alias("key"), "n_tokens", "model_ord", "sent_id")
    facts = scoring.facts(rows.filter("cond_ord in (4, 5)"), *SYS, "sent_id")
    wide = facts.groupBy("model_ord", "sent_id", "id").agg(F.bool_or(F.when(F.col("cond_ord") == 4, F.col("las"))).alias("a"), F.bool_or(F.when(F.col("cond_ord") == 5, F.col("las"))).alias("b"))
    broken = wide.groupBy("model_ord", "sent_id").agg(F.count_if(F.expr("a and not b")).cast("int").alias("key"), F.count("*").cast("int").alias("n_tokens")).filter("key > 0")
    broken = broken.select(F.lit("critique_break").alias("pick"), "key", "n_tokens", "model_ord", "sent_id")
    every = gain.unionByName(zero).unionByName(broken)
    order = W.partitionBy("pick").orderBy(F.desc("key"), F.desc("n_tokens"), "model_ord", "sent_id")
    return every.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence scores of each system in twenty bins, missing answers as 0."""
    n = scoring.sentence_counts(_aligned(spark, sf_dir), *SYS).filter("n_tokens > 0")
    return n.groupBy(*SYS, F.least(F.expr("las_correct * 20 div n_tokens"), F.lit(19)).cast("int").alias("bin")).agg(
        F.count("*").alias("sentences"), F.count_if(F.expr("las_correct = 0")).alias("zeros"), F.count_if(F.expr("las_correct = n_tokens")).alias("perfect")
    )


def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and population deviation of the sentence scores of each system, missing answers as 0, and how many are 0 or 1."""
    n = scoring.sentence_counts(_aligned(spark, sf_dir), *SYS).filter("n_tokens > 0")
    rows = n.select(*SYS, *[(F.col(f"{c}_correct") / F.col("n_tokens")).alias(c) for c in ("uas", "las")])
    stats = [f for c in ("uas", "las") for f in (F.round(F.avg(c), 9).alias(f"mean_{c}"), F.round(F.median(c), 9).alias(f"median_{c}"), F.round(F.stddev_pop(c), 9).alias(f"deviation_{c}"), F.count_if(F.col(c) == 0).alias(f"zeros_{c}"), F.count_if(F.col(c) == 1).alias(f"perfect_{c}"))]
    return rows.groupBy(*SYS).agg(F.count("*").alias("sentences"), *stats)


def failure_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per system the failed and the parsed evaluations, with mean and median of their sentences' lengths."""
    rows = _all(spark, sf_dir).filter("gold is not null").select(*SYS, F.size("gold").alias("n"), F.col("llm_parse").isNull().alias("failed"))
    side = lambda failed, name: [F.count_if(F.col("failed") == failed).alias(name), F.avg(F.when(F.col("failed") == failed, F.col("n"))).alias(f"{name}_mean_length"), F.median(F.when(F.col("failed") == failed, F.col("n"))).alias(f"{name}_median_length")]
    return rows.groupBy(*SYS).agg(*side(True, "failures"), *side(False, "successes"))


def confused_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen gold labels that each condition confuses most often, by count and then name, with their most frequent confusion."""
    rows = scoring.confusions(scoring.facts(_aligned(spark, sf_dir, "exclude"), *SYS), 1_000, "cond_ord")
    summed = rows.groupBy("cond_ord", "gold_label").agg(F.sum("n").alias("n"), F.min_by("pred_label", "place").alias("most_frequent"))
    order = W.partitionBy("cond_ord").orderBy(F.desc("n"), "gold_label")
    return summed.withColumn("place", F.row_number().over(order)).filter("place <= 15")


def top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen relations with most reference tokens, ties by name, and their scores for every system."""
    order = W.orderBy(F.desc("support"), "deprel")
    top = relation_support(spark, sf_dir).orderBy(F.desc("support"), "deprel").limit(15).withColumn("place", F.row_number().over(order))
    return relation_las(spark, sf_dir).join(F.broadcast(top), "deprel").select(*SYS, "deprel", "place", "support", "las_correct", "las")  # fifteen rows


def formatted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus scores as they are printed: percentages with two places."""
    rows = corpus_uas_las(spark, sf_dir)
    return rows.select(*SYS, tx.percent(F.col("uas")).alias("uas"), tx.percent(F.col("las")).alias("las"), tx.p_value(F.col("las") / 2000).alias("small"))


def failure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and failed evaluations of each genre and kind of error, with their lengths."""
    rows = _all(spark, sf_dir)
    kind = F.when(F.col("llm_parse").isNotNull(), "parsed").when(F.length("api_error") > 0, "api_error").when(F.col("validation_error").isNotNull(), F.split("validation_error", r"[:(\n]")[0]).otherwise("unexplained")
    length = F.size("gold")
    return rows.filter("gold is not null").groupBy(tok.genre(F.col("sent_id")).alias("genre"), F.trim(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.sum(length).alias("sum_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.median(length).alias("median_length")
    )


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the evaluator's outcomes and the mean of its sentence scores, per condition."""
    micro = lambda c: F.sum(F.round(F.col(c) * 10000).cast("long"))
    return _all(spark, sf_dir).groupBy("cond_ord").agg(
        F.count("*").alias("total"), F.count("uas").alias("scored"), F.count("validation_error").alias("validation_errors"), F.count("api_error").alias("api_errors"),
        F.count_if(F.exists("structural_warnings", lambda w: w.contains("no_root"))).alias("no_root"), (micro("uas") / F.count("uas")).alias("mean_uas_bp"), (micro("las") / F.count("las")).alias("mean_las_bp"),
    )


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage tokens per model and in total."""
    rows = table(spark, sf_dir, "model_responses").select(F.col("model_config.model_name").alias("model_name"), "usage")
    sums = [F.sum(F.col(f"usage.{c}")).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return rows.rollup("model_name").agg(*sums, F.count("*").alias("calls"), F.grouping("model_name").cast("int").alias("is_total"))


def baseline_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional comparison: parsed sentences of another length than gold, and tokens equal place by place."""
    rows = _all(spark, sf_dir).filter("llm_parse is not null and gold is not null")
    hits = F.size(F.filter(F.arrays_zip("gold", "llm_parse"), lambda z: (z["gold"]["head"] == z["llm_parse"]["head"]) & (z["gold"]["upos"] != "PUNCT")))
    return rows.groupBy(*SYS).agg(F.count("*").alias("sentences"), F.count_if(F.size("gold") != F.size("llm_parse")).alias("other_length"), F.sum(hits).alias("head_hits"))


def flatten_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus scores as path and value."""
    rows = corpus_uas_las(spark, sf_dir)
    values = rows.unpivot(list(SYS), ["total", "uas_correct", "las_correct"], "metric", "value")
    return values.select(F.concat_ws("/", "model_ord", "cond_ord", "metric").alias("path"), "value")


def denominator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems whose token total differs from the reference's: none may."""
    want = relation_support(spark, sf_dir).agg(F.sum("support").alias("want"))
    have = corpus_uas_las(spark, sf_dir).select(*SYS, "total")
    return have.join(F.broadcast(want), have["total"] != want["want"])  # want is one row


def rescored_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations whose stored score is not the one computed anew, by system."""
    n = scoring.sentence_counts(_all(spark, sf_dir).filter("llm_parse is not null and gold is not null and exclude_punct"), *SYS, "uas", "las")
    off = lambda c: F.abs(F.col(c) * F.col("n_tokens") - F.col(f"{c}_correct")) > F.col("n_tokens") * 0.0001
    return n.groupBy(*SYS).agg(F.count("*").alias("checked"), F.count_if(off("uas")).alias("uas_off"), F.count_if(off("las")).alias("las_off"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_uas_las, corpus_scored_only, sentence_counts, sentence_scores, token_error_types, relation_support, relation_las, relation_from_errors, relation_pivot,
        length_bins, length_bins_legacy, arc_direction, arc_length, upos_accuracy, genre_accuracy, tree_audit, reliability_counts, reliability_rates, root_warnings,
        deprel_prf1, deprel_confusion, confusion_matrix, critique_churn, token_diff_rows, qualitative_picks, score_distribution, score_statistics, failure_lengths, confused_labels, top_relations, formatted_scores, failure_profile, evaluation_summary,
        usage_rollup, baseline_lengths, flatten_metrics, denominator_check, rescored_mismatch,
    )
}

# -- SQL -----------------------------------------------------------------------------
CTE = """
rec AS (SELECT e.*, r.experiment, s.model_ord, s.cond_ord FROM model_evaluation e JOIN model_responses r ON e.response_id = r.response_id
  JOIN system_dim s ON s.model_name = r.model_config.model_name AND s.experiment = r.experiment),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_ord, cond_ord, sent_id ORDER BY evaluated_at DESC NULLS LAST, eval_id DESC) AS rk FROM rec) WHERE rk = 1),
ref AS (SELECT sent_id, gold FROM (SELECT sent_id, gold, row_number() OVER (PARTITION BY sent_id ORDER BY eval_id) AS rk FROM model_evaluation WHERE len(gold) > 0 AND sent_id IS NOT NULL) WHERE rk = 1),
al AS (SELECT s.model_ord, s.cond_ord, ref.sent_id, ref.gold, last.llm_parse, last.eval_id IS NOT NULL AS present FROM ref, system_dim s
  LEFT JOIN last ON last.model_ord = s.model_ord AND last.cond_ord = s.cond_ord AND last.sent_id = ref.sent_id)
"""


def _facts(source: str, key: str, where: str = "TRUE") -> str:
    """CTEs that end in ``f``: token facts of the rows of ``source``, whose rows ``key`` tells apart."""
    return f"""
src AS (SELECT row_number() OVER () AS rid, * FROM {source} WHERE {where}),
gt AS (SELECT rid, {key}, unnest(gold) AS g FROM src),
pt AS (SELECT rid, unnest(llm_parse) AS p, generate_subscripts(llm_parse, 1) AS pos FROM src),
pd AS (SELECT * FROM (SELECT rid, p, row_number() OVER (PARTITION BY rid, p.id ORDER BY pos DESC) AS rk FROM pt WHERE p.id IS NOT NULL) WHERE rk = 1),
f AS (SELECT gt.*, g.id AS id, g.form AS form, g.upos AS upos, g.head AS head, g.deprel AS deprel, pd.rid IS NOT NULL AS found, p.head AS p_head, p.deprel AS p_deprel,
  coalesce(p.head = g.head, FALSE) AS uas, coalesce(p.head = g.head AND lower(p.deprel) = lower(g.deprel), FALSE) AS las
  FROM gt LEFT JOIN pd ON gt.rid = pd.rid AND pd.p.id = g.id WHERE g.upos <> 'PUNCT')
"""


_A = _facts("al", "model_ord, cond_ord, sent_id")
_X = _facts("al", "model_ord, cond_ord, sent_id", "llm_parse IS NOT NULL")
_R = _facts("rec", "model_ord, cond_ord, eval_id, experiment", "gold IS NOT NULL")
_SUMS = "count(*) AS total, count(*) FILTER (uas) AS uas_correct, count(*) FILTER (las) AS las_correct"
_ACC = f"{_SUMS}, count(*) FILTER (uas) / count(*) AS uas, count(*) FILTER (las) / count(*) AS las"


def _case(value: str, bins: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} BETWEEN {lo} AND {hi} THEN '{label}'" for label, lo, hi in bins) + " END"


def _labels(labels) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{x}'" for x in labels) + "]) AS bin)"


def _counts(source: str, key: str, where: str = "TRUE") -> str:
    """CTE ``n``: per row of source its counts of scored and right tokens."""
    return _facts(source, key, where) + f""", n AS (SELECT src.rid, {', '.join('src.' + k.strip() for k in key.split(','))}, count(f.rid) AS n_tokens, count(*) FILTER (f.uas) AS uas_correct, count(*) FILTER (f.las) AS las_correct
  FROM src LEFT JOIN f ON src.rid = f.rid GROUP BY ALL)"""


_SUM_N = "CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(uas_correct) AS BIGINT) AS uas_correct, CAST(sum(las_correct) AS BIGINT) AS las_correct"
_CHANGE = """
pair AS (SELECT row_number() OVER () AS rid, a.model_ord, a.sent_id, a.gold, a.llm_parse AS x, b.llm_parse AS y FROM al a JOIN al b ON a.model_ord = b.model_ord AND a.sent_id = b.sent_id
  WHERE a.cond_ord = {a} AND b.cond_ord = {b} AND a.llm_parse IS NOT NULL AND b.llm_parse IS NOT NULL),
g2 AS (SELECT rid, model_ord, sent_id, unnest(gold) AS g, generate_subscripts(gold, 1) AS gpos FROM pair),
x1 AS (SELECT rid, unnest(x) AS p, generate_subscripts(x, 1) AS pos FROM pair), y1 AS (SELECT rid, unnest(y) AS p, generate_subscripts(y, 1) AS pos FROM pair),
x2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, p.id ORDER BY pos DESC) AS rk FROM x1 WHERE p.id IS NOT NULL) WHERE rk = 1),
y2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, p.id ORDER BY pos DESC) AS rk FROM y1 WHERE p.id IS NOT NULL) WHERE rk = 1),
j AS (SELECT g2.*, x2.p AS a, y2.p AS b, coalesce(x2.p.head = g.head AND lower(x2.p.deprel) = lower(g.deprel), FALSE) AS ra, coalesce(y2.p.head = g.head AND lower(y2.p.deprel) = lower(g.deprel), FALSE) AS rb,
  (x2.p.head IS NOT DISTINCT FROM y2.p.head) AND lower(coalesce(x2.p.deprel, '')) = lower(coalesce(y2.p.deprel, '')) AS same
  FROM g2 LEFT JOIN x2 ON x2.rid = g2.rid AND x2.p.id = g.id LEFT JOIN y2 ON y2.rid = g2.rid AND y2.p.id = g.id WHERE g.upos <> 'PUNCT')
"""
_AUDIT = """
au AS (SELECT *, llm_parse IS NOT NULL AS schema_valid, list_distinct(list_transform(gold, lambda g: g.id)) AS gids, list_filter(llm_parse, lambda p: p IS NOT NULL) AS objs FROM {source} WHERE gold IS NOT NULL),
a2 AS (SELECT *, coalesce(len(list_filter(objs, lambda p: p.id IS NULL)) = 0 AND len(objs) = len(gids) AND len(list_distinct(list_transform(objs, lambda p: p.id))) = len(objs)
    AND len(list_filter(objs, lambda p: NOT list_contains(gids, p.id))) = 0, FALSE) AS exact_inventory,
  coalesce(len(list_filter(objs, lambda p: p.head = 0)) = 1, FALSE) AS one_root,
  coalesce(len(list_filter(llm_parse, lambda p: NOT coalesce(p.head = 0 OR list_contains(gids, p.head), FALSE))) = 0, FALSE) AS legal_heads,
  coalesce(len(list_filter(llm_parse, lambda p: p IS NULL OR (p.head IS NOT DISTINCT FROM p.id))) = 0, FALSE) AS no_self_loop FROM au),
a3 AS (SELECT *, exact_inventory AND one_root AND legal_heads AND no_self_loop AS sound, row_number() OVER () AS aid FROM a2),
edge AS (SELECT aid, unnest(objs).id AS id, unnest(objs).head AS head FROM a3 WHERE sound),
walk AS (SELECT aid, id AS start, head AS spot, 1 AS step FROM edge UNION ALL SELECT w.aid, w.start, e.head, w.step + 1 FROM walk w JOIN edge e ON w.aid = e.aid AND w.spot = e.id WHERE w.spot <> 0 AND w.step < 64),
arrived AS (SELECT aid, count(DISTINCT start) AS n FROM walk WHERE spot = 0 GROUP BY aid),
a4 AS (SELECT a3.*, sound AND coalesce(arrived.n = len(objs), FALSE) AS acyclic FROM a3 LEFT JOIN arrived USING (aid))
"""
_FLAGS = "schema_valid, exact_inventory, one_root, legal_heads, no_self_loop, acyclic, sound AND acyclic AS tree"

SQL = {
    "corpus_uas_las": f"WITH {CTE}, {_A} SELECT model_ord, cond_ord, {_ACC} FROM f GROUP BY 1, 2",
    "corpus_scored_only": f"WITH {CTE}, {_X} SELECT model_ord, cond_ord, {_SUMS}, count(*) FILTER (NOT found) AS missed_tokens, count(DISTINCT sent_id) AS scored_sentences FROM f GROUP BY 1, 2",
    "sentence_counts": f"WITH {CTE}, {_counts('rec', 'eval_id', 'gold IS NOT NULL')} SELECT eval_id, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(uas_correct AS INTEGER) AS uas_correct, CAST(las_correct AS INTEGER) AS las_correct FROM n",
    "sentence_scores": f"WITH {CTE}, {_counts('rec', 'eval_id', 'gold IS NOT NULL AND llm_parse IS NOT NULL')} SELECT eval_id, CASE WHEN n_tokens = 0 THEN 0.0::DOUBLE ELSE uas_correct / n_tokens END AS uas, CASE WHEN n_tokens = 0 THEN 0.0::DOUBLE ELSE las_correct / n_tokens END AS las FROM n",
    "token_error_types": f"""WITH {CTE}, {_facts('rec', 'model_ord, cond_ord', 'llm_parse IS NOT NULL')} SELECT model_ord, cond_ord, error_type, count(*) AS n FROM (SELECT *, CASE WHEN NOT found THEN 'missing_token'
        WHEN NOT uas AND NOT coalesce(lower(p_deprel) = lower(deprel), FALSE) THEN 'head_and_deprel' WHEN NOT uas THEN 'head_only' WHEN NOT las THEN 'deprel_only' END AS error_type FROM f) WHERE error_type IS NOT NULL GROUP BY 1, 2, 3""",
    "relation_support": f"WITH {CTE} SELECT g.deprel AS deprel, count(*) AS support FROM (SELECT unnest(gold) AS g FROM ref) WHERE g.upos <> 'PUNCT' GROUP BY 1",
    "relation_las": f"WITH {CTE}, {_A} SELECT model_ord, cond_ord, deprel, {_ACC} FROM f GROUP BY 1, 2, 3",
    "relation_from_errors": f"""WITH {CTE}, src AS (SELECT * FROM rec WHERE llm_parse IS NOT NULL AND gold IS NOT NULL), gt AS (SELECT eval_id, experiment, unnest(gold) AS g FROM src),
        er AS (SELECT eval_id, unnest(token_errors) AS e, generate_subscripts(token_errors, 1) AS pos FROM src), ed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eval_id, e.token_id ORDER BY pos DESC) AS rk FROM er) WHERE rk = 1)
        SELECT experiment, g.deprel AS deprel, count(*) AS total, count(*) FILTER (e.error_type IS NULL OR e.error_type = 'deprel_only') AS uas_correct, count(*) FILTER (e.error_type IS NULL) AS las_correct
        FROM gt LEFT JOIN ed ON ed.eval_id = gt.eval_id AND ed.e.token_id = g.id WHERE g.upos <> 'PUNCT' GROUP BY 1, 2 HAVING count(*) >= 50""",
    "relation_pivot": f"WITH {CTE}, {_A} SELECT deprel, " + ", ".join(f"count(*) FILTER (cond_ord = {c}) AS las_{c}" for c in range(6)) + " FROM f WHERE las GROUP BY 1",
    "length_bins": f"""WITH {CTE}, {_counts('al', 'model_ord, cond_ord')}, b AS (SELECT model_ord, cond_ord, {_case('n_tokens', tok.LENGTH_BINS)} AS bin, count(*) AS sentences, {_SUM_N} FROM n WHERE n_tokens > 0 GROUP BY 1, 2, 3)
        SELECT model_ord, cond_ord, bin, coalesce(sentences, 0) AS sentences, coalesce(n_tokens, 0) AS n_tokens, coalesce(uas_correct, 0) AS uas_correct, coalesce(las_correct, 0) AS las_correct, las_correct / nullif(n_tokens, 0) AS las
        FROM (SELECT * FROM (SELECT DISTINCT model_ord, cond_ord FROM b) CROSS JOIN {_labels(b[0] for b in tok.LENGTH_BINS)}) LEFT JOIN b USING (model_ord, cond_ord, bin)""",
    "length_bins_legacy": f"WITH {CTE}, {_counts('al', 'model_ord, cond_ord', 'llm_parse IS NOT NULL')} SELECT model_ord, cond_ord, coalesce({_case('n_tokens', tok.LENGTH_BINS)}, '51+') AS bin, count(*) AS sentences, {_SUM_N} FROM n GROUP BY 1, 2, 3",
    "arc_direction": f"WITH {CTE}, {_X} SELECT model_ord, cond_ord, CASE WHEN head < id THEN 'left' ELSE 'right' END AS direction, count(*) AS total, count(*) FILTER (uas) AS uas_correct, count(*) FILTER (uas) / count(*) AS uas FROM f WHERE head <> 0 GROUP BY 1, 2, 3",
    "arc_length": f"""WITH {CTE}, {_X}, b AS (SELECT model_ord, cond_ord, {_case('abs(head - id)', tok.ARC_BINS)} AS bin, count(*) AS total, count(*) FILTER (uas) AS uas_correct FROM f WHERE head <> 0 GROUP BY 1, 2, 3)
        SELECT model_ord, cond_ord, bin, coalesce(total, 0) AS total, coalesce(uas_correct, 0) AS uas_correct FROM (SELECT * FROM (SELECT DISTINCT model_ord, cond_ord FROM b) CROSS JOIN {_labels(b[0] for b in tok.ARC_BINS)}) LEFT JOIN b USING (model_ord, cond_ord, bin)""",
    "upos_accuracy": f"WITH {CTE}, {_X} SELECT model_ord, cond_ord, upos, {_ACC} FROM f GROUP BY 1, 2, 3",
    "genre_accuracy": f"""WITH {CTE}, {_counts('al', 'model_ord, cond_ord, sent_id', 'llm_parse IS NOT NULL')}, b AS (SELECT model_ord, cond_ord, split_part(sent_id, '-', 1) AS bin, count(*) AS sentences, {_SUM_N} FROM n GROUP BY 1, 2, 3),
        l AS {_labels(tok.GENRES)} SELECT model_ord, cond_ord, bin AS genre, coalesce(sentences, 0) AS sentences, coalesce(n_tokens, 0) AS n_tokens, coalesce(uas_correct, 0) AS uas_correct, coalesce(las_correct, 0) AS las_correct
        FROM (SELECT * FROM (SELECT DISTINCT model_ord, cond_ord FROM b JOIN l USING (bin)) CROSS JOIN l) LEFT JOIN b USING (model_ord, cond_ord, bin)""",
    "tree_audit": f"WITH RECURSIVE {CTE}, {_AUDIT.format(source='rec')} SELECT eval_id, {_FLAGS} FROM a4",
    "reliability_counts": f"""WITH RECURSIVE {CTE}, {_AUDIT.format(source='al')} SELECT model_ord, cond_ord, count(*) AS sentences, count(*) FILTER (NOT present) AS absent, count(*) FILTER (present AND NOT schema_valid) AS null_parse,
        """ + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in trees.FLAGS[:-1]) + ", count(*) FILTER (sound AND acyclic) AS tree FROM a4 GROUP BY 1, 2",
    "reliability_rates": f"""WITH {CTE}, q AS (SELECT *, validation_error IS NULL AND llm_parse IS NOT NULL AS ok, len(structural_warnings) > 0 AS issue FROM rec)
        SELECT model_ord, cond_ord, count(*) AS total, count(*) FILTER (length(api_error) > 0) AS api_errors, count(*) FILTER (ok) AS parse_success, count(*) FILTER (NOT ok) AS parse_failures,
        count(*) FILTER (len(list_filter(structural_warnings, lambda w: contains(w, 'no_root'))) > 0) AS no_root, count(*) FILTER (len(list_filter(structural_warnings, lambda w: contains(w, 'multiple_roots'))) > 0) AS multiple_roots,
        count(*) FILTER (issue) AS any_issue, count(*) FILTER (ok) / count(*) AS parse_success_rate, coalesce((count(*) FILTER (ok) - count(*) FILTER (issue)) / nullif(count(*) FILTER (ok), 0), 0.0) AS structural_validity_rate FROM q GROUP BY 1, 2""",
    "root_warnings": f"""WITH {CTE}, r AS (SELECT eval_id, list_transform(list_filter(llm_parse, lambda p: p.head = 0), lambda p: p.id) AS roots FROM rec WHERE llm_parse IS NOT NULL)
        SELECT eval_id, CASE WHEN len(roots) = 0 THEN 'no_root' ELSE 'multiple_roots: tokens [' || array_to_string(roots, ', ') || ']' END AS warning FROM r WHERE len(roots) <> 1""",
    "deprel_prf1": f"""WITH {CTE}, {_X}, s AS (SELECT cond_ord, lower(deprel) AS label, CAST(las AS INT) AS tp, 0 AS fp, CAST(NOT las AS INT) AS fn FROM f UNION ALL SELECT cond_ord, lower(p_deprel), 0, 1, 0 FROM f WHERE NOT las AND p_deprel IS NOT NULL),
        t AS (SELECT cond_ord, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY 1, 2)
        SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM t WHERE tp + fn >= 50""",
    "deprel_confusion": f"""WITH {CTE}, {_X}, c AS (SELECT cond_ord, lower(deprel) AS gold_label, lower(p_deprel) AS pred_label, count(*) AS n FROM f WHERE uas AND NOT las GROUP BY 1, 2, 3)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cond_ord, gold_label ORDER BY n DESC, pred_label ASC NULLS FIRST) AS INTEGER) AS place FROM c) WHERE place <= 5""",
    "confusion_matrix": f"WITH {CTE}, {_X} SELECT lower(deprel) AS gold_label, " + ", ".join(f"count(*) FILTER (lower(p_deprel) = '{c}') AS as_{c}" for c in tok.TARGET_LABELS)
    + " FROM f WHERE uas AND NOT las AND lower(deprel) IN (" + ", ".join(f"'{c}'" for c in tok.TARGET_LABELS) + ") GROUP BY 1",
    "critique_churn": f"""WITH {CTE}, {_CHANGE.format(a=4, b=5)}, k AS (SELECT model_ord, count(*) AS tokens, count(*) FILTER (NOT same AND NOT ra AND rb) AS wrong_to_correct, count(*) FILTER (NOT same AND ra AND NOT rb) AS correct_to_wrong,
        count(*) FILTER (NOT same AND ra = rb) AS wrong_to_wrong FROM j GROUP BY 1), p AS (SELECT model_ord, count(*) AS sentences FROM pair GROUP BY 1)
        SELECT *, wrong_to_correct + correct_to_wrong + wrong_to_wrong AS changed, wrong_to_correct - correct_to_wrong AS net FROM k JOIN p USING (model_ord)""",
    "token_diff_rows": f"""WITH {CTE}, {_CHANGE.format(a=2, b=3)}, d AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY gpos) - 1 AS place FROM j
        WHERE NOT ((a.head IS NOT DISTINCT FROM g.head) AND (a.deprel IS NOT DISTINCT FROM g.deprel) AND (b.head IS NOT DISTINCT FROM g.head) AND (b.deprel IS NOT DISTINCT FROM g.deprel)))
        SELECT model_ord, sent_id, CAST(place AS INTEGER) AS place, g.id AS id, g.form AS form, g.head AS gold_head, g.deprel AS gold_deprel, a.head AS first_head, a.deprel AS first_deprel, b.head AS second_head, b.deprel AS second_deprel FROM d WHERE place < 12""",
    "qualitative_picks": f"""WITH {CTE}, {_counts('al', 'model_ord, cond_ord, sent_id', 'llm_parse IS NOT NULL')},
        pr AS (SELECT a.model_ord, a.sent_id, a.n_tokens, a.las_correct AS l2, b.las_correct AS l3 FROM n a JOIN n b ON a.model_ord = b.model_ord AND a.sent_id = b.sent_id WHERE a.cond_ord = 2 AND b.cond_ord = 3 AND a.n_tokens > 0),
        br AS (SELECT a.model_ord, a.sent_id, count(*) FILTER (a.las AND NOT b.las) AS k, count(*) AS n_tokens FROM f a JOIN f b ON a.model_ord = b.model_ord AND a.sent_id = b.sent_id AND a.id = b.id WHERE a.cond_ord = 4 AND b.cond_ord = 5 GROUP BY 1, 2),
        c AS (SELECT 'semantic_gain' AS pick, CAST(l3 - l2 AS INTEGER) AS key, CAST(n_tokens AS INTEGER) AS n_tokens, model_ord, sent_id FROM pr WHERE l3 > l2 UNION ALL SELECT 'syntax_failure', 0, n_tokens, model_ord, sent_id FROM pr WHERE l2 = 0
          UNION ALL SELECT 'critique_break', k, n_tokens, model_ord, sent_id FROM br WHERE k > 0)
        SELECT pick, CAST(key AS INTEGER) AS key, CAST(n_tokens AS INTEGER) AS n_tokens, model_ord, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY key DESC, n_tokens DESC, model_ord, sent_id) AS rk FROM c) WHERE rk = 1""",
    "score_distribution": f"WITH {CTE}, {_counts('al', 'model_ord, cond_ord')} SELECT model_ord, cond_ord, CAST(least(las_correct * 20 // n_tokens, 19) AS INTEGER) AS bin, count(*) AS sentences, count(*) FILTER (las_correct = 0) AS zeros, count(*) FILTER (las_correct = n_tokens) AS perfect FROM n WHERE n_tokens > 0 GROUP BY 1, 2, 3",
    "failure_profile": f"""WITH {CTE}, q AS (SELECT split_part(sent_id, '-', 1) AS genre, len(gold) AS length, trim(CASE WHEN llm_parse IS NOT NULL THEN 'parsed' WHEN length(api_error) > 0 THEN 'api_error'
        WHEN validation_error IS NOT NULL THEN regexp_replace(validation_error, '[:(\\n].*$', '', 's') ELSE 'unexplained' END, ' ') AS kind FROM rec WHERE gold IS NOT NULL)
        SELECT genre, kind, count(*) AS n, CAST(sum(length) AS BIGINT) AS sum_length, CAST(min(length) AS INTEGER) AS min_length, CAST(max(length) AS INTEGER) AS max_length, CAST(median(length) AS DOUBLE) AS median_length FROM q GROUP BY 1, 2""",
    "evaluation_summary": f"""WITH {CTE} SELECT cond_ord, count(*) AS total, count(uas) AS scored, count(validation_error) AS validation_errors, count(api_error) AS api_errors,
        count(*) FILTER (len(list_filter(structural_warnings, lambda w: contains(w, 'no_root'))) > 0) AS no_root, CAST(sum(CAST(round(uas * 10000) AS BIGINT)) AS BIGINT) / count(uas) AS mean_uas_bp, CAST(sum(CAST(round(las * 10000) AS BIGINT)) AS BIGINT) / count(las) AS mean_las_bp FROM rec GROUP BY 1""",
    "usage_rollup": "SELECT model_config.model_name AS model_name, CAST(sum(usage.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(usage.completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(usage.total_tokens) AS BIGINT) AS total_tokens, count(*) AS calls, CAST(grouping(model_config.model_name) AS INTEGER) AS is_total FROM model_responses GROUP BY ROLLUP (model_config.model_name)",
    "baseline_lengths": f"""WITH {CTE}, q AS (SELECT * FROM rec WHERE llm_parse IS NOT NULL AND gold IS NOT NULL),
        gz AS (SELECT eval_id, unnest(gold) AS g, generate_subscripts(gold, 1) AS pos FROM q), pz AS (SELECT eval_id, unnest(llm_parse) AS p, generate_subscripts(llm_parse, 1) AS pos FROM q),
        h AS (SELECT eval_id, count(*) FILTER (g.head = p.head AND g.upos <> 'PUNCT') AS hits FROM gz JOIN pz USING (eval_id, pos) GROUP BY 1)
        SELECT model_ord, cond_ord, count(*) AS sentences, count(*) FILTER (len(gold) <> len(llm_parse)) AS other_length, CAST(coalesce(sum(hits), 0) AS BIGINT) AS head_hits FROM q LEFT JOIN h USING (eval_id) GROUP BY 1, 2""",
    "flatten_metrics": f"WITH {CTE}, {_A}, t AS (SELECT model_ord, cond_ord, {_SUMS} FROM f GROUP BY 1, 2) SELECT model_ord || '/' || cond_ord || '/' || metric AS path, value FROM (UNPIVOT t ON total, uas_correct, las_correct INTO NAME metric VALUE value)",
    "denominator_check": f"WITH {CTE}, {_A}, w AS (SELECT count(*) AS want FROM (SELECT unnest(gold) AS g FROM ref) WHERE g.upos <> 'PUNCT'), t AS (SELECT model_ord, cond_ord, count(*) AS total FROM f GROUP BY 1, 2) SELECT * FROM t, w WHERE total <> want",
    "rescored_mismatch": f"""WITH {CTE}, {_counts('rec', 'model_ord, cond_ord, eval_id', 'llm_parse IS NOT NULL AND gold IS NOT NULL AND exclude_punct')}, m AS (SELECT n.*, rec.uas, rec.las FROM n JOIN rec USING (eval_id))
        SELECT n.model_ord, n.cond_ord, count(*) AS checked, count(*) FILTER (abs(n.uas * n_tokens - uas_correct) > n_tokens * 0.0001::DOUBLE) AS uas_off, count(*) FILTER (abs(n.las * n_tokens - las_correct) > n_tokens * 0.0001::DOUBLE) AS las_off FROM m n GROUP BY 1, 2""",
}
SQL["score_statistics"] = f"""WITH {CTE}, {_counts('al', 'model_ord, cond_ord')}, r AS (SELECT model_ord, cond_ord, uas_correct / n_tokens AS uas, las_correct / n_tokens AS las FROM n WHERE n_tokens > 0)
  SELECT model_ord, cond_ord, count(*) AS sentences, """ + ", ".join(f"round(avg({c}), 9) AS mean_{c}, round(median({c}), 9) AS median_{c}, round(stddev_pop({c}), 9) AS deviation_{c}, count(*) FILTER ({c} = 0) AS zeros_{c}, count(*) FILTER ({c} = 1) AS perfect_{c}" for c in ("uas", "las")) + " FROM r GROUP BY 1, 2"
SQL["failure_lengths"] = f"""WITH {CTE}, r AS (SELECT model_ord, cond_ord, len(gold) AS n, llm_parse IS NULL AS failed FROM rec WHERE gold IS NOT NULL) SELECT model_ord, cond_ord, """ + ", ".join(
    f"count(*) FILTER ({c}) AS {n}, avg(n) FILTER ({c}) AS {n}_mean_length, CAST(median(n) FILTER ({c}) AS DOUBLE) AS {n}_median_length" for c, n in (("failed", "failures"), ("NOT failed", "successes"))
) + " FROM r GROUP BY 1, 2"
SQL["confused_labels"] = f"""WITH {CTE}, {_X}, c AS (SELECT cond_ord, lower(deprel) AS gold_label, lower(p_deprel) AS pred_label, count(*) AS n FROM f WHERE uas AND NOT las GROUP BY 1, 2, 3),
  o AS (SELECT *, row_number() OVER (PARTITION BY cond_ord, gold_label ORDER BY n DESC, pred_label ASC NULLS FIRST) AS rk FROM c), s AS (SELECT cond_ord, gold_label, CAST(sum(n) AS BIGINT) AS n, any_value(pred_label) FILTER (rk = 1) AS most_frequent FROM o GROUP BY 1, 2)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cond_ord ORDER BY n DESC, gold_label) AS INTEGER) AS place FROM s) WHERE place <= 15"""
SQL["top_relations"] = f"""WITH {CTE}, {_A}, t AS (SELECT *, CAST(row_number() OVER (ORDER BY support DESC, deprel) AS INTEGER) AS place FROM (SELECT g.deprel AS deprel, count(*) AS support FROM (SELECT unnest(gold) AS g FROM ref) WHERE g.upos <> 'PUNCT' GROUP BY 1)),
  a AS (SELECT model_ord, cond_ord, deprel, {_ACC} FROM f GROUP BY 1, 2, 3) SELECT model_ord, cond_ord, deprel, place, support, las_correct, las FROM a JOIN t USING (deprel) WHERE place <= 15"""
SQL["formatted_scores"] = f"WITH {CTE}, {_A}, t AS (SELECT model_ord, cond_ord, {_ACC} FROM f GROUP BY 1, 2) SELECT model_ord, cond_ord, printf('%.2f', uas * 100) AS uas, printf('%.2f', las * 100) AS las, CASE WHEN las / 2000 < 0.0001::DOUBLE THEN '<0.0001' ELSE printf('%.4f', las / 2000) END AS small FROM t"
