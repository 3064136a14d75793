"""The seven tables of the report, and the checks of a results folder, from the stored tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from treemill.operators import stats
from treemill.plans import scoring_queries as sq, stats_queries as stq
from treemill.plans.session import table
from treemill.sinks import writers
from treemill.sinks.reports import Report

SYS = ("model_ord", "cond_ord")


def _named(rows: DataFrame, systems: DataFrame) -> DataFrame:
    return systems.join(rows, list(SYS))


def pairwise(spark: SparkSession, sf_dir: str, resamples: int = stq.WHOLE_RESAMPLES) -> DataFrame:
    """Pairs of conditions with difference, interval, p and Holm's correction within each model, and over the primary ones."""
    rows = stq.whole_pairs(stq._numbered_tokens(spark, sf_dir), resamples)
    within = stats.holm(rows, "p", F.concat_ws("/", "first", "second"), "model_ord").withColumnRenamed("holm", "holm_within")
    key = F.concat_ws("/", F.col("model_ord").cast("string"), "first", "second")
    primary = stats.holm(rows.filter("primary").withColumn("family", F.lit("primary")), "p", key, "family").select("model_ord", "first", "second", F.col("holm").alias("holm_primary"))
    wanted = ("model_ord", "first", "second", "difference", "ci_low", "ci_high", "p", "holm_within", "primary")
    return within.select(*wanted).join(primary, ["model_ord", "first", "second"], "left")


def seven_tables(spark: SparkSession, sf_dir: str, resamples: int = stq.WHOLE_RESAMPLES) -> list[Report]:
    """Corpus scores, comparisons, reliability, lengths, relations, usage and churn."""
    systems = table(spark, sf_dir, "system_dim")
    named = lambda rows: _named(rows, systems)
    return [
        Report("corpus", "Corpus scores", named(sq.corpus_uas_las(spark, sf_dir)), SYS),
        Report("pairwise", "Comparisons of conditions", pairwise(spark, sf_dir, resamples), ("model_ord", "first", "second")),
        Report("reliability", "Reliability", named(sq.reliability_counts(spark, sf_dir)), SYS),
        Report("length", "Sentence lengths", named(sq.length_bins(spark, sf_dir)), (*SYS, "bin")),
        Report("relations", "Relations", named(sq.relation_las(spark, sf_dir)), (*SYS, "deprel")),
        Report("token_usage", "Token usage", sq.usage_rollup(spark, sf_dir), ("is_total", "model_name")),
        Report("critique_churn", "Changes by the critique pass", sq.critique_churn(spark, sf_dir), ("model_ord",)),
    ]


def numeric_digest(reports: list[Report]) -> dict[str, str]:
    """SHA-256 of every report's values as canonical JSON, sorted."""
    return {r.name: writers.digest(sorted((list(map(_plain, row)) for row in r.rows.collect()), key=str)) for r in reports}


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


def check_digests(reports: list[Report], stored: dict[str, str]) -> dict[str, str]:
    """What differs from stored digests: ``changed``, ``missing`` from the reports or ``not stored``; empty if all agree."""
    have = numeric_digest(reports)
    out = {name: "changed" for name in have.keys() & stored.keys() if have[name] != stored[name]}
    out |= {name: "missing" for name in stored.keys() - have.keys()}
    return out | {name: "not stored" for name in have.keys() - stored.keys()}


def write_report(spark: SparkSession, sf_dir: str, folder: str, resamples: int = stq.WHOLE_RESAMPLES) -> list[str]:
    """All tables as CSV and LaTeX, and the Markdown report."""
    from treemill.sinks import reports

    found = seven_tables(spark, sf_dir, resamples)
    os.makedirs(folder, exist_ok=True)
    names = reports.export_tables(found, folder)
    reports.write_markdown(found, "Results", f"{folder}/report.md", (f"Intervals and p values come from {resamples} paired resamples.",))
    return names
