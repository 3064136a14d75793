"""Bootstrap, correction and sampling queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treemill.operators import scoring, stats
from treemill.plans.scoring_queries import CTE, SYS, _aligned, _all, _counts
from treemill.plans.session import cut, table

#: ``RESAMPLES`` is what the queries with an SQL twin draw; the whole job of the reference (``*_whole``) draws ``WHOLE_RESAMPLES``.
RESAMPLES, WHOLE_RESAMPLES, SEED = 200, 10_000, 42
#: Unordered pairs of conditions compared as primary.
PRIMARY = (("s1", "s2"), ("s2", "s3"))


#: Columns of right labels: model and condition.
COLUMNS = [[f"m{m}s{c}" for c in range(6)] for m in (0, 1)]


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sentences, numbered, with the right labels of every system as columns."""
    n = scoring.sentence_counts(_aligned(spark, sf_dir), *SYS, "sent_id")
    system = F.concat(F.lit("m"), F.col("model_ord").cast("string"), F.lit("s"), F.col("cond_ord").cast("string"))
    wide = n.withColumn("system", system).groupBy("sent_id").pivot("system", COLUMNS[0] + COLUMNS[1])
    return number(wide.agg(F.sum("las_correct")), "sent_id")


def _numbered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_numbered`` with the scored tokens of each sentence, which all systems share."""
    n = scoring.sentence_counts(_aligned(spark, sf_dir), *SYS, "sent_id")
    system = lambda m, c: F.sum(F.when((F.col("model_ord") == m) & (F.col("cond_ord") == c), F.col("las_correct")))
    wide = n.groupBy("sent_id").agg(F.max("n_tokens").alias("tokens"), *[system(m, c).alias(COLUMNS[m][c]) for m in (0, 1) for c in range(6)])
    return number(wide, "sent_id")


def number(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``i``, the place of the unique ``key`` in its order from 0, and the total ``n``."""
    ranged = cut(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    total, before, pairs = 0, 0, []
    for part, size in sizes:
        pairs += [F.lit(part), F.lit(before)]
        before += size
    total = before
    start = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    return ranged.withColumn("i", (start + F.col("_at")).cast("long")).withColumn("n", F.lit(total).cast("long")).drop("_part", "_at")


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of draws for all systems: resampled sums of every column."""
    return stats.resample_sums(_numbered(spark, sf_dir), COLUMNS[0] + COLUMNS[1], RESAMPLES, SEED)


def bootstrap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled sums of right labels of both models' six conditions."""
    sums = _sums(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(m).alias("model_ord"), *[F.col(c).alias(c[2:]) for c in own]) for m, own in enumerate(COLUMNS)])
    return sums.select("resample", F.explode(each).alias("m")).select("resample", "m.*")


def _deltas(sums: DataFrame) -> DataFrame:
    """``model_ord, first, second, delta`` for the pairs of conditions within each model."""
    out = None
    for model, columns in enumerate(COLUMNS):
        own = sums.select("resample", *[F.col(c).alias(c[2:]) for c in columns])
        part = stats.pair_differences(own, [c[2:] for c in columns]).withColumn("model_ord", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


def _pairs(spark: SparkSession, sf_dir: str, smoothing: str = "add_one") -> DataFrame:
    return whole_pairs(_numbered_tokens(spark, sf_dir), RESAMPLES, smoothing)


def bootstrap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of conditions of both models: observed difference, percentile interval, smoothed p, and whether the pair is primary."""
    rows = _pairs(spark, sf_dir)
    return rows.select(*[F.round(c, 9).alias(c) if c in ("difference", "ci_low", "ci_high") else c for c in rows.columns])


def bootstrap_unsmoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of both models with raw p values and the significance flag."""
    return _pairs(spark, sf_dir, "raw").select("model_ord", "first", "second", "p", (F.col("p") < 0.05).alias("significant"))


def legacy_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older test: each pair of conditions of a model on the sentences that both have parsed."""
    return stats.paired_test(_common(spark, sf_dir), "sent_id", RESAMPLES, SEED, "model_ord", "first", "second").withColumn("difference", F.round("difference", 9))


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_ord, first, second, sent_id, n, a, b`` of the sentences that both conditions of a pair have parsed."""
    counts = scoring.sentence_counts(_aligned(spark, sf_dir, "exclude"), *SYS, "sent_id")
    known = counts.groupBy("model_ord", "sent_id").agg(F.max("n_tokens").alias("n"), F.array_sort(F.collect_list(F.struct("cond_ord", "las_correct"))).alias("c"))  # one entry a condition
    pairs = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y["cond_ord"] > x["cond_ord"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    each = known.select("model_ord", "sent_id", "n", F.explode(pairs).alias("p"))
    name = lambda c: F.concat(F.lit("s"), F.col(f"p.{c}.cond_ord").cast("string"))
    return each.select("model_ord", name("x").alias("first"), name("y").alias("second"), "sent_id", "n", F.col("p.x.las_correct").alias("a"), F.col("p.y.las_correct").alias("b"))


def alignment_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and scored tokens that both conditions of each pair within a model share."""
    return _common(spark, sf_dir).groupBy("model_ord", "first", "second").agg(F.count("*").alias("common"), F.sum("n").alias("tokens"))


def holm_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction over the fifteen pairs of each model."""
    return stats.holm(_pairs(spark, sf_dir).select("model_ord", "first", "second", "p"), "p", F.concat_ws("/", "first", "second"), "model_ord")


def holm_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction over the primary pairs of both models."""
    sides = F.array_sort(F.array("first", "second"))
    primary = F.lit(False)
    for pair in PRIMARY:
        primary = primary | (sides == F.array(*map(F.lit, sorted(pair))))
    rows = _pairs(spark, sf_dir).filter(primary).select("model_ord", "first", "second", "p").withColumn("family", F.lit("primary"))
    return stats.holm(rows, "p", F.concat_ws("/", F.col("model_ord").cast("string"), "first", "second"), "family").drop("family")


# -- the reference's job: 10,000 resamples, both models, intervals; too many draws for the SQL engine ----------------
def _whole_sums(numbered: DataFrame, resamples: int = WHOLE_RESAMPLES) -> DataFrame:
    return stats.resample_matrix(numbered, ["tokens", *COLUMNS[0], *COLUMNS[1]], resamples, SEED)


def whole_pairs(numbered: DataFrame, resamples: int = WHOLE_RESAMPLES, smoothing: str = "add_one") -> DataFrame:
    """All pairs of each model: observed difference of micro LAS, its percentile interval, p, and whether the pair is primary."""
    sums = cut(_whole_sums(numbered, resamples))
    scores = sums.select("resample", *[F.try_divide(F.col(c), F.col("tokens")).alias(c) for c in COLUMNS[0] + COLUMNS[1]])
    found = stats.two_sided(_deltas(scores), smoothing, by=("model_ord",))
    totals = numbered.agg(*[F.sum(c).alias(c) for c in ["tokens", *COLUMNS[0], *COLUMNS[1]]])
    observed = [
        F.struct(F.lit(m).alias("model_ord"), F.lit(a[2:]).alias("first"), F.lit(b[2:]).alias("second"), F.try_divide(F.col(a) - F.col(b), F.col("tokens")).alias("difference"))
        for m, own in enumerate(COLUMNS) for k, a in enumerate(own) for b in own[k + 1 :]
    ]
    sides = totals.select(F.explode(F.array(*observed)).alias("o")).select("o.*")
    return found.join(F.broadcast(sides), ["model_ord", "first", "second"]).withColumn("primary", _is_primary())


def _is_primary() -> Column:
    sides = F.array_sort(F.array("first", "second"))
    return F.exists(F.array(*[F.array(*map(F.lit, sorted(pair))) for pair in PRIMARY]), lambda pair: pair == sides)


def bootstrap_scores_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per resample the drawn tokens and the right labels of all twelve systems."""
    return _whole_sums(_numbered_tokens(spark, sf_dir))


def bootstrap_pairs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of conditions of both models with difference, interval and smoothed p."""
    return whole_pairs(_numbered_tokens(spark, sf_dir))


def bootstrap_unsmoothed_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of both models with interval, raw p and the significance flag."""
    return whole_pairs(_numbered_tokens(spark, sf_dir), smoothing="raw").withColumn("significant", F.col("p") < 0.05)


def holm_within_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction over the fifteen pairs of each model, of 10,000 resamples."""
    rows = whole_pairs(_numbered_tokens(spark, sf_dir)).select("model_ord", "first", "second", "difference", "ci_low", "ci_high", "p")
    return stats.holm(rows, "p", F.concat_ws("/", "first", "second"), "model_ord")


def holm_primary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction over the primary pairs of both models, of 10,000 resamples."""
    rows = whole_pairs(_numbered_tokens(spark, sf_dir)).filter("primary").select("model_ord", "first", "second", "difference", "ci_low", "ci_high", "p")
    return stats.holm(rows.withColumn("family", F.lit("primary")), "p", F.concat_ws("/", F.col("model_ord").cast("string"), "first", "second"), "family").drop("family")


def alignment_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that both models of a condition have parsed."""
    n = scoring.latest(_all(spark, sf_dir).select(*SYS, "sent_id", "llm_parse", "evaluated_at", "eval_id")).filter("llm_parse is not null")
    a = n.filter("model_ord = 0").select("cond_ord", "sent_id")
    b = n.filter("model_ord = 1").select("cond_ord", "sent_id")
    return a.join(b, ["cond_ord", "sent_id"]).groupBy("cond_ord").agg(F.count("*").alias("common"))


def reasoning_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty evaluations with reasoning and errors, from the harder half."""
    return reasoning_rows(spark, sf_dir, 50)


def reasoning_rows(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """As many evaluations with reasoning and errors, from the harder half."""
    rows = table(spark, sf_dir, "model_evaluation").filter("cot_reasoning is not null and cot_reasoning <> '' and llm_parse is not null and size(token_errors) > 0")
    return stats.harder_half_sample(rows.select("eval_id", "sent_id", "las"), "las", "eval_id", n, SEED)


QUERIES = {
    f.__name__: f
    for f in (
        bootstrap_scores, bootstrap_pairs, bootstrap_unsmoothed, holm_within, holm_primary, legacy_significance, alignment_inner, alignment_conditions, reasoning_sample,
        bootstrap_scores_whole, bootstrap_pairs_whole, bootstrap_unsmoothed_whole, holm_within_whole, holm_primary_whole,
    )
}

_S = [f"s{c}" for c in range(6)]
_BOOT = f"""WITH {CTE}, {_counts('al', 'model_ord, cond_ord, sent_id')},
 wide AS (SELECT model_ord, sent_id, max(n_tokens) AS tokens, {', '.join(f"CAST(sum(las_correct) FILTER (cond_ord = {c}) AS BIGINT) AS s{c}" for c in range(6))} FROM n GROUP BY 1, 2),
 num AS (SELECT *, row_number() OVER (PARTITION BY model_ord ORDER BY sent_id) - 1 AS i, count(*) OVER (PARTITION BY model_ord) AS n FROM wide),
 dr AS (SELECT model_ord, b, CAST('0x' || substr(md5('{SEED}-' || b || '-' || i), 1, 8) AS BIGINT) % n AS i FROM num, range({RESAMPLES}) AS r(b)),
 sums AS (SELECT dr.model_ord, dr.b, CAST(sum(tokens) AS BIGINT) AS tokens, {', '.join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in _S)} FROM dr JOIN num ON num.model_ord = dr.model_ord AND num.i = dr.i GROUP BY 1, 2),
 dl AS ({' UNION ALL '.join(f"SELECT model_ord, b, '{a}' AS first, '{b}' AS second, ({a} - {b}) / tokens AS delta FROM sums" for k, a in enumerate(_S) for b in _S[k + 1:])}),
 pr AS (SELECT model_ord, first, second, count(*) AS resamples, count(*) FILTER (delta <= 0) AS at_or_below, count(*) FILTER (delta >= 0) AS at_or_above, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM dl GROUP BY 1, 2, 3),
 ob AS ({' UNION ALL '.join(f"SELECT model_ord, '{a}' AS first, '{b}' AS second, (sum({a}) - sum({b})) / sum(tokens) AS difference FROM wide GROUP BY 1" for k, a in enumerate(_S) for b in _S[k + 1:])}),
 pp AS (SELECT pr.*, difference, {' OR '.join(f"(first = '{a}' AND second = '{b}')" for a, b in PRIMARY)} AS "primary", least(1.0::DOUBLE, 2 * (least(at_or_below, at_or_above) + 1) / (resamples + 1)) AS p FROM pr JOIN ob USING (model_ord, first, second))"""


def _holm(rows: str, family: str, key: str) -> str:
    return f"""SELECT model_ord, first, second, p, max(step) OVER (PARTITION BY {family} ORDER BY p, {key} ROWS UNBOUNDED PRECEDING) AS holm FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY {family})
  - row_number() OVER (PARTITION BY {family} ORDER BY p, {key}) + 1) * p) AS step FROM {rows})"""


_PRIMARY = " OR ".join(f"(first = '{a}' AND second = '{b}')" for a, b in PRIMARY)

SQL = {
    "bootstrap_scores": f"{_BOOT} SELECT CAST(b AS INTEGER) AS resample, model_ord, {', '.join(_S)} FROM sums",
    "bootstrap_pairs": f"{_BOOT} SELECT * REPLACE (round(difference, 9) AS difference, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high) FROM pp",
    "bootstrap_unsmoothed": f"{_BOOT}, q AS (SELECT model_ord, first, second, least(1.0::DOUBLE, 2 * least(at_or_below, at_or_above) / resamples) AS p FROM pr) SELECT *, p < 0.05 AS significant FROM q",
    "holm_within": f"{_BOOT} " + _holm("pp", "model_ord", "first, second"),
    "holm_primary": f"{_BOOT} " + _holm(f"(SELECT * FROM pp WHERE {_PRIMARY})", "1 + 0 * resamples", "model_ord, first, second"),
    "alignment_inner": f"WITH {CTE}, ok AS (SELECT * FROM last WHERE llm_parse IS NOT NULL) SELECT a.cond_ord, count(*) AS common FROM ok a JOIN ok b ON a.cond_ord = b.cond_ord AND a.sent_id = b.sent_id WHERE a.model_ord = 0 AND b.model_ord = 1 GROUP BY 1",
    "reasoning_sample": f"""WITH c AS (SELECT eval_id, sent_id, las, md5('{SEED}-' || eval_id) AS h FROM model_evaluation WHERE cot_reasoning IS NOT NULL AND cot_reasoning <> '' AND llm_parse IS NOT NULL AND len(token_errors) > 0),
        k AS (SELECT *, row_number() OVER (ORDER BY las ASC NULLS FIRST, h) AS rk, count(*) OVER () AS n FROM c) SELECT eval_id, sent_id, las FROM (SELECT * FROM k WHERE rk <= greatest(100, n // 2) ORDER BY h LIMIT 50)""",
}
_COMMON = f"""WITH {CTE}, {_counts('al', 'model_ord, cond_ord, sent_id', 'llm_parse IS NOT NULL')},
  cm AS (SELECT a.model_ord, 's' || a.cond_ord AS first, 's' || b.cond_ord AS second, a.sent_id, a.n_tokens AS n, a.las_correct AS a, b.las_correct AS b FROM n a JOIN n b ON a.model_ord = b.model_ord AND a.sent_id = b.sent_id AND a.cond_ord < b.cond_ord)"""
SQL["alignment_conditions"] = f"{_COMMON} SELECT model_ord, first, second, count(*) AS common, CAST(sum(n) AS BIGINT) AS tokens FROM cm GROUP BY 1, 2, 3"
SQL["legacy_significance"] = f"""{_COMMON}, nm AS (SELECT *, row_number() OVER (PARTITION BY model_ord, first, second ORDER BY sent_id) - 1 AS i, count(*) OVER (PARTITION BY model_ord, first, second) AS total FROM cm),
  dw AS (SELECT model_ord, first, second, r.b AS resample, CAST('0x' || substr(md5('{SEED}-' || r.b || '-' || i), 1, 8) AS BIGINT) % total AS i FROM nm, range({RESAMPLES}) AS r(b)),
  sm AS (SELECT model_ord, first, second, resample, sum(n) AS n, sum(a) AS a, sum(b) AS b FROM dw JOIN nm USING (model_ord, first, second, i) GROUP BY 1, 2, 3, 4),
  de AS (SELECT *, coalesce(a / nullif(n, 0), 0) - coalesce(b / nullif(n, 0), 0) AS delta FROM sm),
  ps AS (SELECT model_ord, first, second, least(1.0::DOUBLE, 2 * least(count(*) FILTER (delta <= 0), count(*) FILTER (delta >= 0)) / count(*)) AS p FROM de GROUP BY 1, 2, 3)
  SELECT model_ord, first, second, count(*) AS sentences, round(coalesce((sum(a) - sum(b)) / nullif(sum(n), 0), 0), 9) AS difference, any_value(p) AS p, any_value(p) < 0.05 AS significant FROM cm JOIN ps USING (model_ord, first, second) GROUP BY 1, 2, 3"""
