"""Queries of the evaluator and of the prompt audit, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from treemill.functions import tokens as tok
from treemill.operators import answers, evaluator, prompts, provenance, scoring
from treemill.plans.scoring_queries import _all
from treemill.plans.session import table
from treemill.plans.text_queries import _USER, _parse_json, _trim

#: Conditions whose system message ends in retrieved examples, and the one that corrects another's parses.
RETRIEVAL, CRITIQUE, REASONING = ("few_shot_retrieval", "semantic_retrieval"), "critique_refine", "cot_few_shot"


def _with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored call with the gold tree and text of its sentence's first evaluation, null where there is none."""
    calls = table(spark, sf_dir, "model_responses").select(
        "response_id", "sent_id", "experiment", F.col("model_config.model_name").alias("model_name"), "raw_response", "api_error", F.col("prompt.system_msg").alias("system"), F.col("prompt.user_msg").alias("user")
    )
    order = W.partitionBy("sent_id").orderBy("eval_id")
    gold = table(spark, sf_dir, "model_evaluation").filter("size(gold.id) > 0 and sent_id is not null").select("sent_id", "eval_id", F.col("text").alias("gold_text"), tok.slim("gold").alias("gold"))
    first = gold.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "eval_id")
    return calls.join(first, "sent_id", "left")


def _records(spark: SparkSession, sf_dir: str, exclude_punct: bool) -> DataFrame:
    rows = _with_gold(spark, sf_dir).select("response_id", "experiment", "raw_response", "api_error", "gold")
    return evaluator.evaluated(rows, exclude_punct=exclude_punct)


def evaluated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored answer evaluated anew: outcome, scores without punctuation, errors, warnings, reasoning."""
    rows = _records(spark, sf_dir, True)
    return rows.select(
        "response_id", "status", F.size("llm_parse").alias("n_parsed"), "uas", "las", F.size("token_errors").alias("n_errors"), F.array_join("structural_warnings", "; ").alias("warnings"),
        F.md5("cot_reasoning").alias("reasoning_hash"), F.substring_index("validation_error", ":", 1).alias("validation"),
    )


def evaluated_with_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every stored answer with punctuation counted."""
    return _records(spark, sf_dir, False).filter("las is not null").select("response_id", "uas", "las", F.size("token_errors").alias("n_errors"))


def evaluated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token errors of all answers evaluated anew, by experiment, kind and gold label."""
    rows = _records(spark, sf_dir, True).select("experiment", F.explode("token_errors").alias("e"))
    return rows.groupBy("experiment", F.col("e.error_type").alias("error_type"), F.col("e.gold_deprel").alias("gold_deprel")).agg(F.count("*").alias("n"))


def evaluated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per experiment of all answers evaluated anew."""
    return evaluator.totals(_records(spark, sf_dir, True), "experiment")


def score_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed anew against the stored evaluations: null alike, of one size, and of the same scores against the stored gold."""
    calls = table(spark, sf_dir, "model_responses").select("response_id", "raw_response", F.lit(None).cast("string").alias("api_error"))
    stored = _all(spark, sf_dir).select("response_id", "cond_ord", "gold", F.col("llm_parse").alias("stored"), F.col("uas").alias("stored_uas"), F.col("las").alias("stored_las"))
    both = evaluator.evaluated(stored.join(calls, "response_id"))
    near = lambda c: F.abs(F.col(c) - F.col(f"stored_{c}")) <= 0.0001
    return both.groupBy("cond_ord").agg(
        F.count("*").alias("n"), F.count_if(F.col("stored").isNull() == F.col("llm_parse").isNull()).alias("same_null"), F.count_if(F.size("stored") == F.size("llm_parse")).alias("same_size"),
        F.count_if(near("uas") & near("las")).alias("same_scores"),
    )


# -- prompts ------------------------------------------------------------------------------------
def _prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _with_gold(spark, sf_dir)
    done = scoring.latest(_all(spark, sf_dir).select("model_ord", "cond_ord", "model_name", "experiment", "sent_id", "llm_parse", "evaluated_at", "eval_id"))
    source = done.filter((F.col("experiment") == REASONING) & F.col("llm_parse").isNotNull()).select("model_name", "sent_id", F.filter("llm_parse", lambda t: t.isNotNull()).alias("source_parse"))
    rows = calls.join(source, ["model_name", "sent_id"], "left").join(provenance.bases(calls, "experiment"), "experiment")
    return provenance.records(rows, "experiment", RETRIEVAL, CRITIQUE)


def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every call's messages, and the template that its user message follows."""
    return _prompt_records(spark, sf_dir).select("response_id", "system_sha256", "user_sha256", "prompt_pair_sha256", "user_template")


def prompt_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and condition the calls whose messages are the ones that can be built, by template, and the distinct ones."""
    return provenance.audit(_prompt_records(spark, sf_dir), "model_name", "experiment")


QUERIES = {f.__name__: f for f in (evaluated_records, evaluated_with_punct, evaluated_errors, evaluated_totals, score_agreement, prompt_records, prompt_provenance)}

# -- SQL ----------------------------------------------------------------------------------------
_WHOLE = "CASE json_type({0}) WHEN 'BOOLEAN' THEN CASE WHEN {0}::VARCHAR = 'true' THEN 1 ELSE 0 END WHEN 'DOUBLE' THEN CASE WHEN TRY_CAST({0}::VARCHAR AS DOUBLE) = floor(TRY_CAST({0}::VARCHAR AS DOUBLE)) THEN TRY_CAST({0}::VARCHAR AS DOUBLE)::BIGINT END WHEN 'VARCHAR' THEN TRY_CAST(replace(regexp_extract({0}->>'$', '^\\s*([+-]?[0-9]+(_[0-9]+)*)\\s*$', 1), '_', '') AS BIGINT) WHEN 'NULL' THEN NULL ELSE TRY_CAST({0}::VARCHAR AS BIGINT) END"
_TEXT = "CASE json_type({0}) WHEN 'NULL' THEN 'None' ELSE {0}->>'$' END"
#: CTEs up to ``ans``: ``response_id, status, toks, reasoning`` of every stored answer, by the strict rules.
ANSWERS = f"""
a0 AS (SELECT response_id, raw_response, api_error, {_trim('raw_response')} AS s FROM model_responses),
a1 AS (SELECT *, CASE WHEN instr(s, '{{') > 0 THEN substr(s, instr(s, '{{')) END AS part FROM a0),
a2 AS (SELECT *, CASE WHEN regexp_matches(part, ',\\s*[\\]}}]') OR regexp_matches(part, '[\\[,]\\s*,') THEN NULL ELSE TRY_CAST(part AS JSON) END AS j FROM a1),
a3 AS (SELECT *, CASE WHEN json_type(j->'tokens') = 'ARRAY' THEN CAST(j->'tokens' AS JSON[]) END AS js FROM a2),
a4 AS (SELECT *, list_transform(js, lambda t: CASE WHEN json_type(t) = 'OBJECT' THEN {{'id': {_WHOLE.format("(t->'id')")}, 'form': {_TEXT.format("(t->'form')")}, 'upos': {_TEXT.format("(t->'upos')")}, 'head': {_WHOLE.format("(t->'head')")}, 'deprel': {_TEXT.format("(t->'deprel')")}}} END) AS toks FROM a3),
ans AS (SELECT response_id, raw_response, api_error, CASE WHEN length(api_error) > 0 THEN 'api_error' WHEN s IS NULL OR s = '' THEN 'empty' WHEN part IS NULL THEN 'no_json' WHEN j IS NULL THEN 'decode_error'
  WHEN js IS NULL OR len(list_filter(toks, lambda t: t IS NULL OR t.id IS NULL OR t.form IS NULL OR t.upos IS NULL OR t.head IS NULL OR t.deprel IS NULL OR abs(t.id) > 2147483647 OR abs(t.head) > 2147483647)) > 0 THEN 'schema_error' ELSE 'parsed' END AS status,
  toks, CASE WHEN instr(s, '{{') > 1 THEN nullif({_trim("substr(s, 1, instr(s, chr(123)) - 1)")}, '') END AS reasoning FROM a4)
"""
_FIRST = "first_gold AS (SELECT sent_id, gold_text, gold FROM (SELECT sent_id, text AS gold_text, gold, row_number() OVER (PARTITION BY sent_id ORDER BY eval_id) AS rk FROM model_evaluation WHERE len(gold) > 0 AND sent_id IS NOT NULL) WHERE rk = 1)"


def _scored(rows: str, where: str) -> str:
    """CTEs up to ``sc``: per row of ``rows`` (``rid``, ``gold``, ``toks``) its counts; ``er`` has the wrong tokens."""
    return f"""
g AS (SELECT rid, unnest(gold) AS g FROM {rows} WHERE toks IS NOT NULL AND gold IS NOT NULL),
t0 AS (SELECT rid, unnest(toks) AS p, generate_subscripts(toks, 1) AS pos FROM {rows} WHERE toks IS NOT NULL),
t1 AS (SELECT rid, p FROM (SELECT rid, p, row_number() OVER (PARTITION BY rid, p.id ORDER BY pos DESC) AS rk FROM t0) WHERE rk = 1),
er AS (SELECT g.rid, g.g.deprel AS deprel, coalesce(p.head = g.g.head, FALSE) AS uas, coalesce(lower(p.deprel) = lower(g.g.deprel), FALSE) AS lab, t1.rid IS NOT NULL AS found FROM g LEFT JOIN t1 ON t1.rid = g.rid AND t1.p.id = g.g.id WHERE {where}),
sc AS (SELECT r.rid, round_even(coalesce(count(*) FILTER (er.uas) / nullif(count(er.rid), 0), 0.0), 4) AS uas, round_even(coalesce(count(*) FILTER (er.uas AND er.lab) / nullif(count(er.rid), 0), 0.0), 4) AS las,
  CAST(count(er.rid) FILTER (NOT (er.uas AND er.lab)) AS INTEGER) AS n_errors FROM {rows} r LEFT JOIN er ON er.rid = r.rid WHERE r.toks IS NOT NULL AND r.gold IS NOT NULL GROUP BY 1)"""


_CALLS = f"""{ANSWERS}, {_FIRST},
c AS (SELECT row_number() OVER () AS rid, ans.response_id, r.experiment, ans.status, ans.reasoning, ans.raw_response, ans.api_error, CASE WHEN ans.status = 'parsed' THEN toks END AS toks, first_gold.gold
  FROM ans JOIN model_responses r USING (response_id) LEFT JOIN first_gold ON first_gold.sent_id = r.sent_id)"""
_NO_PUNCT = "g.g.upos <> 'PUNCT'"
_ROOTS = "list_transform(list_filter(toks, lambda t: t.head = 0), lambda t: t.id)"
_KIND = "CASE WHEN NOT found THEN 'missing_token' WHEN NOT uas AND NOT lab THEN 'head_and_deprel' WHEN NOT uas THEN 'head_only' ELSE 'deprel_only' END"
_RECORDS = f"""{_CALLS}, {_scored('c', _NO_PUNCT)},
w AS (SELECT rid, CASE WHEN toks IS NULL OR len({_ROOTS}) = 1 THEN '' WHEN len({_ROOTS}) = 0 THEN 'no_root' ELSE 'multiple_roots: tokens [' || array_to_string({_ROOTS}, ', ') || ']' END AS warnings FROM c),
rec2 AS (SELECT c.*, CASE WHEN c.status = 'empty' AND length(raw_response) > 0 THEN 'no_json' ELSE c.status END AS final, sc.uas, sc.las, sc.n_errors, w.warnings FROM c LEFT JOIN sc USING (rid) JOIN w USING (rid))"""
_VALIDATION = "CASE final WHEN 'empty' THEN 'empty_response' WHEN 'no_json' THEN 'json_decode_error' WHEN 'decode_error' THEN 'json_decode_error' WHEN 'schema_error' THEN 'schema_error' END"
SQL = {
    "evaluated_records": f"""WITH {_RECORDS} SELECT response_id, final AS status, CAST(len(toks) AS INTEGER) AS n_parsed, uas, las, n_errors, warnings, CASE WHEN final IN ('parsed', 'schema_error') THEN md5(reasoning) END AS reasoning_hash, {_VALIDATION} AS validation FROM rec2""",
    "evaluated_with_punct": f"WITH {_CALLS}, {_scored('c', 'TRUE')} SELECT c.response_id, sc.uas, sc.las, sc.n_errors FROM sc JOIN c USING (rid)",
    "evaluated_errors": f"WITH {_CALLS}, {_scored('c', _NO_PUNCT)} SELECT c.experiment, {_KIND} AS error_type, er.deprel AS gold_deprel, count(*) AS n FROM er JOIN c USING (rid) WHERE NOT (uas AND lab) GROUP BY 1, 2, 3",
    "evaluated_totals": f"""WITH {_RECORDS} SELECT experiment, count(*) AS total, count(uas) AS scored, count(*) FILTER ({_VALIDATION} IS NOT NULL) AS validation_errors, count(*) FILTER (length(api_error) > 0) AS api_errors,
      count(*) FILTER (warnings = 'no_root') AS no_root, CAST(sum(CAST(round(uas * 10000) AS BIGINT)) AS BIGINT) / count(uas) AS mean_uas_bp, CAST(sum(CAST(round(las * 10000) AS BIGINT)) AS BIGINT) / count(las) AS mean_las_bp FROM rec2 GROUP BY 1""",
    "parse_raw_response": f"WITH {ANSWERS} SELECT response_id, status, CASE WHEN status = 'parsed' THEN CAST(len(toks) AS INTEGER) END AS n_tokens FROM ans",
}
_REC = """rec AS (SELECT e.*, r.experiment, s.model_name, s.model_ord, s.cond_ord FROM model_evaluation e JOIN model_responses r ON e.response_id = r.response_id JOIN system_dim s ON s.model_name = r.model_config.model_name AND s.experiment = r.experiment)"""
SQL["reparse_agreement"] = f"""WITH {ANSWERS}, {_REC}, b AS (SELECT rec.cond_ord, rec.llm_parse, CASE WHEN ans.status = 'parsed' THEN toks END AS toks FROM rec JOIN ans USING (response_id))
  SELECT cond_ord, count(*) AS n, count(*) FILTER ((llm_parse IS NULL) = (toks IS NULL)) AS same_null, count(*) FILTER (len(llm_parse) = len(toks)) AS same_size FROM b GROUP BY 1"""
SQL["score_agreement"] = f"""WITH {ANSWERS.replace("CASE WHEN length(api_error) > 0 THEN 'api_error' WHEN s IS", "CASE WHEN s IS")}, {_REC},
  c AS (SELECT row_number() OVER () AS rid, rec.cond_ord, rec.llm_parse, rec.uas AS stored_uas, rec.las AS stored_las, rec.gold, CASE WHEN ans.status = 'parsed' THEN toks END AS toks FROM rec JOIN ans USING (response_id)), {_scored('c', _NO_PUNCT)}
  SELECT cond_ord, count(*) AS n, count(*) FILTER ((llm_parse IS NULL) = (toks IS NULL)) AS same_null, count(*) FILTER (len(llm_parse) = len(toks)) AS same_size,
    count(*) FILTER (abs(sc.uas - stored_uas) <= 0.0001::DOUBLE AND abs(sc.las - stored_las) <= 0.0001::DOUBLE) AS same_scores FROM c LEFT JOIN sc USING (rid) GROUP BY 1"""

_BASE = "split_part(r.prompt.system_msg, chr(10) || chr(10) || 'Input:', 1)"
_GOOD = """len(blocks) = 3 AND len(list_filter(blocks, lambda b: NOT (contains(b, chr(10) || chr(10) || 'Output:' || chr(10)) AND coalesce(json_type(TRY_CAST(substr(b, instr(b, chr(10) || chr(10) || 'Output:' || chr(10)) + 10) AS JSON)->'tokens') = 'ARRAY', FALSE)))) = 0"""
_MESSAGE = f"'Sentence: ' || gold_text || chr(10) || chr(10) || 'Tokens:' || chr(10) || array_to_string(list_transform(gold, lambda t: t.id || chr(9) || t.form), chr(10)) || chr(10) || chr(10) || 'Existing parse:' || chr(10) || {_parse_json('source')}"
_PROMPTS = f"""{_FIRST}, {_REC}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_ord, cond_ord, sent_id ORDER BY evaluated_at DESC NULLS LAST, eval_id DESC) AS rk FROM rec) WHERE rk = 1),
src AS (SELECT model_name, sent_id, list_filter(llm_parse, lambda t: t IS NOT NULL) AS source FROM last WHERE experiment = '{REASONING}' AND llm_parse IS NOT NULL),
bases AS (SELECT experiment, base FROM (SELECT experiment, base, row_number() OVER (PARTITION BY experiment ORDER BY count(*) DESC, base) AS rk FROM (SELECT r.experiment, {_BASE} AS base FROM model_responses r WHERE r.prompt.system_msg IS NOT NULL) GROUP BY 1, 2) WHERE rk = 1),
pr AS (SELECT r.response_id, r.experiment, r.model_config.model_name AS model_name, r.prompt.system_msg AS system, r.prompt.user_msg AS usr, f.gold_text, f.gold, src.source, bases.base,
  CASE WHEN starts_with(r.prompt.system_msg, bases.base || chr(10) || chr(10) || 'Input:' || chr(10) || '# text = ') THEN string_split(substr(r.prompt.system_msg, length(bases.base) + length(chr(10) || chr(10) || 'Input:' || chr(10) || '# text = ') + 1), chr(10) || chr(10) || 'Input:' || chr(10) || '# text = ') END AS blocks
  FROM model_responses r JOIN bases USING (experiment) LEFT JOIN first_gold f ON f.sent_id = r.sent_id LEFT JOIN src ON src.model_name = r.model_config.model_name AND src.sent_id = r.sent_id),
pq AS (SELECT *, CASE WHEN experiment = '{CRITIQUE}' THEN CASE WHEN usr = {_MESSAGE} THEN 'standard_critique' WHEN usr = '# text = ' || gold_text || chr(10) || chr(10) || 'Existing parse:' || chr(10) || {_parse_json('source')} THEN 'short_critique' END
  WHEN usr = {_USER.replace('|| text ||', '|| gold_text ||')} THEN 'first_pass' END AS user_template,
  experiment NOT IN ('{RETRIEVAL[0]}', '{RETRIEVAL[1]}') AND coalesce(system = base, FALSE) AS static_match, experiment IN ('{RETRIEVAL[0]}', '{RETRIEVAL[1]}') AND coalesce({_GOOD}, FALSE) AS retrieval_match FROM pr)"""
SQL["prompt_records"] = f"WITH {_PROMPTS} SELECT response_id, sha256(system) AS system_sha256, sha256(usr) AS user_sha256, sha256(system || chr(0) || usr) AS prompt_pair_sha256, user_template FROM pq"
SQL["prompt_provenance"] = f"""WITH {_PROMPTS} SELECT model_name, experiment, count(*) AS record_count, count(*) FILTER (static_match) AS static_system_matches, count(*) FILTER (retrieval_match) AS retrieval_template_matches,
  count(user_template) AS regenerated_user_matches, count(*) FILTER (user_template = 'standard_critique') AS standard_critique_user_matches, count(*) FILTER (user_template = 'short_critique') AS short_critique_user_matches,
  count(DISTINCT sha256(system)) AS unique_system_prompts, count(DISTINCT sha256(usr)) AS unique_user_messages, count(DISTINCT sha256(system || chr(0) || usr)) AS unique_prompt_pairs,
  bool_and(static_match OR retrieval_match) AS system_verified, bool_and(user_template IS NOT NULL) AS user_verified FROM pq GROUP BY 1, 2"""
SQL["demonstration_check"] = f"WITH {_PROMPTS} SELECT response_id, coalesce({_GOOD}, FALSE) AS valid FROM pr WHERE experiment IN ('{RETRIEVAL[0]}', '{RETRIEVAL[1]}')"
