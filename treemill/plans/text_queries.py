"""Prompts, answers, tracker and integrity queries, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treemill.functions import text as tx, tokens as tok
from treemill.operators import answers, integrity, prompts, provenance, scoring, tracker
from treemill.plans.retrieval_queries import _SENT, _sentences
from treemill.plans.scoring_queries import _A, _ACC, CTE, _all, corpus_uas_las
from treemill.plans.session import table


#: Experiments in the order of the tracker's columns.
EXPERIMENTS = ("zero_shot", "few_shot_fixed", "few_shot_retrieval", "semantic_retrieval", "cot_few_shot", "critique_refine")


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of every sentence's demonstration block and first-pass message."""
    s = _sentences(spark, sf_dir)
    block, user = prompts.demonstration(F.col("text"), F.col("gold")), prompts.user_message(F.col("text"), F.col("gold"))
    return s.select("sent_id", F.sha2(block, 256).alias("block_hash"), F.length(block).alias("block_chars"), F.sha2(user, 256).alias("user_hash"))


def critique_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of both critique messages of every parsed evaluation."""
    rows = table(spark, sf_dir, "model_evaluation").filter("llm_parse is not null and gold is not null")
    parse = F.filter("llm_parse", lambda t: t.isNotNull())
    long, short = prompts.critique_message(F.col("text"), F.col("gold"), parse), prompts.short_critique_message(F.col("text"), parse)
    return rows.select("eval_id", F.sha2(long, 256).alias("long_hash"), F.sha2(short, 256).alias("short_hash"))


def retrieved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the demonstrations in the stored system messages, counted per experiment."""
    rows = table(spark, sf_dir, "model_responses").select("experiment", F.explode(prompts.retrieved_texts(F.col("prompt.system_msg"))).alias("text"))
    return rows.groupBy("experiment", "text").agg(F.count("*").alias("n"))


def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct message pairs and system messages of each experiment."""
    rows = table(spark, sf_dir, "model_responses")
    pair = prompts.pair_hash(F.col("prompt.system_msg"), F.col("prompt.user_msg"))
    return rows.groupBy("experiment").agg(F.count("*").alias("calls"), F.countDistinct(pair).alias("pairs"), F.countDistinct(F.sha2("prompt.system_msg", 256)).alias("systems"))


def prompt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-pass messages of all calls against those built from gold, per experiment; without gold none matches."""
    calls = table(spark, sf_dir, "model_responses").select("response_id", "sent_id", "experiment", F.col("prompt.system_msg").alias("system"), F.col("prompt.user_msg").alias("user"))
    return prompts.audit(calls.join(_sentences(spark, sf_dir).select("sent_id", "text", "gold"), "sent_id", "left"), "experiment")


def demonstration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each retrieval call's system message is well formed: its condition's base and three complete examples."""
    calls = table(spark, sf_dir, "model_responses").filter(F.col("experiment").isin("few_shot_retrieval", "semantic_retrieval")).select("response_id", "experiment", F.col("prompt.system_msg").alias("system"))
    rows = calls.join(provenance.bases(calls, "experiment"), "experiment")
    return rows.select("response_id", F.coalesce(provenance.valid_demonstrations("system", "base"), F.lit(False)).alias("valid"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the JSON part and of the reasoning before it in every answer."""
    rows = table(spark, sf_dir, "model_responses").filter("raw_response is not null")
    part, before = answers.json_part(F.col("raw_response")), answers.reasoning_part(F.col("raw_response"))
    return rows.select("response_id", F.md5(part).alias("json_hash"), F.length(part).alias("json_chars"), F.md5(before).alias("reasoning_hash"))


def parse_raw_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and number of tokens of every stored answer."""
    rows = table(spark, sf_dir, "model_responses").select("response_id", "raw_response", "api_error")
    return answers.routed(rows, "response_id", "raw_response", "api_error").select("response_id", "status", F.size("tokens").alias("n_tokens"))


def reparse_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed anew against the stored parses, per condition."""
    calls = table(spark, sf_dir, "model_responses").select("response_id", "raw_response", "api_error")
    fresh = answers.routed(calls, "response_id", "raw_response", "api_error")
    both = _all(spark, sf_dir).select("response_id", "cond_ord", "llm_parse").join(fresh, "response_id")
    return both.groupBy("cond_ord").agg(F.count("*").alias("n"), F.count_if(F.col("llm_parse").isNull() == F.col("tokens").isNull()).alias("same_null"), F.count_if(F.size("llm_parse") == F.size("tokens")).alias("same_size"))


def pending_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending sentences of every experiment that stand in the dev split, without a successful call of that experiment."""
    source = table(spark, sf_dir, "treebank_sentences").filter("split = 'dev'").select("sent_id")
    calls = table(spark, sf_dir, "model_responses").filter("api_success").select("experiment", "sent_id")
    rows, out = table(spark, sf_dir, "collection_tracker"), None
    for n, name in enumerate(EXPERIMENTS, 1):
        part = tracker.backlog(rows, f"experiment{n}_status", source, calls.filter(F.col("experiment") == name).select("sent_id")).select(F.lit(name).alias("experiment"), "sent_id")
        out = part if out is None else out.unionByName(part)
    return out


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending first-experiment sentences that no successful call has answered."""
    rows = tracker.pending(table(spark, sf_dir, "collection_tracker"), "experiment1_status").select("sent_id")
    done = table(spark, sf_dir, "model_responses").filter("experiment = 'zero_shot' and api_success").select("sent_id")
    return rows.filter("sent_id is not null").distinct().join(done, "sent_id", "left_anti")


def tracker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in each state of each experiment."""
    rows = table(spark, sf_dir, "collection_tracker")
    columns = [f"experiment{n}_status" for n in range(1, 7)]
    long = rows.unpivot([], columns, "experiment", "status")
    return long.groupBy("experiment", F.coalesce(tracker.state(F.col("status")), F.lit("NONE")).alias("state")).agg(F.count("*").alias("n"))


def tracker_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tracker by their state in each experiment, after the states of all stored calls are set."""
    calls = table(spark, sf_dir, "model_responses").filter("sent_id is not null")
    done = calls.select("experiment", "sent_id", F.when(F.col("api_success"), "DONE").otherwise("FAIL").alias("status"))
    rows = table(spark, sf_dir, "collection_tracker")
    for n, name in enumerate(EXPERIMENTS, 1):
        rows = tracker.updated(rows, f"experiment{n}_status", done.filter(F.col("experiment") == name).drop("experiment"))
    columns = [f"experiment{n}_status" for n in range(1, 7)]
    return rows.unpivot(["sent_id"], columns, "experiment", "status").groupBy("experiment", "status").agg(F.count("*").alias("n"))


def keyset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without an evaluation, and evaluations without a call."""
    return integrity.key_difference(table(spark, sf_dir, "model_responses"), table(spark, sf_dir, "model_evaluation"), "response_id")


def gold_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations whose gold heads and labels are not those of the sentence's first evaluation, by genre."""
    slim = F.transform("gold", lambda g: F.struct(g["id"], g["head"], g["deprel"]))
    rows = table(spark, sf_dir, "model_evaluation").filter("size(gold) > 0").select("sent_id", "eval_id", slim.alias("g"))
    reference = scoring.reference(table(spark, sf_dir, "model_evaluation")).select("sent_id", slim.alias("g"))
    both = rows.join(reference.withColumnRenamed("g", "r"), "sent_id")
    return both.groupBy(tok.genre(F.col("sent_id")).alias("genre")).agg(F.count("*").alias("n"), F.count_if(~F.col("g").eqNullSafe(F.col("r"))).alias("different"))


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sentences and tokens of each split."""
    return table(spark, sf_dir, "treebank_sentences").groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct("sent_id").alias("sentences"), F.sum("n_tokens").alias("tokens"), F.count("n_tokens").alias("counted"), F.count("text").alias("with_text")
    )


def split_text_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of the test split that training has as well, and those that it lacks."""
    rows = table(spark, sf_dir, "treebank_sentences").filter("text is not null")
    test, train = rows.filter("split = 'test'").select("text"), rows.filter("split = 'train'").select("text")
    both = test.intersect(train).withColumn("side", F.lit("both"))
    return both.unionByName(test.subtract(train).withColumn("side", F.lit("test only")))


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred sentences of the test split in the order of their ids."""
    rows = table(spark, sf_dir, "treebank_sentences").filter("split = 'test'").select("sent_id", "sent_key")
    return prompts.first_rows(rows, 100, "sent_id", "sent_key")


def latest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sentence, experiment and model the last delivered call."""
    rows = table(spark, sf_dir, "model_responses").select("response_id", "ingested_at", F.concat_ws("/", "sent_id", "experiment", "model_config.model_name").alias("key"))
    return prompts.last_delivery(rows, "key", "ingested_at", "response_id").select("key", "response_id")


def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the corpus table as they stand in LaTeX, with counts."""
    rows = corpus_uas_las(spark, sf_dir).join(table(spark, sf_dir, "system_dim"), ["model_ord", "cond_ord"])
    cells = [tx.latex(F.col(c).cast("string")) for c in ("model_name", "experiment", "uas_correct", "las_correct", "total")]
    return rows.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def critique_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every critique call the size of the reasoning parse that it was to correct, null where there is none."""
    rows = scoring.latest(_all(spark, sf_dir).select("model_ord", "cond_ord", "sent_id", "llm_parse", "evaluated_at", "eval_id"))
    source = rows.filter("cond_ord = 4").select("model_ord", "sent_id", F.size("llm_parse").alias("n_tokens"))
    return rows.filter("cond_ord = 5").select("model_ord", "sent_id").join(source, ["model_ord", "sent_id"], "left")


def corpus_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals that a complete corpus must have: sentences, scored tokens, records, usage."""
    reference = scoring.reference(table(spark, sf_dir, "model_evaluation")).agg(F.count("*").alias("sentences"), F.sum(F.size(tok.scored(F.col("gold")))).alias("tokens"))
    calls = table(spark, sf_dir, "model_responses").agg(F.count("*").alias("records"), F.sum("usage.total_tokens").alias("usage_tokens"), F.count_if("api_success").alias("successes"))
    parts = [F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in ("sentences", "tokens")], [F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in ("records", "usage_tokens", "successes")]
    return reference.select(F.inline(F.array(*parts[0]))).unionByName(calls.select(F.inline(F.array(*parts[1]))))


QUERIES = {
    f.__name__: f
    for f in (
        critique_sources, corpus_invariants, prompt_blocks, critique_prompts, retrieved_texts, prompt_hashes, prompt_audit, demonstration_check, json_extract, parse_raw_response, reparse_agreement, pending_semi_join,
        resume_anti_join, tracker_states, tracker_updated, keyset_difference, gold_mismatch, dataset_stats, split_text_sets, first_sentences, latest_calls, latex_rows,
    )
}

_STR = "'\"' || replace(replace({}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
_TOKEN = "'    {{' || chr(10) || '      \"id\": ' || t.id || ',' || chr(10) || '      \"form\": ' || {f} || ',' || chr(10) || '      \"upos\": ' || {u} || ',' || chr(10) || '      \"head\": ' || t.head || ',' || chr(10) || '      \"deprel\": ' || {d} || chr(10) || '    }}'".format(
    f=_STR.format("t.form"), u=_STR.format("t.upos"), d=_STR.format("t.deprel")
)
_USER = "'# text = ' || text || chr(10) || array_to_string(list_transform(gold, lambda t: t.id || chr(9) || t.form), chr(10))"
_BLOCK = f"'Input:' || chr(10) || {_USER} || chr(10) || chr(10) || 'Output:' || chr(10) || '{{' || chr(10) || '  \"tokens\": [' || chr(10) || array_to_string(list_transform(gold, lambda t: {_TOKEN}), ',' || chr(10)) || chr(10) || '  ]' || chr(10) || '}}'"
_ASCII = "'\"' || array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = '' OR unicode(c) < 128 THEN c ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '') || '\"'"


def _parse_json(tokens: str) -> str:
    """JSON of a list of parsed tokens with escapes for other characters than ASCII (of the basic plane)."""
    text = {c: f"coalesce({_ASCII.format('t.' + c)}, 'null')" for c in ("form", "upos", "deprel")}
    whole = {c: f"coalesce(CAST(t.{c} AS VARCHAR), 'null')" for c in ("id", "head")}
    token = " || ',' || chr(10) || ".join(f"'      \"{c}\": ' || {(text | whole)[c]}" for c in ("id", "form", "upos", "head", "deprel"))
    body = f"array_to_string(list_transform({tokens}, lambda t: '    {{' || chr(10) || {token} || chr(10) || '    }}'), ',' || chr(10))"
    return f"CASE WHEN len({tokens}) = 0 THEN '{{' || chr(10) || '  \"tokens\": []' || chr(10) || '}}' ELSE '{{' || chr(10) || '  \"tokens\": [' || chr(10) || {body} || chr(10) || '  ]' || chr(10) || '}}' END"


_SPACE = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _trim(value: str) -> str:
    return f"regexp_replace({value}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"



SQL = {
    "prompt_blocks": f"WITH {_SENT} SELECT sent_id, sha256({_BLOCK}) AS block_hash, CAST(length({_BLOCK}) AS INTEGER) AS block_chars, sha256({_USER}) AS user_hash FROM s",
    "retrieved_texts": "SELECT experiment, text, count(*) AS n FROM (SELECT experiment, unnest(regexp_extract_all(prompt.system_msg, 'Input:\\n# text = ([^\\n]+)', 1)) AS text FROM model_responses) GROUP BY 1, 2",
    "prompt_hashes": "SELECT experiment, count(*) AS calls, count(DISTINCT sha256(prompt.system_msg || chr(0) || prompt.user_msg)) AS pairs, count(DISTINCT sha256(prompt.system_msg)) AS systems FROM model_responses GROUP BY 1",
    "prompt_audit": f"""WITH {_SENT}, c AS (SELECT r.experiment, coalesce(r.prompt.user_msg = {_USER.replace("|| text ||", "|| s.text ||").replace("(gold", "(s.gold")}, FALSE) AS m, sha256(r.prompt.system_msg || chr(0) || r.prompt.user_msg) AS h
        FROM model_responses r LEFT JOIN s ON s.sent_id = r.sent_id) SELECT experiment, count(*) AS calls, count(*) FILTER (m) AS matching, count(DISTINCT h) AS distinct_prompts, bool_and(m) AS all_match FROM c GROUP BY 1""",
    "json_extract": f"""WITH t AS (SELECT response_id, {_trim('raw_response')} AS s FROM model_responses WHERE raw_response IS NOT NULL), u AS (SELECT response_id, CASE WHEN instr(s, '{{') > 0 THEN substr(s, instr(s, '{{')) END AS part,
        CASE WHEN instr(s, '{{') > 1 THEN nullif({_trim("substr(s, 1, instr(s, chr(123)) - 1)")}, '') END AS before FROM t) SELECT response_id, md5(part) AS json_hash, CAST(length(part) AS INTEGER) AS json_chars, md5(before) AS reasoning_hash FROM u""",
    "pending_semi_join": " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS experiment, sent_id FROM collection_tracker WHERE upper(trim(experiment{n}_status, ' ')) = 'PENDING' AND sent_id IN (SELECT sent_id FROM treebank_sentences WHERE split = 'dev') "
        f"AND sent_id NOT IN (SELECT sent_id FROM model_responses WHERE experiment = '{name}' AND api_success AND sent_id IS NOT NULL)"
        for n, name in enumerate(EXPERIMENTS, 1)
    ),
    "resume_anti_join": "SELECT DISTINCT sent_id FROM collection_tracker WHERE upper(trim(experiment1_status, ' ')) = 'PENDING' AND sent_id IS NOT NULL AND sent_id NOT IN (SELECT sent_id FROM model_responses WHERE experiment = 'zero_shot' AND api_success AND sent_id IS NOT NULL)",
    "tracker_states": " UNION ALL ".join(f"SELECT 'experiment{n}_status' AS experiment, coalesce(upper(trim(experiment{n}_status, ' ')), 'NONE') AS state, count(*) AS n FROM collection_tracker GROUP BY 2" for n in range(1, 7)),
    "tracker_updated": "WITH b AS (SELECT experiment, sent_id, CASE WHEN bool_or(coalesce(api_success, FALSE)) THEN 'DONE' ELSE 'FAIL' END AS st FROM model_responses WHERE sent_id IS NOT NULL GROUP BY 1, 2) "
    + " UNION ALL ".join(
        f"SELECT 'experiment{n}_status' AS experiment, coalesce(b.st, t.experiment{n}_status) AS status, count(*) AS n FROM collection_tracker t LEFT JOIN b ON b.sent_id = t.sent_id AND b.experiment = '{name}' GROUP BY 2"
        for n, name in enumerate(EXPERIMENTS, 1)
    ),
    "keyset_difference": "WITH a AS (SELECT DISTINCT response_id FROM model_responses WHERE response_id IS NOT NULL), b AS (SELECT DISTINCT response_id FROM model_evaluation WHERE response_id IS NOT NULL) SELECT response_id, 'first' AS side FROM a WHERE response_id NOT IN (SELECT response_id FROM b) UNION ALL SELECT response_id, 'second' FROM b WHERE response_id NOT IN (SELECT response_id FROM a)",
    "gold_mismatch": f"""WITH {CTE}, sl AS (SELECT sent_id, list_transform(gold, lambda g: {{'id': g.id, 'head': g.head, 'deprel': g.deprel}}) AS g FROM model_evaluation WHERE len(gold) > 0), rf AS (SELECT sent_id, list_transform(gold, lambda g: {{'id': g.id, 'head': g.head, 'deprel': g.deprel}}) AS r FROM ref)
        SELECT split_part(sent_id, '-', 1) AS genre, count(*) AS n, count(*) FILTER (g IS DISTINCT FROM r) AS different FROM sl JOIN rf USING (sent_id) GROUP BY 1""",
    "dataset_stats": "SELECT split, count(*) AS n_rows, count(DISTINCT sent_id) AS sentences, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(n_tokens) AS counted, count(text) AS with_text FROM treebank_sentences GROUP BY 1",
    "split_text_sets": "WITH t AS (SELECT DISTINCT text FROM treebank_sentences WHERE split = 'test' AND text IS NOT NULL), r AS (SELECT DISTINCT text FROM treebank_sentences WHERE split = 'train' AND text IS NOT NULL) SELECT text, CASE WHEN text IN (SELECT text FROM r) THEN 'both' ELSE 'test only' END AS side FROM t",
    "first_sentences": "SELECT sent_id, sent_key FROM treebank_sentences WHERE split = 'test' ORDER BY sent_id NULLS FIRST, sent_key LIMIT 100",
    "latest_calls": "WITH k AS (SELECT response_id, ingested_at, concat_ws('/', sent_id, experiment, model_config.model_name) AS key FROM model_responses) SELECT key, response_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ingested_at DESC NULLS LAST, response_id DESC) AS rk FROM k) WHERE rk = 1",
}
SQL["critique_sources"] = f"WITH {CTE} SELECT a.model_ord, a.sent_id, CAST(len(b.llm_parse) AS INTEGER) AS n_tokens FROM last a LEFT JOIN last b ON a.model_ord = b.model_ord AND a.sent_id = b.sent_id AND b.cond_ord = 4 WHERE a.cond_ord = 5"
SQL["corpus_invariants"] = f"""WITH {CTE}, n AS (SELECT len(list_filter(gold, lambda g: g.upos <> 'PUNCT')) AS n FROM ref) SELECT 'sentences' AS name, count(*) AS value FROM n UNION ALL SELECT 'tokens', CAST(sum(n) AS BIGINT) FROM n
  UNION ALL SELECT 'records', count(*) FROM model_responses UNION ALL SELECT 'usage_tokens', CAST(sum(usage.total_tokens) AS BIGINT) FROM model_responses UNION ALL SELECT 'successes', count(*) FILTER (api_success) FROM model_responses"""
SQL["critique_prompts"] = f"""WITH e AS (SELECT eval_id, text, array_to_string(list_transform(gold, lambda t: t.id || chr(9) || t.form), chr(10)) AS lines, list_filter(llm_parse, lambda t: t IS NOT NULL) AS p FROM model_evaluation WHERE llm_parse IS NOT NULL AND gold IS NOT NULL),
  j AS (SELECT eval_id, text, lines, {_parse_json('p')} AS parse FROM e)
  SELECT eval_id, sha256('Sentence: ' || text || chr(10) || chr(10) || 'Tokens:' || chr(10) || lines || chr(10) || chr(10) || 'Existing parse:' || chr(10) || parse) AS long_hash, sha256('# text = ' || text || chr(10) || chr(10) || 'Existing parse:' || chr(10) || parse) AS short_hash FROM j"""
SQL["latex_rows"] = f"""WITH {CTE}, {_A}, t AS (SELECT model_ord, cond_ord, {_ACC} FROM f GROUP BY 1, 2) SELECT replace(model_name, '_', '\\_') || ' & ' || replace(experiment, '_', '\\_') || ' & ' || uas_correct || ' & ' || las_correct || ' & ' || total || ' \\\\' AS line
  FROM t JOIN system_dim USING (model_ord, cond_ord)"""
