"""Queries of problem 4: nested records to related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treemill.operators import nested
from treemill.operators.nested import Relation
from treemill.plans.session import table

EVALUATION = (Relation("gold"), Relation("llm_parse"))
RESPONSES = (
    Relation("model_config.retrieval.examples"),
    Relation("model_config.attempts"),
    Relation("model_config.attempts.hops", outer="model_config.attempts"),
)


def _relations(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    evaluation, responses = table(spark, sf_dir, "model_evaluation"), table(spark, sf_dir, "model_responses")
    return [(r.path, nested.flatten(evaluation, "eval_id", r)) for r in EVALUATION] + [(r.path, nested.flatten(responses, "response_id", r)) for r in RESPONSES]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, parents' variants and variants of all objects.  Each relation reads its own columns; unfolding all arrays of a table in one
    pass took three times the CPU seconds, as objects are then copied within array functions."""
    out = None
    for path, rows in _relations(spark, sf_dir):
        part = rows.select(F.lit(path).alias("field_path"), "parent", "variant")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null object with its record and its place: the common keys of the objects that the automaton puts into a variant."""
    return nested.supertype(_relations(spark, sf_dir))


def p4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each structural variant of each array."""
    return _classified(spark, sf_dir).groupBy("field_path", "variant").agg(F.count("*").alias("n_objects"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each variant by the variant of the object around them."""
    return _classified(spark, sf_dir).groupBy("field_path", "parent", "variant").agg(F.count("*").alias("n_objects"))


def p4_parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtype table of the predicted tokens that have every field; ``p4_parse_typed`` has the other variants."""
    rows = nested.flatten(table(spark, sf_dir, "model_evaluation"), "eval_id", Relation("llm_parse"))
    return nested.subtype(rows, "(11111)").drop("parent")


def p4_usage_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional parts of usage, one row per call that has them."""
    responses = table(spark, sf_dir, "model_responses")
    usage = nested.flatten_object(responses, "response_id", "usage")
    return usage.select(
        "rec_id", "variant", *[F.col("obj")[c].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.col("obj.details.reasoning_tokens").alias("reasoning_tokens"), F.col("obj.details.cached_tokens").alias("cached_tokens"),
    )


def _typed(name: str, relation: Relation, key: str, source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.typed(nested.flatten(table(spark, sf_dir, source), key, relation))

    run.__name__, run.__doc__ = name, f"Typed subtype tables of all variants of {relation.path}: keys, variant and fields."
    return run


def write_all(spark: SparkSession, sf_dir: str, folder: str) -> dict[tuple[str, str], str]:
    """Writes the subtype table of every variant of the five arrays and of usage; folders by path and variant."""
    parts = [*_relations(spark, sf_dir), ("usage", nested.flatten_object(table(spark, sf_dir, "model_responses"), "response_id", "usage"))]
    return {(path, state): at for path, rows in parts for state, at in nested.write_subtypes(rows, f"{folder}/{path}").items()}


#: Typed tables of all variants, by relation.
TYPED = {
    name: _typed(name, relation, key, source)
    for name, relation, key, source in (
        ("p4_gold_typed", EVALUATION[0], "eval_id", "model_evaluation"), ("p4_parse_typed", EVALUATION[1], "eval_id", "model_evaluation"),
        ("p4_examples_typed", RESPONSES[0], "response_id", "model_responses"), ("p4_attempts_typed", RESPONSES[1], "response_id", "model_responses"),
        ("p4_hops_typed", RESPONSES[2], "response_id", "model_responses"),
    )
}

QUERIES = {"p4_found": p4_found, "p4_variants": p4_variants, "p4_links": p4_links, "p4_parse_tokens": p4_parse_tokens, "p4_usage_parts": p4_usage_parts} | TYPED


# fixed values: fields of the nested columns; a list holds the fields of an array's objects
_GOLD = dict.fromkeys("id form lemma upos xpos feats head deprel".split())
_PARSE = dict.fromkeys("id form upos head deprel".split())
_EXAMPLE = dict.fromkeys("rnk train_sent_id sim".split())
_HOP = dict.fromkeys("hop_no relay ms".split())
_ATTEMPT = {"attempt_no": None, "err": None, "backoff_ms": None, "hops": [_HOP]}
_CONFIG = {
    "model_name": None, "temperature": None, "top_p": None, "seed": None, "reasoning_effort": None, "response_format": {"fmt": None}, "max_tokens": None,
    "retrieval": {"retrieval_method": None, "examples": [_EXAMPLE]}, "attempts": [_ATTEMPT],
}
_USAGE = {"prompt_tokens": None, "completion_tokens": None, "total_tokens": None, "details": {"reasoning_tokens": None, "cached_tokens": None}}


def _state(value: str, fields, depth: int = 0) -> str:
    """State of a value in the automaton, as SQL."""
    if fields is None:
        return f"CASE WHEN {value} IS NULL THEN '0' ELSE '1' END"
    if isinstance(fields, dict):
        return f"CASE WHEN {value} IS NULL THEN '0' ELSE '(' || " + " || ".join(_state(f"{value}.{n}", f, depth) for n, f in fields.items()) + " || ')' END"
    x, objects = f"x{depth}", f"list_filter({value}, lambda n{depth}: n{depth} IS NOT NULL)"
    states = [f"list_distinct(list_transform({objects}, lambda {x}: {_state(f'{x}.{n}', f, depth + 1)}))" for n, f in fields[0].items()]
    joined = " || ".join(f"CASE WHEN len({s}) = 1 THEN ({s})[1] ELSE '~' END" for s in states)
    return (
        f"CASE WHEN {value} IS NULL THEN '0' WHEN len({value}) = 0 THEN 'e' WHEN len({objects}) = 0 THEN '@0' "
        f"ELSE '@(' || CASE WHEN len({objects}) < len({value}) THEN '~' ELSE '' END || {joined} || ')' END"
    )


def _explode(key: str, path: str, source: str, parent: str) -> str:
    return f"SELECT {key} AS rec_id, {parent} AS parent, unnest({path}) AS obj, generate_subscripts({path}, 1) - 1 AS pos, -1 AS sub_pos FROM {source}"


_HOPS = (
    f"SELECT rec_id, {_state('att', _ATTEMPT)} AS parent, unnest(att.hops) AS obj, pos, generate_subscripts(att.hops, 1) - 1 AS sub_pos FROM "
    "(SELECT response_id AS rec_id, unnest(model_config.attempts) AS att, generate_subscripts(model_config.attempts, 1) - 1 AS pos FROM model_responses)"
)
_PARTS = [
    ("gold", _explode("eval_id", "gold", "model_evaluation", "'(1)'"), _GOLD, "p4_gold_typed"),
    ("llm_parse", _explode("eval_id", "llm_parse", "model_evaluation", "'(1)'"), _PARSE, "p4_parse_typed"),
    ("model_config.retrieval.examples", _explode("response_id", "model_config.retrieval.examples", "model_responses", _state("model_config.retrieval", _CONFIG["retrieval"])), _EXAMPLE, "p4_examples_typed"),
    ("model_config.attempts", _explode("response_id", "model_config.attempts", "model_responses", _state("model_config", _CONFIG)), _ATTEMPT, "p4_attempts_typed"),
    ("model_config.attempts.hops", _HOPS, _HOP, "p4_hops_typed"),
]
_KEYS = "rec_id, CAST(pos AS INTEGER) AS pos, CAST(sub_pos AS INTEGER) AS sub_pos"
_OBJECTS = " UNION ALL ".join(f"SELECT {_KEYS}, '{p}' AS field_path, parent, {_state('obj', f)} AS variant FROM ({q}) WHERE obj IS NOT NULL" for p, q, f, _ in _PARTS)

SQL = {
    "p4_found": f"SELECT rec_id, field_path, pos, sub_pos FROM ({_OBJECTS})",
    "p4_variants": f"SELECT field_path, variant, count(*) AS n_objects FROM ({_OBJECTS}) GROUP BY 1, 2",
    "p4_links": f"SELECT field_path, parent, variant, count(*) AS n_objects FROM ({_OBJECTS}) GROUP BY 1, 2, 3",
    "p4_parse_tokens": f"SELECT {_KEYS}, obj.id AS id, obj.form AS form, obj.upos AS upos, obj.head AS head, obj.deprel AS deprel FROM ({_PARTS[1][1]}) WHERE {_state('obj', _PARSE)} = '(11111)'",
    "p4_usage_parts": f"SELECT response_id AS rec_id, {_state('usage', _USAGE)} AS variant, usage.prompt_tokens AS prompt_tokens, usage.completion_tokens AS completion_tokens, usage.total_tokens AS total_tokens,"
    " usage.details.reasoning_tokens AS reasoning_tokens, usage.details.cached_tokens AS cached_tokens FROM model_responses WHERE usage IS NOT NULL",
} | {
    name: f"SELECT {_KEYS}, parent, {_state('obj', f)} AS variant, " + ", ".join(f"obj.{n} AS {n}" for n, inner in f.items() if not isinstance(inner, list)) + f" FROM ({q}) WHERE obj IS NOT NULL" for _, q, f, name in _PARTS
}
