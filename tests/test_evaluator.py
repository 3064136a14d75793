"""Evaluation records and the prompt audit on hand-made calls."""

import json

from pyspark.sql import functions as F

from treemill.operators import evaluator, prompts, provenance

TREE = [(1, "Old", "ADJ", 2, "amod"), (2, "boats", "NOUN", 3, "nsubj"), (3, "leak", "VERB", 0, "root"), (4, ".", "PUNCT", 3, "punct")]
GOLD = "array<struct<id:int,form:string,upos:string,head:int,deprel:string>>"
SCHEMA = f"k long, raw_response string, api_error string, gold {GOLD}, status_before string"


def answer(rows, before=""):
    return before + json.dumps({"tokens": [dict(zip(("id", "form", "upos", "head", "deprel"), r)) for r in rows]})


def test_routes_and_scores(spark):
    wrong = [TREE[0], (2, "boats", "NOUN", 3, "OBJ"), (3, "leak", "VERB", 1, "root"), (4, ".", "PUNCT", 1, "punct")]
    rows = [
        (1, answer(TREE), None, TREE, "x"), (2, answer(wrong, "The verb leads.\n"), None, TREE, "x"), (3, answer(TREE[:1]), "", TREE, "x"), (4, None, None, TREE, "x"), (5, "  \n", None, TREE, "x"), (6, "no brace", None, TREE, "x"),
        (7, '{"tokens": [', None, TREE, "x"), (8, 'So: {"tokens": [{"id": 1}]}', None, TREE, "x"), (9, answer(TREE), "timeout", TREE, "x"), (10, answer(TREE), None, None, "x"), (11, answer([]), None, TREE[3:], "x"), (None, answer(TREE), None, TREE, "x"),
        (12, answer([*TREE, (2, "boats", "NOUN", 1, "nsubj")]), None, TREE, "x"), (13, "{" * 100_000, None, TREE, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.k: r for r in evaluator.evaluated(df).collect()}
    assert len(got) == len(rows) and "status_before" in evaluator.evaluated(df).columns
    assert {k: got[k].status for k in range(1, 14)} == {1: "parsed", 2: "parsed", 3: "parsed", 4: "empty", 5: "no_json", 6: "no_json", 7: "decode_error", 8: "schema_error", 9: "api_error", 10: "parsed", 11: "parsed", 12: "parsed", 13: "decode_error"}
    assert (got[1].uas, got[1].las, got[1].token_errors, got[1].structural_warnings, got[1].cot_reasoning, got[1].validation_error) == (1.0, 1.0, [], [], None, None)
    assert (got[2].uas, got[2].las, got[2].structural_warnings, got[2].cot_reasoning) == (0.6667, 0.3333, ["no_root"], "The verb leads.")
    assert [(e.token_id, e.error_type, e.pred_head, e.pred_deprel) for e in got[2].token_errors] == [(2, "deprel_only", 3, "OBJ"), (3, "head_only", 1, "root")]
    assert [e.error_type for e in got[3].token_errors] == ["missing_token"] * 2 and got[3].las == 0.3333
    assert got[4].validation_error.startswith("empty_response") and got[7].validation_error.startswith("json_decode_error: Expecting") and got[9].validation_error is None and got[9].llm_parse is None
    assert got[8].cot_reasoning == "So:" and got[7].cot_reasoning is None and got[10].las is None and got[11].las == 0.0 and got[12].las == 0.6667
    with_punct = {r.k: r for r in evaluator.evaluated(df, exclude_punct=False).collect()}
    assert with_punct[2].las == 0.25 and with_punct[11].las == 0.0 and len(with_punct[3].token_errors) == 3 and not with_punct[1].exclude_punct
    totals = evaluator.totals(evaluator.evaluated(df)).first()
    assert (totals.total, totals.scored, totals.validation_errors, totals.api_errors, totals.no_root) == (14, 6, 6, 1, 3)
    assert evaluator.evaluated(df.limit(0)).collect() == []


def test_prompt_audit(spark):
    gold = spark.createDataFrame([("Old boats leak.", TREE, TREE[:3])], f"gold_text string, gold {GOLD}, source_parse {GOLD}")
    built = gold.select("*", prompts.user_message(F.col("gold_text"), F.col("gold")).alias("first"), prompts.critique_message(F.col("gold_text"), F.col("gold"), F.col("source_parse")).alias("long"),
                        prompts.short_critique_message(F.col("gold_text"), F.col("source_parse")).alias("short"), prompts.demonstration(F.col("gold_text"), F.col("gold")).alias("demo")).first()
    three = "\n\n".join(["Base.", *[built.demo] * 3])
    rows = [("plain", "Base.", built.first), ("plain", "Base", built.first), ("plain", "Base.", built.long), ("critique", "Base.", built.long), ("critique", "Base.", built.short), ("critique", "Base.", built.first),
            ("found", three, built.first), ("found", three + "\n\n" + built.demo, built.first), ("found", None, None)]
    calls = spark.createDataFrame(rows, "condition string, system string, user string").crossJoin(gold)
    joined = calls.join(provenance.bases(calls, "condition"), "condition")
    got = {r.condition: r for r in provenance.audit(provenance.records(joined, "condition", ("found",), "critique"), "condition").collect()}
    count = lambda c: (got[c].record_count, got[c].static_system_matches, got[c].retrieval_template_matches, got[c].regenerated_user_matches, got[c].standard_critique_user_matches, got[c].short_critique_user_matches)
    assert count("plain") == (3, 2, 0, 2, 0, 0) and count("critique") == (3, 3, 0, 2, 1, 1) and count("found") == (3, 0, 1, 2, 0, 0)
    assert got["critique"].system_verified and not got["critique"].user_verified and got["plain"].unique_system_prompts == 2 and got["found"].unique_prompt_pairs == 2
