"""Labelled calls and the cutoffs chosen on them."""

import random

import pytest

from treemill.llm import pairs, truncation as tr, validation

TEXT = "The small cat sat on the old mat ."
ASKED = "# text = " + TEXT + "\n" + "\n".join(f"{n}\t{w}" for n, w in enumerate(TEXT.split(), 1))
WHOLE = '{"tokens": [' + ", ".join(f'{{"id": {n}, "form": "{w}", "upos": "X", "head": {0 if n == 1 else 1}, "deprel": "dep"}}' for n, w in enumerate(TEXT.split(), 1)) + "]}"
SCHEMA = (
    "response_id long, source string, text string, raw_response string, reasoning_content string, api_error string, prompt struct<system_msg:string,user_msg:string>, "
    "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, model_config struct<max_tokens:int>"
)
TOKENS = "array<struct<form:string>>"


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("truth", ["empty", "truncated", "refusal", "copied_prompt", "other_language", "none"])
def test_made_calls_get_their_votes(truth, seed):
    row = {"raw": WHOLE, "used": 200, "asked": ASKED, "sentence": TEXT, "thoughts": None}
    call = validation.made(row, truth, random.Random(seed))
    kind, weights, _ = tr.row_weights(call["raw"], ASKED, call["used"], 4096, None, 1.163, 7.0, 0.5, tr.ANY_RATES)
    cast = pairs.votes(pairs.Call(call["raw"], TEXT, ASKED, call["used"], kind, call["thoughts"] or ""))
    cut = kind != tr.WHOLE and tr.share_posterior(tr.ANY_SHARES[kind], weights) >= tr.CUTOFF
    # one function can carry a refusal
    found = {pairs.DEFECT[f] for f, votes in cast.items() if f != "truncated" and (votes.count(pairs.YES) > votes.count(pairs.NO) or f == "refusal" and pairs.YES in votes)} | ({"truncated"} if cut else set())
    assert found == (set() if truth == "none" else {truth})


def test_best_cutoffs():
    assert validation.best_cutoffs([(0.9, True), (0.7, True), (0.4, False), (0.1, False)]) == (0.41, 0.7)
    assert validation.best_cutoffs([]) == (0.01, 0.99)


def test_validated(spark):
    calls = [(n, "lab", TEXT, WHOLE, None, None, ("s", ASKED), (9, 200, 209), (4096,)) for n in range(300)]
    evaluations = [(n, None, 0.9, [("x",)], [("x",)]) for n in range(300)]
    found = validation.validated(spark.createDataFrame(calls, SCHEMA), spark.createDataFrame(evaluations, f"response_id long, validation_error string, las double, gold {TOKENS}, llm_parse {TOKENS}"), sample=120)
    by = {r["defect"]: r for r in found}
    assert set(by) == {"empty", "truncated", "refusal", "copied_prompt", "other_language"} and {r["n_true"] for r in found} == {12}
    assert min(r["precision"] for r in found) > 0.9 and min(r["recall"] for r in found) >= 0.6  # no call of the table has a defect to learn from
