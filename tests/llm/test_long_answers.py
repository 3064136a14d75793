"""Hollow answers and heads in answers of any length."""

import json

import pytest

from treemill.llm import pairs, truncation as tr

TEXT = "The small cat sat on the old mat ."
ASKED = "# text = " + TEXT + "\n" + "\n".join(f"{n}\t{w}" for n, w in enumerate(TEXT.split(), 1))
EMPTY = json.dumps({"tokens": [{"id": None, "form": "", "upos": None, "head": None, "deprel": " "} for _ in range(200)]})


def cast(raw, used=300):
    return pairs.votes(pairs.Call(raw, TEXT, ASKED, used, tr.row_weights(raw, ASKED, used, 4096, None, 1.163, 7.0, 0.5, tr.ANY_RATES)[0]))


@pytest.mark.parametrize("raw", [" " * 401, "\n" * 50_000, "```json\n" + "[" * 500 + "]" * 500 + "\n```", EMPTY, json.dumps([{"note": None, "text": ""}] * 20)])
def test_long_hollow_answers_are_empty(raw):
    assert len(raw) > 400 and tr.is_hollow(raw)
    found = cast(raw)
    assert found["empty"][0] == pairs.YES and pairs.NO not in found["empty"][:2] and found["truncated"][1] == pairs.NO


def test_long_lists_of_empty_values():
    assert cast(EMPTY)["empty"][1] == pairs.YES
    assert not tr.is_hollow(EMPTY[:-2] + ', {"form": "cat"}]}') and cast(json.dumps({"tokens": [{"id": 1, "form": "cat"}] * 30}))["empty"][:2] == (pairs.NO, pairs.NO)
    assert cast("[" * 100_000)["empty"] == (pairs.NO, pairs.ABSTAIN, pairs.NO)


@pytest.mark.parametrize("end", ["Draft parse: 1>2, 2>0, 3>2", '{"head": 2}'])
def test_heads_behind_long_reasoning(end):
    raw = TEXT + " " * 4_100 + end
    assert cast(raw)["copied_prompt"] == (pairs.NO, pairs.NO, pairs.NO)
