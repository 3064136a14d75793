"""Cut answers and broken pairs on hand-made calls."""

import json
import math

import numpy as np
import pytest

from treemill.llm import pairs, truncation as tr

TEXT = "The small cat sat on the old mat ."
ASKED = "# text = " + TEXT + "\n" + "\n".join(f"{n}\t{w}" for n, w in enumerate(TEXT.split(), 1))
TOKENS = [{"id": n, "form": w, "upos": "X", "head": 0 if n == 1 else 1, "deprel": "dep"} for n, w in enumerate(TEXT.split(), 1)]
WHOLE = json.dumps({"tokens": TOKENS})
MEAN = math.log(3.2)


def cut(raw, used="fits", most=4096, limit=None):
    used = round(len(raw) / 3.2) if used == "fits" else used
    return tr.row_posterior(raw, ASKED, used, most, limit, MEAN) >= tr.CUTOFF


@pytest.mark.parametrize(
    "raw, options, is_cut",
    [
        (WHOLE, {}, False), (WHOLE, {"used": 4096}, False), (WHOLE, {"used": None}, False), (WHOLE + " " * 40, {"limit": len(WHOLE) + 40}, False), (WHOLE[:-1] + ",}", {}, False),
        (WHOLE[:300], {"used": round(len(WHOLE) / 3.2)}, True), (WHOLE[:300], {}, True), (WHOLE[:300], {"used": 100, "most": 100}, True), (WHOLE[:300], {"limit": 300}, True),
        (WHOLE[:300], {"used": None}, True), (WHOLE[:300] + "…", {"used": round(len(WHOLE) / 3.2)}, True), (json.dumps({"tokens": TOKENS[:4]}), {}, False),
        (json.dumps({"tokens": TOKENS[:4]}), {"used": round(len(WHOLE) / 3.2)}, True), (json.dumps({"tokens": TOKENS[:4]}), {"used": 100, "most": 100}, True),
        ("", {}, False), (None, {"used": 5}, False), ("null", {"used": 2}, False), ("{}", {"used": None}, False), ("Sorry, I cannot help with this request.", {}, False), ("Step 1 - the root is cat.\nStep 2 - I can", {"used": 300}, True),
        ("\n".join(ASKED.split("\n")[1:]), {}, False), ("x" * 100_000, {"used": None}, False),
    ],
)
def test_cuts(raw, options, is_cut):
    assert cut(raw, **options) == is_cut


def test_limits_are_found_by_the_censored_law():
    rng = np.random.default_rng(1)
    sizes = np.round(np.exp(rng.normal(7, 0.5, 20_000)))
    stored = np.minimum(sizes, 2400)
    values, times = np.unique(stored, return_counts=True)
    opened = np.where(values == 2400, times, 0)
    limit, share = tr.find_limit(values, times.astype(float), opened)
    mean, spread = tr.fit_lognormal(values, times.astype(float), limit)
    assert limit == 2400 and share > 0.9 and abs(mean - 7) < 0.02 and abs(spread - 0.5) < 0.02
    values, times = np.unique(sizes, return_counts=True)
    assert tr.find_limit(values, times.astype(float), np.zeros(len(values)))[0] is None


def votes(raw, used="fits", sentence=TEXT, thoughts=""):
    used = round(len(raw or "") / 3.2) if used == "fits" else used
    kind, weights, _ = tr.row_weights(raw, ASKED, used, 4096, None, MEAN, None, None, tr.ANY_RATES)
    found = pairs.votes(pairs.Call(raw or "", sentence, ASKED, used, kind, thoughts))
    found["truncated"] = (pairs.YES if kind and tr.share_posterior(tr.ANY_SHARES[kind], weights) >= tr.CUTOFF else pairs.NO, *found["truncated"][1:])
    out = set()
    for facet, cast in found.items():
        yes, no = cast.count(pairs.YES), cast.count(pairs.NO)
        if yes > no or facet == "truncated" and cast[0] == pairs.YES:
            out.add(pairs.DEFECT[facet])
    return out


GERMAN = "Das Heft öffnet wieder das Schild nach dem Regen, und die Kiste zeigt heute die Straße vor dem Rathaus."
FOREIGN = json.dumps({"tokens": [t | {"form": w} for t, w in zip(TOKENS, "devant la rivière avec le pont pendant pluie .".split())]}, ensure_ascii=False)


@pytest.mark.parametrize(
    "raw, used, defect",
    [
        (WHOLE, "fits", set()), (WHOLE.replace('"', "'"), "fits", set()), ('{"tokens": []}', 4, {"empty"}), (None, 1, {"empty"}), ("\xa0​", 1, {"empty"}), ("```json\n{}\n```", 5, {"empty"}), ("null", 2, {"empty"}),
        ("Sorry, I can’t assist with annotating this sentence.", "fits", {"refusal"}), ('{"tokens": [], "note": "I apologize; I won\'t produce this analysis."}', "fits", {"refusal"}),
        ("AS AN ASSISTANT, IT IS NOT POSSIBLE FOR ME TO COMPLY.", "fits", {"refusal"}), (TEXT, "fits", {"copied_prompt"}), (json.dumps({"text": TEXT}), "fits", {"copied_prompt"}), (ASKED, "fits", {"copied_prompt"}), (json.dumps(TEXT.lower()), "fits", {"copied_prompt"}),
        (ASKED + "\n\nDraft parse: 1>2, 2>0, 3>2", "fits", set()), (GERMAN, "fits", {"other_language"}), (json.dumps({"respuesta": GERMAN}), "fits", {"other_language"}), (GERMAN + "\n\n" + WHOLE, "fits", {"other_language"}), (FOREIGN, "fits", {"other_language"}),
        ("Step 1 - sorry, correction: I cannot attach \"cat\" so its head is 3.\n\n" + WHOLE, "fits", set()), (WHOLE[:300], round(len(WHOLE) / 3.2), {"truncated"}),
    ],
)
def test_defects(raw, used, defect):
    assert votes(raw, used) == defect


def test_reasoning_in_another_language():
    assert votes(WHOLE, thoughts=GERMAN) == {"other_language"} and votes(WHOLE, thoughts="Checking the main verb and its arguments of item 3.") == set()


@pytest.mark.parametrize("raw", ["Погода была хорошей, и комитет собрался около полудня у старой мельницы.", "今天天气很好委员会中午在老磨坊旁边开会讨论新的计划", "Ο καιρός ήταν καλός και η επιτροπή συνεδρίασε το μεσημέρι κοντά στον μύλο."])
def test_answers_in_another_script(raw):
    kind = tr.row_weights(raw, ASKED, 30, 4096, None, MEAN, None, None, tr.ANY_RATES)[0]
    cast = pairs.votes(pairs.Call(raw, TEXT, ASKED, 30, kind))
    assert cast["foreign_prose"][3] == pairs.YES and pairs.NO not in cast["foreign_prose"] and pairs.YES not in cast["refusal"]


def test_own_words_about_something_else_are_no_refusal():
    cast = pairs.votes(pairs.Call("The weather was pleasant on Tuesday and the committee met at noon.", TEXT, ASKED, 20, tr.WHOLE))
    assert pairs.YES not in cast["refusal"]


def test_a_draft_that_the_prompt_holds_is_copied():
    draft = ASKED + "\n\nDraft parse: 1>2, 2>0, 3>2"
    for asked, want in ((draft, pairs.YES), (ASKED, pairs.NO)):
        assert pairs.votes(pairs.Call("Here is the input again:\n\n" + draft, TEXT, asked, 60, tr.WHOLE))["copied_prompt"] == (want,) * 3


def test_words_of_the_sentence_are_no_defect():
    text = "I am sorry, but I cannot help with la casa verde behind the mill."
    tokens = [{"id": n, "form": w, "upos": "X", "head": 0, "deprel": "dep"} for n, w in enumerate(text.split(), 1)]
    asked = "# text = " + text + "\n" + "\n".join(f"{n}\t{w}" for n, w in enumerate(text.split(), 1))
    for raw, want in ((json.dumps({"tokens": tokens}), set()), (text, {"copied_prompt"})):
        found = pairs.votes(pairs.Call(raw, text, asked, 90, tr.WHOLE))
        assert {pairs.DEFECT[f] for f, c in found.items() if c.count(pairs.YES) > c.count(pairs.NO)} == want


def test_label_model_recovers_the_truth():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.03
    counts, right = {}, {}
    for t in truth:
        cast = []
        for error in (0.02, 0.1, 0.2):
            says = t != (rng.random() < (error if t else error / 10))
            cast.append(pairs.ABSTAIN if rng.random() < 0.2 else pairs.YES if says else pairs.NO)
        code = ((cast[0] * 3 + cast[1]) * 3 + cast[2]) * 3
        counts[code] = counts.get(code, 0) + 1
        right[code] = right.get(code, 0) + int(t)
    model = pairs.label_model("foreign_prose", counts)
    found = sum(n for c, n in counts.items() if model[c] >= 0.5)
    hits = sum(n for c, n in right.items() if model[c] >= 0.5)
    assert hits >= 0.9 * truth.sum() and hits >= 0.9 * found and pairs.label_model("empty", {}) == {}
    assert pairs.unpack(right and 14, 3) == (1, 1, 2)


def _calls(spark, rows):
    schema = "response_id long, source string, text string, raw_response string, reasoning_content string, api_error string, prompt struct<system_msg:string,user_msg:string>, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, model_config struct<max_tokens:int>, defect string"
    return spark.createDataFrame(rows, schema)


def test_whole_operators(spark):
    row = lambda i, raw, used=None, **k: (i, k.get("source", "lab"), TEXT, raw, None, k.get("error"), ("s", ASKED) if k.get("asked", True) else None, (9, used, used and used + 9) if used else None, (4096,), "x")
    rows = [row(n, WHOLE, round(len(WHOLE) / 3.2)) for n in range(200)]
    rows += [row(300, "", 1), row(301, None, 1), row(302, WHOLE[:300], round(len(WHOLE) / 3.2)), row(303, None, error="timeout"), row(304, TEXT, 11), row(304, TEXT, 11), row(305, WHOLE, asked=False), row(306, GERMAN, 33, source=None)]
    evaluations = spark.createDataFrame([(300, "empty_response: raw_response is null"), (None, "x"), (302, "json_decode_error: Unterminated string"), (302, None)], "response_id long, validation_error string")
    got = sorted((r.response_id, r.defect) for r in pairs.defects(_calls(spark, rows), evaluations).collect())
    assert got == [(300, "empty"), (301, "empty"), (302, "truncated"), (304, "copied_prompt"), (304, "copied_prompt"), (306, "other_language")]
    calls = tr.response_calls(_calls(spark, rows))
    assert [r.response_id for r in tr.truncated(calls).collect()] == [302]
    rates = {r.source: (r.n_answers, r.n_truncated) for r in tr.rates(calls).collect()}
    assert rates == {"lab": (205, 1), None: (1, 0)}
    empty = _calls(spark, [])
    assert pairs.defects(empty, evaluations.limit(0)).collect() == [] and tr.truncated(tr.response_calls(empty)).collect() == []
