"""Cutoffs of the label model, chosen on a labelled sample (problem 2).

No call of the tables has a true label, so labelled calls are made: of a bounded number of
whole answers some stay as they are, some get a harmless oddity, and the others one defect
each, written here and not taken from the tables.  They run through the same functions
and the model fitted on all calls; of each facet the cutoffs with the best F1 are the
validated ones.
"""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from treemill.llm import pairs

#: Whole answers that the labelled sample is made from, at most.
SAMPLE = 2_400
_REFUSALS = (
    "I'd rather not work on this sentence.", "This request falls outside of what I will do.", "Sorry, that one is beyond me.", "I am afraid I have to pass on this.", "My policy does not let me annotate it.", "I will not parse this text.",
    "Unfortunately I can't do that for you.", "Please ask somebody else; I won't analyse this.", "I must decline.", "It isn't possible for me to give you a parse.", "Regrettably, I am unable to comply.", "I refuse.",
)
_HOLLOW = ("", " ", "\n\n", "{}", "[]", "null", '{"tokens": []}', '{"tokens": null}', "```json\n\n```", '{"tokens": [{"id": null, "form": "", "head": null}]}', "​", '""')
_FOREIGN = (
    "Der Hund schläft heute unter dem Tisch, weil es draußen regnet und niemand mit ihm gehen will.", "Le chat dort sur la chaise pendant que les enfants jouent dans le jardin avec leurs amis.",
    "La niña lee un libro en la cocina mientras su hermano busca las llaves de la casa.", "Il treno arriva sempre in ritardo quando piove, ma oggi siamo partiti con molta calma.", "O menino comprou pão na loja da esquina e depois voltou para casa com a mãe.",
    "De man leest een krant in de tuin omdat het mooi weer is en hij niet naar zijn werk gaat.", "Собака спит под столом, потому что на улице идёт дождь.", "Η γάτα κοιμάται πάνω στην καρέκλα όσο παίζουν τα παιδιά.", "狗睡在桌子下面因为外面下雨了没有人想出去", "Pies śpi pod stołem, ponieważ na dworze pada deszcz i nikt nie chce wyjść.",
)
_ODD = ("as_it_is", "single_quotes", "trailing_comma", "reasoning", "other_heads", "ended_early")


def made(row: dict, truth: str, rng: random.Random) -> dict:
    """A call with one defect, or with none but maybe an oddity that is no defect."""
    raw, used = row["raw"], row["used"] or max(1, round(len(row["raw"]) / 3.2))
    rate = len(raw) / used
    fits = lambda text: max(1, round(len(text) / rate))
    thoughts = row["thoughts"]
    if truth == "empty":
        raw = rng.choice(_HOLLOW)
        used = rng.choice((1, fits(raw)))
    elif truth == "truncated":
        raw = raw[: rng.randint(max(2, len(raw) // 20), len(raw) * 19 // 20)]
        kind = rng.random()
        used = None if kind < 0.3 else used if kind < 0.9 else fits(raw)
        raw += rng.choice(("", "", "", "…", "\n\n"))
    elif truth == "refusal":
        text = rng.choice(_REFUSALS)
        raw = rng.choice((text, text.upper(), json.dumps({"note": text}), json.dumps({"tokens": [], "error": text})))
        used = fits(raw)
    elif truth == "copied_prompt":
        lines = row["asked"].partition("\n")[2]
        raw = rng.choice((row["sentence"], row["asked"], lines, json.dumps({"sentence": row["sentence"]}), "Input: " + row["sentence"], row["sentence"].lower()))
        used = fits(raw)
    elif truth == "other_language":
        text = rng.choice(_FOREIGN)
        kind = rng.random()
        if kind < 0.3:
            thoughts = text
        else:
            raw = text if kind < 0.6 else json.dumps({"answer": text}, ensure_ascii=False) if kind < 0.8 else text + "\n\n" + raw
            used = fits(raw)
    else:
        odd = rng.choice(_ODD)
        if odd == "single_quotes":
            raw = raw.replace('"', "'")
        elif odd == "trailing_comma":
            raw = raw[:-1] + ",}" if raw.endswith("]}") else raw
        elif odd == "reasoning":
            raw = 'Step 1 - sorry, I cannot attach the last word yet, so the verb is the root.\n\n' + raw
        elif odd == "other_heads":
            raw = raw.replace('"head": 1,', '"head": 999,')
        elif odd == "ended_early" and '"id"' in raw:
            head = raw[: raw.rfind('"id"')].rstrip().rstrip("{").rstrip().rstrip(",")
            raw = head + "]}" if head.endswith("}") else raw
        used = fits(raw)
    return row | {"raw": raw, "used": used, "thoughts": thoughts, "truth": truth}


def labelled(responses: DataFrame, evaluations: DataFrame, sample: int = SAMPLE, seed: int = 11) -> tuple[DataFrame, dict[int, str]]:
    """Calls like ``responses`` with negative ids, and the truth of each: a defect or ``none`` (half of them)."""
    same_forms = "transform(gold, t -> t.form) = transform(llm_parse, t -> t.form)"
    good = evaluations.filter(f"validation_error is null and las >= 0.5 and {same_forms}").select("response_id").distinct()
    whole = responses.filter("api_error is null and raw_response is not null and usage.completion_tokens > 0 and prompt.user_msg is not null and text is not null").join(good, "response_id", "left_semi")
    chosen = whole.orderBy(F.xxhash64("response_id"), "response_id").limit(sample)
    rows = chosen.select(
        "response_id", "source", F.col("text").alias("sentence"), F.col("raw_response").alias("raw"), F.col("prompt.user_msg").alias("asked"), F.col("usage.completion_tokens").alias("used"),
        F.col("model_config.max_tokens").alias("most"), F.col("reasoning_content").alias("thoughts"),
    ).toPandas().astype(object)  # at most ``sample`` rows
    rng = random.Random(seed)
    defects = sorted(set(pairs.DEFECT.values()))
    out, truth = [], {}
    for n, row in enumerate(rows.where(pd.notna(rows), None).to_dict("records"), 1):
        kind = "none" if n % 2 else defects[(n // 2) % len(defects)]
        found = made(row, kind, rng)
        truth[-n] = kind
        used = None if found["used"] is None else int(found["used"])
        out.append((-n, found["source"], found["sentence"], found["raw"], found["thoughts"], None, (None, found["asked"]), (None, used, None) if used else None, (None if found["most"] is None else int(found["most"]),)))
    schema = (
        "response_id long, source string, text string, raw_response string, reasoning_content string, api_error string, prompt struct<system_msg:string,user_msg:string>, "
        "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, model_config struct<max_tokens:int>"
    )
    return responses.sparkSession.createDataFrame(out, schema), truth


def best_cutoffs(scores: list[tuple[float, bool]]) -> tuple[float, float]:
    """Lowest and highest cutoff with the best F1; posteriors of at least the cutoff count as found."""
    best, spans = -1.0, []
    for cutoff in [x / 100 for x in range(1, 100)]:
        hits = sum(t for p, t in scores if p >= cutoff)
        found, true = sum(p >= cutoff for p, _ in scores), sum(t for _, t in scores)
        f1 = 2 * hits / max(1, found + true)
        if f1 > best + 1e-12:
            best, spans = f1, [cutoff]
        elif abs(f1 - best) <= 1e-12:
            spans.append(cutoff)
    return min(spans), max(spans)


def validated(responses: DataFrame, evaluations: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """Per defect the cutoffs with the best F1 on the labelled calls, and precision and recall at the cutoff in use.

    The functions' rates are fitted on the calls of ``responses`` alone.
    """
    extra, truth = labelled(responses, evaluations, sample)
    columns = {
        "response_id": "response_id", "source": "source", "text": "text", "raw_response": "raw_response", "reasoning_content": "reasoning_content", "api_error": "api_error",
        "prompt": "named_struct('system_msg', prompt.system_msg, 'user_msg', prompt.user_msg)", "usage": "named_struct('prompt_tokens', usage.prompt_tokens, 'completion_tokens', usage.completion_tokens, 'total_tokens', usage.total_tokens)",
        "model_config": "named_struct('max_tokens', model_config.max_tokens)",
    }
    own = responses.filter("response_id >= 0").selectExpr(*[f"{value} as {name}" for name, value in columns.items()])
    votes = pairs.cut(pairs.call_votes(own.unionByName(extra), evaluations))
    codes = [r.asDict() for r in votes.filter("response_id < 0").collect()]  # at most ``sample`` rows
    models = pairs.fitted_models(votes.filter("response_id >= 0"))
    out = []
    for defect in sorted(set(pairs.DEFECT.values())):
        facets = [f for f in pairs.FUNCTIONS if pairs.DEFECT[f] == defect]
        scores = [(max(models[f].posterior(r[f]) for f in facets), truth[r["response_id"]] == defect) for r in codes]
        low, high = best_cutoffs(scores)
        cutoff = pairs.CUTOFFS[facets[0]]
        hits, found, true = sum(t for p, t in scores if p >= cutoff), sum(p >= cutoff for p, _ in scores), sum(t for _, t in scores)
        out.append({"defect": defect, "n_true": true, "best_from": low, "best_to": high, "cutoff": cutoff, "precision": hits / max(1, found), "recall": hits / max(1, true)})
    return out
