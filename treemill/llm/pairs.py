"""Broken prompt and response pairs (problem 2).

For each defect some noisy labelling functions vote for it, against it, or not at all.
The vote patterns are counted over all calls; from these counts, of bounded number
whatever the data, expectation-maximization fits how often each function errs and how
common the defect is.  A call keeps every defect whose posterior passes its cutoff.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from treemill.llm import truncation
from treemill.llm.text import words
from treemill.plans.session import cut, spread

#: Language of a prompt whose own words do not tell.
USUAL_LANGUAGE = "en"
ABSTAIN, YES, NO = 0, 1, 2

#: Functions that read the evaluator's message; they vote after the others, without the texts.
VALIDATOR = ("validator_says_empty", "validator_says_unfinished")
#: Functions per facet of a defect, in the order of their votes.  The parts of a defect
#: that show in different places have a label model each.
FUNCTIONS = {
    "empty": ("nothing_left", "only_empty_values", "few_tokens", "validator_says_empty"),
    "truncated": ("length_posterior", "open_end", "validator_says_unfinished"),
    "refusal": ("declines", "opens_with_regret", "own_words_to_the_asker"),
    "copied_prompt": ("holds_the_prompt", "adds_nothing", "no_heads"),
    "foreign_prose": ("function_words", "foreign_letters", "no_words_of_the_prompt_language", "another_script"),
    "foreign_forms": ("forms_not_in_prompt", "forms_of_another_language"),
}
DEFECT = {facet: facet for facet in FUNCTIONS} | {"foreign_prose": "other_language", "foreign_forms": "other_language"}
#: Rates of votes for a defect, without it and with it, that a function starts from; letters of another script are hardly there by accident.
USUAL_START = (0.05, 0.8)
STARTS = {"another_script": (0.002, 0.8)}
#: Cutoffs on the posterior; ``validation`` chooses them on labelled calls, README has the figures.
CUTOFFS = dict.fromkeys(FUNCTIONS, 0.5) | {"empty": 0.9}

# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": "the a and or but of to in on at for with from by as is are was were be this that these those it he she they we you i his her their our your not no so if than then which who must will would can could may should there here have has had do does my me",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war mit von zu im am auf für bei nach vor über unter durch sich wir sie er es ich ihr als auch wie nur noch schon sehr weil dass wenn kein keine zum zur neben während ohne heute",
    "fr": "le la les un une des et ou mais ne pas est sont avec de du au aux en par pour sur sous dans que qui se sa son ses nous vous ils elles il elle on ce cette ces plus très aussi comme sans après devant pendant près encore toujours souvent",
    "es": "el la los las un una unos unas y o pero no es son fue con de del al en por para sobre bajo que se su sus lo le les nos más como también muy sin después durante cerca frente porque siempre pronto apenas",
    "it": "il lo la i gli le un una e o ma non è sono con di del della dei al alla in per su che si suo sua loro noi voi più come anche molto senza dopo durante sempre",
    "pt": "o a os as um uma e ou mas não é são com de do da dos das ao em no na por para sobre que se seu sua nós mais como também muito sem depois durante sempre",
    "nl": "de het een en of maar niet is zijn was met van te in op aan voor bij naar over onder door zich wij zij hij ik als ook zoals maar nog al zeer omdat dat geen zonder na tijdens altijd",
}
_LANGUAGES = {lang: frozenset(text.split()) for lang, text in FUNCTION_WORDS.items()}
_SHARED = Counter(w for own in _LANGUAGES.values() for w in own)

_DECLINES = re.compile(
    r"\b(?:can(?:no|')?t|cannot|could not|couldn't|won'?t|will not|unable to|not able to|must (?:refuse|decline)|have to (?:refuse|decline)|refuse to|decline to|not (?:be )?(?:allowed|permitted|possible|comfortable)|"
    r"do(?: not|n't) feel comfortable|outside what i am|against my|cannot fulfil|not something i can|no puedo|lo siento|kann (?:ich )?nicht|leider|je ne peux pas|désolé)\b", re.I
)
_REGRET = re.compile(r"\b(?:sorry|apolog\w+|unfortunately|as an? (?:ai|assistant|language model)|i have to decline|thank you for asking|regret|i must decline)\b", re.I)
_ABOUT = re.compile(r"\b(?:i|me|my|assist|request|comply|provide|analys\w+|annotat\w+|content|process)\b", re.I)
# fixed values: words with which a writer speaks of itself or to the asker
_ADDRESS = frozenset("i me my we us our you your ich mich mir mein wir uns sie ihnen je me moi nous vous yo mi nosotros usted ustedes io noi voi eu nós você ik mij wij jij u assistant model request".split())
# fixed values: scripts by name
_SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Bengali", "Tamil", "Georgian", "Armenian")}
_HEADS = re.compile(r"""["'](?:head|deprel)["']\s*:""")
_ARROW = re.compile(r"(\d+)\s*(?:>|->|→)\s*(\d+)")
_FORM = re.compile(r"""["']form["']\s*:\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')""")
_KEYS = re.compile(r"""["'](?:\w+)["']\s*:""")
_FOREIGN = regex.compile(r"[\p{L}--\p{ASCII}]", regex.V1)
_PARAGRAPH = re.compile(r"\n\s*\n")
_FRAME = frozenset("input output text here is the again sentence tokens json response reponse respuesta antwort answer note message error original prompt id form".split())
_VALID_EMPTY = "(?i)empty_response"
_VALID_OPEN = "(?i)Unterminated|Expecting ',' delimiter|Expecting ':' delimiter|Expecting property name|Expecting value"


@dataclass(frozen=True)
class Call:
    """What the functions read of one call."""

    raw: str
    sentence: str
    asked: str
    used: int | None
    ending: int
    thoughts: str = ""


def _leaves_empty(value) -> bool:
    if isinstance(value, dict):
        return all(_leaves_empty(v) for v in value.values())
    if isinstance(value, list):
        return all(_leaves_empty(v) for v in value)
    return value is None or isinstance(value, str) and truncation.is_hollow(value)


def _vote(yes: bool, no: bool) -> int:
    return YES if yes else NO if no else ABSTAIN


def language(found: list[str]) -> tuple[str | None, int, int]:
    """Language with the most function words, how many, and how many the second has.

    A word that several languages have counts in part for each of them.
    """
    if not found:
        return None, 0, 0
    scores = sorted(((sum(1.0 / _SHARED[w] for w in found if w in own), lang) for lang, own in _LANGUAGES.items()), reverse=True)
    return (scores[0][1] if scores[0][0] > 0 else None), scores[0][0], scores[1][0]


def scripts(text: str) -> Counter:
    """Letters of each script in a text."""
    if text.isascii():
        return Counter(Latin=sum(map(str.isalpha, text)))
    return Counter({name: len(pattern.findall(text)) for name, pattern in _SCRIPTS.items()})


def _foreign(parts: list[str], sentence: str, known: Counter, home: frozenset[str], asked_language: str) -> tuple[int, int, int, int]:
    """Votes on the language of an answer's own prose: yes if one part is foreign, no if parts tell and none is."""
    cast: list[tuple[int, int, int, int]] = []
    for part in parts:
        plain = part.replace(sentence, " ") if sentence else part
        spoken = letters = at_home = script = ABSTAIN
        if not plain.isascii():  # the same letters tell nothing
            theirs, ours = scripts(plain), scripts(sentence)
            strange = sum(n for name, n in theirs.items() if not ours[name])
            # a writing of few spaces has more in a letter, so letters count, not words
            script = _vote(strange >= 8 and strange > sum(theirs.values()) - strange, False)
        own = [w for w in words(plain.replace("\\n", " ").replace("\\t", " ")) if not w.isdigit()]
        free = [w for w in own if w not in known and w not in _FRAME]
        if len(free) >= 4:
            lang, score, _ = language(free)
            same = sum(1.0 / _SHARED[w] for w in own if w in home)
            foreign = lang is not None and lang != asked_language
            # words that no list knows say nothing
            spoken = _vote(foreign and score >= 1.5 and score > 1.5 * same, lang is not None and (not foreign or score < 1))
            letters = _vote(any(_FOREIGN.search(w) for w in re.findall(r"[^\W\d_]+", plain) if w not in sentence), False)
            if len(free) >= 8:
                at_home = _vote(same <= 0.08 * len(free), same >= 0.2 * len(free))
        cast.append((spoken, letters, at_home, script))
    if not cast:
        return ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN
    # the part that looks most foreign stands for the answer
    return max(cast, key=lambda c: (c.count(YES) - c.count(NO), c))


def votes(call: Call) -> dict[str, tuple[int, ...]]:
    """The votes on each facet, those of the evaluator's message left out."""
    raw = call.raw
    end = truncation.ending(raw, truncation.asked_tokens(call.asked))
    objects = end.objects
    nothing = truncation.is_hollow(raw)
    reasons = bool(truncation._COT.match(raw))
    # empty
    values = ABSTAIN
    if nothing and not raw.strip():
        values = YES
    elif raw.lstrip()[:1] in '{["n':
        try:
            values = YES if _leaves_empty(json.loads(raw)) else NO
        except (ValueError, RecursionError):
            values = ABSTAIN
    few = ABSTAIN if call.used is None or 2 < call.used <= 8 else YES if call.used <= 2 else NO  # a few words are no empty answer
    empty = (NO if call.ending == truncation.OPEN else _vote(nothing, True), values, few)
    # truncated; the posterior of problem 3 votes when it is known for all calls
    truncated = (ABSTAIN, {truncation.OPEN: YES, truncation.WHOLE: NO}.get(call.ending, ABSTAIN))
    # the text in the model's own words: what stands around the objects, or all of a text without objects
    if objects:
        first = raw.find("{")
        own_text = raw[: max(first, 0)]
    else:
        own_text = _KEYS.sub(" ", raw)
    sentence = call.sentence
    asked_words = words(sentence)
    known = Counter(asked_words)
    own_words = words(own_text.replace("\\n", " ").replace("\\t", " ")) if own_text and not nothing else []
    real = [w for w in own_words if not w.isdigit()]
    fresh = [w for w in real if w not in known]
    arrows = set(_ARROW.findall(raw)) if not objects else set()
    # a draft parse that the prompt holds is no parse of the answer's own
    heads = bool(objects) or reasons or bool(_HEADS.search(raw)) or bool(arrows and arrows - set(_ARROW.findall(call.asked)))
    # copied prompt
    wanted = Counter(w for w in asked_words if not w.isdigit())
    have = Counter(real)
    covered = sum(min(n, have[w]) for w, n in wanted.items()) / max(1, sum(wanted.values()))
    framed = set(words(call.asked)) if fresh else set()
    added = [w for w in fresh if w not in _FRAME and w not in framed]
    if heads or nothing or not wanted:
        copied = (NO, NO, _vote(False, heads or nothing))
        is_copy = False
    else:
        is_copy = covered >= 0.8 and len(added) <= 0.15 * len(real)
        copied = (_vote(covered >= 0.8, covered < 0.6), _vote(len(added) <= 0.15 * len(real), True), YES)
    # other language: prose around the objects, and the forms within them
    asked_language, score, second = language(asked_words)
    if asked_language is None or score < 2 or score < 2 * second:
        asked_language = USUAL_LANGUAGE
    home = _LANGUAGES[asked_language]
    # each paragraph and the reasoning speak for themselves, so that one in another language is not outvoted
    parts = [part for part in (*_PARAGRAPH.split(own_text), call.thoughts) if part and not part.isspace()]
    spoken, letters, at_home, script = _foreign(parts, sentence, known, home, asked_language)
    away = form_language = ABSTAIN
    if objects >= 3 and call.asked:
        lexical = [f for f in (a or b for a, b in _FORM.findall(raw)) if any(c.isalpha() for c in f)]
        if len(lexical) >= 2:
            strange = [f for f in lexical if f"\t{f}" not in call.asked and f not in sentence]
            away = _vote(len(strange) >= 0.5 * len(lexical), len(strange) < 0.3 * len(lexical))
            if len(strange) >= 4:
                lang, score, _ = language([w for f in strange for w in words(f)])
                form_language = _vote(lang is not None and lang != asked_language or any(map(_FOREIGN.search, strange)), False)
    # refusal
    if objects or nothing:
        refusal = (NO, _vote(False, objects > 0 or nothing), NO)
    else:
        text = " ".join((own_text.replace(sentence, " ") if sentence else own_text).replace("’", "'").split())
        declines = bool(_DECLINES.search(text)) and bool(_ABOUT.search(text)) and not is_copy and not reasons
        regret = bool(_REGRET.search(text)) and not is_copy and not reasons
        alone = bool(fresh) and covered < 0.5 and not heads
        to_asker = not _ADDRESS.isdisjoint(fresh)
        refusal = (_vote(declines, True), _vote(regret, False), ABSTAIN if YES in (spoken, script, at_home) or alone and not to_asker else _vote(alone, True))
    return {
        "empty": empty, "truncated": truncated, "refusal": refusal, "copied_prompt": copied,
        "foreign_prose": (spoken, letters, at_home, script), "foreign_forms": (away, form_language),
    }


def pack(found: dict[str, tuple[int, ...]]) -> list[int]:
    """One number per facet from its votes, in the order of ``FUNCTIONS``."""
    out = []
    for facet in FUNCTIONS:
        code = 0
        for v in found[facet]:
            code = code * 3 + v
        out.append(code)
    return out


def unpack(code: int, size: int) -> tuple[int, ...]:
    out = []
    for _ in range(size):
        out.append(code % 3)
        code //= 3
    return tuple(reversed(out))


@dataclass(frozen=True)
class LabelModel:
    """How common a facet is, and each function's rate of votes for it, by truth."""

    prior: float
    rates: np.ndarray

    def posterior(self, code: int) -> float:
        """Of a vote pattern; 0 where all functions abstain."""
        cast = unpack(code, len(self.rates))
        if not any(cast):
            return 0.0
        odds = math.log(self.prior / (1 - self.prior))
        for rate, v in zip(self.rates, cast):
            if v == YES:
                odds += math.log(rate[1] / rate[0])
            elif v == NO:
                odds += math.log((1 - rate[1]) / (1 - rate[0]))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit_label_model(functions: tuple[str, ...], counts: dict[int, int], rounds: int = 200) -> LabelModel:
    """The model of a facet's functions by expectation-maximization over counted vote patterns.

    Functions are taken as independent given the truth; an abstention says nothing, and a
    call on which all abstain is not accused.  Each function has a rate of right votes for
    either truth, started at mostly right and smoothed by a few imagined calls.  A
    function is taken to find at least half of the defective calls it votes on and to
    accuse at most three tenths of the others, so the two truths cannot change places;
    how common the defect is, is free.
    """
    size = len(functions)
    patterns = [(unpack(code, size), code, n) for code, n in counts.items() if any(unpack(code, size))]
    total = sum(n for *_, n in patterns)
    start = np.array([STARTS.get(name, USUAL_START) for name in functions])
    model = LabelModel(0.02, start)
    for _ in range(rounds):
        result = {code: model.posterior(code) for _, code, _n in patterns}
        mass = sum(result[code] * n for _, code, n in patterns)
        prior = min((mass + 0.4) / (total + 20.0), 1 - 1e-6)
        rates = np.empty((size, 2))
        for i in range(size):
            seen = np.array([4.0, 5.0])
            yes = seen * start[i]
            for cast, code, n in patterns:
                if cast[i] != ABSTAIN:
                    share = np.array([1 - result[code], result[code]]) * n
                    seen += share
                    yes += share * (cast[i] == YES)
            rates[i] = np.clip(yes / seen, (1e-6, 0.5), (0.3, 1 - 1e-6))
        moved, model = abs(prior - model.prior), LabelModel(prior, rates)
        if moved < 1e-9:
            break
    return model


def label_model(facet: str, counts: dict[int, int]) -> dict[int, float]:
    """Posterior of a facet for each vote pattern."""
    model = fit_label_model(FUNCTIONS[facet], counts)
    return {code: model.posterior(code) for code in counts}


VOTES = "response_id {kind}, empty int, truncated int, refusal int, copied_prompt int, foreign_prose int, foreign_forms int, source string"


def _coded(facet: str, function: str) -> int:
    """What a vote of 1 of this function adds to the code of its facet."""
    return 3 ** (len(FUNCTIONS[facet]) - 1 - FUNCTIONS[facet].index(function))


def call_votes(responses: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``VOTES`` of every call without an API error.

    Texts are read in a map; what the evaluator said, and the posteriors of problem 3,
    are then joined and turned to votes without the texts.
    """
    calls = truncation.response_calls(responses).filter("api_error is null")
    fitted, rates = truncation.with_fitted(spread(calls), truncation.fit_sources(calls))
    kind = responses.schema["response_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["response_id", "sentence", "thoughts", "source", *truncation.READS]
        for batch in batches:
            out = []
            for key, sentence, thoughts, source, *read in zip(*(batch[n] for n in names)):
                raw, asked, used = read[0] or "", read[1] or "", truncation._number(read[2])
                ending, weights, no_usage = truncation.row_weights(*read, rates)
                sentence = sentence or asked.partition("# text = ")[2].partition("\n")[0]
                out.append((key, *pack(votes(Call(raw, sentence, asked, used, ending, thoughts or ""))), source, ending, *weights, no_usage))
            yield pd.DataFrame(out, columns=["response_id", *FUNCTIONS, "source", "kind", *truncation.WAYS, "no_usage"])

    wanted = fitted.select("response_id", "sentence", "thoughts", "source", *truncation.READS)
    cast = cut(wanted.mapInPandas(run, f"{VOTES.format(kind=kind)}, {truncation.EVIDENCE}"))
    missing = truncation.posterior_column(truncation.counted_shares(cast)) >= truncation.CUTOFF
    length_vote = F.when(missing, YES).otherwise(NO) * _coded("truncated", "length_posterior")
    said = evaluations.filter("response_id is not null and validation_error is not null").groupBy("response_id").agg(
        F.bool_or(F.col("validation_error").rlike(_VALID_EMPTY)).alias("says_empty"), F.bool_or(F.col("validation_error").rlike(_VALID_OPEN)).alias("says_open")
    )
    joined = cast.withColumn("truncated", F.col("truncated") * 3 + length_vote).withColumn("empty", F.col("empty") * 3).join(said, "response_id", "left")
    empty = F.col("empty") + F.when(F.col("says_empty"), YES).otherwise(ABSTAIN)
    truncated = F.col("truncated") + F.when(F.col("says_open"), YES).when(F.col("says_open").isNull(), NO).otherwise(ABSTAIN)
    return joined.select("response_id", "source", empty.cast("int").alias("empty"), truncated.cast("int").alias("truncated"), *[f for f in FUNCTIONS if f not in ("empty", "truncated")])


def counted_patterns(found: DataFrame) -> dict[str, dict[int, int]]:
    """Calls of each vote pattern of each facet, in one pass; at most 3 ** functions patterns a facet."""
    counts: dict[str, dict[int, int]] = {facet: {} for facet in FUNCTIONS}
    for r in found.unpivot(["response_id"], list(FUNCTIONS), "facet", "code").groupBy("facet", "code").count().collect():
        counts[r.facet][r.code] = r["count"]
    return counts


def fitted_models(found: DataFrame) -> dict[str, LabelModel]:
    """The label model of each facet, from all calls."""
    return {facet: fit_label_model(FUNCTIONS[facet], counts) for facet, counts in counted_patterns(found).items()}


def defects(responses: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``response_id, defect, posterior``: one row per call and defect that passes its cutoff.

    Calls with an API error are left out, null and blank answers are empty ones, missing
    prompts, usage or evaluations only silence the functions that read them, and
    repeated calls count by themselves.
    """
    found = cut(call_votes(responses, evaluations))
    counts = counted_patterns(found)
    parts = []
    for facet in FUNCTIONS:
        kept = {code: p for code, p in label_model(facet, counts[facet]).items() if p >= CUTOFFS[facet]} or {-1: 0.0}
        table = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair])
        parts.append(F.when(F.col(facet).isin(list(kept)), F.struct(F.lit(DEFECT[facet]).alias("defect"), F.element_at(table, F.col(facet)).alias("posterior"))))
    flagged = found.select("response_id", F.array_compact(F.array(*parts)).alias("facets"))
    # a call with both facets of a defect gets it once, with the larger posterior
    merged = F.array_distinct(F.transform("facets", lambda x: x["defect"]))
    rows = flagged.select("response_id", "facets", F.explode(merged).alias("defect"))
    best = F.array_max(F.transform(F.filter("facets", lambda x: x["defect"] == F.col("defect")), lambda x: x["posterior"]))
    return rows.select("response_id", "defect", best.alias("posterior"))
