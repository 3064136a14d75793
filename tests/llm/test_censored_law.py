"""Posteriors and limits from the censored law of a source."""

import json
import math

import numpy as np

from treemill.llm import truncation as tr

RATE = math.log(3.2)
ASKED = "\n".join(f"{n}\tword" for n in range(1, 41))


def answer(tokens, closed=True):
    text = json.dumps({"tokens": [{"id": n, "form": "word", "upos": "X", "head": 0 if n == 1 else 1, "deprel": "dep"} for n in range(1, tokens + 1)]})
    return text if closed else text[:-2]


def of(raw, used=None, limit=None, law=(7.6, 0.25), most=4096):
    return tr.row_posterior(raw, ASKED, used, most, limit, RATE, *law)


def weigh(raw, used=None, limit=None, law=(7.6, 0.25), most=4096):
    return dict(zip(tr.WAYS, tr.row_weights(raw, ASKED, used, most, limit, RATE, *law, tr.ANY_RATES)[1]))


def test_values_follow_the_length_law():
    closed, opened = [of(answer(k)) for k in (5, 10, 30)], [of(answer(k, False)) for k in (5, 10, 30)]
    assert closed[0] > closed[2] and closed[1] > closed[2] and len({round(x, 6) for x in closed}) == 3  # closed afterwards, no usage
    assert min(opened) > 0.99 and all(o > c for o, c in zip(opened, closed))
    fits, sent = (round(len(answer(10)) / 3.2), round(len(answer(40)) / 3.2))
    assert of(answer(10), used=fits) < 0.01 and of(answer(10), used=sent) > 0.99 and of(answer(40), used=sent) == 0.0


def test_tail_against_density_at_the_limit():
    raw = answer(20, False)
    # a law whose answers all end near the limit explains more of what stands there than one that reaches far beyond
    near, far = (weigh(raw, limit=len(raw), used=round(len(raw) / 3.2), law=(math.log(len(raw)), s))["field_limit"] for s in (0.01, 0.6))
    assert 0 < near < far
    assert of(raw, used=500, most=500, law=(6.5, 0.3)) > 0.9 and of(answer(40), used=500, most=500) == 0.0
    assert weigh(raw, used=499, most=500)["token_limit"] == 0 < weigh(raw, used=500, most=500)["token_limit"]


def test_shares_are_fitted_behind_each_kind_of_ending():
    token, whole = (40.0, 0.0, 0.5, 0.0, 0.0), (0.0, 0.0, 0.01, 0.0, 0.0)
    got = tr.fit_shares([(tr.SHORT, token, 900), (tr.SHORT, whole, 100), (tr.WHOLE, (0.0,) * 5, 20_000)], 0.04)[tr.SHORT]
    few = tr.fit_shares([(tr.SHORT, token, 10), (tr.SHORT, whole, 990), (tr.WHOLE, (0.0,) * 5, 20_000)], 0.04)[tr.SHORT]
    assert got[1] > 0.85 > 0.05 > few[1] and few[0] > 0.95
    assert tr.share_posterior(got, token) > 0.99 and tr.share_posterior(got, whole) < 0.01
    rare = tr.fit_shares([(tr.OPEN, (0.0, 0.0, 0.0, 0.0, 1.0), 50), (tr.WHOLE, (0.0,) * 5, 100_000)], 0.04)[tr.OPEN]
    assert rare[0] == 0.2002 or abs(rare[0] - 0.2) < 0.01  # ten slips among a hundred thousand answers explain ten of fifty


def counted(stored, limits):
    values, times = np.unique(stored, return_counts=True)
    return values, times.astype(float), np.where(np.isin(values, limits), times, (times >= 12) * 2)


def test_all_limits_are_found_wherever_they_lie():
    rng = np.random.default_rng(2)
    sizes = np.round(np.exp(rng.normal(7, 0.5, 60_000)))
    late = np.where(np.arange(60_000) < 20_000, sizes, np.minimum(sizes, 1500))  # got its limit late: 7 % are longer
    two = np.where(np.arange(60_000) % 2, np.minimum(sizes, 1300), np.minimum(sizes, 2400))
    assert [x for x, _ in tr.find_limits(*counted(late, [1500]))] == [1500]
    assert [x for x, _ in tr.find_limits(*counted(two, [1300, 2400]))] == [1300, 2400]
    values, times, opened = counted(np.minimum(sizes, 2400), [2400])
    far = np.arange(5_000.0, 5_120.0, 2)  # sixty longer lengths with two open ends each, in under 0.5 % of the answers
    found = tr.find_limits(np.append(values, far), np.append(times, np.full(60, 4.0)), np.append(opened, np.full(60, 2)))
    assert 2400 in [x for x, _ in found]
    assert tr.find_limits(values, times, np.zeros(len(values))) == []


def test_each_of_two_limits_counts():
    raw = answer(20)
    at, spare = len(raw), round(len(answer(40)) / 3.2)
    assert weigh(raw, spare, [at, 9_000])["field_limit"] == weigh(raw, spare, [500, at])["field_limit"] > 0 == weigh(raw, spare, [500, 9_000])["field_limit"]
