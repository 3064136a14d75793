"""Texts cut off by output limits, field limits or broken transfers (problem 3).

Per source, the lengths of stored answers follow a log-normal law that is right-censored
at its field limits; it is fitted by maximum likelihood, every length being scored as a
limit.  Characters per usage token follow a law of their own, kept as a histogram.  For
each value and each way to lose an end (the call's token limit, a field limit, a transfer
that broke with the sender's usage, with the receiver's or with none) a weight says how
much better that way explains size and usage than an answer that ended by itself: tail
mass of the censored law against its density there.  How common each way is behind each
kind of ending is then fitted by expectation-maximization over the counted weights of all
answers, and gives every value its censoring posterior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from treemill.plans.session import cut as materialised, spread

#: Up to this many sources, their fitted values are broadcast; beyond it they are joined.
MANY_SOURCES = 10_000
CUTOFF = 0.5
#: Characters that an object of an answer takes, where it has none to measure.
OBJECT_CHARS = 75.0
#: Lengths to either side whose counts say what is usual at a length.
AROUND = 25
#: Error of the whole length as reckoned from the part that is there; 0.05 to 0.10 measured on whole answers stopped at a random token.
OWN_SPREAD = 0.08
#: The same where nothing of the structure is there yet, and the spread of a source's law where none is fitted.
FREE_SPREAD, ANY_SPREAD = 0.35, 0.5
#: Part of the whole answers that follow no law of their source (early ends, refusals), spread evenly over log length.
STRAY, STRAY_WIDTH = 0.1, 5.0
#: Answers in which a model that ended by itself left its structure open, as a share of all answers.
OPEN_SLIPS = 1e-4
#: Histogram of log characters per token around the mean of the source.
RATE_STEP, RATE_REACH = 0.02, 40

# kinds of endings
WHOLE, SHORT, OPEN, PROSE = range(4)
#: Ways to lose an end, in the order of the weights; the receiver's usage fits what arrived, so its weight is 1.
WAYS = ("token_limit", "field_limit", "broken", "usage_lost", "received")
#: Shares of an own end and of each way, by kind, of a few imagined answers; expectation-maximization starts from them.
USUAL = {SHORT: (0.7, 0.05, 0.05, 0.15, 0.05, 0.0), OPEN: (0.0, 0.2, 0.2, 0.3, 0.15, 0.15), PROSE: (0.96, 0.01, 0.01, 0.015, 0.005, 0.0)}
IMAGINED = 5.0

# fixed values: words of wrappings that hold nothing themselves
_WRAPPING = regex.compile(
    r"""(?:["']?\b(?:tokens?|parse|result|results|output|answer|response|text|note|message|data|content|json|null|none|nil|n/a|undefined|empty|id|form|upos|head|deprel)\b["']?|[\s\p{P}\p{S}\p{C}\p{Z}])*+""", regex.I
)
_LAST_ID = re.compile(r"""["']id["']\s*:\s*["']?(\d+)""")
_CLOSED = re.compile(r"""[}\]]\s*,?\s*\]""")
_SENTENCE_END = re.compile(r"""[.!?:)\]}"'`»”。！？]\s*$""")
_BAD_END = re.compile(r"(?:�|…|\.\.\.)\s*$")
_COT = re.compile(r"^\s*(?:The sentence is|Step \d)")
_ARROWS = re.compile(r"\d\s*>\s*\d")


@dataclass(frozen=True)
class Ending:
    """What the text itself says: tokens asked for, last token reached, whether its structure is closed."""

    asked: int
    reached: int
    objects: int
    closed: bool
    bad: bool

    @property
    def complete(self) -> bool:
        return self.closed and (self.objects == 0 or self.reached >= self.asked)


def is_hollow(raw: str) -> bool:
    """Whether nothing is left of an answer, however long, without wrapping, white space and null words; reading stops at the first other character."""
    return _WRAPPING.match(raw).end() == len(raw)


def ending(raw: str, asked: int) -> Ending:
    """Reads the end of an answer; only the part behind the last token is looked at closely."""
    objects = raw.count('"id"') or raw.count("'id'")
    bad = bool(_BAD_END.search(raw[-12:]))
    if objects:
        at = max(raw.rfind('"id"'), raw.rfind("'id'"))
        last = _LAST_ID.match(raw, at)
        reached = int(last.group(1)) if last and len(last.group(1)) < 9 else 0
        tail = raw[at:]
        closed = bool(_CLOSED.search(tail))
        if not closed or last is None:
            before = max(raw.rfind('"id"', 0, at), raw.rfind("'id'", 0, at))
            if reached == 0 and before >= 0 and (known := _LAST_ID.match(raw, before)):
                reached = int(known.group(1)) if len(known.group(1)) < 9 else 0
        return Ending(asked, reached, objects, closed, bad)
    text = raw.rstrip()
    if _COT.match(text):  # reasoning alone
        return Ending(asked, 0, 0, bool(_SENTENCE_END.search(text)) and not bad, bad)
    if text[:1] in "{[" or text.startswith("```"):
        if text.startswith("```"):
            closed = text.count("```") >= 2
        else:
            closed = text[-1:] in "}]" and text.count("{") <= text.count("}") and text.count("[") <= text.count("]")
        return Ending(asked, 0, 0, closed, bad)
    listed = "\t" in text and bool(re.search(r"\d\t\S+$", text))
    return Ending(asked, 0, 0, bool(_SENTENCE_END.search(text)) and not bad or listed or bool(_ARROWS.search(text)), bad)


@dataclass(frozen=True)
class Rates:
    """Law of log characters per usage token, around a source's mean: densities by step, of whole answers and of cut ones."""

    whole: np.ndarray
    cut: np.ndarray
    free: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Rates:
        """From counts by step; some imagined answers follow a normal law, and a few stand anywhere."""
        at = np.arange(-RATE_REACH, RATE_REACH + 1) * RATE_STEP
        usual = np.exp(-0.5 * (at / 0.07) ** 2)
        own = counts + 20 * usual / usual.sum() + 0.02
        own = own / own.sum() / RATE_STEP

        def blurred(by: float) -> np.ndarray:
            lags = np.arange(-2 * RATE_REACH, 2 * RATE_REACH + 1)
            kernel = np.exp(-0.5 * (lags * RATE_STEP / by) ** 2)
            moved = np.convolve(own, kernel / kernel.sum(), "full")[2 * RATE_REACH :]
            return np.maximum(moved[: len(own)], 1e-4)

        return Rates(own, blurred(OWN_SPREAD), blurred(FREE_SPREAD))

    @staticmethod
    def at(law: np.ndarray, value: float) -> float:
        step = round(value / RATE_STEP)
        return float(law[step + RATE_REACH]) if -RATE_REACH <= step <= RATE_REACH else 1e-4


#: Where nothing is counted yet.
ANY_RATES = Rates.of(np.zeros(2 * RATE_REACH + 1))


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _whole_density(size: float, law: tuple[float, float]) -> float:
    """Density, a unit of length, of answers that end by themselves at ``size``: the source's law and strays."""
    z = (math.log(size) - law[0]) / law[1]
    return (1 - STRAY) * math.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * law[1] * size) + STRAY / (STRAY_WIDTH * size)


def _at_limit(limit: float, law: tuple[float, float], own: tuple[float, float]) -> float:
    """Tail mass beyond a limit against the density of whole answers there."""
    return _tail((math.log(limit) - own[0]) / own[1]) / _whole_density(limit, law)


def _anywhere(size: float, own: tuple[float, float]) -> float:
    """Density of answers broken off at ``size``, if longer ones break at an even place: the mean of 1 / length over the tail."""
    mean, spread = own
    return math.exp(-mean + 0.5 * spread**2) * _tail((math.log(size) - mean + spread**2) / spread)


def ending_kind(raw: str, end: Ending) -> int:
    """What the end of a text looks like, whatever its size."""
    if not raw or end.complete and (end.objects or raw.lstrip()[:1] in ("{", "[", "`")) or is_hollow(raw) and raw.count("{") <= raw.count("}") and raw.count("[") <= raw.count("]"):
        return WHOLE
    structured = end.objects or _COT.match(raw) or raw.lstrip()[:1] in ("{", "[", "`")
    if structured:
        return SHORT if end.closed else OPEN
    return WHOLE if end.closed else OPEN if end.bad else PROSE


def weights(raw: str, end: Ending, used: int | None, most: int | None, limits: tuple[int, ...], mean: float, law: tuple[float, float] | None, rates: Rates) -> tuple[int, tuple[float, ...]]:
    """Kind of ending, and the weight of each of ``WAYS`` against an end of its own; 0 where a way is ruled out.

    ``used`` completion tokens of at most ``most``; ``limits`` characters of the source's
    fields; ``mean`` of its log characters per token; ``law`` mean and spread of its log
    length, fitted with its limits as censored.
    """
    kind, size = ending_kind(raw, end), len(raw)
    if kind == WHOLE:
        return kind, (0.0,) * len(WAYS)
    each = size / end.objects if end.objects else OBJECT_CHARS
    lacking = max(end.asked - end.reached, 0 if end.objects else end.asked)
    if end.objects and 0 < end.reached < end.asked:
        before = max(raw.find("{"), 0)  # reasoning in front of the objects
        whole = before + (size - before) * end.asked / end.reached
    else:
        whole = size + (lacking or 0.3) * each
    law = law or (math.log(whole), ANY_SPREAD)
    own = (math.log(whole), OWN_SPREAD if end.objects else FREE_SPREAD)  # the answer's own law, by its prompt
    known = used is not None and used > 0
    by_usage = 1.0  # how much better the usage fits an answer that was longer
    if known:
        by_usage = Rates.at(rates.cut if end.objects else rates.free, math.log(whole / used) - mean) / Rates.at(rates.whole, math.log(size / used) - mean)
        if math.log(size / used) < mean - RATE_REACH * RATE_STEP:  # no answer of that size would have used so many tokens
            by_usage = max(by_usage, 1e3)
    token = field = 0.0
    if known and most is not None and 0 < most <= used:
        tokens = (law[0] - mean, math.hypot(law[1], 0.07))
        token = _at_limit(most, tokens, (max(own[0] - mean, math.log(most)), own[1]))
    span = 1.5 * each if end.closed else 24.0
    for limit in limits:
        if size == limit and not end.closed:
            field += _at_limit(limit, law, (max(own[0], math.log(limit)), own[1]))
        elif size < limit < whole and size >= limit - span or size == limit < whole:  # cut at the limit, then trimmed or closed within the span
            field += _at_limit(limit, law, own) / span * max(by_usage, 1e-3)
    anywhere = _anywhere(size, own) / _whole_density(size, law)
    return kind, (token, field, anywhere * by_usage if known else 0.0, 0.0 if known else anywhere, float(known and kind == OPEN))


def share_posterior(shares: tuple[float, ...], found: tuple[float, ...]) -> float:
    """Posterior of a missing end from the shares of a kind and a value's weights."""
    lost = sum(s * w for s, w in zip(shares[1:], found))
    return lost / (shares[0] + lost) if lost else 0.0


def fit_shares(cells: list[tuple[int, tuple[float, ...], int]], lost_by_chance: float) -> dict[int, tuple[float, ...]]:
    """Share of an own end and of each way behind each kind of ending, by expectation-maximization.

    ``cells`` are kinds, weights and counts.  A received usage fits a broken
    transfer as well as an own end, so the share of own ends among open structures is not
    fitted but ``OPEN_SLIPS`` of all answers.  ``lost_by_chance`` is the share of whole
    answers without usage, against which a lost usage is weighed.
    """
    total = sum(n for _, _, n in cells)
    out = {}
    for kind, usual in USUAL.items():
        own = [((*w[:3], w[3] / lost_by_chance, w[4]), n) for k, w, n in cells if k == kind]
        mass = sum(n for _, n in own)
        fixed = min(0.5, OPEN_SLIPS * total / mass) if kind == OPEN and mass else OPEN_SLIPS if kind == OPEN else None
        shares = np.array(usual) if fixed is None else np.array([fixed, *(np.array(usual[1:]) * (1 - fixed))])
        for _ in range(200):
            sums = np.array(usual) * IMAGINED
            for w, n in own:
                part = shares * np.array([1.0, *w])
                sums += n * part / part.sum()
            if fixed is None:
                new = sums / sums.sum()
            else:
                new = np.array([fixed, *(sums[1:] / sums[1:].sum() * (1 - fixed))])
            moved, shares = np.abs(new - shares).max(), new
            if moved < 1e-6:
                break
        out[kind] = tuple(float(x) for x in shares[:4]) + (float(shares[4]) / lost_by_chance, float(shares[5]))
    return out


#: Shares before any answer is counted.
ANY_SHARES = fit_shares([], 0.04)


# -- fitted per source ---------------------------------------------------------------
def fit_lognormal(sizes: np.ndarray, times: np.ndarray, limit: float | list[float] | None) -> tuple[float, float]:
    """Mean and spread of log length by maximum likelihood.

    Values at one ``limit`` and beyond count as censored there; of several limits, the
    values at each are censored and all others are seen, so that a limit may hold for a
    part of the answers only.
    """
    logs, weight = np.log(np.maximum(sizes, 1.0)), times.astype(float)
    total = weight.sum()
    mean = float((logs * weight).sum() / total)
    spread = max(float(np.sqrt(((logs - mean) ** 2 * weight).sum() / total)), 0.05)
    if limit is None or isinstance(limit, list) and not limit:
        return mean, spread
    if isinstance(limit, list):
        seen = ~np.isin(sizes, limit)
        cut = [(math.log(x), float(weight[sizes == x].sum())) for x in limit]
    else:
        seen = logs < math.log(limit)
        cut = [(math.log(limit), float(weight[~seen].sum()))]
    for _ in range(60):
        sum_1, sum_2 = (logs[seen] * weight[seen]).sum(), (logs[seen] ** 2 * weight[seen]).sum()
        for edge, n_cut in cut:
            z = (edge - mean) / spread
            tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
            rate = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
            first = mean + spread * rate
            sum_1 += n_cut * first
            sum_2 += n_cut * (spread**2 * (1 + z * rate - rate**2) + first**2)
        new_mean = sum_1 / total
        new_spread = math.sqrt(max(sum_2 / total - new_mean**2, 1e-4))
        moved = abs(new_mean - mean) + abs(new_spread - spread)
        mean, spread = float(new_mean), float(new_spread)
        if moved < 1e-7:
            break
    return mean, spread


def _chance(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Upper bound of the logarithm of the chance of ``n`` or more where ``expected`` are (Chernoff's for Poisson counts)."""
    n, expected = np.maximum(n, 1e-9), np.maximum(expected, 1e-12)
    return np.where(n <= expected, 0.0, n - expected + n * np.log(expected / n))


def find_limits(sizes: np.ndarray, times: np.ndarray, open_ends: np.ndarray) -> list[tuple[int, float]]:
    """The lengths at which a source cuts, and the share of the answers there that the law cannot explain.

    Every length is scored, wherever it lies: it is kept if it has at least two open ends
    and more of them, and more answers, than chance allows among so many lengths, and if
    the law censored at all kept limits, and the lengths around, expect under a fifth of
    what stands there.
    """
    order = np.argsort(sizes)
    sizes, times, open_ends = sizes[order].astype(float), times[order].astype(float), open_ends[order].astype(float)
    total, sure = times.sum(), math.log(0.01 / len(sizes))
    kept = np.zeros(len(sizes), bool)
    low, high = np.searchsorted(sizes, sizes - AROUND), np.searchsorted(sizes, sizes + AROUND, "right")
    shares = np.zeros(len(sizes))
    for _ in range(5):  # limits found make the law and the surroundings of the others plainer
        mean, spread = fit_lognormal(sizes, times, [float(x) for x in sizes[kept]])
        z = (np.log(np.maximum(sizes, 1.0)) - mean) / spread
        by_law = total * np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * spread * np.maximum(sizes, 1.0))

        def around(values: np.ndarray) -> np.ndarray:
            own = np.where(kept, 0.0, values)
            sums = np.concatenate([[0.0], np.cumsum(own)])
            return (sums[high] - sums[low] - own) / (2 * AROUND)

        expected = np.maximum(by_law, around(times))
        rate = open_ends[~kept].sum() / max(1.0, times[~kept].sum())
        opened = np.maximum(by_law * rate, around(open_ends))
        shares = 1 - expected / times
        now = (open_ends >= 2) & (shares > 0.8) & (_chance(times, expected) < sure) & (_chance(open_ends, opened) < sure)
        if (now == kept).all():
            break
        kept = now
    return [(int(sizes[i]), float(shares[i])) for i in np.flatnonzero(kept)]


def find_limit(sizes: np.ndarray, times: np.ndarray, open_ends: np.ndarray) -> tuple[int | None, float]:
    """The limit of ``find_limits`` that explains most of what stands there."""
    return max(find_limits(sizes, times, open_ends), key=lambda x: x[1], default=(None, 0.0))


FITTED = "source string, field_limits array<int>, limit_shares array<double>, size_mean double, size_spread double, rate_mean double, rates array<long>"


def fit_sources(calls: DataFrame) -> DataFrame:
    """``FITTED`` per source, from all answers.  ``calls`` has ``source, raw, used``.

    Lengths and rates are counted in one aggregation before anything is gathered, so a
    source brings at most one row per length or step, however many answers it has.
    """
    closed = F.col("raw").rlike(r"[}\]][\s`]*$")
    built = F.col("raw").rlike(r"""^\s*(?:[{\[]|```|The sentence is|Step \d)|["']id["']""")
    rate = F.when(closed & (F.col("used") > 0) & (F.length("raw") >= 300), F.round(F.ln(F.length("raw") / F.col("used")) / RATE_STEP).cast("int"))
    rows = calls.filter("raw is not null and length(raw) > 0").select(
        F.coalesce("source", F.lit("")).alias("source"), F.length("raw").alias("size"), rate.alias("rate"), (built & ~closed).alias("open"), F.xxhash64("raw").alias("text"),
    )
    # a repeated text is one piece of evidence: its open ends count only beside another text of that length
    texts = F.when(F.col("open"), F.col("text"))
    parts = F.array(F.struct(F.lit(True).alias("is_size"), F.col("size").alias("at")), F.struct(F.lit(False).alias("is_size"), F.col("rate").alias("at")))
    each = rows.select("source", "open", "text", F.explode(parts).alias("p")).select("source", "open", "text", "p.*").filter("at is not null")
    counted = each.groupBy("source", "is_size", "at").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"), (F.min(texts) < F.max(texts)).alias("several"))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        source = own["source"].iloc[0]
        rates, own = own[~own["is_size"]].sort_values("at"), own[own["is_size"]]
        sizes, times = own["at"].to_numpy(dtype=float), own["n"].to_numpy(dtype=float)
        found = find_limits(sizes, times, np.where(own["several"].eq(True), own["n_open"], 0))
        mean, spread = fit_lognormal(sizes, times, [float(x) for x, _ in found])
        steps, n = rates["at"].to_numpy(int), rates["n"].to_numpy(int)
        middle = float(steps[np.searchsorted(np.cumsum(n), n.sum() / 2)]) if len(n) else round(math.log(3.2) / RATE_STEP)
        near = np.abs(steps - middle) <= RATE_REACH // 4  # the mean of the bulk, between steps
        centre = float((steps[near] * n[near]).sum() / n[near].sum()) if near.any() else middle
        held = np.zeros(2 * RATE_REACH + 1, int)
        places = np.round(steps - centre).astype(int)
        inside = np.abs(places) <= RATE_REACH
        np.add.at(held, places[inside] + RATE_REACH, n[inside])
        return pd.DataFrame(
            {"source": [source], "field_limits": [[x for x, _ in found]], "limit_shares": [[x for _, x in found]], "size_mean": [mean], "size_spread": [spread], "rate_mean": [centre * RATE_STEP], "rates": [held]}
        )

    return counted.groupBy("source").applyInPandas(fit, FITTED)


def with_fitted(calls: DataFrame, fitted: DataFrame) -> tuple[DataFrame, Rates]:
    """``calls`` with the values of their source, and the law of rates around the sources' means.

    The fitted table is broadcast only if its counted size allows it.
    """
    spark = calls.sparkSession
    fitted = materialised(fitted)
    steps = fitted.select(F.posexplode("rates").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()  # one row a step
    counts = np.zeros(2 * RATE_REACH + 1)
    for r in steps:
        counts[r.pos] = r.n
    own = fitted.select(F.col("source").alias("own_source"), "field_limits", "size_mean", "size_spread", "rate_mean")
    if fitted.count() <= MANY_SOURCES:
        own = F.broadcast(own)
    return calls.join(own, F.coalesce(calls["source"], F.lit("")) == F.col("own_source"), "left"), Rates.of(counts)


def response_calls(responses: DataFrame) -> DataFrame:
    """The fields of a stored call that the operators of problems 2 and 3 read."""
    return responses.select(
        "response_id", "source", "api_error", F.col("text").alias("sentence"), F.col("raw_response").alias("raw"), F.col("prompt.user_msg").alias("asked_text"),
        F.col("usage.completion_tokens").alias("completion"), F.col("usage.total_tokens").alias("total"), F.col("usage.prompt_tokens").alias("prompted"),
        F.col("model_config.max_tokens").alias("most"), F.col("reasoning_content").alias("thoughts"),
    ).withColumn("used", F.coalesce("completion", F.col("total") - F.col("prompted"))).drop("completion", "total", "prompted")


def asked_tokens(asked_text: str | None) -> int:
    """Numbered tokens in the prompt."""
    return asked_text.count("\t") if asked_text else 0


def _number(value) -> int | None:
    return None if value is None or value != value else int(value)


#: What the reading of a text needs of its call and source.
READS = ("raw", "asked_text", "used", "most", "field_limits", "rate_mean", "size_mean", "size_spread")
EVIDENCE = "kind int, " + ", ".join(f"{w} double" for w in WAYS) + ", no_usage boolean"


def row_weights(raw: str | None, asked: str | None, used, most, limits, mean, size_mean, size_spread, rates: Rates) -> tuple[int, tuple[float, ...], bool]:
    """``EVIDENCE`` of one call; null and empty answers are whole."""
    end = ending(raw or "", asked_tokens(asked))
    mean = math.log(3.2) if mean is None or mean != mean else mean
    law = None if size_mean is None or size_mean != size_mean else (size_mean, size_spread)
    known = () if limits is None else tuple(int(x) for x in np.atleast_1d(limits) if x == x)
    used = _number(used)
    kind, found = weights(raw or "", end, used, _number(most), known, mean, law, rates)
    return kind, found, used is None or used <= 0


def row_posterior(raw: str | None, asked: str | None, used, most, limits, mean, size_mean=None, size_spread=None, rates: Rates = ANY_RATES, shares: dict = ANY_SHARES) -> float:
    """Probability that the end of one answer is missing."""
    kind, found, _ = row_weights(raw, asked, used, most, limits, mean, size_mean, size_spread, rates)
    return 0.0 if kind == WHOLE else share_posterior(shares[kind], found)


def counted_shares(evidence: DataFrame) -> dict[int, tuple[float, ...]]:
    """``fit_shares`` over all rows of ``EVIDENCE``; the counted cells are few levels, whatever the data."""
    levels = [F.when(F.col(w) > 0, F.greatest(F.lit(-10), F.least(F.lit(14), F.rint(F.ln(w)))).cast("int")).alias(w) for w in WAYS]  # null where ruled out
    whole = F.col("kind") == WHOLE
    cells = evidence.select("kind", *levels, F.when(whole, F.col("no_usage")).alias("lost")).groupBy("kind", "lost", *WAYS).count().collect()
    n_whole, n_lost = sum(r["count"] for r in cells if r.kind == WHOLE), sum(r["count"] for r in cells if r.kind == WHOLE and r.lost)
    return fit_shares([(r.kind, tuple(0.0 if r[w] is None else math.exp(r[w]) for w in WAYS), r["count"]) for r in cells], (n_lost + 1) / (n_whole + 25))


def posterior_column(shares: dict[int, tuple[float, ...]]) -> Column:
    """The posterior as an expression over ``EVIDENCE``."""
    out = F.lit(0.0)
    for kind, (own, *ways) in shares.items():
        lost = sum((F.lit(s) * F.col(w) for s, w in zip(ways, WAYS)), F.lit(0.0))
        out = F.when(F.col("kind") == kind, F.coalesce(F.try_divide(lost, lost + own), F.lit(0.0))).otherwise(out)
    return out


def truncation(calls: DataFrame) -> DataFrame:
    """``response_id, source, cut``: the posterior of a missing end for every answer.

    Null answers have none and are left out; empty and blank ones get 0.  Null usage,
    limits or prompts drop that evidence only.  Repeated rows stay.
    """
    rows, rates = with_fitted(spread(calls.filter("raw is not null")), fit_sources(calls))
    kind = calls.schema["response_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [row_weights(*x, rates) for x in zip(*(batch[n] for n in READS))]
            out = pd.DataFrame([(k, *w, lost) for k, w, lost in read], columns=["kind", *WAYS, "no_usage"])
            out.insert(0, "response_id", batch["response_id"].to_numpy())
            out.insert(1, "source", batch["source"].to_numpy())
            yield out

    evidence = materialised(rows.select("response_id", "source", *READS).mapInPandas(run, f"response_id {kind}, source string, {EVIDENCE}"))
    return evidence.select("response_id", "source", posterior_column(counted_shares(evidence)).alias("cut"))


def truncated(calls: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``response_id`` of the answers whose end is missing."""
    return truncation(calls).filter(F.col("cut") >= cutoff).select("response_id")


def rates(calls: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per source: answers, answers whose end is missing, and their share."""
    cut = F.count_if(F.col("cut") >= cutoff)
    return truncation(calls).groupBy("source").agg(F.count("*").alias("n_answers"), cut.alias("n_truncated"), (cut / F.count("*")).alias("share"))
