"""Statistics, retrieval, demonstrations, prompts, answers, tracker and integrity."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill.functions import text as tx
from treemill.operators import answers, demos, integrity, prompts, retrieval, stats, tracker
from treemill.plans.stats_queries import number

TOKEN = "struct<id:int,form:string,upos:string,head:int,deprel:string>"


def test_holm_with_ties_and_cap(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.03), ("e", 0.9)], "name string, p double").withColumn("f", F.lit(1))
    got = {r.name: round(r.holm, 6) for r in stats.holm(rows, "p", "name", "f").collect()}
    assert got == {"a": 0.05, "c": 0.12, "d": 0.12, "b": 0.12, "e": 0.9}


def test_bootstrap_is_paired_and_reproducible(spark):
    rows = number(spark.createDataFrame([(f"s{n:02d}", n % 5, n % 5, n % 3) for n in range(40)], "k string, a long, b long, c long"), "k")
    assert sorted((r.i, r.k) for r in rows.collect()) == [(n, f"s{n:02d}") for n in range(40)]
    w = stats.weights(rows, 30, 7).groupBy("b").agg(F.sum("w").alias("n")).collect()
    assert {r.n for r in w} == {40} and len(w) == 30
    sums = stats.resample_sums(rows, ["a", "b", "c"], 30, 7)
    got = {(r.first, r.second): r for r in stats.two_sided(stats.pair_differences(sums, ["a", "b", "c"])).collect()}
    assert got["a", "b"].p == 1.0 and got["a", "b"].at_or_below == 30 and got["a", "c"].p < 0.5
    raw = {(r.first, r.second): r.p for r in stats.two_sided(stats.pair_differences(sums, ["a", "b", "c"]), "raw").collect()}
    assert raw["a", "b"] == 1.0 and raw["a", "c"] < got["a", "c"].p


def test_sample_takes_the_harder_half(spark):
    rows = spark.createDataFrame([(n, n / 100) for n in range(100)], "id int, las double")
    got = [r.id for r in stats.harder_half_sample(rows, "las", "id", 10, 42).collect()]
    assert len(got) == 10 and max(got) < 50 and got == [r.id for r in stats.harder_half_sample(rows, "las", "id", 10, 42).collect()]


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = vectors[3]
    data = [(n, f"t{n % 40}", [float(x) for x in v]) for n, v in enumerate(vectors)] + [(60, "zero", [0.0] * 8), (61, "null", None)]
    pool = spark.createDataFrame(data, "id long, text string, v array<double>")
    got = retrieval.top_similar(retrieval.unit_rows(pool.filter("id < 5"), "id", "text", "v"), retrieval.unit_rows(pool, "id", "text", "v"), 3, False)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(5):
        close, seen, want = np.round(unit @ unit[q], 9), {f"t{q % 40}"}, []
        for n in sorted(range(60), key=lambda n: (-close[n], n)):
            if f"t{n % 40}" not in seen:
                seen.add(f"t{n % 40}")
                want.append(n)
        assert [r.key for r in got.filter(F.col("query") == q).orderBy("place").collect()] == want[:3]


def test_window_and_its_fallback(spark):
    schema = "key string, text string, size int, vec binary"
    v = lambda *x: np.array(x, dtype=float).tobytes()
    pool = spark.createDataFrame([("a", "a", 10, v(1, 0)), ("b", "b", 40, v(0.6, 0.8))], schema)
    asks = spark.createDataFrame([("q", "q", 12, v(0, 1)), ("r", "r", 200, v(0, 1))], schema)
    got = {(r.query, r.place): r.key for r in retrieval.top_similar(asks, pool, 2, True).collect()}
    assert got == {("q", 1): "a", ("r", 1): "b", ("r", 2): "a"}


def test_signature():
    v = retrieval.signature(["DET", "NOUN"], {"DET": 0, "NOUN": 1}, {"DET NOUN": 0})
    raw = np.array([2 / 12 * 0.2, 0, 0, 0, 0, 0.15, 0.15, 0.4, 0.05, 0, 0, 0])
    assert np.allclose(v, raw / np.linalg.norm(raw)) and not retrieval.signature([], {"DET": 0}, {}).any()


def test_trio_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["nsubj", "obj", "obl", "det", "advmod", "amod", "compound", "case"]
    data = [(f"s{n:02d}", sorted(rng.sample(labels, rng.randint(1, 4))), rng.random() < 0.8) for n in range(25)]
    got = demos.best_trio(spark.createDataFrame(data, "sent_id string, hits array<string>, passes boolean")).collect()[0]
    order = sorted((x for x in data if x[2]), key=lambda x: (-len(x[1]), x[0]))
    best = max(itertools.combinations(order, 3), key=lambda c: len(set().union(*[x[1] for x in c])))
    assert (got.covered, got.first, got.second, got.third) == (len(set().union(*[x[1] for x in best])), *[x[0] for x in best])


def test_prompt_building_equals_json(spark):
    gold = [(1, 'caf"é\\', "NOUN", 0, "root"), (2, "🎉\t", "X", 1, "dep")]
    df = spark.createDataFrame([("A \"text\"", gold)], f"text string, gold array<{TOKEN}>")
    got = df.select(prompts.demonstration(F.col("text"), F.col("gold")).alias("d"), prompts.critique_message(F.col("text"), F.col("gold"), F.col("gold")).alias("c"), prompts.short_critique_message(F.col("text"), F.slice("gold", 1, 0)).alias("s")).collect()[0]
    tokens = [dict(zip(answers.FIELDS, t)) for t in gold]
    lines = "\n".join(f"{t[0]}\t{t[1]}" for t in gold)
    assert got.d == f'Input:\n# text = A "text"\n{lines}\n\nOutput:\n' + json.dumps({"tokens": tokens}, ensure_ascii=False, indent=2)
    assert got.c == f'Sentence: A "text"\n\nTokens:\n{lines}\n\nExisting parse:\n' + json.dumps({"tokens": tokens}, indent=2)
    assert got.s == '# text = A "text"\n\nExisting parse:\n' + json.dumps({"tokens": []}, indent=2)


def test_demonstrations_of_a_system_message():
    block = 'Input:\n# text = a\n1\ta\n\nOutput:\n{"tokens": []}'
    good = "base\n\n" + "\n\n".join([block] * 3)
    assert prompts.valid_demonstrations(good, "base")
    for bad in (None, "", "base", good + "\n\n" + block, good.replace("base", "other", 1), good.replace("tokens", "words"), good + "x", good.replace("Output", "Out")):
        assert not prompts.valid_demonstrations(bad, "base")


def test_assembled_messages_keep_the_order(spark):
    found = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a")], "query string, place int, key string")
    pool = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, block string")
    assert prompts.assembled(found, pool, "base").collect()[0].system == "base\n\nA\n\nB"


@pytest.mark.parametrize(
    "raw, status, tokens",
    [
        (None, "empty", None), ("  \n", "empty", None), ("no braces", "no_json", None), ('{"tokens": [', "decode_error", None), ('{"tokens": []} trailing', "decode_error", None),
        ('{"words": []}', "schema_error", None), ('{"tokens": 3}', "schema_error", None), ('{"tokens": [3]}', "schema_error", None), ('think {"tokens": []}', "parsed", 0),
        ('{"tokens": [{"id": "1_0", "form": 3, "upos": "X", "head": 1.0, "deprel": null}]}', "parsed", 1), ('{"tokens": [{"id": true, "form": "a", "upos": "X", "head": " 2 ", "deprel": "d"}]}', "parsed", 1),
        ('{"tokens": [{"id": 1.5, "form": "a", "upos": "X", "head": 0, "deprel": "d"}]}', "schema_error", None), ('{"tokens": [{"id": 1, "form": "a", "upos": "X", "head": 0}]}', "schema_error", None),
    ],
)
def test_answers(raw, status, tokens):
    got = answers.parse_answer(raw)
    assert got[0] == status and (None if got[1] is None else len(got[1])) == tokens


def test_answers_in_batches(spark):
    df = spark.createDataFrame([(1, "why {\"tokens\": []}", None), (2, None, "timeout"), (3, "\xa0{}", "")], "k int, raw string, err string")
    assert sorted((r.k, r.status) for r in answers.routed(df, "k", "raw", "err").collect()) == [(1, "parsed"), (2, "api_error"), (3, "schema_error")]
    got = df.select("k", answers.json_part(F.col("raw")).alias("j"), answers.reasoning_part(F.col("raw")).alias("r")).orderBy("k").collect()
    assert [(r.j, r.r) for r in got] == [('{"tokens": []}', "why"), (None, None), ("{}", None)]


def test_tracker(spark):
    t = spark.createDataFrame([("a", " pending"), ("b", "DONE"), ("c", None), ("d", "Pending "), ("a", "PENDING")], "sent_id string, experiment1_status string")
    source, done = spark.createDataFrame([("a",), ("d",)], "sent_id string"), spark.createDataFrame([("d",)], "sent_id string")
    assert [r.sent_id for r in tracker.backlog(t, "experiment1_status", source, done).collect()] == ["a"]
    results = spark.createDataFrame([("a", "FAIL"), ("a", "DONE"), ("c", "FAIL")], "sent_id string, status string")
    assert sorted((r.sent_id, r.experiment1_status) for r in tracker.updated(t, "experiment1_status", results).collect()) == [("a", "DONE"), ("a", "DONE"), ("b", "DONE"), ("c", "FAIL"), ("d", "Pending ")]
    assert tracker.initial(source, 2).columns == ["sent_id", "experiment1_status", "experiment2_status"]
    with pytest.raises(Exception, match="unique"):
        tracker.initial(source.union(source)).collect()


def test_integrity(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "k int, v string"), spark.createDataFrame([(2, None), (3, "z"), (1, "w")], "k int, v string")
    assert sorted((r.k, r.side) for r in integrity.key_difference(a, b, "k").collect()) == [(3, "second")]
    assert [r.k for r in integrity.unequal(a, b, "k", "v").collect()] == [1]
    integrity.assert_empty(a.filter("k > 5"), "none")
    with pytest.raises(AssertionError, match="some"):
        integrity.assert_empty(a, "some")


def test_text_functions(spark):
    df = spark.createDataFrame([("  a_b & 5% #\xa0", 0.12345, 0.00001)], "t string, x double, p double")
    got = df.select(tx.strip(F.col("t")).alias("s"), tx.latex(F.col("t")).alias("l"), tx.percent(F.col("x")).alias("x"), tx.p_value(F.col("p")).alias("p")).collect()[0]
    assert got.s == "a_b & 5% #" and r"a\_b \& 5\% \#" in got.l and got.x == "12.35" and got.p == "<0.0001"


def test_injected_models(spark):
    from treemill.operators import annotators

    df = spark.createDataFrame([(1, "The cat quickly jumped over 3 walls ."), (2, None)], "k int, t string")
    got = {r.key: r.tags for r in annotators.tagged(df, "k", "t").collect()}
    assert got == {1: ["DET", "NOUN", "ADV", "VERB", "ADP", "NUM", "NOUN", "PUNCT"], 2: []}
    vectors = annotators.encoded(df, "k", "t", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert sorted((r.key, list(r.vectors)) for r in vectors) == [(1, [37.0, 1.0]), (2, [0.0, 1.0])]
