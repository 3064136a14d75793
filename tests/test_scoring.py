"""Scoring on a sentence of five tokens, and the cases at the edges."""

import pytest
from pyspark.sql import functions as F

from treemill.functions import tokens as tok
from treemill.operators import scoring, trees

GOLD = [(1, "Heavy", "ADJ", 2, "amod"), (2, "rain", "NOUN", 4, "nsubj"), (3, "soon", "ADV", 4, "advmod"), (4, "stopped", "VERB", 0, "root"), (5, "!", "PUNCT", 4, "punct")]
#: A wrong label, a wrong head, both wrong, a right root.
ERRORS = [(1, "Heavy", "ADJ", 2, "det"), (2, "rain", "NOUN", 0, "nsubj"), (3, "soon", "ADV", 2, "obj"), (4, "stopped", "VERB", 0, "root"), (5, "!", "PUNCT", 4, "punct")]
TOKEN = "struct<id:int,form:string,upos:string,head:int,deprel:string>"
SCHEMA = f"model_ord int, cond_ord int, sent_id string, gold array<{TOKEN}>, llm_parse array<{TOKEN}>"


def rows(spark, *cases):
    return spark.createDataFrame([(0, 0, f"email-{n}", gold, parse) for n, (gold, parse) in enumerate(cases)], SCHEMA)


def first(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize(
    "parse, uas, las",
    [
        (GOLD, 4, 4), (ERRORS, 2, 1), (None, 0, 0), ([], 0, 0), ([*GOLD[:3], None], 3, 3),
        ([*GOLD, (4, "stopped", "VERB", 1, "root")], 3, 3),  # the last of a repeated id wins
        ([(i, f, u, h, d.upper()) for i, f, u, h, d in GOLD], 4, 4), ([(i, f, u, None, None) for i, f, u, h, d in GOLD], 0, 0), ([(None, f, u, h, d) for i, f, u, h, d in GOLD], 0, 0),
    ],
)
def test_scores(spark, parse, uas, las):
    got = first(scoring.accuracy(scoring.facts(rows(spark, (GOLD, parse)), "sent_id"), "sent_id"))
    assert (got["total"], got["uas_correct"], got["las_correct"]) == (4, uas, las)
    n = first(scoring.sentence_counts(rows(spark, (GOLD, parse)), "sent_id"))
    assert (n["n_tokens"], n["uas_correct"], n["las_correct"]) == (4, uas, las)


def test_only_punctuation_scores_nothing(spark):
    assert scoring.facts(rows(spark, ([GOLD[4]], GOLD)), "sent_id").count() == 0
    assert first(scoring.sentence_counts(rows(spark, ([GOLD[4]], GOLD)), "sent_id"))["n_tokens"] == 0


def test_error_types(spark):
    parse = [ERRORS[0], (2, "rain", "NOUN", 1, "nsubj"), (3, "soon", "ADV", 1, "dep")]
    kinds = rows(spark, (GOLD, parse)).select(F.transform(tok.token_facts(tok.scored(F.col("gold")), F.col("llm_parse")), tok.error_type).alias("k"))
    assert first(kinds)["k"] == ["deprel_only", "head_only", "head_and_deprel", "missing_token"]


def test_precision_recall(spark):
    got = {r.label: r for r in scoring.precision_recall(scoring.facts(rows(spark, (GOLD, ERRORS)), "sent_id")).collect()}
    assert (got["amod"].tp, got["amod"].fn, got["amod"].recall) == (0, 1, 0.0)
    assert (got["nsubj"].tp, got["nsubj"].fp, got["nsubj"].fn) == (0, 1, 1)
    assert got["root"].f1 == 1.0 and (got["det"].fp, got["obj"].fp) == (1, 1)


def test_confusions_and_top(spark):
    got = scoring.confusions(scoring.facts(rows(spark, (GOLD, ERRORS)), "sent_id"), 1, "sent_id").collect()
    assert [(r.gold_label, r.pred_label, r.n) for r in got] == [("amod", "det", 1)]


@pytest.mark.parametrize(
    "parse, flags",
    [
        (GOLD, (1, 1, 1, 1, 1, 1, 1)), (None, (0, 0, 0, 0, 0, 0, 0)), ([], (1, 0, 0, 1, 1, 0, 0)),
        (ERRORS, (1, 1, 0, 1, 1, 0, 0)), ([*GOLD[:4], (5, "!", "PUNCT", 5, "punct")], (1, 1, 1, 1, 0, 0, 0)),
        ([GOLD[0], (2, "rain", "NOUN", 1, "nsubj"), *GOLD[2:]], (1, 1, 1, 1, 1, 0, 0)), ([*GOLD[:4], (5, "!", "PUNCT", 9, "punct")], (1, 1, 1, 0, 1, 0, 0)),
        ([*GOLD, GOLD[4]], (1, 0, 1, 1, 1, 0, 0)), ([*GOLD[:4], (5, "!", "PUNCT", None, "punct")], (1, 1, 1, 0, 1, 0, 0)), ([*GOLD, None], (1, 1, 1, 0, 0, 0, 0)),
    ],
)
def test_audit(spark, parse, flags):
    got = first(trees.audit(rows(spark, (GOLD, parse)), "sent_id"))
    assert tuple(int(got[f]) for f in trees.FLAGS) == flags


def test_long_chains_reach_the_root(spark):
    chain = [(n, "w", "X", n - 1, "dep") for n in range(1, 3_001)]
    broken = [*chain[:2_000], (2_001, "w", "X", 3_000, "dep"), *chain[2_001:]]
    got = rows(spark, (chain, None), (broken, None), (GOLD, None), ([], None)).orderBy("sent_id").select(tok.reaches_root(F.col("gold")).alias("r")).collect()
    assert [r.r for r in got] == [True, False, True, True]


def test_root_warnings(spark):
    none = [(i, f, u, 1, d) for i, f, u, h, d in GOLD]
    got = rows(spark, (GOLD, GOLD), (GOLD, none), (GOLD, ERRORS), (GOLD, None)).orderBy("sent_id").select(trees.root_warnings(F.col("llm_parse")).alias("w")).collect()
    assert [r.w for r in got] == [[], ["no_root"], ["multiple_roots: tokens [2, 4]"], []]


def test_alignment_and_denominators(spark):
    systems = spark.createDataFrame([(0, 0), (0, 1)], "model_ord int, cond_ord int")
    reference = spark.createDataFrame([("email-0", GOLD), ("email-1", GOLD)], f"sent_id string, gold array<{TOKEN}>")
    have = rows(spark, (GOLD, GOLD), (GOLD, None))
    zero = {(r.model_ord, r.cond_ord): (r.total, r.las_correct) for r in scoring.accuracy(scoring.facts(scoring.aligned(reference, systems, have), *scoring.SYSTEM), *scoring.SYSTEM).collect()}
    assert zero == {(0, 0): (8, 4), (0, 1): (8, 0)}
    assert scoring.aligned(reference, systems, have, "exclude").count() == 1


def test_churn_and_differences(spark):
    pair = rows(spark, (GOLD, ERRORS)).select("model_ord", "sent_id", "gold", F.col("llm_parse").alias("first")).withColumn("second", F.col("gold"))
    got = first(scoring.churn(pair, "model_ord"))
    assert (got["sentences"], got["tokens"], got["wrong_to_correct"], got["correct_to_wrong"], got["net"]) == (1, 4, 3, 0, 3)
    assert [r.id for r in scoring.differences(pair, 2, "sent_id").collect()] == [1, 2]


def test_pairs_of_conditions(spark):
    schema = f"model_ord int, cond_ord int, sent_id string, llm_parse array<{TOKEN}>, evaluated_at int, eval_id long"
    records = [(0, 4, "a", ERRORS, 1, 1), (0, 4, "a", GOLD, 2, 2), (0, 5, "a", ERRORS, 1, 3), (0, 4, "b", GOLD, 1, 4), (0, 5, "b", None, 1, 5), (1, 4, "a", GOLD, 1, 6), (0, 3, "a", GOLD, 1, 7), (0, 4, None, GOLD, 1, 8), (0, 5, None, GOLD, 1, 9), (0, 4, "x", GOLD, 1, 10), (0, 5, "x", GOLD, 1, 11)]
    reference = spark.createDataFrame([("a", GOLD), ("b", GOLD)], f"sent_id string, gold array<{TOKEN}>")
    got = scoring.paired(reference, spark.createDataFrame(records, schema), 4, 5).collect()
    assert [(r.model_ord, r.sent_id, [tuple(t) for t in r.first], [tuple(t) for t in r.second]) for r in got] == [(0, "a", GOLD, ERRORS)]


def test_bins_are_complete(spark):
    counted = spark.createDataFrame([(0, "1-10", 3)], "g int, bin string, n long")
    got = scoring.with_all(counted, "bin", tuple(b[0] for b in tok.LENGTH_BINS), ("n",), "g").collect()
    assert {r.bin: r.n for r in got} == {"1-10": 3, "11-20": 0, "21-30": 0, "31-50": 0, "51+": 0}


def test_projectivity(spark):
    crossing = [(1, "a", "X", 3, "d"), (2, "b", "X", 4, "d"), (3, "c", "X", 0, "root"), (4, "d", "X", 3, "d")]
    got = rows(spark, (GOLD, None), (crossing, None), ([], None)).orderBy("sent_id").select(tok.projective(F.col("gold")).alias("p")).collect()
    assert [r.p for r in got] == [True, False, True]
