"""Queries of the training-data problems, and SQL where it can say the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treemill.llm import encoding, leakage, neighbours, overlap, pairs, quality, truncation, validation
from treemill.plans.session import table


# -- problem 1 ----------------------------------------------------------------
def _side() -> Column:
    return F.when(F.col("split") == "train", 0).when(F.col("split").isin("dev", "test"), 1)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a training sentence and an equal or almost equal held-out one."""
    found = overlap.cross_split_pairs(table(spark, sf_dir, "treebank_sentences"), "sent_key", "text", _side())
    return found.select(F.col("key_a").alias("sent_key_a"), F.col("key_b").alias("sent_key_b"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlapping sentence with its class of equal texts and its number of partners."""
    return overlap.partners(table(spark, sf_dir, "treebank_sentences"), "sent_key", "text", _side()).withColumnRenamed("key", "sent_key")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs, and rows with a partner, per split and source."""
    sentences = table(spark, sf_dir, "treebank_sentences")
    rows = sentences.select(F.col("sent_key").alias("key"), "split", F.split("sent_id", "-")[0].alias("source"))
    counted = overlap.partners(sentences, "sent_key", "text", _side())
    return counted.join(rows, "key").groupBy("split", "source").agg(F.sum("n_partners").alias("n_pairs"), F.count("*").alias("n_rows"))


# -- problem 2 ----------------------------------------------------------------
def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "model_responses"), table(spark, sf_dir, "model_evaluation"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective calls with each of their defects."""
    return _defects(spark, sf_dir).select("response_id", "defect")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects per experiment."""
    calls = table(spark, sf_dir, "model_responses").select("response_id", "experiment")
    return _defects(spark, sf_dir).join(calls, "response_id").groupBy("experiment", "defect").agg(F.count("*").alias("n_calls"))


def p2_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of each defect on labelled calls made from whole ones, and the cutoffs that would be best there."""
    rows = validation.validated(table(spark, sf_dir, "model_responses"), table(spark, sf_dir, "model_evaluation"))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "defect string, n_true int, best_from double, best_to double, cutoff double, precision double, recall double")


# -- problem 3 ----------------------------------------------------------------
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.response_calls(table(spark, sf_dir, "model_responses"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of which the end is missing."""
    return truncation.truncated(_calls(spark, sf_dir))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut answers per source."""
    return truncation.rates(_calls(spark, sf_dir))


# -- problem 5 ----------------------------------------------------------------
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pool rows that are among each other's ten most similar, with a cosine of at least 0.9."""
    near = neighbours.nearest(table(spark, sf_dir, "train_pool"), "pool_id", "vectors", all_copies=False)
    return neighbours.mutual(near).select(F.col("id_a").alias("pool_id_a"), F.col("id_b").alias("pool_id_b"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every pool row whose id is divisible by 100 the ten most similar rows, against all rows."""
    near = neighbours.nearest(table(spark, sf_dir, "train_pool"), "pool_id", "vectors", least=None, factor=3.0, asking="id % 100 = 0")
    return near.select("query", "other", F.round("cosine", 6).alias("cosine"))


# -- problem 6 ----------------------------------------------------------------
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text by byte_bpe_50k."""
    return encoding.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of each document, and whether decoding restores its text."""
    return encoding.roundtrip(table(spark, sf_dir, "documents"), "doc_id", "text")


# -- problem 7 ----------------------------------------------------------------
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items of which they hold 13 consecutive words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the original text each leaked passage stands."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text", spans=True)


# -- problem 8 ----------------------------------------------------------------
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk rather than prose."""
    return quality.not_prose(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line, symbol and common-word figures of every document."""
    return quality.document_figures(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_links": p1_links, "p1_report": p1_report,
    "p2_found": p2_found, "p2_report": p2_report, "p2_validation": p2_validation,
    "p3_found": p3_found, "p3_rates": p3_rates,
    "p5_found": p5_found, "p5_neighbours": p5_neighbours,
    "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found, "p7_spans": p7_spans,
    "p8_found": p8_found, "p8_figures": p8_figures,
}

def _words_sql(text: str) -> str:
    """The words of a text, as an SQL list: compatibility decomposition by translating every character that stands for one other, and ligatures."""
    return f"regexp_extract_all(regexp_replace(lower(strip_accents(replace(replace(translate({text}, '{_FROM}', '{_TO}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))), '[\\p{{M}}\\p{{Cf}}]+', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


#: Characters whose compatibility decomposition is one letter or digit of ASCII, and that one.
_SAME = [(chr(c), d) for c in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)] if len(d := unicodedata.normalize("NFKD", chr(c))) == 1 and d.isascii() and d.isalnum()]
_FROM, _TO = "".join(a for a, _ in _SAME), "".join(b for _, b in _SAME)

_P1 = f"""WITH w AS (SELECT sent_key, split, split_part(sent_id, '-', 1) AS source, {_words_sql('text')} AS w FROM treebank_sentences WHERE split IN ('train', 'dev', 'test')),
  s AS MATERIALIZED (SELECT sent_key, split, source, array_to_string(w, '') AS s FROM w WHERE len(w) >= 6),
  p AS (SELECT a.sent_key AS x, b.sent_key AS y FROM s a JOIN s b ON a.split = 'train' AND b.split <> 'train' AND abs(length(a.s) - length(b.s)) <= greatest(length(a.s), length(b.s)) // 10
    AND CASE WHEN a.s = b.s THEN TRUE ELSE levenshtein(a.s, b.s) <= greatest(length(a.s), length(b.s)) // 10 END)"""
_P7 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents), i AS (SELECT item_id, {_words_sql('text')} AS w FROM eval_items),
  dw AS (SELECT r, doc_id, array_to_string(w[k + 1 : k + 13], ' ') AS run FROM (SELECT r, doc_id, w, unnest(range(len(w) - 12)) AS k FROM d WHERE len(w) >= 13)),
  iw AS (SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + 13], ' ') AS run FROM (SELECT item_id, w, unnest(range(len(w) - 12)) AS k FROM i WHERE len(w) >= 13))"""

#: Brute force over all pairs, and over all runs of 13 words; of the pool only the pairs with a high cosine can be mutual.
SQL: dict[str, str] = {
    "p1_found": f"{_P1} SELECT least(x, y) AS sent_key_a, greatest(x, y) AS sent_key_b FROM p",
    "p1_report": f"{_P1}, e AS (SELECT x AS k FROM p UNION ALL SELECT y FROM p), n AS (SELECT k, count(*) AS n FROM e GROUP BY 1) "
    "SELECT split, source, CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_rows FROM n JOIN s ON s.sent_key = n.k GROUP BY 1, 2",
    "p1_links": f"{_P1}, e AS (SELECT x AS k FROM p UNION ALL SELECT y FROM p), n AS (SELECT k, count(*) AS n_partners FROM e GROUP BY 1), c AS (SELECT s, min(sent_key) AS class_id FROM s GROUP BY 1) "
    "SELECT s.sent_key, c.class_id, n.n_partners FROM n JOIN s ON s.sent_key = n.k JOIN c ON c.s = s.s",
    "p7_found": f"{_P7} SELECT doc_id, item_id FROM (SELECT DISTINCT r, doc_id, item_id FROM dw JOIN iw USING (run))",
    "p5_found": """WITH p AS (SELECT pool_id, CAST(vectors AS DOUBLE[]) AS v FROM train_pool WHERE len(list_filter(vectors, lambda x: x <> 0)) > 0),
      c AS (SELECT a.pool_id AS x, b.pool_id AS y, list_cosine_similarity(a.v, b.v) AS cosine FROM p a JOIN p b ON a.pool_id <> b.pool_id AND len(a.v) = len(b.v)),
      k AS (SELECT x, y FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS place FROM c WHERE cosine >= 0.9) WHERE place <= 10)
      SELECT k.x AS pool_id_a, k.y AS pool_id_b FROM k JOIN k m ON m.x = k.y AND m.y = k.x WHERE k.x < k.y""",
}
