"""Tag vocabularies, signatures, similar sentences and demonstrations, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from treemill.functions import tokens as tok
from treemill.operators import demos, retrieval, scoring
from treemill.plans.session import cut, table


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sent_id, text, gold, tags`` of each sentence's first evaluation with gold."""
    order = W.partitionBy("sent_id").orderBy("eval_id")
    rows = table(spark, sf_dir, "model_evaluation").filter("size(gold.id) > 0 and sent_id is not null").select("sent_id", "text", "eval_id", tok.slim("gold").alias("gold"))
    rows = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    return rows.withColumn("tags", F.transform("gold", lambda t: t["upos"]))


def pos_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tags, numbered."""
    return retrieval.vocabulary(_sentences(spark, sf_dir), F.col("tags"), "tag")


def bigram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of neighbouring tags, numbered."""
    return retrieval.vocabulary(_sentences(spark, sf_dir), F.col("tags"), "bigram")


def pos_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and tag pairs of each sentence, counted."""
    s = _sentences(spark, sf_dir)
    terms = F.concat(F.col("tags"), retrieval.bigrams(F.col("tags")))
    return s.select("sent_id", F.explode(terms).alias("term")).groupBy("sent_id", "term").agg(F.count("*").alias("n"))


def pos_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length features and ratios of each sentence's signature."""
    return _sentences(spark, sf_dir).select("sent_id", *[c.alias(n) for n, c in retrieval.ratios(F.col("tags")).items()])


def signature_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each sentence's signature vector that are not zero, by name."""
    pool = cut(_sentences(spark, sf_dir).select("sent_id", "text", "tags"))
    tags, pairs = retrieval.vocabularies(pool, F.col("tags"))
    return retrieval.named_entries(retrieval.signatures(pool, "sent_id", "text", "tags", tags, pairs), "sent_id", tags, pairs)


def syntactic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every evaluation whose id is divisible by 100, the three sentences of most similar tags.

    The query's tags are the predicted ones, the pool's are gold; sizes must be near.
    """
    pool = cut(_sentences(spark, sf_dir).select("sent_id", "text", "tags"))  # ranked once; the vocabularies and the signatures read it
    tags, pairs = retrieval.vocabularies(pool, F.col("tags"))
    queries = table(spark, sf_dir, "model_evaluation").filter("eval_id % 100 = 0 and size(llm_parse) > 0")
    queries = queries.select("eval_id", "text", F.transform(F.filter("llm_parse", lambda t: t["upos"].isNotNull()), lambda t: t["upos"]).alias("tags"))
    found = retrieval.top_similar(retrieval.signatures(queries, "eval_id", "text", "tags", tags, pairs), retrieval.signatures(pool, "sent_id", "text", "tags", tags, pairs), 3, True)
    return found.select(F.col("query").alias("eval_id"), "place", F.col("key").alias("sent_id"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every pool row whose id is divisible by 100, the three other sentences of most similar vectors."""
    pool = table(spark, sf_dir, "train_pool").select("pool_id", F.coalesce("sent_id", F.col("pool_id").cast("string")).alias("sent_id"), "vectors")
    queries = pool.filter("pool_id % 100 = 0")
    found = retrieval.top_similar(retrieval.unit_rows(queries, "pool_id", "sent_id", "vectors"), retrieval.unit_rows(pool, "pool_id", "sent_id", "vectors"), 3, False)
    return found.select(F.col("query").alias("query_id"), "place", F.col("key").alias("pool_id"))


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "treebank_sentences").filter("split in ('dev', 'test')").select("text")


def projectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sentence's gold tree has no crossing arcs."""
    return _sentences(spark, sf_dir).select("sent_id", tok.projective(F.col("gold")).alias("projective"))


def demo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides whether a sentence may serve as a demonstration."""
    rows = demos.candidates(_sentences(spark, sf_dir), _held_out(spark, sf_dir))
    return rows.select("sent_id", "n_tokens", "length_ok", "projective", "held_out", F.concat_ws(",", "hits").alias("hits"), F.concat_ws(",", "missed").alias("missed"), "passes")


def best_trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three eligible sentences that cover most target labels; texts of the test split are held out (gold trees are of dev and test alone)."""
    held = table(spark, sf_dir, "treebank_sentences").filter("split = 'test'").select("text")
    return demos.best_trio(demos.candidates(_sentences(spark, sf_dir), held))


def held_out_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sentences whose text is in no held-out split."""
    rows = table(spark, sf_dir, "treebank_sentences")
    out = _held_out(spark, sf_dir).select(tok.stripped(F.col("text")).alias("key"))
    train = rows.filter("split = 'train'").select("sent_key", tok.stripped(F.col("text")).alias("key"))
    return train.join(out, "key", "left_anti").select("sent_key")


QUERIES = {f.__name__: f for f in (pos_vocabulary, bigram_vocabulary, pos_frequencies, pos_signature, signature_terms, syntactic_topk, semantic_topk, projectivity, demo_candidates, best_trio, held_out_anti_join)}

_SENT = """s AS (SELECT sent_id, text, gold, list_transform(gold, lambda t: t.upos) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY eval_id) AS rk FROM model_evaluation WHERE len(gold) > 0 AND sent_id IS NOT NULL) WHERE rk = 1)"""


def _terms(source: str, key: str) -> str:
    return f"""(SELECT {key}, t AS term, 'tag' AS kind FROM (SELECT {key}, unnest(tags) AS t FROM {source}) UNION ALL
      SELECT {key}, tags[i] || ' ' || tags[i + 1], 'bigram' FROM (SELECT {key}, tags, unnest(range(1, len(tags))) AS i FROM {source}))"""


def _share(*kinds: str) -> str:
    return f"len(list_filter(tags, lambda t: t IN ({', '.join(chr(39) + k + chr(39) for k in kinds)}))) / len(tags)"


def _signature(source: str, key: str) -> str:
    n = f"(SELECT {key}, term, kind, count(*) AS c, any_value(n) AS n FROM (SELECT x.*, len(y.tags) AS n FROM {_terms(source, key)} x JOIN {source} y USING ({key})) WHERE term IN (SELECT term FROM voc) GROUP BY ALL)"
    raw = f"""SELECT {key}, kind || term AS dim, CASE kind WHEN 'tag' THEN 0.3::DOUBLE * c / n ELSE 0.4::DOUBLE * c / greatest(1, n - 1) END AS v FROM {n}
      UNION ALL SELECT {key}, unnest(['l1', 'l2', 'l3', 'l4', 'l5', 'r1', 'r2', 'r3', 'r4']), unnest([0.2::DOUBLE * len(tags) / (len(tags) + 10), 0.2::DOUBLE * {_share('PUNCT')}, 0.2::DOUBLE * {_share('VERB', 'AUX')}, 0.2::DOUBLE * {_share('CCONJ')}, 0.2::DOUBLE * {_share('SCONJ')},
        0.1::DOUBLE * {_share('NOUN')}, 0.1::DOUBLE * {_share('VERB', 'AUX')}, 0.1::DOUBLE * {_share('ADP')}, 0.1::DOUBLE * {_share('PRON')}]) FROM {source}"""
    return f"(SELECT {key}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM ({raw}) WHERE v <> 0)"


_TARGET = "[" + ", ".join(f"'{x}'" for x in sorted(tok.TARGET_LABELS)) + "]"
_CROSS = """NOT EXISTS (SELECT 1 FROM arcs x JOIN arcs y ON x.sent_id = y.sent_id AND x.a < y.a AND y.a < x.b AND x.b < y.b WHERE x.sent_id = s.sent_id)"""
_ARCS = "arcs AS (SELECT sent_id, least(g.id, g.head) AS a, greatest(g.id, g.head) AS b FROM (SELECT sent_id, unnest(gold) AS g FROM s) WHERE g.head <> 0)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _candidates(held: str) -> str:
    return f"""WITH {_SENT}, {_ARCS}, h AS (SELECT DISTINCT {_STRIP.format('text')} AS key FROM treebank_sentences WHERE {held}),
     lab AS (SELECT sent_id, list_distinct(list_transform(gold, lambda g: split_part(g.deprel, ':', 1))) AS labels FROM s),
     c AS (SELECT s.sent_id, len(list_filter(gold, lambda g: g.upos <> 'PUNCT')) AS n_tokens, {_CROSS} AS projective, {_STRIP.format('s.text')} IN (SELECT key FROM h WHERE key IS NOT NULL) AS held_out,
       list_filter({_TARGET}, lambda x: list_contains(labels, x)) AS hits, list_filter({_TARGET}, lambda x: NOT list_contains(labels, x)) AS missed FROM s JOIN lab USING (sent_id)),
     d AS (SELECT *, n_tokens BETWEEN 8 AND 15 AS length_ok, n_tokens BETWEEN 8 AND 15 AND projective AND NOT held_out AS passes FROM c)"""


SQL = {
    "pos_vocabulary": f"WITH {_SENT} SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT term FROM {_terms('s', 'sent_id')} WHERE kind = 'tag')",
    "bigram_vocabulary": f"WITH {_SENT} SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT term FROM {_terms('s', 'sent_id')} WHERE kind = 'bigram')",
    "pos_frequencies": f"WITH {_SENT} SELECT sent_id, term, count(*) AS n FROM {_terms('s', 'sent_id')} GROUP BY 1, 2",
    "pos_signature": f"WITH {_SENT} SELECT sent_id, len(tags) / (len(tags) + 10) AS length, {_share('PUNCT')} AS punct, {_share('VERB', 'AUX')} AS verb, {_share('CCONJ')} AS cconj, {_share('SCONJ')} AS sconj, {_share('NOUN')} AS noun, {_share('ADP')} AS adp, {_share('PRON')} AS pron FROM s",
    "signature_terms": f"WITH {_SENT}, voc AS (SELECT DISTINCT term FROM {_terms('s', 'sent_id')}) SELECT sent_id, dim, round(v, 9) AS value FROM {_signature('s', 'sent_id')}",
    "syntactic_topk": f"""WITH {_SENT}, voc AS (SELECT DISTINCT term FROM {_terms('s', 'sent_id')}),
        q AS (SELECT eval_id, text, list_transform(list_filter(llm_parse, lambda t: t.upos IS NOT NULL), lambda t: t.upos) AS tags FROM model_evaluation WHERE eval_id % 100 = 0 AND len(llm_parse) > 0),
        sv AS {_signature('s', 'sent_id')}, qv AS {_signature('q', 'eval_id')},
        dot AS (SELECT eval_id, sent_id, round(sum(qv.v * sv.v), 9) AS close FROM qv JOIN sv USING (dim) GROUP BY 1, 2),
        c AS (SELECT d.*, {_STRIP.format('s.text')} AS text, abs(len(s.tags) - len(q.tags)) <= greatest(3, CAST(floor(0.3 * len(q.tags)) AS INTEGER)) AS inside FROM dot d JOIN s USING (sent_id) JOIN q USING (eval_id) WHERE {_STRIP.format('s.text')} <> {_STRIP.format('q.text')}),
        w AS (SELECT *, max(CAST(inside AS INT)) OVER (PARTITION BY eval_id) AS any_in FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY eval_id, text ORDER BY close DESC, sent_id) AS again FROM w WHERE CAST(inside AS INT) = any_in)
        SELECT eval_id, CAST(place AS INTEGER) AS place, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY close DESC, sent_id) AS place FROM o WHERE again = 1) WHERE place <= 3""",
    "semantic_topk": """WITH p AS (SELECT pool_id, coalesce(sent_id, CAST(pool_id AS VARCHAR)) AS sent_id, CAST(vectors AS DOUBLE[]) AS v FROM train_pool WHERE len(list_filter(vectors, lambda x: x <> 0)) > 0),
        c AS (SELECT q.pool_id AS query_id, p.pool_id, p.sent_id, round(list_cosine_similarity(q.v, p.v), 9) AS close FROM p q JOIN p ON q.sent_id <> p.sent_id WHERE q.pool_id % 100 = 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, sent_id ORDER BY close DESC, pool_id) AS again FROM c)
        SELECT query_id, CAST(place AS INTEGER) AS place, pool_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY close DESC, pool_id) AS place FROM o WHERE again = 1) WHERE place <= 3""",
    "projectivity": f"WITH {_SENT}, {_ARCS} SELECT sent_id, {_CROSS} AS projective FROM s",
    "demo_candidates": f"{_candidates("split IN ('dev', 'test')")} SELECT sent_id, CAST(n_tokens AS INTEGER) AS n_tokens, length_ok, projective, held_out, array_to_string(hits, ',') AS hits, array_to_string(missed, ',') AS missed, passes FROM d",
    "best_trio": f"""{_candidates("split = 'test'")}, t AS (SELECT sent_id, hits, row_number() OVER (ORDER BY len(hits) DESC, sent_id) AS i FROM d WHERE passes), u AS (SELECT * FROM t WHERE i <= 80)
        SELECT CAST(len(list_distinct(list_concat(x.hits, list_concat(y.hits, z.hits)))) AS INTEGER) AS covered, array_to_string(list_filter({_TARGET}, lambda l: NOT list_contains(list_concat(x.hits, list_concat(y.hits, z.hits)), l)), ',') AS missed, x.sent_id AS first, y.sent_id AS second, z.sent_id AS third FROM u x JOIN u y ON x.i < y.i JOIN u z ON y.i < z.i ORDER BY covered DESC, x.i, y.i, z.i LIMIT 1""",
    "held_out_anti_join": f"SELECT sent_key FROM treebank_sentences WHERE split = 'train' AND text IS NOT NULL AND {_STRIP.format('text')} NOT IN (SELECT {_STRIP.format('text')} FROM treebank_sentences WHERE split IN ('dev', 'test') AND text IS NOT NULL) UNION ALL SELECT sent_key FROM treebank_sentences WHERE split = 'train' AND text IS NULL",
}
