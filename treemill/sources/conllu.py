"""CoNLL-U files as one row per sentence.

Sentences are split by the reader itself at blank lines, so a large file is read in
parallel; their lines are taken apart by array functions.  Ranges of multi-word tokens
and empty nodes are no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treemill.operators import integrity

FULL = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel")
SHORT = ("id", "form", "upos", "head", "deprel")
# fixed values: columns of the format
UNICODE_BREAKS = "\r?\n|[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_COLUMN = {"id": 0, "form": 1, "lemma": 2, "upos": 3, "xpos": 4, "feats": 5, "head": 6, "deprel": 7}


def _comment(lines: Column, name: str, prefix: bool = False) -> Column:
    """Value of the last comment of this name; with ``prefix`` a longer name counts too, as ``text_en`` for ``text``."""
    pattern = rf"^#\s*{name}{'[^=]*' if prefix else ''}\s*=\s*(.*)$"
    found = F.filter(lines, lambda x: x.rlike(pattern))
    return F.regexp_extract(F.try_element_at(found, F.lit(-1)), pattern, 1)


def read(spark: SparkSession, path: str, fields: tuple[str, ...] = FULL, require_text: bool = False, text_prefix: bool = False, line_end: str = "\n", breaks: str = "\r?\n") -> DataFrame:
    """``sent_id, text, tokens`` of every block with a word.

    ``require_text`` drops sentences without a text; ``text_prefix`` lets a later
    ``# text_en`` override the text.  Heads that are no integers are null.  A file without
    a blank line at its end, repeated blank lines and blanks at line ends are read as usual.
    """
    blocks = spark.read.text(path, lineSep=line_end * 2)
    lines = F.transform(F.split(F.col("value"), breaks), lambda x: F.regexp_replace(x, r"[ \r]+$", ""))
    rows = blocks.select(lines.alias("lines"))
    words = F.filter(F.transform("lines", lambda x: F.split(x, "\t")), lambda c: (F.size(c) >= 10) & F.get(c, F.lit(0)).rlike("^[0-9]+$"))

    def token(c: Column) -> Column:
        value = lambda f: F.get(c, F.lit(_COLUMN[f]))
        return F.struct(*[(value(f).try_cast("int") if f in ("id", "head") else value(f)).alias(f) for f in fields])

    out = rows.select(_comment(F.col("lines"), "sent_id").alias("sent_id"), _comment(F.col("lines"), "text", text_prefix).alias("text"), F.transform(words, token).alias("tokens"))
    out = out.filter(F.size("tokens") > 0)
    return out.filter("text is not null and text <> ''") if require_text else out


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold sentences, whose ids must be there and unique; else an error.

    Lines also end at the other line breaks of Unicode, as texts of gold files may hold them.
    """
    out = read(spark, path, breaks=UNICODE_BREAKS)
    integrity.assert_empty(repeated_ids(out), "sentence ids must be unique and not empty")
    return out


def tags(sentences: DataFrame) -> DataFrame:
    """``sent_id, text, tags``: the parts of speech in order, for retrieval."""
    return sentences.select("sent_id", "text", F.transform("tokens", lambda t: t["upos"]).alias("tags"))


def statistics(sentences: DataFrame, *by: str) -> DataFrame:
    """Sentences, words, punctuation and other words."""
    punct = F.size(F.filter("tokens", lambda t: t["upos"] == "PUNCT"))
    return sentences.groupBy(*by).agg(
        F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words"), F.sum(punct).alias("punct"), F.sum(F.size("tokens") - punct).alias("non_punct")
    )


def repeated_ids(sentences: DataFrame) -> DataFrame:
    """Sentence ids that are missing or occur more than once; gold needs this to be empty."""
    return sentences.groupBy("sent_id").agg(F.count("*").alias("n")).filter("n > 1 or sent_id is null or sent_id = ''")


def sentence_ids(spark: SparkSession, path: str) -> DataFrame:
    """Only the sentence ids of a file, in one pass over its lines."""
    return spark.read.text(path).filter(F.col("value").startswith("# sent_id")).select(F.trim(F.split("value", "=", 2)[1]).alias("sent_id"))
