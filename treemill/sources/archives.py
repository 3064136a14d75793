"""JSON archives of answers and evaluations, trackers, prompts, caches and raw files."""

from __future__ import annotations

import gzip
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from treemill.functions import text as tx

_GOLD = "array<struct<id:int,form:string,lemma:string,upos:string,xpos:string,feats:string,head:int,deprel:string>>"
_PARSE = "array<struct<id:int,form:string,upos:string,head:int,deprel:string>>"
#: Schema of an evaluation archive; given, since inference drops columns that are always null.
EVALUATIONS = (
    f"sent_id string, text string, timestamp string, gold {_GOLD}, llm_parse {_PARSE}, uas double, las double, exclude_punct boolean, "
    "token_errors array<struct<token_id:int,form:string,gold_upos:string,gold_head:int,gold_deprel:string,pred_head:int,pred_deprel:string,error_type:string>>, "
    "structural_warnings array<string>, cot_reasoning string, validation_error string, api_error string"
)
RESPONSES = (
    "sent_id string, text string, experiment string, run_id string, few_shot_k int, retrieval_method string, timestamp string, model_config map<string,string>, "
    "prompt struct<system:string,user:string>, raw_response string, reasoning_content string, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, "
    f"api_error string, api_success boolean, source_experiment string, source_uas double, source_las double, gold {_GOLD}"
)


def read_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file, or a folder or pattern of files, each one JSON array; ``.json.gz`` reads the same.

    Where the plain path does not exist but its gzipped twin does, that is read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if "*" not in path and not path.endswith(".gz") and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        path += ".gz"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """A tracker CSV with its header; every column text."""
    return spark.read.csv(path, header=True)


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """``path, prompt, sha256`` of whole prompt files without white space at their ends."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", tx.strip(F.col("value")).alias("prompt"), F.sha2("value", 256).alias("sha256"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as bytes, for manifests.  A symbolic link in a local folder is an error: its target could change unseen."""
    local = folder.removeprefix("file://")
    if os.path.isdir(local):
        linked = [os.path.join(at, name) for at, folders, names in os.walk(local) for name in (*folders, *names) if os.path.islink(os.path.join(at, name))]
        if linked:
            raise ValueError(f"symbolic links are not followed: {sorted(linked)[0]}")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def unzipped(files: DataFrame) -> DataFrame:
    """The same with gzipped contents unpacked, a file at a time."""
    @F.pandas_udf("binary")
    def unpack(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([gzip.decompress(c) if c is not None and n.endswith(".gz") else c for n, c in zip(names, contents)])

    return files.withColumn("content", unpack("path", "content")).withColumn("length", F.length("content").cast("long"))


def cached(spark: SparkSession, path: str, model: str, build) -> DataFrame:
    """A Parquet cache of a computed table, rebuilt where it is missing, unreadable or of another model."""
    try:
        rows = spark.read.parquet(path)
        first = rows.select("model").first()
        if first is not None and first.model == model:
            return rows.drop("model")
    except Exception:  # noqa: BLE001  any failure to read means: build it again
        pass
    build().withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("model")
