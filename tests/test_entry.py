"""Registered queries: they exist, have stable columns, and agree with their SQL on the smallest tables."""

import ast
import glob
import math
import os
from pathlib import Path

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES) and "corpus_uas_las" in QUERIES


def test_nothing_outside_imports_the_llm_subpackage():
    for file in [*ROOT.glob("treemill/**/*.py"), ROOT / "bench.py"]:
        if "llm" in file.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("treemill.llm") for n in names), file


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return plain(value.asDict()) if hasattr(value, "asDict") else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in SQL if n.startswith(("corpus", "tree_audit", "bootstrap_pairs", "syntactic", "prompt_blocks", "p4_found", "best_trio", "tracker_states"))])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(file).stem} AS SELECT * FROM read_parquet('{file}')")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(repr([plain(dict(zip(columns, r))[c]) for c in sorted(columns)]) for r in found.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["model_ord", "cond_ord", "total", "uas_correct", "las_correct", "uas", "las"]
