"""Subtype tables of all variants hold the whole relation."""

import os

import pytest

from treemill.operators import nested
from treemill.operators.nested import Relation
from treemill.plans import nested_queries as nq

DATA = "/root/testdata/sf0.001"
SCHEMA = "k long, arr array<struct<pos:string,n:int,hops:array<struct<ms:double>>>>, opt struct<a:int,b:struct<c:int>>"
ROWS = [(1, [("p", 1, [(0.5,)]), None, (None, None, None), ("q", 3, [])], (1, (None,))), (2, None, (None, None)), (3, [("r", None, None)], None)]


def test_tables_of_all_variants_add_up(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    arr = nested.flatten(df, "k", Relation("arr"))
    at = nested.write_subtypes(arr, str(tmp_path / "arr"))
    assert set(at) == {"(11@(1))", "(000)", "(11e)", "(100)"}
    tables = {state: spark.read.parquet(folder) for state, folder in at.items()}
    assert sum(t.count() for t in tables.values()) == arr.count() == 4
    assert tables["(100)"].columns == ["rec_id", "pos", "sub_pos", "parent", "obj_pos"] and tables["(000)"].columns == ["rec_id", "pos", "sub_pos", "parent"]
    assert [tuple(r)[:5] for r in tables["(11e)"].collect()] == [(1, 3, -1, "(1)", "q")]
    typed = nested.typed(arr)
    assert typed.columns == ["rec_id", "pos", "sub_pos", "parent", "variant", "obj_pos", "n"] and typed.count() == 4
    assert set(nested.write_subtypes(nested.flatten_object(df, "k", "opt"), str(tmp_path / "opt"))) == {"(1(0))", "(00)"}


def test_keys_come_from_the_classified_relations(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    monkeypatch.setattr(nq, "_relations", lambda spark, sf_dir: [("arr", nested.flatten(df, "k", Relation("arr"))), ("arr.hops", nested.flatten(df, "k", Relation("arr.hops", outer="arr")))])
    keys = nq.p4_found(spark, "")
    assert sorted(tuple(r) for r in keys.collect()) == [(1, "arr", 0, -1), (1, "arr", 2, -1), (1, "arr", 3, -1), (1, "arr.hops", 0, 0), (3, "arr", 0, -1)]
    assert "concat((" in keys._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    assert {(r.field_path, r.parent, r.variant, r.n_objects) for r in nq.p4_links(spark, "").collect()} == {
        ("arr", "(1)", "(11@(1))", 1), ("arr", "(1)", "(000)", 1), ("arr", "(1)", "(11e)", 1), ("arr.hops", "(11@(1))", "(1)", 1), ("arr", "(1)", "(100)", 1),
    }


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_registered_tables_hold_every_object(spark, tmp_path):
    sizes = {r.field_path: r.n for r in nq.p4_found(spark, DATA).groupBy("field_path").count().withColumnRenamed("count", "n").collect()}
    typed = {"p4_gold_typed": "gold", "p4_parse_typed": "llm_parse", "p4_examples_typed": nq.RESPONSES[0].path, "p4_attempts_typed": nq.RESPONSES[1].path, "p4_hops_typed": nq.RESPONSES[2].path}
    assert {path: nq.QUERIES[name](spark, DATA).count() for name, path in typed.items()} == {path: sizes.get(path, 0) for path in typed.values()}
    found: dict = {}
    for (path, _), folder in nq.write_all(spark, DATA, str(tmp_path)).items():
        found[path] = found.get(path, 0) + spark.read.parquet(folder).count()
    assert found.pop("usage") == nq.p4_usage_parts(spark, DATA).count() and found == sizes
