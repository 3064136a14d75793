"""Flattening of nested records."""

from treemill.operators import nested
from treemill.operators.nested import Relation

HOP = "array<struct<hop_no:int,ms:double>>"
SCHEMA = f"k long, obj string, conf struct<name:string,tries:array<struct<no:int,pos:string,hops:{HOP}>>>, opt struct<a:int,b:struct<c:int>>"
ROWS = [
    (1, "x", ("m", [(1, "p", [(1, 0.5), None, (2, None)]), None, (None, None, None), (3, "q", [])]), (1, (None,))), (2, None, None, None), (3, None, (None, None), (None, None)), (4, None, ("n", []), None),
    (1, "x", ("m", [(1, "p", [(1, 0.5)])]), None), (None, None, ("z", [(9, "r", None)]), None),
]


def test_objects_keep_their_place(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    tries = nested.flatten(df, "k", Relation("conf.tries"))
    assert sorted((r.rec_id or 0, r.pos, r.sub_pos, r.variant) for r in tries.collect()) == [(0, 0, -1, "(110)"), (1, 0, -1, "(11@(11))"), (1, 0, -1, "(11@(~1~))"), (1, 2, -1, "(000)"), (1, 3, -1, "(11e)")]
    hops = nested.flatten(df, "k", Relation("conf.tries.hops", outer="conf.tries"))
    assert sorted((r.rec_id, r.pos, r.sub_pos, r.variant) for r in hops.collect()) == [(1, 0, 0, "(11)"), (1, 0, 0, "(11)"), (1, 0, 2, "(10)")]
    keys = nested.supertype([("tries", tries), ("hops", hops)])
    assert keys.columns == ["rec_id", "field_path", "pos", "sub_pos"] and keys.count() == 8
    assert {(r.pos, r.parent) for r in hops.filter("sub_pos = 2").collect()} == {(0, "(11@(~1~))")}
    assert {r.parent for r in tries.collect()} == {"(1@(110))", "(1@(11@(11)))", "(1@(~~~~))"}


def test_subtypes_have_the_fields_of_their_variant(spark, tmp_path):
    tries = nested.flatten(spark.createDataFrame(ROWS, SCHEMA), "k", Relation("conf.tries"))
    table = nested.subtype(tries, "(11@(~1~))")
    assert table.columns == ["rec_id", "pos", "sub_pos", "parent", "no", "obj_pos"] and table.count() == 1
    assert nested.subtype(tries, "(110)").columns[-1] == "obj_pos" and nested.subtype(tries, "(000)").columns == ["rec_id", "pos", "sub_pos", "parent"]
    nested.write_variants(tries, str(tmp_path / "v"))
    assert {p.name for p in (tmp_path / "v").iterdir() if p.is_dir()} == {"variant=(11@(~1~))", "variant=(11@(11))", "variant=(000)", "variant=(11e)", "variant=(110)"}


def test_optional_objects(spark):
    parts = nested.flatten_object(spark.createDataFrame(ROWS, SCHEMA), "k", "opt")
    assert sorted((r.rec_id, r.variant) for r in parts.collect()) == [(1, "(1(0))"), (3, "(00)")]
    assert nested.present_fields("(1(0))", parts.schema["obj"].dataType) == ["a", "b"] and nested.present_fields("(00)", parts.schema["obj"].dataType) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nested.flatten(df, "k", Relation("conf.tries")).count() == 0
