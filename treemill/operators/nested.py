"""Nested records to flat, linked tables by structural variant.

A bottom-up tree automaton reads each object.  A leaf is in state ``0`` (null) or ``1``
(present), a nested object takes its children's states between parentheses.  An array of
objects is in state ``0`` (null), ``e`` (empty), or ``@(...)`` with the join of its
elements' states: a field has the state that all elements give it, ``~`` where they
differ, and a leading ``~`` tells of null elements beside others (``@0``: nothing but
them).  Other arrays are in state ``0``, ``e`` or ``+``.  The state of an object, its
*variant*, therefore names the fields that it really has.  Each array of objects becomes
one relation with the keys every variant shares (record id, place, place in the inner
array), the variant of the object around it, and the typed fields of that kind; a
variant's subtype table is the part of the relation in that state, narrowed to its fields.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

KEYS = ("rec_id", "pos", "sub_pos")


@dataclass(frozen=True)
class Relation:
    """An array of objects: where it is, and the array of objects around it, if any."""

    path: str
    outer: str | None = None


def shape_state(value: Column, kind: T.DataType) -> Column:
    """State of ``value`` in the automaton, as text; built from its children's states."""
    if isinstance(kind, T.StructType):
        inner = [shape_state(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("("), *inner, F.lit(")")))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        objects = F.filter(value, lambda x: x.isNotNull())
        joined = [_join_state(objects, f) for f in kind.elementType.fields]
        some_null = F.when(F.size(objects) < F.size(value), F.lit("~")).otherwise(F.lit(""))
        return (
            F.when(value.isNull(), F.lit("0")).when(F.size(value) == 0, F.lit("e")).when(F.size(objects) == 0, F.lit("@0"))
            .otherwise(F.concat(F.lit("@("), some_null, *joined, F.lit(")")))
        )
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNull(), F.lit("0")).when(F.size(value) == 0, F.lit("e")).otherwise(F.lit("+"))
    return F.when(value.isNull(), F.lit("0")).otherwise(F.lit("1"))


def _join_state(objects: Column, field: T.StructField) -> Column:
    """The state that all objects give a field, or ``~``."""
    states = F.array_distinct(F.transform(objects, lambda x: shape_state(x[field.name], field.dataType)))
    return F.when(F.size(states) == 1, F.try_element_at(states, F.lit(1))).otherwise(F.lit("~"))


def type_of(schema: T.StructType, path: str) -> T.DataType:
    """Type at a dotted path; arrays on the way are entered."""
    kind: T.DataType = schema
    for name in path.split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        kind = kind[name].dataType
    return kind


def _parent(df: DataFrame, path: str) -> Column:
    """Variant of the object around a top-level relation's array: its enclosing struct, or for a column of the record itself whether it is there."""
    outer, _, _ = path.rpartition(".")
    if outer:
        return shape_state(_path(outer), type_of(df.schema, outer))
    return F.concat(F.lit("("), F.when(_path(path).isNull(), F.lit("0")).otherwise(F.lit("1")), F.lit(")"))


def flatten(df: DataFrame, key: str, relation: Relation) -> DataFrame:
    """One row per non-null object of an array.

    Columns: ``rec_id`` (from ``key``), ``pos`` and ``sub_pos`` (places from 0,
    null elements counted; ``sub_pos`` is -1 unless the array lies in another
    array of objects, whose place is then ``pos``), ``parent`` (variant of the object
    around the array), ``variant``, and the object's fields under ``obj``, so that
    fields named like a key cannot clash with it.  Null and empty arrays, null parents
    and null elements give no row; a null key stays as a null ``rec_id``; repeated
    records give repeated rows.
    """
    kind = type_of(df.schema, relation.path)
    assert isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType), relation.path
    id_col = F.col(f"`{key}`").alias("rec_id")
    if relation.outer is None:
        rows = df.select(id_col, _parent(df, relation.path).alias("parent"), F.posexplode(_path(relation.path)).alias("pos", "obj")).withColumn("sub_pos", F.lit(-1))
    else:
        field = relation.path[len(relation.outer) + 1 :]
        around = type_of(df.schema, relation.outer)
        outer = df.select(id_col, F.posexplode(_path(relation.outer)).alias("pos", "outer"))
        rows = outer.select("rec_id", "pos", shape_state(F.col("outer"), around.elementType).alias("parent"), F.posexplode(F.col("outer")[field]).alias("sub_pos", "obj"))
    return rows.filter(F.col("obj").isNotNull()).select(*KEYS, "parent", shape_state(F.col("obj"), kind.elementType).alias("variant"), "obj")


def flatten_object(df: DataFrame, key: str, path: str) -> DataFrame:
    """One row per non-null optional object (no array): ``rec_id``, ``variant``, ``obj``."""
    kind = type_of(df.schema, path)
    rows = df.select(F.col(f"`{key}`").alias("rec_id"), _path(path).alias("obj")).filter(F.col("obj").isNotNull())
    return rows.select("rec_id", shape_state(F.col("obj"), kind).alias("variant"), "obj")


def supertype(parts: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Common keys of all relations: ``rec_id, field_path, pos, sub_pos``.

    Of a classified relation only objects that the automaton puts into a variant count.
    """
    out: DataFrame | None = None
    for path, rows in parts:
        rows = rows.filter(F.col("variant") != "0") if "variant" in rows.columns else rows
        part = rows.select("rec_id", F.lit(path).alias("field_path"), F.col("pos").cast("int"), F.col("sub_pos").cast("int"))
        out = part if out is None else out.unionByName(part)
    assert out is not None, "no relation given"
    return out


def present_fields(variant: str, kind: T.StructType) -> list[str]:
    """Names of the top-level fields that objects in this state have."""
    names, at = [], 1
    for field in kind.fields:
        state, at = _read_state(variant, at)
        if state != "0":
            names.append(field.name)
    return names


def _is_relation(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def subtype(rows: DataFrame, variant: str) -> DataFrame:
    """Typed table of one variant: the shared keys, the parent's variant and only the fields it has.

    Fields named like a key get the prefix ``obj_``.  An array of objects is no field of
    a flat table: its objects stand in a relation of their own, linked by record and place.
    """
    kind = rows.schema["obj"].dataType
    keys = [k for k in (*KEYS, "parent") if k in rows.columns]
    fields = [F.col("obj")[n].alias(f"obj_{n}" if n in keys else n) for n in present_fields(variant, kind) if not _is_relation(kind[n].dataType)]
    return rows.filter(F.col("variant") == variant).select(*keys, *fields)


def write_subtypes(rows: DataFrame, folder: str) -> dict[str, str]:
    """The typed table of every variant, narrowed to its fields, in a folder of its own; the folder by variant.

    Objects are classified once into ``folder/all``; a table then reads only its own part.
    """
    write_variants(rows, f"{folder}/all")
    parts = rows.sparkSession.read.schema(T.StructType([f for f in rows.schema.fields if f.name != "variant"] + [T.StructField("variant", T.StringType())])).parquet(f"{folder}/all")
    out = {}
    for state in sorted(r.variant for r in parts.select("variant").distinct().collect()):
        out[state] = f"{folder}/variant={state}"
        subtype(parts, state).write.mode("overwrite").parquet(out[state])
    return out


def typed(rows: DataFrame) -> DataFrame:
    """All subtype tables of a relation, one below the other: keys, ``parent``, ``variant``, and typed fields, null where the variant lacks them; arrays of objects are relations of their own."""
    kind = rows.schema["obj"].dataType
    keys = [k for k in (*KEYS, "parent", "variant") if k in rows.columns]
    return rows.select(*keys, *[F.col("obj")[n].alias(f"obj_{n}" if n in keys else n) for n in kind.fieldNames() if not _is_relation(kind[n].dataType)])


def write_variants(rows: DataFrame, folder: str) -> None:
    """All subtype tables of a relation at once: one folder per variant, a single pass."""
    rows.write.mode("overwrite").partitionBy("variant").parquet(folder)


def _path(path: str) -> Column:
    value: Column | None = None
    for name in path.split("."):
        value = F.col(f"`{name}`") if value is None else value[name]
    assert value is not None
    return value


def _read_state(text: str, at: int) -> tuple[str, int]:
    if text[at] == "@":
        inner, end = _read_state(text, at + 1)
        return "@" + inner, end
    if text[at] != "(":
        return text[at], at + 1
    depth, end = 0, at
    while True:
        depth += (text[end] == "(") - (text[end] == ")")
        end += 1
        if depth == 0:
            return text[at:end], end
