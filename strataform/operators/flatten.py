"""Deeply nested records as flat tables, a root and a child for every array, that keep parent and position.

Method. One pass over all records infers the merged schema: the kinds (object, array) seen at every path, with text
that itself is JSON read as if it stood inline. A second pass recursively explodes every array level; each row of a
child table carries its own key, the key of the nearest enclosing array element and its position. Where the merged
schema has an array and a record a lone object or scalar, that is element 0. Objects that are no elements become columns
of the row around them (``owner.name``), elements that are scalars rows of one column. Neither pass shuffles rows. Both read records
in Arrow batches: the built-in JSON readers need one type per path, which these records break, and the variant
functions would copy each subtree once per level.

Defined results: records that are null or not parseable have no rows; null elements count as positions but give no
row; empty arrays give no row; repeated records give their rows again unless the caller removes them; arrays directly
inside arrays are followed and written ``a[0][1]``; a key column may have any name, clashing ones included. A record has
one row in the root table, named by the empty string; one that is an array has a row per element there. A column whose
values have no common type is text; one that clashes with a key column or differs from another in case only gets ``_``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

ITEM = "[]"
ROOT = ""
KEYS = ("row_key", "parent_key", "id", "ordinal", "path")
#: Integers up to here are exact as doubles.
_EXACT = 2**53


def _read(text: str):
    """A text that is JSON itself, read; anything else as it is. Text in text is read as often as it takes."""
    value = text
    while isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "["):
            return value
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _record(text: str):
    """A whole record; a text where it can't be parsed."""
    try:
        return _read(json.loads(text))
    except (ValueError, RecursionError):
        return text


def _scalar_kind(v) -> str:
    c = v.__class__
    if c is int:
        return "long" if -_EXACT <= v <= _EXACT else "wide" if -(2**63) <= v < 2**63 else "string"
    return {str: "string", bool: "boolean", float: "double"}.get(c, "null")


def _kinds(value, path: tuple, out: set, leaves: bool = False) -> None:
    """Adds (path, kind) of every container, with ``leaves`` of every scalar too; elements of arrays and lone objects share no path yet."""
    kind = value.__class__
    if kind is dict:
        out.add((path, "object"))
        for k, v in value.items():
            c = v.__class__
            if c is dict or c is list:
                _kinds(v, (*path, k), out, leaves)
            elif c is str and v.lstrip()[:1] in ("{", "["):
                _kinds(_read(v), (*path, k), out, leaves)
            elif leaves:
                out.add(((*path, k), _scalar_kind(v)))
    elif kind is list:
        out.add((path, "array"))
        at = (*path, ITEM)
        for v in value:
            if v.__class__ is str:
                v = _read(v)
            if v.__class__ is dict or v.__class__ is list:
                _kinds(v, at, out, leaves)
            elif leaves:
                out.add((at, _scalar_kind(v)))
    elif leaves:
        out.add((path, _scalar_kind(value)))


def array_paths(df: DataFrame, column: str, max_paths: int = 100_000) -> frozenset[tuple]:
    """The merged schema's arrays: every path at which any record holds one, written without element steps.

    An element step is left out because a lone object may stand for any array on the way. The driver gets one row per
    distinct path; more than ``max_paths`` of them is an error, not a cut.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    value = _record(text)
                    if value.__class__ is not str:
                        _kinds(value, (), seen)
        rows = sorted({_merged(p) for p, kind in seen if kind == "array"})
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(p) for p in rows], pa.string())], ["path"])

    rows = df.select(column).mapInArrow(scan, "path string").distinct().limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} distinct array paths")
    return frozenset(tuple(json.loads(r[0])) for r in rows)


def _merged(path: tuple) -> tuple:
    """Array paths without the element step after a key; steps into arrays inside arrays stay."""
    out: list = []
    for i, step in enumerate(path):
        if step == ITEM and (i + 1 < len(path) and path[i + 1] != ITEM):
            continue
        out.append(step)
    return tuple(out)


@dataclass(frozen=True)
class Schema:
    """The merged schema: its arrays, and per table, written as its array's path, (path in the row, column name, type)."""

    arrays: frozenset[tuple]
    tables: dict[tuple, tuple[tuple[tuple, str, str], ...]]

    def names(self) -> dict[str, tuple]:
        return {".".join(t): t for t in self.tables}

    def columns(self, table: str) -> StructType:
        found = self.tables.get(self.names().get(table), ())
        return StructType([StructField(name, _parse_datatype_string(kind)) for _, name, kind in found])


def _place(path: tuple, arrays: frozenset) -> tuple[tuple, tuple]:
    """(table, path in its row) of a path with element steps."""
    generic, table, within = (), (), ()
    for i, step in enumerate(path):
        if step == ITEM:
            if i and path[i - 1] == ITEM:
                generic = (*generic, ITEM)
            table, within = generic, ()
        else:
            generic, within = (*generic, step), (*within, step)
            if generic in arrays:
                table, within = generic, ()
    return table, within


def _column_type(kinds: set) -> str:
    kinds = kinds - {"null"}
    if kinds and kinds <= {"long", "wide"}:
        return "long"
    if kinds and kinds <= {"long", "double"}:
        return "double"
    return "boolean" if kinds == {"boolean"} else "string"


def merged_schema(df: DataFrame, column: str, max_paths: int = 100_000) -> Schema:
    """Every table and column that any record has. More than ``max_paths`` distinct paths and kinds are an error, not a cut."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    value = _record(text)
                    if value.__class__ is not str:
                        _kinds(value, (), seen, leaves=True)
        rows = [json.dumps(x) for x in sorted(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["path"])

    rows = df.select(column).mapInArrow(scan, "path string").distinct().limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} distinct paths")
    seen = [(tuple(p), kind) for p, kind in (json.loads(r[0]) for r in rows)]
    arrays = frozenset(_merged(p) for p, kind in seen if kind == "array")
    found: dict[tuple, dict[tuple, set]] = {(): {}} | {a: {} for a in arrays}
    for p, kind in seen:
        table, within = _place(p, arrays)
        if kind not in ("object", "array") and (within or kind != "null"):
            found[table].setdefault(within, set()).add(kind)
    tables = {}
    for table, columns in found.items():
        taken, out = set(KEYS), []
        for within in sorted(columns):
            name = ".".join(within) if within else "value"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out.append((within, name, _column_type(columns[within])))
        tables[table] = tuple(out)
    return Schema(arrays, tables)


def _fields(obj: dict, generic: tuple, arrays: frozenset, within: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """(path in the row, scalar) of an object and of the objects in it that are no elements."""
    for k, v in obj.items():
        if v.__class__ is str and v.lstrip()[:1] in ("{", "["):
            v = _read(v)
        at = (*generic, k)
        if at in arrays or v.__class__ is list:
            continue
        if v.__class__ is dict:
            yield from _fields(v, at, arrays, (*within, k))
        else:
            yield (*within, k), v


def _explode(value, generic: tuple, written: str, near: str, depth: int, arrays: frozenset, emit, leaves: bool = False) -> None:
    """Calls ``emit`` for every object that is an element, with ``leaves`` for every scalar that is one too."""
    kind = value.__class__
    if kind is dict:
        for k, v in value.items():
            c = v.__class__
            if c is str and v.lstrip()[:1] in ("{", "["):
                v = _read(v)
                c = v.__class__
            if c is dict or c is list or leaves and v is not None:
                at = (*generic, k)
                if c is not list and at in arrays:
                    v, c = [v], list
                if c is dict or c is list:
                    _explode(v, at, f"{written}.{k}" if written else k, near, depth, arrays, emit, leaves)
    elif kind is list:
        for i, v in enumerate(value):
            c = v.__class__
            if c is str:
                v = _read(v)
                c = v.__class__
            if c is dict:
                here = f"{written}[{i}]"
                emit(near, here, generic, i, depth + 1, v)
                _explode(v, generic, here, here, depth + 1, arrays, emit, leaves)
            elif c is list:
                _explode(v, (*generic, ITEM), f"{written}[{i}]", near, depth, arrays, emit, leaves)
            elif leaves and v is not None:
                emit(near, f"{written}[{i}]", generic, i, depth + 1, v)


def _rows(df: DataFrame, id_col: str, column: str, arrays: frozenset, fields, leaves: bool, max_rows: int) -> DataFrame:
    """Rows of the records' elements, with ``leaves`` of scalars and of the records too; ``fields`` gives the last column, or False for no row."""
    names = ["id", "table", "parent_path", "path", "ordinal", "depth", "fields"]
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            out: list[tuple] = []
            for row, text in enumerate(texts):
                if text:
                    value = _record(text)
                    if value.__class__ is str or value is None:
                        continue

                    def own(near, here, table, i, depth, v, row=row):
                        held = fields(table, v)
                        if held is not False:
                            out.append((row, ".".join(table), near, here, i, depth, held))

                    if leaves and value.__class__ is not list:
                        own("", "", (), 0, 0, value)
                    _explode(value, (), "", "", 0, arrays, own, leaves)
            for k in range(0, len(out), max_rows):
                part = list(zip(*out[k : k + max_rows]))
                cols = [ids.take(pa.array(part[0], pa.int64())), *[pa.array(c, t) for c, t in zip(part[1:], (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))]]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col).alias("id"), F.col(column).alias("text")).mapInArrow(
        scan, f"id {kind}, table string, parent_path string, path string, ordinal int, depth int, fields string"
    )


def nested_objects(df: DataFrame, id_col: str, column: str, arrays: frozenset | None = None, with_fields: bool = True, max_rows: int = 20_000) -> DataFrame:
    """One row per object that is an element of an array, at any depth.

    Columns: id, table (its array's path), parent_path, path, ordinal, depth, fields (its scalars as JSON, those of
    objects in it by dotted name; null without ``with_fields``). ``max_rows`` bounds an output batch, not the result.
    """
    arrays = array_paths(df, column) if arrays is None else arrays

    def fields(table: tuple, v):
        return json.dumps({".".join(p): x for p, x in _fields(v, table, arrays)}, ensure_ascii=False) if with_fields else None

    return _rows(df, id_col, column, arrays, fields, False, max_rows)


def flat_rows(df: DataFrame, id_col: str, column: str, schema: Schema | None = None, only: str | None = None, max_rows: int = 20_000) -> DataFrame:
    """The rows of all tables, or of one: as ``nested_objects``, with records and scalar elements, fields by column name."""
    schema = merged_schema(df, column) if schema is None else schema
    arrays, names = schema.arrays, {t: {p: name for p, name, _ in cols} for t, cols in schema.tables.items()}
    wanted = None if only is None else schema.names().get(only)

    def fields(table: tuple, v):
        if only is not None and table != wanted:
            return False
        held = _fields(v, table, arrays) if v.__class__ is dict else [((), v)]
        return json.dumps({names[table][p]: x for p, x in held}, ensure_ascii=False)

    return _rows(df, id_col, column, arrays, fields, True, max_rows)


def _keys() -> list:
    """row_key and parent_key, 128 bits of (id, path), so that no two rows of a corpus share one; rows of the root table
    have no parent, those right below it have the record."""
    key = lambda path: F.md5(F.concat_ws("\0", F.col("id").cast("string"), path))
    return [key(F.col("path")).alias("row_key"), F.when(F.col("table") != ROOT, key(F.col("parent_path"))).alias("parent_key")]


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Rows of any tables with their keys: table, row_key, parent_key, id, ordinal, path, fields."""
    return rows.select("table", *_keys(), "id", "ordinal", "path", "fields")


def child_table(objects: DataFrame, table: str, schema: str | StructType) -> DataFrame:
    """The flat table of one array, or the root: row_key, parent_key (null for the root), id, ordinal, path and the columns of ``schema``."""
    t = keyed_rows(objects.filter(F.col("table") == table))
    if not isinstance(schema, str) and not schema.fields:
        return t.select(*KEYS)
    return t.select(*KEYS, F.from_json("fields", schema).alias("f")).select(*KEYS, "f.*")


def flat_table(df: DataFrame, id_col: str, column: str, table: str) -> DataFrame:
    """The flat table of one array, or the root, with every column that any record has for it."""
    schema = merged_schema(df, column)
    return child_table(flat_rows(df, id_col, column, schema, only=table), table, schema.columns(table))
