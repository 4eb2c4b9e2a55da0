"""Static value types over Spark's data types, and comparison rules of the language.

Graph values are structs told apart by their fields: a node has ``_id`` and
``_labels``, a relationship ``_id`` and ``_type``, a path ``_nodes`` and ``_rels``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DURATION = T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "seconds", "nanos")])
POINT = T.StructType([T.StructField("srid", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("x", "y", "z")]])
TIME = T.StructType([T.StructField("nano_of_day", T.LongType()), T.StructField("offset_s", T.IntegerType())])
LOCAL_TIME = T.StructType([T.StructField("nano_of_day", T.LongType())])


def _fields(t) -> list[str]:
    return t.fieldNames() if isinstance(t, T.StructType) else []


def is_node(t) -> bool:
    return "_id" in _fields(t) and "_type" not in _fields(t)


def is_rel(t) -> bool:
    return "_id" in _fields(t) and "_type" in _fields(t)


def is_path(t) -> bool:
    return _fields(t)[:2] == ["_nodes", "_rels"]


def is_element(t) -> bool:
    return "_id" in _fields(t)


def is_duration(t) -> bool:
    return _fields(t) == ["months", "days", "seconds", "nanos"]


def is_point(t) -> bool:
    return _fields(t)[:1] == ["srid"]


def is_time(t) -> bool:
    return _fields(t)[:1] == ["nano_of_day"]


def is_int(t) -> bool:
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def is_float(t) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))


def is_number(t) -> bool:
    return is_int(t) or is_float(t)


def is_string(t) -> bool:
    return isinstance(t, T.StringType)


def is_list(t) -> bool:
    return isinstance(t, T.ArrayType)


def is_map(t) -> bool:
    return isinstance(t, T.MapType) or (isinstance(t, T.StructType) and not (is_element(t) or is_path(t) or is_duration(t) or is_point(t) or is_time(t)))


def is_null(t) -> bool:
    return isinstance(t, T.NullType)


def is_instant(t) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def kind(t) -> str:
    """The family within which values compare."""
    for name, test in (("number", is_number), ("string", is_string), ("list", is_list), ("node", is_node), ("rel", is_rel), ("path", is_path), ("duration", is_duration), ("point", is_point), ("time", is_time), ("null", is_null)):
        if test(t):
            return name
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampType):
        return "datetime"
    if isinstance(t, T.TimestampNTZType):
        return "localdatetime"
    return "map"




def _null_bool() -> Column:
    return F.lit(None).cast("boolean")


def equal(a: Column, ta, b: Column, tb, fixed: bool = False) -> Column:
    """Three-valued equality: null against anything is null, other kinds are unequal.

    ``fixed``: one side is a number that is written out, and no NaN.
    """
    if is_null(ta) or is_null(tb):
        return _null_bool()
    ka, kb = kind(ta), kind(tb)
    if ka != kb:
        return F.when(a.isNull() | b.isNull(), _null_bool()).otherwise(F.lit(False))
    if ka in ("node", "rel"):
        return a["_id"] == b["_id"]
    if ka == "path":
        ids = lambda p: F.transform(p["_rels"], lambda r: r["_id"])
        return (ids(a) == ids(b)) | (ids(a) == F.reverse(ids(b)))
    if fixed and ka == "number":
        return a == b
    if is_float(ta) or is_float(tb):
        x, y = a.cast("double"), b.cast("double")
        return F.when(F.isnan(x) | F.isnan(y), F.when(a.isNotNull() & b.isNotNull(), F.lit(False))).otherwise(x == y)
    if ka == "list":
        ea, eb = ta.elementType, tb.elementType
        pairs = F.zip_with(a, b, lambda x, y: equal(x, ea, y, eb))
        return F.when(a.isNull() | b.isNull(), _null_bool()).when(F.size(a) != F.size(b), F.lit(False)).otherwise(F.forall(pairs, lambda x: x))
    if ka == "map" and isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        if sorted(ta.fieldNames()) != sorted(tb.fieldNames()):
            return F.when(a.isNull() | b.isNull(), _null_bool()).otherwise(F.lit(False))
        out = F.lit(True)
        for f in ta.fieldNames():
            out = out & equal(a[f], ta[f].dataType, b[f], tb[f].dataType)
        return F.when(a.isNull() | b.isNull(), _null_bool()).otherwise(out)
    return a == b


def less(a: Column, ta, b: Column, tb, op: str, fixed: bool = False) -> Column:
    """Three-valued ordering; unlike kinds and graph values do not order.

    ``fixed``: b is a number that is written out. NaN is Spark's largest value, so
    then ``<`` needs no guard and ``>`` one that leaves the comparison to the scan.
    """
    ka, kb = kind(ta), kind(tb)
    if ka != kb or ka in ("null", "node", "rel", "path", "map", "point", "duration"):
        return _null_bool()
    plain = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if fixed and ka == "number":
        return plain if op in ("<", "<=") or not is_float(ta) else plain & ~F.isnan(a.cast("double"))
    if is_float(ta) or is_float(tb):
        nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        return F.when(nan, F.when(a.isNotNull() & b.isNotNull(), F.lit(False))).otherwise(plain)
    if ka == "list":
        common = F.least(F.size(a), F.size(b))
        holes = F.exists(F.slice(a, 1, common), lambda x: x.isNull()) | F.exists(F.slice(b, 1, common), lambda x: x.isNull())
        return F.when(holes, _null_bool()).otherwise(plain)
    if ka == "time" and "offset_s" in ta.fieldNames():
        utc = lambda x: x["nano_of_day"] - x["offset_s"] * 1_000_000_000
        x, y = utc(a), utc(b)
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return plain


def member(item: Column, ti, items: Column, tl) -> Column:
    """``item IN items`` with nulls undecided unless a match is found."""
    if is_null(tl):
        return _null_bool()
    te = tl.elementType
    if is_null(ti):
        return F.when(items.isNull(), _null_bool()).when(F.size(items) == 0, F.lit(False)).otherwise(_null_bool())
    return F.when(items.isNull(), _null_bool()).when(F.size(items) == 0, F.lit(False)).otherwise(F.exists(items, lambda x: equal(x, te, item, ti)))
