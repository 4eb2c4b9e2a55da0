"""Scalar functions: text, numbers, lists, maps, graph elements, points, and the apoc library."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans import values as v
from arbora.plans.lower import CypherError, Rows, Val, col
from arbora.sources.graph import widened

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
FUNCTIONS: dict = {}
#: Mean radius of the earth in metres.
EARTH_M = 6_371_008.8
# Coordinate systems by name.
SRIDS = {"cartesian": 7203, "cartesian-3d": 9157, "wgs-84": 4326, "wgs-84-3d": 4979}


def function(*names: str):
    def keep(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return keep


def simple(names, make, kind=None):
    """A function of columns alone; ``kind`` a type, or the number of the argument whose type it has."""
    for n in [names] if isinstance(names, str) else names:
        FUNCTIONS[n] = lambda rows, a, make=make, kind=kind: Val(make(*[x.col for x in a]), rows, kind=a[kind].type if isinstance(kind, int) else kind)


def _null(rows: Rows) -> Val:
    return Val(F.lit(None), rows, kind=T.NullType())


def constant(x: Val):
    """The value of an argument that must be written out or a parameter."""
    if x.node is not None and x.node[0] == "lit":
        return x.node[1]
    if x.node is not None and x.node[0] == "param":
        return x.rows.params[x.node[1]]
    if x.node is not None and x.node[0] == "map":
        return {k: constant(Val(None, x.rows, y)) for k, y in x.node[1].items()}
    if x.node is not None and x.node[0] == "un" and x.node[2][0] == "lit":
        return -x.node[2][1]
    if x.node is not None and x.node[0] == "list":
        return [constant(Val(None, x.rows, y)) for y in x.node[1]]
    raise CypherError("this argument must be a literal or a parameter")


# graph ---------------------------------------------------------------------------
@function("id", "elementid")
def _id(rows, a):
    return Val(a[0].col["_id"].cast("string"), rows, kind=STRING)


@function("labels")
def _labels(rows, a):
    return Val(a[0].col["_labels"], rows, kind=T.ArrayType(STRING)) if not v.is_null(a[0].type) else _null(rows)


@function("type")
def _type(rows, a):
    return Val(a[0].col["_type"], rows, kind=STRING) if not v.is_null(a[0].type) else _null(rows)


def _own(kind) -> list[str]:
    return [f.name for f in kind if not f.name.startswith("_")]


@function("keys")
def _keys(rows, a):
    x = a[0]
    if isinstance(x.type, T.MapType):
        return Val(F.array_sort(F.map_keys(x.col)), rows, kind=T.ArrayType(STRING))
    if v.is_null(x.type):
        return _null(rows)
    have = F.filter(F.array(*[F.when(x.col[n].isNotNull(), F.lit(n)) for n in sorted(_own(x.type))]).cast("array<string>"), lambda y: y.isNotNull())
    return Val(F.when(x.col.isNotNull(), have), rows, kind=T.ArrayType(STRING))


@function("properties")
def _properties(rows, a):
    x = a[0]
    if not v.is_element(x.type):
        return x
    names = _own(x.type)
    return Val(F.when(x.col.isNotNull(), F.struct(*[x.col[n].alias(n) for n in names]) if names else F.struct(F.lit(None).alias("_none"))), rows)


def _end_of(which: str):
    def f(rows, a):
        if rows.inside:
            raise CypherError("an end of a relationship cannot be looked up inside a list expression")
        from arbora.plans.lower import fresh

        n, k = fresh("n"), fresh("k")
        rows.with_column(k, a[0].col[which])
        nodes = rows.graph.scan_nodes([], n, None)
        rows.df = rows.df.join(nodes, F.col(k) == F.col(n)["_id"], "left").drop(k)
        return Val(col(n), rows)

    return f


FUNCTIONS["startnode"], FUNCTIONS["endnode"] = _end_of("_src"), _end_of("_dst")
simple("nodes", lambda p: p["_nodes"])
simple("relationships", lambda p: p["_rels"])


@function("size", "length", "char_length", "character_length")
def _size(rows, a):
    x = a[0]
    if v.is_null(x.type):
        return _null(rows)
    if v.is_path(x.type):
        return Val(F.size(x.col["_rels"]).cast("long"), rows, kind=LONG)
    if v.is_string(x.type):
        return Val(F.length(x.col).cast("long"), rows, kind=LONG)
    if v.is_list(x.type) or isinstance(x.type, T.MapType):
        return Val(F.when(x.col.isNotNull(), F.size(x.col)).cast("long"), rows, kind=LONG)
    raise CypherError("size needs a list, a text or a path")


simple("exists", lambda x: x.isNotNull(), BOOL)


@function("isempty")
def _isempty(rows, a):
    x = a[0]
    if v.is_string(x.type):
        return Val(F.length(x.col) == 0, rows, kind=BOOL)
    if isinstance(x.type, T.StructType):
        return Val(F.when(x.col.isNotNull(), F.lit(not _own(x.type))), rows, kind=BOOL)
    return Val(F.when(x.col.isNotNull(), F.size(x.col) == 0), rows, kind=BOOL)


# text ----------------------------------------------------------------------------
simple(["tolower", "lower"], F.lower, STRING)
simple(["toupper", "upper"], F.upper, STRING)
simple("trim", lambda s: F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), STRING)
simple("ltrim", lambda s: F.regexp_replace(s, r"^[\s\p{Z}]+", ""), STRING)
simple("rtrim", lambda s: F.regexp_replace(s, r"[\s\p{Z}]+$", ""), STRING)
simple("left", lambda s, n: F.left(s, n.cast("int")), STRING)
simple("right", lambda s, n: F.right(s, n.cast("int")), STRING)
simple("replace", lambda s, a, b: F.when(F.length(a) == 0, s).otherwise(F.replace(s, a, b)), STRING)
simple("split", lambda s, d: F.when(F.length(d) == 0, F.split(s, "")).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1)), T.ArrayType(STRING))


@function("substring")
def _substring(rows, a):
    start = F.greatest(a[1].col.cast("int"), F.lit(0))
    n = F.greatest(a[2].col.cast("int"), F.lit(0)) if len(a) > 2 else F.length(a[0].col)
    return Val(F.substring(a[0].col, start + 1, n), rows, kind=STRING)


simple("reverse", F.reverse, 0)


def _float_text(x: Column) -> Column:
    """Floats without an exponent: 1.0, 100000000000000000000.0, 0.00001."""
    plain = x.cast("string")
    long = F.regexp_replace(F.format_string("%.17f", x), r"(\.\d+?)0+$", "$1")
    return F.when(F.isnan(x), F.lit("NaN")).when(F.contains(plain, F.lit("E")), long).otherwise(plain)


@function("tostring")
def _tostring(rows, a):
    from arbora.functions import temporal

    x = a[0]
    k = x.type
    if v.is_null(k):
        return Val(F.lit(None).cast("string"), rows, kind=STRING)
    if v.is_float(k):
        return Val(_float_text(x.col.cast("double")), rows, kind=STRING)
    if temporal.is_temporal(k):
        return Val(temporal.text(x), rows, kind=STRING)
    if isinstance(k, (T.StructType, T.ArrayType, T.MapType)):
        return Val(F.to_json(x.col, {"ignoreNullFields": "false"}), rows, kind=STRING)
    return Val(x.col.cast("string"), rows, kind=STRING)


@function("tointeger", "tointegerornull")
def _tointeger(rows, a):
    x = a[0]
    if v.is_string(x.type):
        s = F.trim(x.col)
        return Val(F.coalesce(s.try_cast("long"), s.try_cast("double").try_cast("long")), rows, kind=LONG)
    if v.is_number(x.type) or isinstance(x.type, T.BooleanType):
        return Val(x.col.try_cast("long"), rows, kind=LONG)
    return Val(F.lit(None).cast("long"), rows, kind=LONG)


@function("tofloat", "tofloatornull")
def _tofloat(rows, a):
    x = a[0]
    ok = v.is_string(x.type) or v.is_number(x.type)
    return Val((F.trim(x.col) if v.is_string(x.type) else x.col).try_cast("double") if ok else F.lit(None).cast("double"), rows, kind=DOUBLE)


@function("toboolean", "tobooleanornull")
def _toboolean(rows, a):
    x = a[0]
    if v.is_string(x.type):
        s = F.lower(F.trim(x.col))
        return Val(F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False)), rows, kind=BOOL)
    if isinstance(x.type, T.BooleanType):
        return x
    return Val((x.col != 0) if v.is_int(x.type) else F.lit(None).cast("boolean"), rows, kind=BOOL)


FUNCTIONS["tostringornull"] = FUNCTIONS["tostring"]


def _listed(name: str, kind):
    def f(rows, a):
        if v.is_null(a[0].type):
            return _null(rows)
        elem = a[0].type.elementType
        return Val(F.transform(a[0].col, lambda y: FUNCTIONS[name](rows, [Val(y, rows, kind=elem)]).col), rows, kind=T.ArrayType(kind))

    return f


for _name, _kind in (("string", STRING), ("integer", LONG), ("float", DOUBLE), ("boolean", BOOL)):
    FUNCTIONS[f"to{_name}list"] = _listed(f"to{_name}", _kind)


def type_name(k) -> str:
    if v.is_list(k):
        return f"LIST<{type_name(k.elementType)}>"
    return {"number": "FLOAT" if v.is_float(k) else "INTEGER", "string": "STRING", "boolean": "BOOLEAN", "node": "NODE", "rel": "RELATIONSHIP", "path": "PATH", "map": "MAP", "date": "DATE",
            "datetime": "ZONED DATETIME", "localdatetime": "LOCAL DATETIME", "duration": "DURATION", "point": "POINT", "null": "NULL",
            "time": "ZONED TIME" if v.is_time(k) and "offset_s" in k.fieldNames() else "LOCAL TIME"}[v.kind(k)]


@function("valuetype")
def _valuetype(rows, a):
    k = a[0].type
    if v.is_null(k):
        return Val(F.lit("NULL"), rows, kind=STRING)
    return Val(F.when(a[0].col.isNull(), F.lit("NULL")).otherwise(F.lit(type_name(k) + " NOT NULL")), rows, kind=STRING)


# lists ---------------------------------------------------------------------------
@function("coalesce")
def _coalesce(rows, a):
    kinds = [x.type for x in a if not v.is_null(x.type)]
    if not kinds:
        return _null(rows)
    to = DOUBLE if all(v.is_number(k) for k in kinds) and len({v.is_float(k) for k in kinds}) > 1 else kinds[0]
    return Val(F.coalesce(*[x.col.cast(to) if x.type != to and not isinstance(to, T.StructType) else x.col for x in a if not v.is_null(x.type)]), rows, kind=to)


@function("range")
def _range(rows, a):
    x, y = a[0].col.cast("long"), a[1].col.cast("long")
    s = a[2].col.cast("long") if len(a) > 2 else F.lit(1).cast("long")
    if len(a) > 2 and a[2].node == ("lit", 0):
        raise CypherError("range needs a step other than 0")
    none = F.array().cast("array<bigint>")
    return Val(F.when(((s > 0) & (x <= y)) | ((s < 0) & (x >= y)), F.sequence(x, y, s)).when(x.isNotNull() & y.isNotNull() & s.isNotNull(), none), rows, kind=T.ArrayType(LONG))


def _elem(rows, x: Val, c: Column) -> Val:
    return _null(rows) if v.is_null(x.type) else Val(c, rows, kind=x.type.elementType)


@function("head")
def _head(rows, a):
    return _elem(rows, a[0], F.get(a[0].col, F.lit(0)))


@function("last")
def _last(rows, a):
    return _elem(rows, a[0], F.try_element_at(a[0].col, F.lit(-1)))


simple("tail", lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(0))), 0)


# numbers -------------------------------------------------------------------------
@function("abs")
def _abs(rows, a):
    return Val(F.abs(a[0].col), rows, kind=a[0].type)


simple("sign", lambda x: F.coalesce(F.when(F.isnan(x.cast("double")), F.lit(0)).otherwise(F.signum(x.cast("double"))).cast("long"), F.lit(None).cast("long")), LONG)
simple("ceil", lambda x: F.ceil(x.cast("double")).cast("double"), DOUBLE)
simple("floor", lambda x: F.floor(x.cast("double")).cast("double"), DOUBLE)
simple("sqrt", lambda x: F.sqrt(x.cast("double")), DOUBLE)
simple("exp", lambda x: F.exp(x.cast("double")), DOUBLE)


def _log(f):
    def g(x):
        y = x.cast("double")
        return F.when(y == 0, F.lit(float("-inf"))).when(y < 0, F.lit(float("nan"))).otherwise(f(y))

    return g


simple(["log", "ln"], _log(F.ln), DOUBLE)
simple("log10", _log(F.log10), DOUBLE)
for _n, _f in (("sin", F.sin), ("cos", F.cos), ("tan", F.tan), ("cot", F.cot), ("asin", F.asin), ("acos", F.acos), ("atan", F.atan), ("degrees", F.degrees), ("radians", F.radians)):
    simple(_n, lambda x, f=_f: f(x.cast("double")), DOUBLE)
simple("atan2", lambda y, x: F.atan2(y.cast("double"), x.cast("double")), DOUBLE)
simple("haversin", lambda x: (F.lit(1.0) - F.cos(x.cast("double"))) / 2, DOUBLE)
simple("isnan", lambda x: F.when(x.isNotNull(), F.isnan(x.cast("double"))), BOOL)
FUNCTIONS["pi"] = lambda rows, a: Val(F.lit(math.pi), rows, kind=DOUBLE)
FUNCTIONS["e"] = lambda rows, a: Val(F.lit(math.e), rows, kind=DOUBLE)
FUNCTIONS["rand"] = lambda rows, a: Val(F.rand(), rows, kind=DOUBLE)
FUNCTIONS["randomuuid"] = lambda rows, a: Val(F.expr("uuid()"), rows, kind=STRING)
FUNCTIONS["timestamp"] = lambda rows, a: Val(F.unix_millis(F.current_timestamp()), rows, kind=LONG)


@function("round")
def _round(rows, a):
    x = a[0].col.cast("double")
    places = constant(a[1]) if len(a) > 1 else 0
    mode = constant(a[2]).upper() if len(a) > 2 else "HALF_UP"
    p = F.lit(10.0**places)
    if mode == "HALF_UP":
        out = F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.round(x, places))
    elif mode == "HALF_EVEN":
        out = F.bround(x, places)
    else:
        y = x * p
        down, up = F.floor(y).cast("double"), F.ceil(y).cast("double")
        zero, away = F.when(y >= 0, down).otherwise(up), F.when(y >= 0, up).otherwise(down)
        z = {"UP": away, "DOWN": zero, "CEILING": up, "FLOOR": down, "HALF_DOWN": F.when(F.abs(y - zero) > 0.5, away).otherwise(zero)}.get(mode)
        if z is None:
            raise CypherError(f"unknown rounding mode {mode}")
        out = z / p
    return Val(out.cast("double"), rows, kind=DOUBLE)


# points --------------------------------------------------------------------------
@function("point")
def _point(rows, a):
    fields = a[0].type.fieldNames() if isinstance(a[0].type, T.StructType) else None
    if fields is None:
        raise CypherError("point needs a map")
    c = a[0].col
    pick = lambda *names: next((c[n].cast("double") for n in names if n in fields), None)
    x, y, z = pick("x", "longitude"), pick("y", "latitude"), pick("z", "height")
    given = {}
    if a[0].node is not None and a[0].node[0] == "map":
        given = {k: e[1] for k, e in a[0].node[1].items() if e[0] == "lit"}
    geographic = "longitude" in fields or str(given.get("crs", "")).lower().startswith("wgs")
    srid = given.get("srid") or SRIDS[str(given.get("crs", "wgs-84" if geographic else "cartesian")).lower() + ("-3d" if z is not None and "3d" not in str(given.get("crs", "")).lower() else "")]
    if x is None or y is None:
        raise CypherError("a point needs two coordinates")
    point = F.struct(F.lit(srid).cast("int").alias("srid"), x.alias("x"), y.alias("y"), (z if z is not None else F.lit(None).cast("double")).alias("z"))
    return Val(F.when(x.isNotNull() & y.isNotNull(), point), rows, kind=v.POINT)


@function("point.distance", "distance")
def _distance(rows, a):
    p, q = a[0].col, a[1].col
    flat = F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) + F.coalesce(F.pow(p["z"] - q["z"], 2), F.lit(0.0)))
    h = F.pow(F.sin(F.radians(q["y"] - p["y"]) / 2), 2) + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * F.pow(F.sin(F.radians(q["x"] - p["x"]) / 2), 2)
    arc = 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    arc = F.when(p["z"].isNotNull() & q["z"].isNotNull(), F.sqrt(arc * arc + F.pow(p["z"] - q["z"], 2))).otherwise(arc)
    return Val(F.when(p["srid"] == q["srid"], F.when(p["srid"].isin(4326, 4979), arc).otherwise(flat)), rows, kind=DOUBLE)


@function("point.withinbbox")
def _bbox(rows, a):
    p, lo, hi = (x.col for x in a)
    inside = p["x"].between(lo["x"], hi["x"]) & p["y"].between(lo["y"], hi["y"]) & F.coalesce(p["z"].between(lo["z"], hi["z"]), F.lit(True))
    return Val(F.when((p["srid"] == lo["srid"]) & (p["srid"] == hi["srid"]), inside), rows, kind=BOOL)


# apoc: collections -----------------------------------------------------------------
def _numbers(x: Val):
    e = x.type.elementType
    return F.filter(x.col.cast(T.ArrayType(DOUBLE if v.is_float(e) else LONG)), lambda y: y.isNotNull()), (DOUBLE if v.is_float(e) else LONG)


@function("apoc.coll.sum")
def _csum(rows, a):
    x, k = _numbers(a[0])
    return Val(F.aggregate(x, F.lit(0).cast(k), lambda s, y: s + y), rows, kind=k)


@function("apoc.coll.avg")
def _cavg(rows, a):
    x, _ = _numbers(a[0])
    return Val(F.when(F.size(x) > 0, F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda s, y: s + y) / F.size(x)), rows, kind=DOUBLE)


FUNCTIONS["apoc.coll.max"] = lambda rows, a: Val(F.array_max(a[0].col), rows, kind=a[0].type.elementType)
FUNCTIONS["apoc.coll.min"] = lambda rows, a: Val(F.array_min(a[0].col), rows, kind=a[0].type.elementType)
simple("apoc.coll.toset", F.array_distinct, 0)
simple("apoc.coll.sort", F.array_sort, 0)
simple("apoc.coll.sortdesc", lambda x: F.sort_array(x, asc=False), 0)
simple("apoc.coll.reverse", F.reverse, 0)
FUNCTIONS["apoc.coll.contains"] = lambda rows, a: Val(F.coalesce(v.member(a[1].col, a[1].type, a[0].col, a[0].type), F.lit(False)), rows, kind=BOOL)
simple("apoc.coll.union", F.array_union, 0)
simple("apoc.coll.intersection", F.array_intersect, 0)
simple("apoc.coll.subtract", F.array_except, 0)
FUNCTIONS["apoc.coll.flatten"] = lambda rows, a: Val(F.flatten(a[0].col), rows, kind=a[0].type.elementType)
FUNCTIONS["apoc.coll.indexof"] = lambda rows, a: Val((F.array_position(a[0].col, a[1].col) - 1).cast("long"), rows, kind=LONG)
FUNCTIONS["apoc.coll.occurrences"] = lambda rows, a: Val(F.size(F.filter(a[0].col, lambda y: F.coalesce(v.equal(y, a[0].type.elementType, a[1].col, a[1].type), F.lit(False)))).cast("long"), rows, kind=LONG)


@function("apoc.coll.zip")
def _zip(rows, a):
    n = F.least(F.size(a[0].col), F.size(a[1].col))
    same = a[0].type.elementType == a[1].type.elementType
    kind = a[0].type.elementType if same else STRING
    x, y = (F.slice(z.col if same else z.col.cast("array<string>"), 1, n) for z in a)
    return Val(F.zip_with(x, y, lambda p, q: F.array(p, q)), rows, kind=T.ArrayType(T.ArrayType(kind)))


# apoc: text ------------------------------------------------------------------------
simple("apoc.text.join", lambda x, d: F.concat_ws("", F.transform(x, lambda y, i: F.concat(F.when(i > 0, d).otherwise(F.lit("")), F.coalesce(y.cast("string"), F.lit(""))))), STRING)
simple("apoc.text.split", lambda s, r: F.split(s, r, -1), T.ArrayType(STRING))
simple("apoc.text.replace", lambda s, r, t: F.regexp_replace(s, r, t), STRING)
simple("apoc.text.indexof", lambda s, t: F.when(F.contains(s, t), F.octet_length(F.substring(s, F.lit(1), F.position(t, s) - 1))).otherwise(F.lit(-1)).cast("long"), LONG)


def _pad(left: bool):
    def f(s, n, p):
        n = n.cast("int")
        padded = F.call_function("lpad" if left else "rpad", s, n, p)
        return F.when((F.length(s) >= n) | (F.length(p) == 0), s).otherwise(padded)

    return f


simple("apoc.text.lpad", _pad(True), STRING)
simple("apoc.text.rpad", _pad(False), STRING)
_capital = lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))
_chars = lambda s: F.split(s, "")
simple("apoc.text.capitalize", _capital, STRING)
simple("apoc.text.decapitalize", lambda s: F.concat(F.lower(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30)), STRING)
simple("apoc.text.capitalizeall", lambda s: F.array_join(F.transform(F.split(s, " "), _capital), " "), STRING)
simple("apoc.text.swapcase", lambda s: F.array_join(F.transform(_chars(s), lambda c: F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))), ""), STRING)
_tokens = lambda s: F.filter(F.split(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), r"[\s_\-]+"), lambda x: F.length(x) > 0)
simple("apoc.text.uppercamelcase", lambda s: F.array_join(F.transform(_tokens(s), lambda x: _capital(F.lower(x))), ""), STRING)
simple("apoc.text.camelcase", lambda s: F.array_join(F.transform(_tokens(s), lambda x, i: F.when(i == 0, F.lower(x)).otherwise(_capital(F.lower(x)))), ""), STRING)
simple("apoc.text.snakecase", lambda s: F.array_join(F.transform(_tokens(s), F.lower), "_"), STRING)
simple("apoc.text.repeat", lambda s, n: F.repeat(s, n.cast("int")), STRING)
simple("apoc.text.reverse", F.reverse, STRING)
simple("apoc.text.urlencode", lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")), STRING)
simple("apoc.text.urldecode", lambda s: F.url_decode(s), STRING)
simple("apoc.text.hexvalue", F.hex, STRING)
simple("apoc.text.base64encode", lambda s: F.base64(s.cast("binary")), STRING)
simple("apoc.text.base64decode", lambda s: F.unbase64(s).cast("string"), STRING)
simple("apoc.text.bytecount", lambda s: F.octet_length(s).cast("long"), LONG)
simple("apoc.text.clean", lambda s: F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")), STRING)
simple("apoc.text.levenshteindistance", lambda a, b: F.levenshtein(a, b).cast("long"), LONG)


@function("apoc.text.regexgroups")
def _regexgroups(rows, a):
    import re

    pattern = constant(a[1])
    n = re.compile(pattern).groups
    per = [F.regexp_extract_all(a[0].col, F.lit(pattern), F.lit(g)) for g in range(n + 1)]
    idx = F.sequence(F.lit(0), F.size(per[0]) - 1)
    out = F.when(F.size(per[0]) > 0, F.transform(idx, lambda i: F.array(*[F.get(p, i) for p in per]))).otherwise(F.array().cast("array<array<string>>"))
    return Val(out, rows, kind=T.ArrayType(T.ArrayType(STRING)))


# apoc: maps ------------------------------------------------------------------------
def _fields(x: Val) -> dict[str, Column]:
    if not isinstance(x.type, T.StructType):
        raise CypherError("this map function needs a map with known keys")
    return {f.name: x.col[f.name] for f in x.type if not f.name.startswith("_")}


def _struct(rows, fields: dict[str, Column]) -> Val:
    return Val(F.struct(*[c.alias(k) for k, c in fields.items()]) if fields else F.create_map().cast("map<string,string>"), rows)


FUNCTIONS["apoc.map.merge"] = lambda rows, a: _struct(rows, _fields(a[0]) | _fields(a[1]))
FUNCTIONS["apoc.map.setkey"] = lambda rows, a: _struct(rows, _fields(a[0]) | {constant(a[1]): a[2].col})
FUNCTIONS["apoc.map.removekey"] = lambda rows, a: _struct(rows, {k: c for k, c in _fields(a[0]).items() if k != constant(a[1])})
FUNCTIONS["apoc.map.removekeys"] = lambda rows, a: _struct(rows, {k: c for k, c in _fields(a[0]).items() if k not in constant(a[1])})
FUNCTIONS["apoc.map.submap"] = lambda rows, a: _struct(rows, {k: _fields(a[0]).get(k, F.lit(None)) for k in constant(a[1])})


@function("apoc.map.mergelist")
def _mergelist(rows, a):
    fields: dict[str, Column] = {}
    for x in a[0].node[1]:
        fields |= _fields(rows.compile(x))
    return _struct(rows, fields)


@function("apoc.map.frompairs", "apoc.coll.tomap")
def _frompairs(rows, a):
    if a[0].node is not None and a[0].node[0] == "list":
        return _struct(rows, {constant(Val(None, rows, p[1][0])): rows.compile(p[1][1]).col for p in a[0].node[1]})
    e = a[0].type.elementType
    pair = lambda p: F.struct(p[0] if v.is_list(e) else p["key"], p[1] if v.is_list(e) else p["value"])
    return Val(F.map_from_entries(F.transform(a[0].col, pair)), rows)


@function("apoc.map.fromlists")
def _fromlists(rows, a):
    return Val(F.map_from_arrays(a[0].col, a[1].col), rows)


@function("apoc.map.fromvalues")
def _fromvalues(rows, a):
    items = a[0].node[1]
    return _struct(rows, {constant(Val(None, rows, items[i])): rows.compile(items[i + 1]).col for i in range(0, len(items) - 1, 2)})


@function("apoc.map.values")
def _values(rows, a):
    from arbora.functions.expressions import array_of

    fields = _fields(a[0])
    keys = constant(a[1]) if len(a) > 1 else sorted(fields)
    return array_of(rows, [Val(fields[k], rows) if k in fields else _null(rows) for k in keys])


# apoc: hashes, json, numbers, dates ---------------------------------------------------
def _joined(x: Val) -> Column:
    return F.concat_ws("", F.transform(x.col, lambda y: F.coalesce(y.cast("string"), F.lit("")))) if v.is_list(x.type) else x.col.cast("string")


for _n, _f in (("md5", F.md5), ("sha1", F.sha1), ("sha256", lambda c: F.sha2(c, 256)), ("sha384", lambda c: F.sha2(c, 384)), ("sha512", lambda c: F.sha2(c, 512))):
    FUNCTIONS[f"apoc.util.{_n}"] = lambda rows, a, f=_f: Val(f(_joined(a[0])), rows, kind=STRING)


@function("apoc.convert.tojson")
def _tojson(rows, a):
    k = a[0].type
    if isinstance(k, (T.StructType, T.ArrayType, T.MapType)):
        return Val(F.to_json(a[0].col, {"ignoreNullFields": "false"}), rows, kind=STRING)
    if v.is_string(k):
        return Val(F.regexp_extract(F.to_json(F.struct(a[0].col.alias("x"))), r"^\{\"x\":(.*)\}$", 1), rows, kind=STRING)
    return Val(F.coalesce(a[0].col.cast("string"), F.lit("null")), rows, kind=STRING)


def _from_json(kind: str, what: type):
    """A text that is written out has the types of its values; others come as texts, as no plan knows their types."""
    def f(rows, a):
        try:
            text = constant(a[0])
        except CypherError:
            return Val(F.from_json(a[0].col, kind), rows)
        if text is None:
            return _null(rows)
        from arbora.functions.expressions import literal

        try:
            got = json.loads(text)
        except ValueError as e:
            raise CypherError(f"this is no JSON: {e}") from None
        if not isinstance(got, what):
            raise CypherError(f"the JSON text holds no {what.__name__}")
        return literal(rows, got)

    return f


FUNCTIONS["apoc.convert.fromjsonmap"] = _from_json("map<string,string>", dict)
FUNCTIONS["apoc.convert.fromjsonlist"] = _from_json("array<string>", list)


@function("apoc.number.parseint")
def _parseint(rows, a):
    radix = constant(a[1]) if len(a) > 1 else 10
    s = F.trim(a[0].col)
    ok = s.rlike("^[+-]?[0-9a-zA-Z]+$")
    return Val(F.when(ok, s.try_cast("long") if radix == 10 else F.conv(s, radix, 10).try_cast("long")), rows, kind=LONG)


simple("apoc.number.parsefloat", lambda s: F.trim(s).try_cast("double"), DOUBLE)
# Roman numerals, largest first.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


@function("apoc.number.arabictoroman")
def _toroman(rows, a):
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r).alias("r")) for n, r in ROMAN])
    start = F.struct(a[0].col.cast("int").alias("left"), F.lit("").alias("out"))
    step = lambda s, x: F.struct((s["left"] % x["n"]).cast("int").alias("left"), F.concat(s["out"], F.repeat(x["r"], F.floor(s["left"] / x["n"]).cast("int"))).alias("out"))
    return Val(F.when(a[0].col.between(1, 3999), F.aggregate(table, start, step, lambda s: s["out"])), rows, kind=STRING)


@function("apoc.number.romantoarabic")
def _fromroman(rows, a):
    digits = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
    worth = lambda c: [F.when(c == k, F.lit(n)) for k, n in digits.items()]
    nums = F.transform(F.split(F.upper(a[0].col), ""), lambda c: F.coalesce(*worth(c), F.lit(0)))
    signed = F.transform(nums, lambda n, i: F.when(n < F.coalesce(F.get(nums, i + 1), F.lit(0)), -n).otherwise(n))
    return Val(F.aggregate(signed, F.lit(0), lambda s, n: s + n).cast("long"), rows, kind=LONG)


simple("apoc.number.format", lambda x, *p: F.regexp_replace(F.format_number(x.cast("double"), 3), r"\.?0+$", ""), STRING)
FUNCTIONS["apoc.create.uuid"] = FUNCTIONS["randomuuid"]
_urlsafe = lambda c: F.translate(F.regexp_replace(c, "=+$", ""), "+/", "-_")
FUNCTIONS["apoc.create.uuidbase64"] = lambda rows, a: Val(_urlsafe(F.base64(F.unhex(F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))))), rows, kind=STRING)
simple("apoc.create.uuidhextobase64", lambda s: _urlsafe(F.base64(F.unhex(F.replace(s, F.lit("-"), F.lit(""))))), STRING)
simple("apoc.create.uuidbase64tohex", lambda s: F.regexp_replace(F.lower(F.hex(F.unbase64(F.concat(F.translate(s, "-_", "+/"), F.lit("=="))))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), STRING)


def apoc_type(k) -> str:
    return {"number": "FLOAT" if v.is_float(k) else "INTEGER", "string": "STRING", "boolean": "BOOLEAN", "list": "LIST", "map": "MAP", "node": "NODE", "rel": "RELATIONSHIP", "path": "PATH", "null": "NULL",
            "date": "DATE", "datetime": "DATE_TIME", "localdatetime": "LOCAL_DATE_TIME", "duration": "DURATION", "point": "POINT", "time": "TIME"}[v.kind(k)]


FUNCTIONS["apoc.meta.type"] = lambda rows, a: Val(F.when(a[0].col.isNull(), F.lit("NULL")).otherwise(F.lit(apoc_type(a[0].type))), rows, kind=STRING)
FUNCTIONS["apoc.meta.istype"] = lambda rows, a: Val(F.when(a[0].col.isNull(), a[1].col == "NULL").otherwise(F.lit(apoc_type(a[0].type)) == a[1].col), rows, kind=BOOL)
FUNCTIONS["apoc.meta.types"] = lambda rows, a: _struct(rows, {k: F.when(c.isNull(), F.lit("NULL")).otherwise(F.lit(apoc_type(a[0].type[k].dataType))) for k, c in _fields(a[0]).items()})

# Milliseconds of the units and their other names.
UNITS_MS = {"ms": 1, "milli": 1, "millis": 1, "milliseconds": 1, "s": 1000, "second": 1000, "seconds": 1000, "m": 60_000, "minute": 60_000, "minutes": 60_000, "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000, "w": 604_800_000, "week": 604_800_000, "weeks": 604_800_000}


def _unit(x: Val) -> int:
    name = str(constant(x)).lower()
    if name not in UNITS_MS:
        raise CypherError(f"unknown unit {name}")
    return UNITS_MS[name]


FUNCTIONS["apoc.date.currenttimestamp"] = FUNCTIONS["timestamp"]
FUNCTIONS["apoc.date.toiso8601"] = lambda rows, a: Val(F.date_format(F.timestamp_millis(a[0].col * (_unit(a[1]) if len(a) > 1 else 1)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), rows, kind=STRING)
FUNCTIONS["apoc.date.fromiso8601"] = lambda rows, a: Val(F.unix_millis(F.to_timestamp(a[0].col)), rows, kind=LONG)
FUNCTIONS["apoc.date.convert"] = lambda rows, a: Val(F.call_function("div", a[0].col * _unit(a[1]), F.lit(_unit(a[2])).cast("long")), rows, kind=LONG)
FUNCTIONS["apoc.date.add"] = lambda rows, a: Val(a[0].col + F.call_function("div", a[2].col * _unit(a[3]), F.lit(_unit(a[1])).cast("long")), rows, kind=LONG)


# apoc: paths -------------------------------------------------------------------------
def _path(rows, ns, rs) -> Val:
    return Val(F.struct(ns.alias("_nodes"), rs.alias("_rels")), rows)


FUNCTIONS["apoc.path.slice"] = lambda rows, a: _path(rows, F.slice(a[0].col["_nodes"], a[1].col.cast("int") + 1, a[2].col.cast("int") + 1), F.slice(a[0].col["_rels"], a[1].col.cast("int") + 1, a[2].col.cast("int")))
FUNCTIONS["apoc.path.combine"] = lambda rows, a: Val(
    F.when(F.try_element_at(a[0].col["_nodes"], F.lit(-1))["_id"] == F.get(a[1].col["_nodes"], F.lit(0))["_id"],
           F.struct(F.concat(a[0].col["_nodes"], F.slice(a[1].col["_nodes"], F.lit(2), F.size(a[1].col["_nodes"]))).alias("_nodes"), F.concat(a[0].col["_rels"], a[1].col["_rels"]).alias("_rels"))), rows)


@function("apoc.path.create")
def _create(rows, a):
    """A path from a node along relationships; the nodes on the way are looked up once for all rows."""
    from arbora.operators.patterns import recast, uniform_type
    from arbora.plans.lower import fresh

    if rows.inside:
        raise CypherError("a path cannot be made inside a list expression")
    kinds = rows.graph.property_types("node"), rows.graph.property_types("rel")
    first = recast(a[0].col, a[0].type, kinds[0], False)
    if len(a) < 2 or v.is_null(a[1].type) or not v.is_rel(a[1].type.elementType):
        return _path(rows, F.array(first), F.array().cast(T.ArrayType(uniform_type(kinds[1], True))))
    elem, ids = a[1].type.elementType, fresh("p")
    way = F.aggregate(a[1].col, F.array(a[0].col["_id"]), lambda acc, x: F.array_append(acc, F.when(F.element_at(acc, -1) == x["_src"], x["_dst"]).otherwise(x["_src"])))
    rows.with_column(ids, way)
    rels, start = fresh("p"), fresh("p")
    rows.with_column(rels, F.transform(a[1].col, lambda x: recast(x, elem, kinds[1], True)))
    rows.with_column(start, first)
    nodes, found = rows.graph.scan_nodes([], "__m", None), fresh("p")
    nodes = nodes.select(recast(F.col("__m"), nodes.schema["__m"].dataType, kinds[0], False).alias("__m"))
    at = rows.df.select(F.col(ids).alias("__k")).distinct().select("__k", F.posexplode("__k").alias("__i", "__id")).join(nodes, F.col("__id") == F.col("__m._id"))
    listed = at.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m")), lambda x, y: x["__i"] - y["__i"]), lambda x: x["__m"]).alias(found))
    rows.df = rows.df.join(listed, F.col(ids) == F.col("__k"), "left").drop("__k")
    return _path(rows, F.coalesce(F.col(found), F.array(F.col(start))), F.coalesce(F.col(rels), F.array().cast(T.ArrayType(uniform_type(kinds[1], True)))))


@function("apoc.path.elements")
def _elements(rows, a):
    """Nodes and relationships in turn, in one shape; a node has no ``_type`` and a relationship no labels."""
    kinds = rows.graph.property_types("node"), rows.graph.property_types("rel")
    nk, rk = (a[0].type[x].dataType.elementType for x in ("_nodes", "_rels"))
    props = dict(kinds[0])
    for k, t in kinds[1].items():
        props[k] = t if k not in props or props[k] == t else widened(props[k], t)
    base = {"_id": LONG, "_labels": T.ArrayType(STRING), "_type": STRING, "_src": LONG, "_dst": LONG} | dict(sorted(props.items()))
    shaped = lambda x, kind: F.struct(*[(x[n] if n in kind.names else F.lit(None)).cast(t).alias(n) for n, t in base.items()])
    n, r = a[0].col["_nodes"], a[0].col["_rels"]
    ns, rs = F.transform(n, lambda x: shaped(x, nk)), F.transform(r, lambda x: shaped(x, rk))
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.array(F.get(rs, i), F.get(ns, i + 1))))
    return Val(F.when(F.size(r) == 0, F.slice(ns, 1, 1)).otherwise(F.concat(F.slice(ns, 1, 1), steps)), rows)
