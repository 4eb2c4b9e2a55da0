"""Expressions to columns: operators, list and map forms, property access, calls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions import temporal
from arbora.functions.scalars import FUNCTIONS
from arbora.plans import values as v
from arbora.plans.lower import AGGREGATES, CypherError, Rows, Val, col, free_vars, fresh


def literal(rows: Rows, x) -> Val:
    if isinstance(x, DataFrame):
        # A frame of one column stands for the list of its values.
        if rows.inside or rows.lambdas:
            raise CypherError("a list of rows cannot be read inside a list expression")
        name = fresh("l")
        rows.start()
        rows.df = rows.df.crossJoin(x.agg(F.collect_list(x.columns[0]).alias(name)))
        return Val(col(name), rows)
    if x is None:
        return Val(F.lit(None), rows, kind=T.NullType())
    if isinstance(x, bool):
        return Val(F.lit(x), rows, kind=T.BooleanType())
    if isinstance(x, int):
        return Val(F.lit(x).cast("long"), rows, kind=T.LongType())
    if isinstance(x, float):
        return Val(F.lit(x), rows, kind=T.DoubleType())
    if isinstance(x, str):
        return Val(F.lit(x), rows, kind=T.StringType())
    if isinstance(x, dt.datetime):
        return Val(F.lit(x).cast("timestamp" if x.tzinfo else "timestamp_ntz"), rows)
    if isinstance(x, dt.date):
        return Val(F.lit(x), rows)
    if isinstance(x, (list, tuple)):
        return array_of(rows, [literal(rows, y) for y in x])
    if isinstance(x, dict):
        return Val(F.struct(*[literal(rows, y).col.alias(k) for k, y in x.items()]) if x else F.struct(F.lit(None).alias("_none")), rows)
    raise CypherError(f"a parameter of type {type(x).__name__} is not supported")


def array_of(rows: Rows, items: list[Val]) -> Val:
    """A list literal; elements of several types are widened, numbers to floats, others to text."""
    if not items:
        return Val(F.array().cast("array<string>"), rows, kind=T.ArrayType(T.StringType()))
    kinds = [i.type for i in items if not v.is_null(i.type)]
    if not kinds:
        return Val(F.array(*[F.lit(None).cast("string") for _ in items]), rows, kind=T.ArrayType(T.StringType()))
    if all(v.is_number(k) for k in kinds) and len({v.is_float(k) for k in kinds}) > 1:
        return Val(F.array(*[i.col.cast("double") for i in items]), rows, kind=T.ArrayType(T.DoubleType()))
    families = {v.kind(k) for k in kinds}
    if len(families) > 1:
        return Val(F.array(*[FUNCTIONS["tostring"](rows, [i]).col for i in items]), rows, kind=T.ArrayType(T.StringType()))
    if families <= {"node", "rel"}:
        from arbora.operators.patterns import recast, uniform_type

        rel = families == {"rel"}
        props = rows.graph.property_types("rel" if rel else "node")
        return Val(F.array(*[recast(i.col, i.type, props, rel) for i in items]), rows, kind=T.ArrayType(uniform_type(props, rel)))
    one = kinds[0]
    return Val(F.array(*[i.col.cast(one) if v.is_null(i.type) else i.col for i in items]), rows, kind=T.ArrayType(one))


def compile_node(rows: Rows, e) -> Val:
    return globals()["_" + e[0]](rows, e)


def _lit(rows, e):
    return literal(rows, e[1])


def _param(rows, e):
    if e[1] not in rows.params:
        raise CypherError(f"parameter ${e[1]} has no value")
    return literal(rows, rows.params[e[1]])


def _var(rows, e):
    if e[1] in rows.lambdas:
        c, kind = rows.lambdas[e[1]]
        return Val(c, rows, kind=kind)
    if rows.df is None or e[1] not in rows.df.columns:
        raise CypherError(f"variable {e[1]} is not defined")
    return Val(col(e[1]), rows, kind=rows.schema_type(e[1]))


def _prop(rows, e):
    base, key = rows.compile(e[1]), e[2]
    kind = base.type
    if v.is_null(kind):
        return literal(rows, None)
    if v.is_path(kind):
        raise CypherError("a path has no properties")
    if v.is_instant(kind) or v.is_duration(kind) or v.is_point(kind) or v.is_time(kind):
        return temporal.accessor(rows, base, key)
    if isinstance(kind, T.MapType):
        return Val(F.try_element_at(base.col, F.lit(key)), rows, kind=kind.valueType)
    if isinstance(kind, T.StructType):
        if key in kind.fieldNames() and not (v.is_element(kind) and key.startswith("_")):
            return Val(base.col[key], rows, kind=kind[key].dataType)
        return literal(rows, None)
    if v.is_list(kind):
        raise CypherError("a list has no properties")
    raise CypherError(f"a {v.kind(kind)} has no property {key}")


def _idx(rows, e):
    base = rows.compile(e[1])
    if v.is_list(base.type):
        i = rows.compile(e[2]).col.cast("int")
        at = F.when(i >= 0, F.get(base.col, F.greatest(i, F.lit(0)))).otherwise(F.get(base.col, F.size(base.col) + i))
        return Val(F.when(F.size(base.col) + i < 0, F.lit(None)).otherwise(at), rows, kind=base.type.elementType)
    if e[2][0] == "lit" and isinstance(e[2][1], str):
        return _prop(rows, ("prop", e[1], e[2][1]))
    if e[2][0] == "param" and isinstance(rows.params.get(e[2][1]), str):
        return _prop(rows, ("prop", e[1], rows.params[e[2][1]]))
    key = rows.compile(e[2])
    if isinstance(base.type, T.MapType):
        return Val(F.try_element_at(base.col, key.col), rows, kind=base.type.valueType)
    if isinstance(base.type, T.StructType):
        names = [f.name for f in base.type if not f.name.startswith("_")]
        if not names:
            return literal(rows, None)
        same = len({base.type[n].dataType for n in names}) == 1
        out = None
        for n in names:
            x = base.col[n] if same else base.col[n].cast("string")
            out = F.when(key.col == n, x) if out is None else out.when(key.col == n, x)
        return Val(out, rows)
    if v.is_null(base.type):
        return literal(rows, None)
    raise CypherError("only lists and maps have elements")


def _slice(rows, e):
    base = rows.compile(e[1])
    n = F.size(base.col)
    bound = lambda x, other: other if x is None else rows.compile(x).col.cast("int")
    fixed = lambda i: F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))
    a, b = fixed(bound(e[2], F.lit(0))), fixed(bound(e[3], n))
    return Val(F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.slice(base.col, a + 1, F.greatest(b - a, F.lit(0)))), rows, kind=base.type)


def _un(rows, e):
    x = rows.compile(e[2])
    if e[1] == "NOT":
        _boolean(x)
        return Val(~x.col.cast("boolean"), rows, kind=T.BooleanType())
    if v.is_duration(x.type):
        return temporal.scaled(rows, x, F.lit(-1.0))
    return Val(-x.col, rows, kind=x.type)


def _boolean(x: Val) -> None:
    if not isinstance(x.type, (T.BooleanType, T.NullType)):
        raise CypherError("a boolean is needed")


def _bin(rows, e):
    op, a, b = e[1], rows.compile(e[2]), rows.compile(e[3])
    if op in ("AND", "OR", "XOR"):
        _boolean(a)
        _boolean(b)
        x, y = a.col.cast("boolean"), b.col.cast("boolean")
        return Val({"AND": lambda: x & y, "OR": lambda: x | y, "XOR": lambda: x != y}[op](), rows, kind=T.BooleanType())
    if op in ("=", "<>"):
        same = v.equal(a.col, a.type, b.col, b.type, _number(rows, e[2]) or _number(rows, e[3]))
        return Val(same if op == "=" else ~same, rows, kind=T.BooleanType())
    if op in ("<", "<=", ">", ">="):
        if _number(rows, e[2]) and not _number(rows, e[3]):
            a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
            return Val(v.less(a.col, a.type, b.col, b.type, op, True), rows, kind=T.BooleanType())
        return Val(v.less(a.col, a.type, b.col, b.type, op, _number(rows, e[3])), rows, kind=T.BooleanType())
    if op == "IN":
        if not v.is_list(b.type) and not v.is_null(b.type):
            raise CypherError("IN needs a list")
        return Val(v.member(a.col, a.type, b.col, b.type), rows, kind=T.BooleanType())
    if op in ("STARTS", "ENDS", "CONTAINS", "=~"):
        if not (v.is_string(a.type) and v.is_string(b.type)):
            return Val(F.lit(None).cast("boolean"), rows, kind=T.BooleanType())
        out = {
            "STARTS": lambda: F.startswith(a.col, b.col), "ENDS": lambda: F.endswith(a.col, b.col), "CONTAINS": lambda: F.contains(a.col, b.col),
            "=~": lambda: F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))),
        }[op]()
        return Val(out, rows, kind=T.BooleanType())
    return arithmetic(rows, op, a, b)


def _number(rows: Rows, e) -> bool:
    """Whether an expression is a number that is written out or a parameter, and no NaN."""
    x = e[1] if e[0] == "lit" else rows.params.get(e[1]) if e[0] == "param" else None
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x


def arithmetic(rows: Rows, op: str, a: Val, b: Val) -> Val:
    ta, tb = a.type, b.type
    if v.is_null(ta) and v.is_null(tb):
        return literal(rows, None)
    if temporal.is_temporal(ta) or temporal.is_temporal(tb):
        return temporal.arithmetic(rows, op, a, b)
    if op == "+" and (v.is_list(ta) or v.is_list(tb)):
        if v.is_list(ta) and v.is_list(tb):
            same = ta.elementType == tb.elementType
            return Val(F.concat(a.col, b.col if same else b.col.cast(ta)), rows, kind=ta)
        if v.is_list(ta):
            return Val(F.array_append(a.col, b.col.cast(ta.elementType) if not isinstance(ta.elementType, T.StructType) else b.col), rows, kind=ta)
        return Val(F.array_prepend(b.col, a.col.cast(tb.elementType) if not isinstance(tb.elementType, T.StructType) else a.col), rows, kind=tb)
    if op == "+" and (v.is_string(ta) or v.is_string(tb)):
        if not (v.is_string(ta) or v.is_null(ta)) or not (v.is_string(tb) or v.is_null(tb)):
            raise CypherError("text and a number do not add; use toString")
        return Val(F.concat(a.col, b.col), rows, kind=T.StringType())
    for t in (ta, tb):
        if not (v.is_number(t) or v.is_null(t)):
            raise CypherError(f"{op} needs numbers")
    ints = not v.is_float(ta) and not v.is_float(tb)
    kind = T.LongType() if ints else T.DoubleType()
    x, y = a.col.cast(kind), b.col.cast(kind)
    if op in ("+", "-", "*"):
        return Val({"+": x + y, "-": x - y, "*": x * y}[op], rows, kind=kind)
    if op == "^":
        return Val(F.pow(x.cast("double"), y.cast("double")), rows, kind=T.DoubleType())
    if ints:
        return Val(_div(x, y) if op == "/" else x % y, rows, kind=kind)
    if op == "/":
        inf = F.lit(float("inf"))
        zero = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).when(x > 0, inf).otherwise(-inf)
        return Val(F.when(y == 0, zero).otherwise(x / y), rows, kind=kind)
    return Val(F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(x % y), rows, kind=kind)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _isnull(rows, e):
    x = rows.compile(e[1])
    return Val(x.col.isNull() if e[2] else x.col.isNotNull(), rows, kind=T.BooleanType())


def _label(rows, e):
    x = rows.compile(e[1])
    if v.is_rel(x.type):
        out = F.lit(True)
        for n in e[2]:
            out = out & (x.col["_type"] == n)
        return Val(F.when(x.col.isNotNull(), out), rows, kind=T.BooleanType())
    if v.is_null(x.type):
        return literal(rows, None)
    out = F.lit(True)
    for n in e[2]:
        out = out & F.array_contains(x.col["_labels"], n)
    return Val(F.when(x.col.isNotNull(), out), rows, kind=T.BooleanType())


def _list(rows, e):
    return array_of(rows, [rows.compile(x) for x in e[1]])


def _map(rows, e):
    if not e[1]:
        return Val(F.create_map().cast("map<string,string>"), rows, kind=T.MapType(T.StringType(), T.StringType()))
    return Val(F.struct(*[rows.compile(x).col.alias(k) for k, x in e[1].items()]), rows)


def _mapproj(rows, e):
    base = rows.compile(e[1])
    fields: dict[str, Column] = {}
    for k, x in e[2]:
        if k == "*":
            fields |= {f.name: base.col[f.name] for f in base.type if not f.name.startswith("_")}
        else:
            fields[k] = rows.compile(x).col
    return Val(F.when(base.col.isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()])), rows)


def _case(rows, e):
    results = [rows.compile(t) for _, t in e[2]] + ([rows.compile(e[3])] if e[3] is not None else [])
    kinds = [r.type for r in results if not v.is_null(r.type)]
    to = T.DoubleType() if kinds and all(v.is_number(k) for k in kinds) and any(v.is_float(k) for k in kinds) else None
    if kinds and len({v.kind(k) for k in kinds}) > 1:
        results = [FUNCTIONS["tostring"](rows, [r]) for r in results]
        kinds = [T.StringType()]
    operand = rows.compile(e[1]) if e[1] is not None else None
    out = None
    for (w, _), r in zip(e[2], results, strict=False):
        when = rows.compile(w)
        test = when.col.cast("boolean") if operand is None else v.equal(operand.col, operand.type, when.col, when.type)
        c = r.col.cast(to) if to else r.col
        out = F.when(test, c) if out is None else out.when(test, c)
    if e[3] is not None:
        c = results[-1].col
        out = out.otherwise(c.cast(to) if to else c)
    return Val(out, rows, kind=to or (kinds[0] if kinds else T.NullType()))


# forms with a variable of their own ---------------------------------------------
def _typed(rows: Rows, names: dict[str, object], bodies: list) -> list:
    """Types of bodies with the names bound to values of given types."""
    if rows.inside:
        return [rows.memo[id(b)] for b in bodies]
    before = dict(rows.lambdas)
    rows.lambdas |= {n: (F.lit(None).cast(k), k) for n, k in names.items()}
    try:
        return [rows.compile(b).type for b in bodies]
    finally:
        rows.lambdas = before


def _within(rows: Rows, names: dict[str, tuple[Column, object]], body) -> Column:
    before = dict(rows.lambdas)
    rows.lambdas |= names
    rows.inside += 1
    try:
        return rows.compile(body).col
    finally:
        rows.inside -= 1
        rows.lambdas = before


def _source(rows: Rows, e) -> Val:
    x = rows.compile(e)
    if v.is_null(x.type):
        return Val(F.lit(None).cast("array<string>"), rows, kind=T.ArrayType(T.StringType()))
    if not v.is_list(x.type):
        raise CypherError("a list is needed")
    return x


def _has_subquery(e) -> bool:
    if isinstance(e, dict):
        return any(map(_has_subquery, e.values()))
    if isinstance(e, (list, tuple)):
        return bool(isinstance(e, tuple) and e and e[0] in ("sub", "patcomp", "pattern")) or any(map(_has_subquery, e))
    return False


def _unrolled(rows: Rows, var: str, x: Val, where, body) -> Val:
    """A list comprehension that holds subqueries: a row for each item of each row's list, computed
    together and gathered again."""
    if rows.inside or rows.lambdas:
        raise CypherError("a subquery cannot stand two lists deep")
    from arbora.operators.staging import staged

    # Rows are numbered and staged, as a list that is collected anew may come in another order.
    number, items, place, out = fresh("k"), fresh("x"), fresh("i"), fresh("l")
    rows.df = rows.df.select(*[(col(f.name).cast("string") if v.is_null(f.dataType) else col(f.name)).alias(f.name) for f in rows.df.schema], x.col.alias(items), F.monotonically_increasing_id().alias(number))
    rows.df = staged(rows.df, rows.graph.spark)
    shared = [s for s in rows.scope if s != var and s in free_vars((where, body))]
    each = rows.df.select(number, *[col(s) for s in shared], F.posexplode(items).alias(place, var))
    inner = rows.child(each, [*shared, var], [number, place])
    if where is not None:
        inner.filter(where)
    value = inner.compile(body if body is not None else ("var", var))
    kind = T.ArrayType(value.type)
    got = inner.df.select(F.col(number).alias(place + "n"), F.struct(col(place).alias("i"), value.col.alias("x")).alias(place)).groupBy(place + "n").agg(
        F.transform(F.array_sort(F.collect_list(place), lambda a, b: a["i"] - b["i"]), lambda p: p["x"]).alias(out))
    rows.df = rows.df.join(got, F.col(number) == F.col(place + "n"), "left").drop(place + "n", number)
    return Val(F.when(col(items).isNotNull(), F.coalesce(col(out), F.array().cast(kind))), rows, kind=kind)


def _lcomp(rows, e):
    _, var, source, where, body = e
    x = _source(rows, source)
    if _has_subquery((where, body)):
        return _unrolled(rows, var, x, where, body)
    elem = x.type.elementType
    out = x.col
    if where is not None:
        _typed(rows, {var: elem}, [where])
        out = F.filter(out, lambda y: _within(rows, {var: (y, elem)}, where).cast("boolean"))
    if body is None:
        return Val(out, rows, kind=x.type)
    kind = _typed(rows, {var: elem}, [body])[0]
    return Val(F.transform(out, lambda y: _within(rows, {var: (y, elem)}, body)), rows, kind=T.ArrayType(kind))


def _quant(rows, e):
    _, how, var, source, where = e
    x = _source(rows, source)
    elem = x.type.elementType
    if _has_subquery(where):
        x = _unrolled(rows, var, x, None, where)
        test = lambda y: y.cast("boolean")
    else:
        _typed(rows, {var: elem}, [where])
        test = lambda y: _within(rows, {var: (y, elem)}, where).cast("boolean")
    if how == "any":
        out = F.exists(x.col, test)
    elif how == "all":
        out = F.forall(x.col, test)
    elif how == "none":
        out = ~F.exists(x.col, test)
    else:
        hits = F.size(F.filter(x.col, test))
        open_ones = F.exists(x.col, lambda y: test(y).isNull())
        out = F.when(hits > 1, F.lit(False)).when(open_ones, F.lit(None).cast("boolean")).otherwise(hits == 1)
    return Val(F.when(x.col.isNull(), F.lit(False)).otherwise(out), rows, kind=T.BooleanType())


def _reduce(rows, e):
    _, acc, init, var, source, body = e
    x, start = _source(rows, source), rows.compile(init)
    elem = x.type.elementType
    kind = _typed(rows, {acc: start.type, var: elem}, [body])[0]
    if kind != start.type and not rows.inside:
        kind = _typed(rows, {acc: kind, var: elem}, [body])[0]
    begin = start.col.cast(kind) if kind != start.type else start.col
    out = F.aggregate(x.col, begin, lambda a, y: _within(rows, {acc: (a, kind), var: (y, elem)}, body))
    return Val(out, rows, kind=kind)


# subqueries ------------------------------------------------------------------------
def _pattern(rows, e):
    return Val(rows.sub_column(e, "exists")[0], rows, kind=T.BooleanType())


def _sub(rows, e):
    c, kind = rows.sub_column(e, e[1])
    return Val(c, rows, kind=kind or (T.LongType() if e[1] == "count" else T.BooleanType()))


def _patcomp(rows, e):
    c, kind = rows.sub_column(e, "collect", e[3])
    return Val(c, rows, kind=kind)


def _call(rows, e):
    name, args = e[1], e[3]
    if name in AGGREGATES:
        raise CypherError(f"{name} cannot stand here")
    if name == "exists" and args and args[0][0] == "pattern":
        return _pattern(rows, args[0])
    f = FUNCTIONS.get(name) or temporal.FUNCTIONS.get(name)
    if f is None:
        raise CypherError(f"unknown function {name}")
    return f(rows, [rows.compile(a) for a in args])
