"""Lowering: each clause of a query becomes a DataFrame transformation.

Every bound variable is one column. Patterns become joins between the current
rows, relationship tables and node tables; OPTIONAL MATCH, EXISTS, COUNT and
COLLECT become joins with a body computed once for all rows (keyed on what it
shares with them) instead of once per row. Which properties and elements a query
reads is known before a scan is made, so scans stay narrow, and a node of which
only the identity is read is taken from the relationship table.
"""

from __future__ import annotations

import contextlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans import values as v
from arbora.plans.parser import parse


class CypherError(ValueError):
    """A query that parses but has no meaning here."""


_fresh = itertools.count()


def fresh(prefix: str) -> str:
    return f"__{prefix}{next(_fresh)}"


#: Hidden column of the place of a row after WITH … ORDER BY.
ORDER = "__order"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two frames with the same columns; where the types differ both take a common one."""
    from arbora.operators.patterns import recast
    from arbora.sources.graph import widened

    def common(x, y):
        if x == y:
            return x
        if v.is_list(x) and v.is_list(y):
            return T.ArrayType(common(x.elementType, y.elementType))
        return widened(x, y)

    left, right = [], []
    for name in a.columns:
        x, y = a.schema[name].dataType, b.schema[name].dataType
        if x != y and v.is_element(x) and v.is_element(y) and v.is_rel(x) == v.is_rel(y):
            props: dict = {}
            for f in (*x, *y):
                if not f.name.startswith("_"):
                    props[f.name] = f.dataType if f.name not in props else common(props[f.name], f.dataType)
            left.append(recast(col(name), x, props, v.is_rel(x)).alias(name))
            right.append(recast(col(name), y, props, v.is_rel(x)).alias(name))
        else:
            to = common(x, y)
            cast = lambda kind, to=to, name=name: (F.to_json(col(name)) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and isinstance(to, T.StringType) else col(name).cast(to)).alias(name)
            left.append(cast(x) if x != to else col(name))
            right.append(cast(y) if y != to else col(name))
    return a.select(*left).union(b.select(*right))


# what a query reads -----------------------------------------------------------
@dataclass
class Needs:
    whole: set[str] = field(default_factory=set)
    props: dict[str, set[str]] = field(default_factory=dict)
    labels: set[str] = field(default_factory=set)

    def of(self, var: str) -> set[str] | None:
        return None if var in self.whole else self.props.get(var, set())

    def light(self, var: str) -> bool:
        return var not in self.whole and not self.props.get(var) and var not in self.labels

    def within(self, body: Needs, shared: set[str]) -> Needs:
        """Needs inside a body that stands alone: of what it shares, only what it reads itself."""
        pick = lambda mine, own: {x for x in mine if x not in shared} | {x for x in own if x in shared}
        props = {k: p for k, p in self.props.items() if k not in shared} | {k: p for k, p in body.props.items() if k in shared}
        return Needs(pick(self.whole, body.whole), props, pick(self.labels, body.labels))


_ID_ONLY = {"id", "elementid", "count"}


def read_by(tree, needs: Needs | None = None) -> Needs:
    """Walk a statement and note which variables are read whole and which properties of others."""
    needs = needs or Needs()

    def walk(x) -> None:
        if isinstance(x, dict):
            if x.get("kind") == "with":
                for e, alias, _ in x["items"]:
                    if not (e[0] == "var" and alias in (None, e[1])):
                        walk(e)
                for k in ("order", "skip", "limit", "where"):
                    walk(x[k])
                return
            if x.get("kind") == "procedure":
                walk(x["args"])
                walk(x["where"])
                return
            if x.get("kind") == "return" and x["star"]:
                needs.whole.add("*")
            if x.get("kind") in ("set", "remove", "delete", "foreach", "merge", "create"):
                needs.whole.add("*")
            if "nodes" in x and "rels" in x:
                if x["path"]:
                    for e in (*x["nodes"], *x["rels"]):
                        if e["var"]:
                            needs.whole.add(e["var"])
                for e in (*x["nodes"], *x["rels"]):
                    walk(e["props"])
                    if e["props"] is not None and e["var"] and e["props"][0] == "map":
                        needs.props.setdefault(e["var"], set()).update(e["props"][1])
                return
            for y in x.values():
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, tuple) and x and not isinstance(x[0], str):
            for y in x:
                walk(y)
        elif isinstance(x, tuple) and x:
            if x[0] == "prop" and isinstance(x[1], tuple) and x[1][0] == "var":
                needs.props.setdefault(x[1][1], set()).add(x[2])
            elif x[0] == "label" and x[1][0] == "var":
                needs.labels.add(x[1][1])
            elif x[0] == "call" and x[1] in _ID_ONLY and x[3] and all(a[0] == "var" for a in x[3]):
                pass
            elif x[0] == "call" and x[1] in ("labels", "type") and x[3] and x[3][0][0] == "var":
                needs.labels.add(x[3][0][1])
            elif x[0] == "isnull" and x[1][0] == "var" or x[0] == "bin" and x[1] in ("=", "<>") and x[2][0] == "var" == x[3][0]:
                pass
            elif x[0] == "var":
                needs.whole.add(x[1])
            elif x[0] == "map":
                for y in x[1].values():
                    walk(y)
            else:
                for y in x[1:]:
                    walk(y)

    walk(tree)
    return needs


def free_vars(tree) -> set[str]:
    """Names that a tree mentions, as expressions or in patterns."""
    out: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, dict):
            if isinstance(x.get("var"), str):
                out.add(x["var"])
            for y in x.values():
                walk(y)
        elif isinstance(x, (list, tuple)):
            if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
                out.add(x[1])
                return
            for y in x:
                walk(y)

    walk(tree)
    return out


AGGREGATES = {
    "count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentiledisc", "percentilecont",
    "apoc.agg.first", "apoc.agg.last", "apoc.agg.nth", "apoc.agg.median", "apoc.agg.product",
}


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        if e and e[0] == "call" and e[1] in AGGREGATES:
            return True
        if e and e[0] == "sub":
            return False
        return any(has_aggregate(x) for x in e)
    if isinstance(e, list):
        return any(has_aggregate(x) for x in e)
    if isinstance(e, dict):
        return any(has_aggregate(x) for x in e.values())
    return False


def substituted(e, swap: list[tuple]):
    """``e`` with every subtree equal to a first item replaced by its second."""
    for old, new in swap:
        if e == old:
            return new
    if isinstance(e, tuple):
        return tuple(substituted(x, swap) for x in e)
    if isinstance(e, list):
        return [substituted(x, swap) for x in e]
    if isinstance(e, dict):
        return {k: substituted(x, swap) for k, x in e.items()}
    return e


def conjuncts(e) -> list:
    if e is None:
        return []
    if e[0] == "bin" and e[1] == "AND":
        return conjuncts(e[2]) + conjuncts(e[3])
    return [e]


def has_kind(tree, kinds: tuple[str, ...]) -> bool:
    """Whether a clause of one of the kinds stands anywhere in a tree."""
    if isinstance(tree, dict):
        return tree.get("kind") in kinds or any(has_kind(x, kinds) for x in tree.values())
    return isinstance(tree, (list, tuple)) and any(has_kind(x, kinds) for x in tree)


class Val:
    """A compiled expression: its column and, when asked for, its static type."""

    __slots__ = ("col", "node", "_type", "rows")

    def __init__(self, column: Column, rows: Rows, node=None, kind=None):
        self.col, self.rows, self.node, self._type = column, rows, node, kind

    @property
    def type(self):
        if self._type is None:
            self._type = self.rows.type_of(self)
        return self._type


class Rows:
    """The rows of a query so far: a DataFrame, its variables, and what to carry along."""

    def __init__(self, graph, params: dict, needs: Needs, df: DataFrame | None = None, scope: list[str] | None = None, carry: list[str] | None = None):
        self.graph, self.params, self.needs = graph, params, needs
        self.df, self.scope, self.carry = df, list(scope or []), list(carry or [])
        #: Labels that variables are known to carry.
        self.known: dict[str, set[str]] = {}
        self.lambdas: dict[str, tuple[Column, object]] = {}
        self.memo: dict[int, object] = {}
        self.keep: list = []
        self.inside = 0
        self.seeds: DataFrame | None = None
        self.wrote = False
        #: Whether all elements in the rows are from the graph as it is now.
        self.steady = False

    # types ----------------------------------------------------------------------
    def type_of(self, value: Val):
        if value.node is not None and id(value.node) in self.memo:
            return self.memo[id(value.node)]
        if self.inside:
            raise CypherError("the type of a part of a list expression cannot be told")
        base = self.df if self.df is not None else self.graph.spark.range(1)
        kind = base.select(value.col.alias("x")).schema[0].dataType
        return kind

    def schema_type(self, name: str):
        return self.df.schema[name].dataType

    def compile(self, e) -> Val:
        from arbora.functions import expressions

        out = expressions.compile_node(self, e)
        out.node = e
        self.keep.append(e)  # ids stay unique while the tree lives
        if not self.inside:
            if self.lambdas:
                self.memo[id(e)] = out.type
        elif id(e) in self.memo:
            out._type = self.memo[id(e)]
        return out

    def child(self, df=None, scope=None, carry=None) -> Rows:
        out = Rows(self.graph, self.params, self.needs, df, scope, carry)
        out.steady = self.steady
        return out

    def with_column(self, name: str, column: Column) -> None:
        self.df = self.df.withColumn(name, column)

    def start(self) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select(F.lit(1).alias("__one")).drop("__one")
            self.df = self.graph.spark.range(1).withColumnRenamed("id", "__unit")

    # filters ----------------------------------------------------------------------
    def filter(self, e) -> None:
        for part in conjuncts(e):
            negated = part[0] == "un" and part[1] == "NOT"
            inner = part[2] if negated else part
            if inner[0] == "pattern" or (inner[0] == "sub" and inner[1] == "exists"):
                self.semi(inner, negated)
            else:
                test = self.compile(part)
                if not isinstance(test.type, (T.BooleanType, T.NullType)):
                    raise CypherError("a predicate must be boolean")
                self.df = self.df.where(test.col.cast("boolean"))

    def semi(self, e, negated: bool) -> None:
        """Pattern predicates and EXISTS in a conjunction: a semi or an anti join."""
        body, keys = self.body_of(e)
        if not keys:
            n = body.limit(1).select(F.lit(1).alias("__hit"))
            self.df = self.df.join(n, how="left_anti" if negated else "left_semi", on=F.lit(True))
            return
        names = [fresh("k") for _ in keys]
        self.df = self.df.join(body.select(*[col(b).alias(n) for (_, b), n in zip(keys, names, strict=True)]).distinct() if negated else body.select(*[col(b).alias(n) for (_, b), n in zip(keys, names, strict=True)]),
                               on=self._on(keys, names), how="left_anti" if negated else "left_semi")

    @staticmethod
    def _on(keys, names) -> Column:
        out = None
        for (outer, _), n in zip(keys, names, strict=True):
            c = outer == col(n)
            out = c if out is None else out & c
        return out

    # correlated bodies ------------------------------------------------------------
    def body_of(self, e, select=None) -> tuple[DataFrame, list[tuple[Column, str]]]:
        """Rows of a subquery for all outer rows, and its keys: (outer column, body column).

        A body of one MATCH that shares nothing but nodes of its pattern is
        computed on its own and keyed on their ids. Any other body starts from
        the distinct values of what it shares.
        """
        if e[0] == "pattern":
            clauses = [{"kind": "match", "optional": False, "patterns": [e[1]], "where": None}]
        elif e[0] == "patcomp":
            clauses = [{"kind": "match", "optional": False, "patterns": [e[1]], "where": e[2]}]
        else:
            clauses = e[2]["parts"][0]
        union = e[2] if e[0] == "sub" else None
        shared = [s for s in self.scope if s in free_vars(clauses if union is None else union) | (free_vars(select) if select is not None else set())]
        plain = len(clauses) == 1 and clauses[0]["kind"] == "match" and not clauses[0]["optional"] and (union is None or len(union["parts"]) == 1)
        in_pattern = {n["var"] for c in clauses if c["kind"] == "match" for p in c["patterns"] for n in p["nodes"]} if plain else set()
        if plain and all(s in in_pattern and v.is_node(self.schema_type(s)) for s in shared):
            inner = self.child()
            inner.needs = self.needs.within(read_by((clauses, select)), set(shared))
            inner.match(clauses[0])
            keys = []
            for s in shared:
                k = fresh("c")
                inner.with_column(k, col(s)["_id"])
                keys.append((col(s)["_id"], k))
            inner.carry = [k for _, k in keys]
            return self._selected(inner, select), keys
        cols, keys = [], []
        for s in shared:
            k = fresh("c")
            kind = self.schema_type(s)
            outer = col(s)["_id"] if v.is_element(kind) else col(s)
            cols.append(outer.alias(k))
            keys.append((outer, k))
        seeds = self.df.select(*[col(s) for s in shared], *cols).dropDuplicates([k for _, k in keys]) if shared else None
        if seeds is not None:
            for _, k in keys:
                seeds = seeds.where(col(k).isNotNull())
        outs = []
        for part in [clauses] if union is None else union["parts"]:
            inner = self.child(seeds, shared, [k for _, k in keys])
            inner.seeds = seeds
            inner.run(part)
            outs.append(self._selected(inner, select))
        df = outs[0]
        for other in outs[1:]:
            df = united(df, other)
        if union is not None and len(outs) > 1 and not union["all"]:
            df = df.distinct()
        return df, keys

    @staticmethod
    def _selected(inner: Rows, select) -> DataFrame:
        if select is None:
            return inner.df
        got = inner.compile(select)
        return inner.df.select(*[col(k) for k in inner.carry], got.col.alias("__value"))

    def sub_column(self, e, how: str, select=None) -> tuple[Column, object]:
        """Join the result of a correlated subquery and return it as a column."""
        if self.inside or self.lambdas:
            raise CypherError("a subquery cannot stand inside a list expression")
        body, keys = self.body_of(e, select)
        name = fresh("s")
        if how == "exists":
            agg = F.lit(True).alias(name)
        elif how == "count":
            agg = F.count(F.lit(1)).alias(name)
        else:
            if "__value" not in body.columns:
                own = [c for c in body.columns if c not in {k for _, k in keys} and not c.startswith("__")]
                if len(own) != 1:
                    raise CypherError("COLLECT needs exactly one column")
                body = body.withColumnRenamed(own[0], "__value")
            agg = F.collect_list("__value").alias(name)
        kind = T.ArrayType(body.schema["__value"].dataType) if how == "collect" else None
        if not keys:
            self.df = self.df.crossJoin(body.limit(1).agg(F.count(F.lit(1)).alias(name)).select((col(name) > 0).alias(name)) if how == "exists" else body.agg(agg))
            return col(name), kind
        names = [fresh("k") for _ in keys]
        grouped = body.groupBy(*[col(b).alias(n) for (_, b), n in zip(keys, names, strict=True)])
        got = grouped.agg(F.first(F.lit(True)).alias(name)) if how == "exists" else grouped.agg(agg)
        self.df = self.df.join(got, on=self._on(keys, names), how="left").drop(*names)
        if how == "exists":
            return F.coalesce(col(name), F.lit(False)), None
        if how == "count":
            return F.coalesce(col(name), F.lit(0)).cast("long"), None
        return F.coalesce(col(name), F.array().cast(kind)), kind

    # clauses ------------------------------------------------------------------------
    def run(self, clauses: list[dict]) -> None:
        for c in clauses:
            getattr(self, "do_" + c["kind"])(c)

    def do_match(self, c: dict) -> None:
        if c["optional"]:
            self.optional(c)
        else:
            self.match(c)

    def match(self, c: dict) -> None:
        from arbora.operators.patterns import match_pattern

        used: list[tuple[str, list[str]]] = []
        for p in c["patterns"]:
            match_pattern(self, p, used)
        if c["where"] is not None:
            self.filter(c["where"])
        hidden = [x for x in self.df.columns if x.startswith("__") and x not in self.carry and x != "__unit"]
        if hidden:
            self.df = self.df.drop(*hidden)

    def optional(self, c: dict) -> None:
        if self.df is None:
            self.start()
        names = {e["var"] for p in c["patterns"] for e in (*p["nodes"], *p["rels"]) if e["var"]} | {p["path"] for p in c["patterns"] if p["path"]}
        new = [n for n in sorted(names) if n not in self.scope]
        e = ("sub", "rows", {"kind": "union", "all": True, "parts": [[c | {"optional": False}]]})
        body, keys = self.body_of(e)
        ks = [fresh("k") for _ in keys]
        body = body.select(*[col(b).alias(k) for (_, b), k in zip(keys, ks, strict=True)], *[col(n) for n in new])
        self.df = self.df.join(body, on=self._on(keys, ks) if keys else F.lit(True), how="left").drop(*ks)
        self.scope += new

    def do_unwind(self, c: dict) -> None:
        self.start()
        if c["expr"][0] == "param" and isinstance(given := self.params.get(c["expr"][1]), DataFrame):
            # The rows of a frame are no list: they are joined as they are.
            self.df = self.df.drop(c["var"]).crossJoin(given.select(col(given.columns[0]).alias(c["var"])))
            self.scope = [s for s in self.scope if s != c["var"]] + [c["var"]]
            return
        e = self.compile(c["expr"])
        if v.is_null(e.type):
            self.df = self.df.where(F.lit(False)).withColumn(c["var"], F.lit(None).cast("string"))
        elif not v.is_list(e.type):
            raise CypherError("UNWIND needs a list")
        else:
            x = fresh("u")
            kept = [k for k in self.df.columns if k != c["var"]]
            self.df = self.df.select(*[col(k) for k in kept], F.explode(e.col).alias(x)).withColumnRenamed(x, c["var"])
        if c["var"] not in self.scope:
            self.scope.append(c["var"])

    def do_with(self, c: dict) -> None:
        self.projection(c)
        if c["order"] and not self.carry:
            # Row ids rise along a global sort: what reads rows in order needs no other key.
            self.with_column(ORDER, F.monotonically_increasing_id())
        if c["where"] is not None:
            self.filter(c["where"])

    def do_return(self, c: dict) -> None:
        self.projection(c)

    def projection(self, c: dict) -> None:
        self.start()
        items = [(("var", s), s, s) for s in self.scope] if c["star"] else []
        items += c["items"]
        named = [(e, alias or (e[1] if e[0] == "var" else text)) for e, alias, text in items]
        if c["star"] and not named:
            raise CypherError("there is no variable to project")
        self.known = {name: self.known[e[1]] for e, name in named if e[0] == "var" and e[1] in self.known}
        if any(has_aggregate(e) for e, _ in named):
            self.aggregate(named, c)
            return
        outs = [(name, self.compile(e)) for e, name in named]
        swap = [(("var", name), e) for e, name in named]
        hidden = []
        if c["order"] and not c["distinct"]:
            for e, down in c["order"]:
                hidden.append((fresh("o"), self.compile(substituted(e, swap)), down))
        # The order of an earlier ORDER BY stays known for aggregates that depend on it.
        order = [col(ORDER)] if ORDER in self.df.columns and not c["distinct"] and not c["order"] else []
        self.df = self.df.select(*[col(k) for k in self.carry], *order, *[o.col.alias(n) for n, o in outs], *[h.col.alias(n) for n, h, _ in hidden])
        self.scope = [n for n, _ in outs]
        if c["distinct"]:
            self.distinct()
            back = [(e, ("var", name)) for e, name in named]
            for e, down in c["order"]:
                x = self.compile(substituted(e, back))
                name = fresh("o")
                self.with_column(name, x.col)
                hidden.append((name, x, down))
        self.order_and_cut(hidden, c)

    def distinct(self) -> None:
        keys, temps = list(self.carry), []
        for s in self.scope:
            kind = self.schema_type(s)
            if v.is_element(kind):
                t = fresh("d")
                self.with_column(t, col(s)["_id"])
                keys.append(t)
                temps.append(t)
            else:
                keys.append(s)
        self.df = self.df.dropDuplicates(["`" + k + "`" if "." in k else k for k in keys]) if not any("." in k for k in keys) else self._drop_dotted(keys)
        if temps:
            self.df = self.df.drop(*temps)

    def _drop_dotted(self, keys: list[str]) -> DataFrame:
        names = self.df.columns
        plain = self.df.toDF(*[f"__x{i}" for i in range(len(names))])
        out = plain.dropDuplicates([f"__x{names.index(k)}" for k in keys])
        return out.toDF(*names)

    def order_and_cut(self, hidden: list, c: dict) -> None:
        sort = [(col(n).desc_nulls_first() if down else col(n).asc_nulls_last()) for n, _, down in hidden]
        skip, limit = self.count_of(c["skip"], "SKIP"), self.count_of(c["limit"], "LIMIT")
        if self.carry and (skip is not None or limit is not None):
            # Per outer row of a correlated body.
            n = fresh("r")
            w = W.partitionBy(*[col(k) for k in self.carry]).orderBy(*(sort or [F.lit(0)]))
            self.with_column(n, F.row_number().over(w))
            if skip:
                self.df = self.df.where(col(n) > skip)
            if limit is not None:
                self.df = self.df.where(col(n) <= limit + (skip or 0))
            self.df = self.df.drop(n)
        else:
            if sort:
                self.df = self.df.orderBy(*sort)
            if skip:
                self.df = self.df.offset(skip)
            if limit is not None:
                self.df = self.df.limit(limit)
        if hidden:
            self.df = self.df.drop(*[n for n, _, _ in hidden])

    def count_of(self, e, what: str) -> int | None:
        if e is None:
            return None
        n = self.known_value(e)
        n = 0 if n is None else n
        if not isinstance(n, int) or n < 0:
            raise CypherError(f"{what} needs an integer of 0 or more")
        return n

    def known_value(self, e):
        """What an expression without variables comes to."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params.get(e[1])
        return self.graph.spark.range(1).select(Rows(self.graph, self.params, self.needs).compile(e).col.alias("n")).first().n

    def aggregate(self, named: list, c: dict) -> None:
        from arbora.functions.aggregates import lower_aggregate

        keys = [(e, name) for e, name in named if not has_aggregate(e)]
        found: list[tuple] = []

        def pull(e):
            if isinstance(e, tuple):
                if e and e[0] == "call" and e[1] in AGGREGATES:
                    if any(has_aggregate(a) for a in e[3] or []):
                        raise CypherError("aggregates cannot be nested")
                    for old, name in found:
                        if old == e:
                            return ("var", name)
                    found.append((e, fresh("a")))
                    return ("var", found[-1][1])
                return tuple(pull(x) for x in e)
            if isinstance(e, list):
                return [pull(x) for x in e]
            if isinstance(e, dict):
                return {k: pull(x) for k, x in e.items()}
            return e

        posts = [(pull(e), name) for e, name in named]
        orders = [(pull(substituted(e, [(x, ("var", n)) for x, n in named])), down) for e, down in c["order"]]
        # Everything grouped by or aggregated is computed first, so subqueries join before the grouping.
        kcols = [(fresh("g"), self.compile(e), e, name) for e, name in keys]
        args = []
        for e, name in found:
            args.append((name, e, [self.compile(a) for a in (e[3] or [])]))
        pre = [k.col.alias(n) for n, k, _, _ in kcols]
        group, firsts, back = [], [], []
        for n, k, e, name in kcols:
            if v.is_element(k.type):
                group.append(col(n)["_id"].alias(n + "i"))
                firsts.append(F.first(col(n)).alias(n))
            else:
                group.append(col(n))
            back.append((e, ("var", n)))
        flat = []
        for name, _, vals in args:
            for i, a in enumerate(vals):
                flat.append(a.col.alias(f"{name}_{i}"))
        ordered = ORDER in self.df.columns
        base = self.df.select(*[col(k) for k in self.carry], *pre, *flat, *([col(ORDER)] if ordered else []))
        aggs, post = [], []
        for name, e, vals in args:
            agg, fix = lower_aggregate(self, name, e, vals, ordered)
            aggs.append(agg.alias(name))
            post.append((name, fix))
        grouped = base.groupBy(*[col(k) for k in self.carry], *group)
        df = grouped.agg(*(aggs + firsts))
        if self.carry and not keys:
            # A grouping without keys has a row for each outer row, also over nothing.
            outer = (self.seeds if self.seeds is not None else base).select(*[col(k) for k in self.carry]).distinct()
            df = outer.join(df, self.carry, "left")
        self.df = df.select(*[col(k) for k in self.carry], *[col(n) for n, _, _, _ in kcols], *[fix(col(name)).alias(name) for name, fix in post])
        self.scope = [n for n, _, _, _ in kcols] + [name for name, _ in post]
        aliases = [(("var", name), ("var", n)) for n, _, e, name in kcols if e != ("var", name)]
        outs = [(name, self.compile(substituted(e, back))) for e, name in posts]
        hidden = [(fresh("o"), self.compile(substituted(e, back + aliases + [(("var", name), substituted(x, back)) for x, name in posts])), down) for e, down in orders]
        self.df = self.df.select(*[col(k) for k in self.carry], *[o.col.alias(n) for n, o in outs], *[h.col.alias(n) for n, h, _ in hidden])
        self.scope = [n for n, _ in outs]
        if c["distinct"]:
            names = [n for n, _, _ in hidden]
            self.scope += names
            self.distinct()
            self.scope = [s for s in self.scope if s not in names]
        self.order_and_cut(hidden, c)

    def do_subquery(self, c: dict) -> None:
        if c["batches"] is not None:
            from arbora.operators.writes import in_transactions

            in_transactions(self, c)
            return
        parts, own = [], []
        for clauses in c["body"]["parts"]:
            first = clauses[0]
            own.append([s for s in self.scope if first["star"] or any(e == ("var", s) for e, _, _ in first["items"])] if first["kind"] == "with" and self.scope else [])
        # All parts of a UNION are keyed by what any of them imports.
        imports = [s for s in self.scope if any(s in x for x in own)]
        keys = [fresh("c") for _ in imports]
        ids = [(col(s)["_id"] if v.is_element(self.schema_type(s)) else col(s)) for s in imports]
        if imports:
            seeds = self.df.select(*[col(s) for s in imports], *[i.alias(k) for i, k in zip(ids, keys, strict=True)]).dropDuplicates(keys)
        for clauses, mine in zip(c["body"]["parts"], own, strict=True):
            if not imports:
                inner = self.child()
                inner.run(clauses)
                parts.append((inner, []))
                continue
            seed = seeds.select(*[col(s) for s in mine], *keys)
            inner = self.child(seed, mine, keys)
            inner.seeds = seed
            inner.run(clauses)
            if inner.scope:
                inner.df = inner.df.select(F.struct(*[col(k) for k in keys]).alias("__key"), *[col(s) for s in inner.scope])
            parts.append((inner, list(zip(ids, keys, strict=True))))
        if parts[0][0].wrote or not parts[0][0].scope:
            self.start()
            return
        df, keys = parts[0][0].df, parts[0][1]
        names = parts[0][0].scope
        for inner, _ in parts[1:]:
            if inner.scope != names:
                raise CypherError("the parts of a UNION must return the same columns")
            some = (["__key"] if keys else []) + names
            df = united(df.select(*[col(s) for s in some]), inner.df.select(*[col(s) for s in some]))
        if len(parts) > 1 and not c["body"]["all"]:
            df = df.distinct()
        new = [s for s in names if s not in self.scope]
        if keys:
            cond = None
            for ident, k in keys:
                this = ident.eqNullSafe(F.col("__key")[k])
                cond = this if cond is None else cond & this
            self.df = self.df.join(df.select("__key", *[col(s) for s in new]), cond).drop("__key")
        elif self.df is None:
            self.df = df.select(*[col(s) for s in new])
        else:
            self.df = self.df.crossJoin(df.select(*[col(s) for s in new]))
        self.scope += new

    def do_procedure(self, c: dict) -> None:
        from arbora.operators.procedures import call_procedure

        call_procedure(self, c)

    def do_load_csv(self, c: dict) -> None:
        from arbora.sources.files import load_csv

        load_csv(self, c)

    def __getattr__(self, name: str):
        if name in ("do_create", "do_merge", "do_set", "do_remove", "do_delete", "do_foreach"):
            from arbora.operators import writes

            return lambda c: getattr(writes, name[3:] + "_clause")(self, c)
        raise AttributeError(name)

    def result(self) -> DataFrame:
        return self.df.select(*[col(s) for s in self.scope])


def run_statement(graph, tree: dict, params: dict) -> Rows:
    needs = read_by(tree)
    if "*" in needs.whole:
        class All(Needs):
            def of(self, var):
                return None

            def light(self, var):
                return False

            def within(self, body, shared):
                return self

        needs = All(needs.whole, needs.props, needs.labels)
    # Writes change the graph under the rows; parameters may hold elements of another time.
    steady = not has_kind(tree, ("create", "merge", "set", "remove", "delete", "foreach", "procedure")) and all(x is None or isinstance(x, (str, int, float)) for x in params.values())
    outs = []
    for part in tree["parts"]:
        rows = Rows(graph, params, needs)
        rows.steady = steady
        rows.run(part)
        if part[-1]["kind"] != "return" and not (part[-1]["kind"] == "procedure" or rows.wrote or part[-1]["kind"] == "subquery"):
            raise CypherError("a query must end in RETURN or in a write")
        if part[-1]["kind"] not in ("return", "procedure"):
            rows.df, rows.scope = graph.spark.createDataFrame([], "done boolean"), []
        outs.append(rows)
    first = outs[0]
    for other in outs[1:]:
        if other.scope != first.scope:
            raise CypherError("the parts of a UNION must return the same columns")
        first.df = united(first.df.select(*[col(s) for s in first.scope]), other.df.select(*[col(s) for s in other.scope]))
    if len(outs) > 1 and not tree["all"]:
        first.distinct()
    return first


def run(graph, text: str, params: dict) -> DataFrame:
    tree = parse(text)
    if tree["kind"] == "schema":
        from arbora.operators.schema import run_schema

        return run_schema(graph, tree)
    rows = run_statement(graph, tree, params)
    out = rows.result() if rows.scope else rows.df.limit(0).select()
    if tree["mode"] == "explain":
        from contextlib import redirect_stdout
        from io import StringIO

        with contextlib.closing(StringIO()) as text_out, redirect_stdout(text_out):
            out.explain(mode="formatted")
            plan = text_out.getvalue()
        return graph.spark.createDataFrame([(plan,)], "plan string")
    if tree["mode"] == "profile":
        n = out.count()
        return graph.spark.createDataFrame([(out._jdf.queryExecution().executedPlan().toString(), n)], "profile string, rows long")
    return out
