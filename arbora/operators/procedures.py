"""Procedures: CALL name(arguments) YIELD columns."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.staging import staged
from arbora.plans import values as v
from arbora.plans.lower import CypherError, Rows, col, fresh
from arbora.sources.graph import RelTable

PROCEDURES: dict = {}


def procedure(name: str, *inputs: str):
    def keep(f):
        PROCEDURES[name.lower()] = (f, inputs)
        return f

    return keep


def call_procedure(rows: Rows, c: dict) -> None:
    name = c["name"].lower()
    found = PROCEDURES.get(name) or rows.graph.procedures.get(name)
    if found is None:
        raise CypherError(f"unknown procedure {c['name']}")
    f, inputs = found
    args = c["args"]
    if args is None:
        args = [("param", i) for i in inputs if i in rows.params]
    # A procedure gets its rows, and returns a frame to join: (frame, columns, key or None).
    df, columns, key = f(rows, args)
    wanted = [(x, x) for x in columns] if c["yields"] in (None, "*") else c["yields"]
    for x, _ in wanted:
        if x not in columns:
            raise CypherError(f"{c['name']} yields no {x}")
    picked = [col(x).alias(alias) for x, alias in wanted]
    if df is not None:
        if key is None:
            df = df.select(*picked)
            rows.df = df if rows.df is None else rows.df.crossJoin(df)
        else:
            k = fresh("k")
            df = df.select(col(key[1]).alias(k), *picked)
            rows.df = rows.df.join(df, key[0] == col(k)).drop(k)
    rows.start()
    if df is None:
        # The procedure put its columns into the rows itself.
        named = dict(wanted)
        rows.df = rows.df.withColumnsRenamed({x: a for x, a in wanted if x != a})
        rows.scope = [named.get(s, s) if s in columns else s for s in rows.scope]
    rows.scope += [alias for _, alias in wanted if df is not None and alias not in rows.scope]
    if c["where"] is not None:
        rows.filter(c["where"])


def value_of(rows: Rows, e):
    """An argument that is written out."""
    from arbora.functions.scalars import constant
    from arbora.plans.lower import Val

    return constant(Val(None, rows, e))


def _list(rows: Rows, column: str, values: list) -> tuple:
    return rows.graph.spark.createDataFrame([(x,) for x in values], f"`{column}` string"), [column], None


@procedure("db.labels")
def _labels(rows, args):
    return _list(rows, "label", sorted({x for t in rows.graph.nodes for x in t.labels}))


@procedure("db.relationshipTypes")
def _types(rows, args):
    return _list(rows, "relationshipType", sorted({t.type for t in rows.graph.rels}))


@procedure("db.propertyKeys")
def _keys(rows, args):
    return _list(rows, "propertyKey", sorted(set(rows.graph.property_types("node")) | set(rows.graph.property_types("rel"))))


@procedure("db.constraints")
def _constraints(rows, args):
    found = [(c["name"], c["scope"], c["label"], c["properties"], c["type"]) for c in rows.graph.constraints]
    return rows.graph.spark.createDataFrame(found, "name string, scope string, label string, properties array<string>, type string"), ["name", "scope", "label", "properties", "type"], None


@procedure("apoc.meta.schema")
def _schema(rows, args):
    """One row: a map from label or type to kind, count and property types."""
    from arbora.functions.scalars import apoc_type

    g = rows.graph
    parts = []
    for name, tables, which in [(x, [t for t in g.nodes if x in t.labels], "node") for x in sorted({x for t in g.nodes for x in t.labels})] + [(x, [t for t in g.rels if t.type == x], "relationship") for x in sorted({t.type for t in g.rels})]:
        props: dict[str, set] = {}
        for t in tables:
            for f in t.df.schema:
                if f.name not in ("id", "src", "dst"):
                    props.setdefault(f.name, set()).add(apoc_type(f.dataType))
        count = reduce(DataFrame.union, [t.df.select(F.lit(1).alias("x")) for t in tables]).agg(F.count("x").alias("n"))
        indexed = {p for i in g.indexes if i["label"] == name for p in i["properties"]}
        entries = [F.struct(F.lit(p).alias("k"), F.struct(F.lit("|".join(sorted(k))).alias("type"), F.lit(p in indexed).alias("indexed")).alias("v")) for p, k in sorted(props.items())]
        kind = "array<struct<k: string, v: struct<type: string, indexed: boolean>>>"
        parts.append(count.select(F.struct(F.lit(name).alias("k"), F.struct(F.lit(which).alias("type"), F.col("n").alias("count"), F.map_from_entries(F.array(*entries).cast(kind)).alias("properties")).alias("v")).alias("e")))
    out = reduce(DataFrame.union, parts).agg(F.map_from_entries(F.collect_list("e")).alias("value"))
    return out, ["value"], None


# elements --------------------------------------------------------------------------
@procedure("apoc.create.node", "labels", "props")
def _create_node(rows, args):
    from arbora.operators.writes import create_clause

    name = fresh("n")
    props = args[1] if len(args) > 1 else ("map", {})
    create_clause(rows, {"patterns": [{"path": None, "short": None, "rels": [], "nodes": [{"var": name, "labels": value_of(rows, args[0]), "props": props}]}]})
    rows.df = rows.df.withColumnRenamed(name, "node")
    rows.scope = [s for s in rows.scope if s != name] + ["node"]
    return None, ["node"], None


@procedure("apoc.create.relationship", "from", "relType", "props", "to")
def _create_rel(rows, args):
    from arbora.operators.writes import create_rel, property_columns, settle

    settle(rows)
    rows.wrote = True
    create_rel(rows, "rel", value_of(rows, args[1]), args[0][1], args[3][1], {k: x.col for k, x in property_columns(rows, args[2]).items()})
    return None, ["rel"], None


def _relabelled(add: bool, remove: bool, whole: bool = False):
    def f(rows, args):
        from arbora.operators.writes import refresh, relabel, settle

        rows.wrote = True
        settle(rows)
        x = rows.compile(args[0])
        ids = rows.df.select((F.explode(x.col) if v.is_list(x.type) else x.col).alias("n")).select(F.col("n._id").alias("id")).distinct()
        ids = staged(ids, rows.graph.spark)
        names = value_of(rows, args[1])
        every = sorted({y for t in rows.graph.nodes for y in t.labels})
        relabel(rows.graph, ids, add=names if add else (), remove=[y for y in every if y not in names] if whole else names if remove else ())
        refresh(rows)
        new = rows.graph.scan_nodes([], "node", None).join(ids, F.col("node._id") == F.col("id"), "left_semi")
        return new, ["node"], None

    return f


PROCEDURES["apoc.create.addlabels"] = (_relabelled(True, False), ("nodes", "labels"))
PROCEDURES["apoc.create.removelabels"] = (_relabelled(False, True), ("nodes", "labels"))
PROCEDURES["apoc.create.setlabels"] = (_relabelled(True, True, True), ("nodes", "labels"))


def _set_property(column: str):
    def f(rows, args):
        from arbora.operators.writes import apply_sets, refresh, settle

        rows.wrote = True
        settle(rows)
        apply_sets(rows, [("prop", args[0], value_of(rows, args[1]), args[2])])
        refresh(rows)
        rows.with_column(column, col(args[0][1]))
        rows.scope.append(column)
        return None, [column], None

    return f


PROCEDURES["apoc.create.setproperty"] = (_set_property("node"), ("node", "key", "value"))
PROCEDURES["apoc.create.setrelproperty"] = (_set_property("rel"), ("rel", "key", "value"))


@procedure("apoc.refactor.setType", "rel", "newType")
def _set_type(rows, args):
    from arbora.operators.writes import add_rels, commit, refresh, settle

    rows.wrote = True
    settle(rows)
    g, kind = rows.graph, value_of(rows, args[1])
    ids = staged(rows.df.select(rows.compile(args[0]).col["_id"].alias("id")).distinct(), g.spark)
    moved = [staged(t.df.join(ids, "id", "left_semi"), g.spark) for t in g.rels if t.type != kind]
    kept = [t if t.type == kind else RelTable(t.type, staged(t.df.join(ids, "id", "left_anti"), g.spark), t.src_labels, t.dst_labels) for t in g.rels]
    before, g.rels = g.rels, kept
    for df in moved:
        if not df.isEmpty():
            g.rels = add_rels(g, kind, df)
    after, g.rels = g.rels, before
    commit(g, g.nodes, after, {"types": ids})
    refresh(rows)
    rows.with_column("rel", col(args[0][1]))
    rows.scope.append("rel")
    return None, ["rel"], None


# path expansion ----------------------------------------------------------------------
UNIQUENESS = ("NODE_GLOBAL", "NODE_LEVEL", "NODE_PATH", "RELATIONSHIP_GLOBAL", "RELATIONSHIP_LEVEL", "RELATIONSHIP_PATH", "NONE")
NODE_LISTS = ("endNodes", "blacklistNodes", "whitelistNodes")


def _rel_filter(text: str) -> list[tuple[list[str], str]]:
    """``TYPE>``, ``<TYPE``, ``TYPE``, ``>``, ``<``: (types, direction) of each alternative."""
    out = []
    for part in [p.strip() for p in (text or "").split("|")]:
        way = "out" if part.endswith(">") else "in" if part.startswith("<") else "both"
        name = part.strip("<>")
        out.append(([name] if name else [], way))
    return out


def _label_filter(text: str) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {"+": set(), "-": set(), ">": set(), "/": set()}
    for part in [p.strip() for p in (text or "").split("|") if p.strip()]:
        out[part[0] if part[0] in "+->/" else "+"].add(part.lstrip("+->/"))
    return out


def _has(node: str, labels: set[str]):
    return F.arrays_overlap(F.col(f"{node}._labels"), F.array(*[F.lit(x) for x in sorted(labels)]))


def _node_lists(rows: Rows, e) -> dict:
    """The ids of each node list that a config gives, as a sorted array; null is no filter."""
    if e[0] == "param":
        given = {k: ("param", x) for k, x in (rows.params[e[1]] or {}).items()}
    else:
        given = e[1] if e[0] == "map" else {}

    def wrong(k):
        raise CypherError(f"{k} must be a node or a list of nodes")

    def ident(k, n):
        i = n["_id"]
        return F.coalesce(i, F.raise_error(F.lit(f"{k} must contain nodes")).cast("long"))

    def node(k, x):
        x = rows.compile(x)
        if not (isinstance(x.type, T.StructType) and "_labels" in x.type.names):
            wrong(k)
        return x.col

    out = {}
    for k in NODE_LISTS:
        if k not in given or given[k] in (("lit", None), ("param", None)):
            continue
        x = given[k]
        if e[0] == "param" or x[0] == "param":  # nodes as results give them
            held = x[1] if e[0] == "param" else rows.params[x[1]]
            if held is None:
                continue
            try:
                ids = F.array(*[F.lit(int(n["_id"])) for n in (held if isinstance(held, list) else [held])])
            except (TypeError, ValueError, KeyError):
                wrong(k)
        elif x[0] == "list":
            ids = F.array(*[ident(k, node(k, y)) for y in x[1]])
        else:
            y = rows.compile(x)
            if isinstance(y.type, T.ArrayType) and isinstance(y.type.elementType, T.StructType) and "_labels" in y.type.elementType.names:
                ids = F.transform(y.col, lambda n, k=k: ident(k, n))
            else:
                n = node(k, x)
                ids = F.when(n["_id"].isNotNull(), F.array(n["_id"]))
        out[k] = F.array_sort(F.array_distinct(ids.cast("array<long>")))
    return out


def expand(rows: Rows, start, config: dict, lists: dict | None = None) -> tuple[DataFrame, object]:
    """(__start, __path) and the key of a row that __start equals: breadth-first expansion
    from every distinct start node, with its node lists if there are any.

    Uniqueness is by path, by level or global for a start; of the ways that compete
    for a node or relationship within a level the first by relationship ids stays.
    Every level is one join and is staged.
    """
    g, spark = rows.graph, rows.graph.spark
    config = {k: x for k, x in config.items() if x is not None}
    uniq = config.get("uniqueness", "NODE_GLOBAL").strip().upper()
    if uniq not in UNIQUENESS:
        raise CypherError(f"unknown uniqueness mode {uniq}; there are {', '.join(UNIQUENESS)}")
    key = F.struct(start["_id"].alias("id"), *[x.alias(k) for k, x in lists.items()]) if lists else start["_id"]
    at_start = F.col("__start.id") if lists else F.col("__start")

    def listed(df: DataFrame, node: str, *names: str) -> DataFrame:
        for k in names:
            if k in (lists or {}):
                there = F.array_contains(F.col(f"__start.{k}"), F.col(node))
                df = df.where(F.coalesce(~there if k == "blacklistNodes" else there, F.lit(True)))
        return df

    low, high = int(config.get("minLevel", 1)), config.get("maxLevel", -1)
    low = 1 if low < 0 else low
    high = None if high is None or int(high) < 0 else int(high)
    labels = _label_filter(config.get("labelFilter", ""))
    start_filtered = config.get("filterStartNode", False)
    kinds = g.property_types("node"), g.property_types("rel")
    from arbora.operators.patterns import recast, uniform_type

    nt, rt = uniform_type(kinds[0], False), uniform_type(kinds[1], True)
    edges = []
    for types, way in _rel_filter(config.get("relationshipFilter", "")):
        e = g.scan_rels(types, "__r", None, way)
        edges.append(e.select(F.col("__s").alias("__vs"), F.col("__e").alias("__ve"), recast(F.col("__r"), e.schema["__r"].dataType, kinds[1], True).alias("__r")))
    edges = reduce(DataFrame.union, edges)
    n = g.scan_nodes([], "__m", None)
    nodes = n.select(F.col("__m._id").alias("__mid"), recast(F.col("__m"), n.schema["__m"].dataType, kinds[0], False).alias("__m"))
    first = rows.df.select(key.alias("__start")).where(at_start.isNotNull()).distinct()
    level = first.join(nodes, at_start == F.col("__mid")).select("__start", at_start.alias("__at"), F.array("__m").cast(T.ArrayType(nt)).alias("__ns"), F.array().cast(T.ArrayType(rt)).alias("__rs"), F.col("__m"))
    seen = level.select(F.col("__start").alias("__ss"), F.col("__at").alias("__sa"))
    used = None

    def ends(df: DataFrame, depth: int) -> DataFrame:
        if depth == 0 and start_filtered:
            df = listed(df, "__at", "blacklistNodes", "whitelistNodes")
        df = listed(df, "__at", "endNodes")
        if depth == 0 and not start_filtered:
            return df if not labels[">"] and not labels["/"] else df.where(F.lit(False))
        stops = labels[">"] | labels["/"]
        return df.where(_has("__m", stops)) if stops else df

    found, depth = ([ends(level, 0)] if low == 0 else []), 0
    while high is None or depth < high:
        if depth and labels["/"]:
            level = level.where(~_has("__m", labels["/"]))
        depth += 1
        step = level.drop("__m").join(edges, F.col("__at") == F.col("__vs")).join(nodes, F.col("__ve") == F.col("__mid"))
        step = listed(step, "__ve", "blacklistNodes", "whitelistNodes")
        if labels["-"]:
            step = step.where(~_has("__m", labels["-"]))
        if labels["+"]:
            step = step.where(_has("__m", labels["+"] | labels[">"] | labels["/"]))
        if uniq == "RELATIONSHIP_PATH":
            step = step.where(~F.exists("__rs", lambda x: x["_id"] == F.col("__r._id")))
        elif uniq == "NODE_LEVEL" and depth == 1:
            step = step.where(F.col("__ve") != at_start)
        elif uniq == "RELATIONSHIP_GLOBAL" and used is not None:
            step = step.join(used, (F.col("__start") == F.col("__ss")) & (F.col("__r._id") == F.col("__sr")), "left_anti")
        elif uniq == "NODE_PATH":
            step = step.where(~F.exists("__ns", lambda x: x["_id"] == F.col("__ve")))
        step = step.select("__start", F.col("__ve").alias("__at"), F.array_append("__ns", F.col("__m")).alias("__ns"), F.array_append("__rs", F.col("__r")).alias("__rs"), "__m")
        if uniq in ("NODE_GLOBAL", "NODE_LEVEL"):
            if uniq == "NODE_GLOBAL":
                step = step.join(seen, (F.col("__start") == F.col("__ss")) & (F.col("__at") == F.col("__sa")), "left_anti")
            order = F.transform("__rs", lambda x: x["_id"])
            step = step.groupBy("__start", "__at").agg(F.min_by(F.struct("__ns", "__rs", "__m"), order).alias("p")).select("__start", "__at", "p.*")
        if uniq in ("RELATIONSHIP_GLOBAL", "RELATIONSHIP_LEVEL"):
            last = F.element_at("__rs", -1)["_id"]
            step = step.withColumn("__l", last).groupBy("__start", "__l").agg(F.min_by(F.struct("__at", "__ns", "__rs", "__m"), F.transform("__rs", lambda x: x["_id"])).alias("p")).select("__start", "p.*")
        level = staged(step, spark)
        if level.isEmpty():
            break
        if uniq == "NODE_GLOBAL":
            seen = seen.union(level.select("__start", "__at"))
        if uniq == "RELATIONSHIP_GLOBAL":
            now = level.select(F.col("__start").alias("__ss"), F.element_at("__rs", -1)["_id"].alias("__sr"))
            used = now if used is None else used.union(now)
        if depth >= low:
            found.append(ends(level, depth))
        if high is None and depth >= g.max_hops:
            raise CypherError(f"paths go on beyond {g.max_hops} hops; give maxLevel")
    if not found:
        found = [level.where(F.lit(False))]
    out = reduce(DataFrame.union, [f.select("__start", "__ns", "__rs") for f in found])
    out = out.select("__start", F.struct(F.col("__ns").alias("_nodes"), F.col("__rs").alias("_rels")).alias("__path"))
    if config.get("limit"):
        out = out.limit(int(config["limit"]))
    return out, key


def _expansion(name: str, columns: list[str], make, forced: dict):
    def f(rows, args):
        rows.start()
        start = rows.compile(args[0])
        config, lists = args[1] if len(args) > 1 else ("map", {}), {}
        if config[0] in ("map", "param"):
            lists = _node_lists(rows, config)
        if config[0] == "map":
            config = ("map", {k: x for k, x in config[1].items() if k not in NODE_LISTS})
        df, key = expand(rows, start.col, {**(value_of(rows, config) or {}), **forced}, lists)
        return make(df), columns, (key, "__start")

    PROCEDURES[f"apoc.path.{name}"] = (f, ("start", "config"))


_expansion("expandconfig", ["path"], lambda d: d.withColumnRenamed("__path", "path"), {})
_expansion("spanningtree", ["path"], lambda d: d.withColumnRenamed("__path", "path"), {"uniqueness": "NODE_GLOBAL", "minLevel": 0})
_expansion("subgraphnodes", ["node"], lambda d: d.select("__start", F.element_at("__path._nodes", -1).alias("node")), {"uniqueness": "NODE_GLOBAL", "minLevel": 0})
_expansion("subgraphall", ["nodes", "relationships"], lambda d: d.groupBy("__start").agg(
    F.collect_list(F.element_at("__path._nodes", -1)).alias("nodes"), F.array_distinct(F.flatten(F.collect_list("__path._rels"))).alias("relationships")), {"uniqueness": "NODE_GLOBAL", "minLevel": 0})


@procedure("apoc.path.expand", "start", "relFilter", "labelFilter", "min", "max")
def _expand(rows, args):
    rows.start()
    start = rows.compile(args[0])
    r, lab, low, high = (value_of(rows, a) for a in args[1:5])
    df, key = expand(rows, start.col, {"relationshipFilter": r, "labelFilter": lab, "minLevel": low, "maxLevel": high})
    return df.withColumnRenamed("__path", "path"), ["path"], (key, "__start")


# statements --------------------------------------------------------------------------
def _run(writes: bool):
    def f(rows, args):
        from arbora.plans.lower import run_statement
        from arbora.plans.parser import parse

        tree = parse(value_of(rows, args[0]))
        kinds = {c["kind"] for p in tree.get("parts", []) for c in p}
        if not writes and kinds & {"create", "merge", "set", "remove", "delete", "foreach"}:
            raise CypherError("apoc.cypher.run only reads; use doIt")
        given = args[1] if len(args) > 1 else ("map", {})
        try:
            params = value_of(rows, given)
        except CypherError:
            return _run_by_row(rows, tree, given, writes)
        inner = run_statement(rows.graph, tree, params or {})
        rows.wrote = rows.wrote or inner.wrote
        df = inner.result() if inner.scope else rows.graph.spark.createDataFrame([], "x int")
        return df.select(F.struct(*[col(c) for c in df.columns]).alias("value")), ["value"], None

    return f


def _run_by_row(rows: Rows, tree: dict, given, writes: bool):
    """A statement whose parameters come from the rows: it is run once for all of them, keyed by the
    parameters where it only reads and by the row where it writes."""
    from arbora.plans.lower import read_by, substituted, united

    if given[0] != "map":
        raise CypherError("parameters that depend on the rows must be written out as a map")
    rows.start()
    names = {k: fresh("v") for k in given[1]}
    for k, e in given[1].items():
        rows.with_column(names[k], rows.compile(e).col)
    key = fresh("k")
    if writes:
        rows.with_column(key, F.monotonically_increasing_id().cast("string"))
        rows.df = staged(rows.df, rows.graph.spark)
        ident = col(key)
    else:
        ident = F.to_json(F.struct(*[col(n) for n in names.values()]), {"ignoreNullFields": "false"})
    seeds = rows.df.select(*[col(n) for n in names.values()], ident.alias(key)).dropDuplicates([key])
    tree = substituted(tree, [(("param", k), ("var", n)) for k, n in names.items()])
    out = None
    for part in tree["parts"]:
        inner = Rows(rows.graph, {}, read_by(tree), seeds, list(names.values()), [key])
        inner.seeds = seeds
        inner.run(part)
        rows.wrote = rows.wrote or inner.wrote
        shown = inner.scope if part[-1]["kind"] == "return" else []
        df = inner.df.select(col(key), *[col(s) for s in shown])
        out = df if out is None else united(out, df)
    if not tree.get("all", True) and len(tree["parts"]) > 1:
        out = out.distinct()
    fields = [col(c) for c in out.columns if c != key]
    return out.select(col(key), (F.struct(*fields) if fields else F.struct(F.lit(None).alias("x"))).alias("value")), ["value"], (ident, key)


PROCEDURES["apoc.cypher.run"] = (_run(False), ("statement", "params"))
PROCEDURES["apoc.cypher.doit"] = (_run(True), ("statement", "params"))


@procedure("apoc.periodic.iterate", "iterate", "action", "config")
def _iterate(rows, args):
    """Batches of the first statement's rows, each run through the second and committed on its own."""
    from arbora.operators.writes import numbered
    from arbora.plans.lower import run_statement
    from arbora.plans.parser import parse

    g = rows.graph
    config = value_of(rows, args[2]) if len(args) > 2 else {}
    size = int(config.get("batchSize", 1000))
    params = config.get("params", {})
    source = run_statement(g, parse(value_of(rows, args[0])), params)
    n = fresh("n")
    numbered(source, n, 0)
    total = source.df.count()
    action = parse(value_of(rows, args[1]))["parts"][0]
    done = failed = batches = 0
    begun = time.monotonic()
    messages: dict[str, int] = {}
    for first in range(0, total, size):
        batches += 1
        before = list(g.nodes), list(g.rels)
        rows_in = min(size, total - first)
        try:
            part = Rows(g, params, source.needs, source.df.where(f"{n} >= {first} and {n} < {first + size}").drop(n), source.scope)
            part.run(action)
            done += rows_in
        except Exception as e:
            g.nodes, g.rels = before
            failed += rows_in
            messages[str(e)[:200]] = messages.get(str(e)[:200], 0) + 1
    rows.wrote = True
    broken = sum(messages.values())
    counts = "struct<total: long, committed: long, failed: long, errors: map<string,long>>"
    schema = (f"batches long, total long, timeTaken long, committedOperations long, failedOperations long, failedBatches long, retries long, errorMessages map<string,long>, "
              f"batch {counts}, operations {counts}, wasTerminated boolean, failedParams map<string,string>, updateStatistics map<string,long>")
    row = (batches, total, int(time.monotonic() - begun), done, failed, broken, 0, messages,
           (batches, batches - broken, broken, messages), (total, done, failed, messages), False, {}, {})
    out = g.spark.createDataFrame([row], schema)
    return out, out.columns, None


# files ---------------------------------------------------------------------------------
@procedure("apoc.load.json", "path", "pointer")
def _load_json(rows, args):
    from arbora.sources.files import json_rows

    return json_rows(rows.graph, value_of(rows, args[0]), value_of(rows, args[1]) if len(args) > 1 else None), ["value"], None


@procedure("apoc.load.csv", "path", "config")
def _load_csv(rows, args):
    from arbora.sources.files import csv_rows

    config = value_of(rows, args[1]) if len(args) > 1 else {}
    return csv_rows(rows.graph, value_of(rows, args[0]), config.get("header", True), config.get("sep", ",")), ["lineNo", "list", "map"], None


def _export(what: str, of_query: bool):
    def f(rows, args):
        from arbora.sources.files import export

        if of_query:
            q = rows.graph.cypher(value_of(rows, args[0]))
            df = export(rows.graph, what, value_of(rows, args[1]), q)
        else:
            df = export(rows.graph, what, value_of(rows, args[0]))
        return df, df.columns, None

    return f


for _what in ("csv", "json", "cypher"):
    PROCEDURES[f"apoc.export.{_what}.all"] = (_export(_what, False), ("file", "config"))
    PROCEDURES[f"apoc.export.{_what}.query"] = (_export(_what, True), ("query", "file", "config"))


# triggers --------------------------------------------------------------------------------
def _trigger_rows(g, names=None):
    found = [(n, t["statement"], t["phase"], t["paused"]) for n, t in sorted(g.triggers.items()) if names is None or n in names]
    return g.spark.createDataFrame(found, "name string, query string, phase string, paused boolean"), ["name", "query", "phase", "paused"], None


PHASES = ("before", "after", "afterAsync", "rollback")
#: Lists that a trigger's statement may ask for, each with the kind of element that it is about.
TRIGGER_LISTS = {
    "createdNodes": "node", "createdRelationships": "relationship", "deletedNodes": "node", "deletedRelationships": "relationship", "assignedNodeProperties": "node", "removedNodeProperties": "node",
    "assignedRelationshipProperties": "relationship", "removedRelationshipProperties": "relationship", "assignedLabels": "node", "removedLabels": "node",
}


def trigger_list(g, before: tuple, delta: dict, name: str) -> DataFrame:
    """One column ``item``: the elements or changes that a commit brought; empty where it brought none."""
    from dataclasses import replace

    from arbora.plans.lower import united

    kind = TRIGGER_LISTS[name]
    old = replace(g, nodes=before[0], rels=before[1])

    def elements(graph) -> DataFrame:
        if kind == "node":
            return graph.scan_nodes([], "item", None)
        return graph.scan_rels([], "item", None, "out").select("item")

    def of(graph, ids) -> DataFrame:
        if ids is None:
            return elements(graph).where(F.lit(False))
        return elements(graph).join(ids.select(F.col("id").alias("__id")).distinct(), F.col("item._id") == F.col("__id"), "left_semi")

    if name.startswith(("created", "deleted")):
        return of(g if name.startswith("created") else old, delta.get(name))
    if name.endswith("Labels"):
        ids, add, remove = delta.get("labels") or (None, [], [])
        which, mine = (add, g) if name.startswith("assigned") else (remove, old)
        other = of(old if mine is g else g, ids).select(F.col("item._id").alias("__oid"), F.col("item._labels").alias("__had"))
        now = of(mine, ids).join(other, F.col("item._id") == F.col("__oid")) if which else None
        if now is None:
            return of(g, None).select(F.struct(F.lit("").alias("label"), F.col("item").alias("node")).alias("item"))
        now = now.withColumn("label", F.explode(F.array(*[F.lit(x) for x in which]))).where("array_contains(item._labels, label) and not array_contains(__had, label)")
        return now.select(F.struct("label", F.col("item").alias("node")).alias("item"))
    change = delta.get("assigned" + name.removeprefix("assigned").removeprefix("removed"))
    element = lambda x: F.struct("key", "old", "new", x.alias(kind)).alias("item")
    out = None
    for key in [c for c in change.columns if c != "id"] if change is not None else []:
        had = elements(old).select(F.col("item._id").alias("__oid"), *([F.col(f"item.`{key}`").alias("old")] if key in elements(old).schema["item"].dataType.names else [F.lit(None).cast("string").alias("old")]))
        one = change.select(F.col("id").alias("__id"), F.lit(key).alias("key"), F.col(f"`{key}`").alias("new")).join(had, F.col("__id") == F.col("__oid"))
        one = one.where("new is not null" if name.startswith("assigned") else "new is null and old is not null")
        one = one.join(elements(g), F.col("item._id") == F.col("__id")).select("key", "old", "new", "item")
        out = one if out is None else united(out, one)
    if out is None:
        none = F.lit(None).cast("string")
        out = of(g, None).select(F.lit("").alias("key"), none.alias("old"), none.alias("new"), "item")
    return out.select(element(F.col("item")))


@procedure("apoc.trigger.install", "name", "statement", "selector")
def _install(rows, args):
    """Run a statement at every commit: before it (an error undoes it), after it, or after an undo.

    The statement's ``$createdNodes`` and the like are frames: UNWIND reads them
    row by row, and anything else sees them as lists.
    """
    name, statement = value_of(rows, args[0]), value_of(rows, args[1])
    wanted = [x for x in TRIGGER_LISTS if re.search(rf"\$`?{x}\b", statement)]
    config = value_of(rows, args[2]) if len(args) > 2 else {}
    phase, extra = (config or {}).get("phase", "before"), (config or {}).get("params", {})
    if phase not in PHASES:
        raise CypherError(f"unknown phase {phase}; there are {', '.join(PHASES)}")
    busy = []

    def run(graph, before, delta):
        if busy:  # what a trigger writes sets off no trigger
            return
        busy.append(1)
        try:
            given = {x: trigger_list(graph, before, delta, x) for x in wanted}
            if "$createdCount" in statement:
                made = delta.get("createdNodes")
                given["createdCount"] = made.count() if made is not None else 0
            graph.cypher(statement, **(extra | given))
        finally:
            busy.clear()

    rows.graph.triggers[name] = {"statement": statement, "phase": phase, "paused": False, "run": run}
    return _trigger_rows(rows.graph, [name])


@procedure("apoc.trigger.drop", "name")
def _drop(rows, args):
    out = _trigger_rows(rows.graph, [value_of(rows, args[0])])
    rows.graph.triggers.pop(value_of(rows, args[0]), None)
    return out


@procedure("apoc.trigger.list")
def _triggers(rows, args):
    return _trigger_rows(rows.graph)


def _pause(to: bool):
    def f(rows, args):
        name = value_of(rows, args[0])
        if name not in rows.graph.triggers:
            raise CypherError(f"there is no trigger {name}")
        rows.graph.triggers[name]["paused"] = to
        return _trigger_rows(rows.graph, [name])

    return f


PROCEDURES["apoc.trigger.stop"], PROCEDURES["apoc.trigger.start"] = (_pause(True), ("name",)), (_pause(False), ("name",))
