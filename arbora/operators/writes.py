"""Write clauses: deltas over the tables of a graph, committed as new tables.

A write reads the rows so far, stages them once (so that new ids are fixed), and
derives new, changed and removed elements as DataFrames. Tables are replaced at
the end of the clause, checked against the constraints first.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.schema import check_all
from arbora.operators.staging import staged
from arbora.plans import values as v
from arbora.plans.lower import CypherError, Rows, col, fresh
from arbora.sources.graph import NodeTable, RelTable, widened

_RESERVED = ("id", "src", "dst")


def settle(rows: Rows) -> None:
    rows.start()
    rows.df = staged(rows.df, rows.graph.spark)


def next_id(graph) -> int:
    """The first id that no element has; each table is looked through once, and those that writes made not at all."""
    for t in [*graph.nodes, *graph.rels]:
        if id(t) not in graph.seen_tables:
            graph.top_id = max(graph.top_id, t.df.agg(F.max("id")).first()[0] or 0)
            graph.seen_tables[id(t)] = t
    return graph.top_id + 1


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name with types widened and columns added."""
    kinds: dict[str, T.DataType] = {}
    for df in (a, b):
        for f in df.schema:
            kinds[f.name] = f.dataType if f.name not in kinds else (kinds[f.name] if kinds[f.name] == f.dataType else widened(kinds[f.name], f.dataType))
    pick = lambda df: df.select(*[(col(n).cast(k) if n in df.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])
    return pick(a).union(pick(b))


def commit(graph, tables_n: list[NodeTable], tables_r: list[RelTable], added: dict) -> None:
    before = graph.nodes, graph.rels
    graph.nodes, graph.rels = tables_n, tables_r

    def fire(phases: tuple[str, ...]):
        for name, t in list(graph.triggers.items()):
            if t["phase"] in phases and not t["paused"]:
                yield name, t, lambda t=t: t["run"](graph, before, added)

    try:
        check_all(graph)
        for _, _, run in fire(("before",)):
            run()
    except Exception:
        graph.nodes, graph.rels = before
        for _, _, run in fire(("rollback",)):
            run()
        raise
    if all(id(t) in graph.seen_tables for t in (*before[0], *before[1])):
        # Ids come from next_id alone, so tables that a write made hold none above it.
        graph.seen_tables = {id(t): t for t in (*tables_n, *tables_r)}
    for name, t, run in fire(("after", "afterAsync")):
        try:
            run()
        except Exception as e:  # the commit stands, so a failing trigger can only be reported
            t["error"] = repr(e)
            warnings.warn(f"trigger {name} failed after the commit: {e}", stacklevel=2)


def touched(tables: list, ids: DataFrame, *columns: str) -> set[int]:
    """Numbers of the tables with a row whose ``columns`` hold one of the ids: one job over the id columns."""
    keys = [t.df.select(F.lit(i).alias("table"), F.explode(F.array(*columns)).alias("id")) for i, t in enumerate(tables)]
    if not keys:
        return set()
    return {r.table for r in _union(keys).join(ids.select("id").distinct(), "id", "left_semi").select("table").distinct().collect()}


def add_nodes(graph, labels: tuple[str, ...], df: DataFrame) -> list[NodeTable]:
    key = tuple(sorted(set(labels)))
    df = staged(df, graph.spark)
    out, done = [], False
    for t in graph.nodes:
        if tuple(sorted(t.labels)) == key:
            out.append(NodeTable(t.labels, merged(t.df, df)))
            done = True
        else:
            out.append(t)
    return out if done else [*out, NodeTable(key, df)]


def add_rels(graph, kind: str, df: DataFrame) -> list[RelTable]:
    df = staged(df, graph.spark)
    out, done = [], False
    for t in graph.rels:
        if t.type == kind and not done:
            out.append(RelTable(kind, merged(t.df, df)))
            done = True
        else:
            out.append(RelTable(t.type, t.df) if t.type == kind else t)
    return out if done else [*out, RelTable(kind, df)]


def property_columns(rows: Rows, props) -> dict[str, object]:
    """Compiled properties of ``{...}`` or of a parameter map; null literals are left out."""
    if props is None:
        return {}
    pairs = props[1] if props[0] == "map" else {k: ("lit", x) for k, x in rows.params[props[1]].items()}
    out = {}
    for k, e in pairs.items():
        x = rows.compile(e)
        if not v.is_null(x.type):
            out[k] = x
    return out


def numbered(rows: Rows, name: str, start: int) -> int:
    """Give every row a dense id in column ``name``; returns the next free one.

    Rows are counted by partition; only those counts come to the driver.
    """
    spark = rows.graph.spark
    df = staged(rows.df.withColumn("__m", F.monotonically_increasing_id()), spark)
    part = F.shiftright("__m", 33)
    counts = {r.p: r.n for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], start
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    rows.graph.top_id = max(rows.graph.top_id, total - 1)
    if not offsets:
        rows.df = df.withColumn(name, F.lit(None).cast("long")).drop("__m")
        return start
    # One row for each partition, so this side may be broadcast.
    base = F.broadcast(spark.createDataFrame(offsets, "__p long, __base long"))
    df = df.join(base, part == F.col("__p")).withColumn(name, F.col("__base") + F.col("__m").bitwiseAND((1 << 33) - 1))
    rows.df = staged(df.drop("__m", "__p", "__base"), spark)
    return total


def create_clause(rows: Rows, c: dict) -> None:
    rows.wrote = True
    settle(rows)
    for p in c["patterns"]:
        create_pattern(rows, p)


def create_pattern(rows: Rows, p: dict) -> None:
    graph = rows.graph
    for n in p["nodes"]:
        if n["var"] in rows.scope and n["var"]:
            if (n["labels"] or n["props"] is not None):
                raise CypherError(f"{n['var']} is bound already")
            continue
        n["var"] = n["var"] or fresh("n")
        ident = fresh("i")
        props = property_columns(rows, n["props"])
        cols = {k: x.col for k, x in props.items()}
        numbered(rows, ident, next_id(graph))
        new = rows.df.select(col(ident).alias("id"), *[x.alias(k) for k, x in cols.items()])
        tables = add_nodes(graph, tuple(n["labels"]), new)
        commit(graph, tables, graph.rels, {"createdNodes": new})
        rows.with_column(n["var"], F.struct(col(ident).alias("_id"), F.array(*[F.lit(x) for x in sorted(set(n["labels"]))]).cast("array<string>").alias("_labels"), *[x.alias(k) for k, x in cols.items()]))
        rows.df = rows.df.drop(ident)
        rows.scope.append(n["var"])
    for i, r in enumerate(p["rels"]):
        if r["dir"] == "both" or len(r["types"]) != 1 or r["length"] is not None:
            raise CypherError("a created relationship has one type and one direction")
        a, b = p["nodes"][i]["var"], p["nodes"][i + 1]["var"]
        if r["dir"] == "in":
            a, b = b, a
        r["var"] = r["var"] or fresh("r")
        create_rel(rows, r["var"], r["types"][0], a, b, {k: x.col for k, x in property_columns(rows, r["props"]).items()})
    if p["path"]:
        from arbora.operators.patterns import finish

        finish(rows, p, p["nodes"], p["rels"])


def create_rel(rows: Rows, var: str, kind: str, a: str, b: str, cols: dict) -> None:
    graph, ident = rows.graph, fresh("i")
    numbered(rows, ident, next_id(graph))
    new = rows.df.select(col(ident).alias("id"), col(a)["_id"].alias("src"), col(b)["_id"].alias("dst"), *[x.alias(k) for k, x in cols.items()])
    commit(graph, graph.nodes, add_rels(graph, kind, new), {"createdRelationships": new})
    rows.with_column(var, F.struct(col(ident).alias("_id"), F.lit(kind).alias("_type"), col(a)["_id"].alias("_src"), col(b)["_id"].alias("_dst"), *[x.alias(k) for k, x in cols.items()]))
    rows.df = rows.df.drop(ident)
    if var not in rows.scope:
        rows.scope.append(var)


def merge_clause(rows: Rows, c: dict) -> None:
    """Rows whose pattern exists are matched; for the others the whole pattern is created, once per distinct key."""
    rows.wrote = True
    settle(rows)
    p = c["pattern"]
    outer = list(rows.scope)
    for e in (*p["nodes"], *p["rels"]):
        e["var"] = e["var"] or fresh("m")
    key = fresh("k")
    # Rows that ask for the same pattern share a key: bound ends and property values.
    parts = []
    for e in (*p["nodes"], *p["rels"]):
        if e["var"] in outer:
            parts.append(col(e["var"])["_id"].cast("string"))
        parts += [x.col.cast("string") for x in property_columns(rows, e["props"]).values()]
    rows.with_column(key, F.to_json(F.array(*[F.coalesce(x, F.lit("\0")) for x in parts])) if parts else F.lit(""))
    rows.df = staged(rows.df, rows.graph.spark)
    new_vars = [e["var"] for e in (*p["nodes"], *p["rels"]) if e["var"] not in outer]

    def matched() -> Rows:
        inner = rows.child(rows.df, outer)
        inner.carry = [key]
        either = {"kind": "match", "optional": False, "patterns": [dict(p, nodes=[dict(n) for n in p["nodes"]], rels=[dict(r) for r in p["rels"]])], "where": None}
        inner.match(either)
        return inner

    hits = matched()
    found = staged(hits.df.select(key).distinct(), rows.graph.spark)
    missing = rows.child(staged(rows.df.join(found, key, "left_anti").dropDuplicates([key]), rows.graph.spark), outer)
    made = None
    if not missing.df.isEmpty():
        plain = dict(p, nodes=[dict(n) for n in p["nodes"]], rels=[dict(r) for r in p["rels"]])
        for n in plain["nodes"]:
            if n["var"] in outer:
                n["labels"], n["props"] = [], None
        for r in plain["rels"]:
            r["dir"] = "out" if r["dir"] == "both" else r["dir"]
        create_pattern(missing, plain)
        made = staged(missing.df.select(key).distinct(), rows.graph.spark)
    after = matched()
    rows.df, rows.scope = staged(after.df, rows.graph.spark), outer + new_vars
    for items, side in ((c["on_match"], found), (c["on_create"], made)):
        if items and side is not None:
            some = rows.child(rows.df.join(side, key, "left_semi"), rows.scope)
            apply_sets(some, items)
    rows.df = rows.df.drop(key)
    if c["on_match"] or c["on_create"]:
        refresh(rows)


def refresh(rows: Rows) -> None:
    """Read the elements in scope again, as a write has changed them."""
    rows.scope = [s for s in rows.scope if s in rows.df.columns]
    for s in rows.scope:
        kind = rows.schema_type(s)
        if v.is_node(kind):
            new = rows.graph.scan_nodes([], "__new", None)
        elif v.is_rel(kind):
            new = rows.graph.scan_rels([], "__new", None, "out").select("__new")
        else:
            continue
        order = rows.df.columns
        rows.df = rows.df.withColumn("__key", col(s)["_id"]).drop(s).join(new, F.col("__key") == F.col("__new._id"), "left").withColumnRenamed("__new", s).drop("__key").select(*[col(x) for x in order])
    rows.df = staged(rows.df, rows.graph.spark)


def set_clause(rows: Rows, c: dict) -> None:
    rows.wrote = True
    settle(rows)
    apply_sets(rows, c["items"])
    refresh(rows)


def apply_sets(rows: Rows, items: list[tuple]) -> None:
    """Right sides are computed from the rows before any of them is written."""
    jobs = []
    for it in items:
        if it[0] == "labels":
            jobs.append((it[1], "labels", it[2], None))
            continue
        target = it[1] if isinstance(it[1], str) else it[1][1]
        if it[0] == "prop":
            x = rows.compile(it[3])
            jobs.append((target, "props", {it[2]: None if v.is_null(x.type) else x.col}, None))
        else:
            e = it[2]
            value = rows.compile(e)
            if not isinstance(value.type, T.StructType):
                raise CypherError("an element is set from a map or another element")
            fields = {f.name: value.col[f.name] for f in value.type if not f.name.startswith("_")}
            jobs.append((target, "props", fields, it[0] == "replace"))
    outs = []
    for target, how, what, replace in jobs:
        kind = rows.schema_type(target)
        ident = col(target)["_id"].alias("id")
        if how == "labels":
            outs.append((kind, how, staged(rows.df.select(ident).where("id is not null").distinct(), rows.graph.spark), what, None))
        else:
            cols = [(x if x is not None else F.lit(None).cast("string")).alias(k) for k, x in what.items()]
            delta = rows.df.select(ident, *cols).where("id is not null").groupBy("id").agg(*[F.last(col(k)).alias(k) for k in what]) if what else rows.df.select(ident).where("id is not null").distinct()
            outs.append((kind, how, staged(delta, rows.graph.spark), what, replace))
    graph = rows.graph
    for kind, how, delta, what, replace in outs:
        if how == "labels":
            relabel(graph, delta, add=what)
        elif v.is_rel(kind):
            some = touched(graph.rels, delta, "id")
            commit(graph, graph.nodes, [RelTable(t.type, overlay(t.df, delta, list(what), replace), t.src_labels, t.dst_labels) if i in some else t for i, t in enumerate(graph.rels)], {"assignedRelationshipProperties": delta})
        else:
            some = touched(graph.nodes, delta, "id")
            commit(graph, [NodeTable(t.labels, overlay(t.df, delta, list(what), replace)) if i in some else t for i, t in enumerate(graph.nodes)], graph.rels, {"assignedNodeProperties": delta})


def overlay(df: DataFrame, delta: DataFrame, names: list[str], replace: bool | None) -> DataFrame:
    """``df`` with the columns ``names`` of matching ids replaced; ``replace`` clears their other properties."""
    d = delta.select(F.col("id").alias("__did"), *[col(n).alias(f"__d_{n}") for n in names])
    joined = df.join(d, F.col("id") == F.col("__did"), "left")
    hit = F.col("__did").isNotNull()
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for f in df.schema:
        if f.name in _RESERVED or (f.name not in names and not replace):
            out.append(col(f.name))
        elif f.name not in names:
            out.append(F.when(~hit, col(f.name)).alias(f.name))
        else:
            new = delta.schema[f.name].dataType
            to = kinds[f.name] if kinds[f.name] == new else widened(kinds[f.name], new)
            out.append(F.when(hit, F.col(f"`__d_{f.name}`").cast(to)).otherwise(col(f.name).cast(to)).alias(f.name))
    out += [F.when(hit, F.col(f"`__d_{n}`")).alias(n) for n in names if n not in kinds]
    return staged(joined.select(*out), df.sparkSession)


def relabel(graph, ids: DataFrame, add: list[str] = (), remove: list[str] = ()) -> None:
    """Move nodes between label sets."""
    kept, moved, some = [], [], touched(graph.nodes, ids, "id")
    for i, t in enumerate(graph.nodes):
        want = tuple(sorted((set(t.labels) | set(add)) - set(remove)))
        if want == tuple(sorted(t.labels)) or i not in some:
            kept.append(t)
            continue
        kept.append(NodeTable(t.labels, staged(t.df.join(ids, "id", "left_anti"), graph.spark)))
        moved.append((want, t.df.join(ids, "id", "left_semi")))
    before = graph.nodes
    graph.nodes = kept
    for want, df in moved:
        graph.nodes = add_nodes(graph, want, df)
    after, graph.nodes = graph.nodes, before
    # Ends declared for relationships may no longer hold.
    commit(graph, after, [RelTable(t.type, t.df) for t in graph.rels], {"labels": (ids, list(add), list(remove))})


def remove_clause(rows: Rows, c: dict) -> None:
    rows.wrote = True
    settle(rows)
    for it in c["items"]:
        if it[0] == "labels":
            relabel(rows.graph, staged(rows.df.select(col(it[1])["_id"].alias("id")).where("id is not null").distinct(), rows.graph.spark), remove=it[2])
        else:
            apply_sets(rows, [("prop", it[1], it[2], ("lit", None))])
    refresh(rows)


def delete_clause(rows: Rows, c: dict) -> None:
    rows.wrote = True
    settle(rows)
    graph = rows.graph
    nodes, rels = [], []
    for e in c["items"]:
        x = rows.compile(e)
        if v.is_path(x.type):
            nodes.append(rows.df.select(F.explode(x.col["_nodes"]).alias("x")).select(F.col("x._id").alias("id")))
            rels.append(rows.df.select(F.explode(x.col["_rels"]).alias("x")).select(F.col("x._id").alias("id")))
        elif v.is_node(x.type):
            nodes.append(rows.df.select(x.col["_id"].alias("id")))
        elif v.is_rel(x.type):
            rels.append(rows.df.select(x.col["_id"].alias("id")))
        elif not v.is_null(x.type):
            raise CypherError("only nodes, relationships and paths can be deleted")
    both = lambda frames: staged(_union(frames).where("id is not null").distinct(), graph.spark) if frames else None
    gone_n, gone_r = both(nodes), both(rels)
    hit_r = touched(graph.rels, gone_r, "id") if gone_r is not None else set()
    hit_ends = touched(graph.rels, gone_n, "src", "dst") if gone_n is not None else set()
    new_rels = []
    for i, t in enumerate(graph.rels):
        df = t.df.join(gone_r, "id", "left_anti") if i in hit_r else t.df
        if i in hit_ends and not c["detach"]:
            for end in ("src", "dst"):
                if not df.join(gone_n.select(F.col("id").alias(end)), end, "left_semi").isEmpty():
                    raise CypherError("a node that still has relationships cannot be deleted without DETACH")
        if i in hit_ends and c["detach"]:
            for end in ("src", "dst"):
                df = df.join(gone_n.select(F.col("id").alias(end)), end, "left_anti")
        if df is not t.df:
            df = df.select(*[col(x) for x in ["id", "src", "dst"] + [y for y in df.columns if y not in _RESERVED]])
            t = RelTable(t.type, staged(df, graph.spark), t.src_labels, t.dst_labels)
        new_rels.append(t)
    hit_n = touched(graph.nodes, gone_n, "id") if gone_n is not None else set()
    new_nodes = [NodeTable(t.labels, staged(t.df.join(gone_n, "id", "left_anti"), graph.spark)) if i in hit_n else t for i, t in enumerate(graph.nodes)]
    commit(graph, new_nodes, new_rels, {"deletedNodes": gone_n, "deletedRelationships": gone_r})


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def foreach_clause(rows: Rows, c: dict) -> None:
    rows.wrote = True
    settle(rows)
    inner = rows.child(rows.df, rows.scope)
    inner.do_unwind({"expr": c["list"], "var": c["var"]})
    for body in c["body"]:
        getattr(inner, "do_" + body["kind"])(body)
    refresh(rows)


def in_transactions(rows: Rows, c: dict) -> None:
    """CALL { … } IN TRANSACTIONS: batches of rows, each committed or undone on its own."""
    graph, spec = rows.graph, c["batches"]
    settle(rows)
    size = 1000 if spec["rows"] is None else rows.count_of(spec["rows"], "OF ROWS")
    n = fresh("n")
    numbered(rows, n, 0)
    total = rows.df.count()
    states, stop = [], False
    for first in range(0, total, max(1, size)):
        status = {"started": not stop, "committed": False, "transactionId": f"batch-{first // max(1, size)}", "errorMessage": None}
        if not stop:
            before = list(graph.nodes), list(graph.rels)
            try:
                part = rows.child(rows.df.where(f"{n} >= {first} and {n} < {first + size}").drop(n), rows.scope)
                clauses = c["body"]["parts"][0]
                if clauses[0]["kind"] == "with" and all(e[0] == "var" for e, _, _ in clauses[0]["items"]):
                    clauses = clauses[1:]
                part.run(clauses)
                status["committed"] = True
            except Exception as e:
                graph.nodes, graph.rels = before
                if spec["on_error"] == "fail":
                    raise
                status["errorMessage"] = str(e)[:500]
                stop = spec["on_error"] == "break"
        states.append((first, tuple(status.values())))
    rows.wrote = True
    if spec["report"]:
        kind = f"__first long, `{spec['report']}` struct<started: boolean, committed: boolean, transactionId: string, errorMessage: string>"
        st = graph.spark.createDataFrame(states, kind)
        rows.df = rows.df.join(st, F.col("__first") == F.col(n) - F.col(n) % size).drop("__first")
        rows.scope.append(spec["report"])
    rows.df = rows.df.drop(n)
