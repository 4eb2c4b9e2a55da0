"""Graph patterns as joins: hops, variable-length trails, shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans import values as v
from arbora.plans.lower import CypherError, Rows, col, fresh


def match_pattern(rows: Rows, p: dict, used: list[tuple[str, list[str]]]) -> None:
    """Join one path pattern to the rows; ``used`` lists the clause's relationships so far."""
    nodes, rels = [dict(n) for n in p["nodes"]], [dict(r) for r in p["rels"]]
    for e in (*nodes, *rels):
        e["anonymous"] = e["var"] is None
        e["var"] = e["var"] or fresh("e")
        if p["path"]:
            rows.needs.whole.add(e["var"])
    if p["short"]:
        shortest(rows, p, nodes, rels)
        return
    bound = [i for i, n in enumerate(nodes) if n["var"] in rows.scope]
    given = [i for i, r in enumerate(rels) if r["length"] is not None and r["var"] in rows.scope]
    start = bound[0] if bound else given[0] if given else 0
    first = nodes[start]
    if bound:
        narrow(rows, first)
    elif given:
        begin_at_list(rows, first, rels[start])
    elif rows.needs.light(first["var"]) and first["props"] is None and rels and rels[start]["length"] is None and rels[start]["var"] not in rows.scope and set(first["labels"]) <= rows.graph.end_labels(
            rels[start]["types"], {"out": "in", "in": "out", "both": "both"}[rels[start]["dir"]], labels_of(rows, nodes[start + 1]), set(first["labels"])):
        # Only the identity of the first node is read: begin at the relationships.
        begin_at_rel(rows, nodes, rels, start, used)
        for i in range(start + 2, len(nodes)):
            hop(rows, nodes[i - 1], rels[i - 1], nodes[i], used, p["path"])
        finish(rows, p, nodes, rels)
        return
    else:
        scan(rows, first)
    for i in range(start + 1, len(nodes)):
        hop(rows, nodes[i - 1], rels[i - 1], nodes[i], used, p["path"])
    for i in range(start - 1, -1, -1):
        turned = dict(rels[i])
        turned["dir"] = {"out": "in", "in": "out", "both": "both"}[rels[i]["dir"]]
        turned["turned"] = True
        hop(rows, nodes[i + 1], turned, nodes[i], used, p["path"])
    finish(rows, p, nodes, rels)


def props_of(rows: Rows, e: dict) -> set[str] | None:
    need = rows.needs.of(e["var"])
    if need is None:
        return None
    return need | (set(e["props"][1]) if e["props"] is not None and e["props"][0] == "map" else set())


def bind(rows: Rows, name: str) -> None:
    if name not in rows.scope:
        rows.scope.append(name)


def cross(rows: Rows, df: DataFrame) -> None:
    rows.df = df if rows.df is None else rows.df.crossJoin(df)


def scan(rows: Rows, n: dict) -> None:
    cross(rows, rows.graph.scan_nodes(n["labels"], n["var"], props_of(rows, n)))
    bind(rows, n["var"])
    rows.known[n["var"]] = set(n["labels"])
    inline(rows, n)


def begin_at_rel(rows: Rows, nodes, rels, start, used) -> None:
    a, r, b = nodes[start], rels[start], nodes[start + 1]
    edges = rows.graph.scan_rels(r["types"], r["var"], props_of(rows, r), r["dir"], set(a["labels"]), labels_of(rows, b))
    edges = edges.withColumn(a["var"], F.struct(F.col("__s").alias("_id"))).drop("__s")
    cross(rows, edges)
    bind(rows, a["var"])
    bind(rows, r["var"])
    inline(rows, r)
    unique(rows, r, used)
    far_end(rows, r, b, set(a["labels"]))


def labels_of(rows: Rows, n: dict) -> set[str]:
    """Labels that a node is known to carry, from this pattern or an earlier one."""
    return set(n["labels"]) | rows.known.get(n["var"], set())


def narrow(rows: Rows, n: dict) -> None:
    """A node that is bound already must carry the labels and properties written here."""
    kind = rows.schema_type(n["var"])
    if not v.is_node(kind) and not v.is_null(kind):
        raise CypherError(f"{n['var']} is no node")
    if n["labels"]:
        if "_labels" not in kind.fieldNames():
            rows.df = rows.df.join(rows.graph.scan_nodes(n["labels"], "__n", set()).select(F.col("__n._id").alias("__nid")), F.col("__nid") == col(n["var"])["_id"], "left_semi")
        else:
            for x in n["labels"]:
                rows.df = rows.df.where(F.array_contains(col(n["var"])["_labels"], x))
    inline(rows, n)


def inline(rows: Rows, e: dict) -> None:
    """Filters for ``{key: value}``."""
    if e["props"] is None:
        return
    pairs = e["props"][1] if e["props"][0] == "map" else {k: ("lit", x) for k, x in rows.params[e["props"][1]].items()}
    for k, x in pairs.items():
        rows.filter(("bin", "=", ("prop", ("var", e["var"]), k), x))


def unique(rows: Rows, r: dict, used) -> None:
    """No relationship stands for two of a MATCH clause."""
    for other, types, many in used:
        if r["types"] and types and not set(types) & set(r["types"]):
            continue
        mine = col(r["var"])
        if many:
            rows.df = rows.df.where(~_holds(col(other), mine))
        else:
            rows.df = rows.df.where(mine["_id"] != col(other)["_id"])
    used.append((r["var"], r["types"], False))


def _holds(many: Column, one: Column) -> Column:
    return F.exists(many, lambda x: x["_id"] == one["_id"])


def far_end(rows: Rows, r: dict, b: dict, near: set[str] = frozenset()) -> None:
    """Bind node b at column __e."""
    if b["var"] in rows.scope:
        rows.df = rows.df.where(F.col("__e") == col(b["var"])["_id"]).drop("__e")
        narrow(rows, b)
        return
    known = rows.graph.end_labels(r["types"], r["dir"], near, set(b["labels"]))
    rows.known[b["var"]] = set(b["labels"]) | known
    if b["props"] is None and rows.needs.light(b["var"]) and set(b["labels"]) <= known:
        rows.with_column(b["var"], F.struct(F.col("__e").alias("_id")))
        rows.df = rows.df.drop("__e")
        bind(rows, b["var"])
        return
    ends = rows.graph.scan_nodes(set(b["labels"]) | known, b["var"], props_of(rows, b))
    rows.df = rows.df.join(ends, F.col("__e") == col(b["var"])["_id"]).drop("__e")
    bind(rows, b["var"])
    inline(rows, b)


def hop(rows: Rows, a: dict, r: dict, b: dict, used, path) -> None:
    if r["length"] is not None:
        trails(rows, a, r, b, used, bool(path))
        return
    if r["var"] in rows.scope:
        edges = rows.graph.scan_rels(r["types"], "__r", set(), r["dir"]).select("__s", "__e", F.col("__r._id").alias("__rid"))
        rows.df = rows.df.join(edges, (col(r["var"])["_id"] == F.col("__rid")) & (col(a["var"])["_id"] == F.col("__s"))).drop("__s", "__rid")
        far_end(rows, r, b)
        return
    near = labels_of(rows, a)
    edges = rows.graph.scan_rels(r["types"], r["var"], props_of(rows, r), r["dir"], near, labels_of(rows, b))
    rows.df = rows.df.join(edges, col(a["var"])["_id"] == F.col("__s")).drop("__s")
    bind(rows, r["var"])
    inline(rows, r)
    unique(rows, r, used)
    far_end(rows, r, b, near)


def trails(rows: Rows, a: dict, r: dict, b: dict, used, path: bool) -> None:
    """Variable-length trails: each level joins the last one to the relationships not yet on it.

    A bounded length is unrolled into one plan. An open one is staged level by
    level until no trail goes on; more than ``max_hops`` levels is an error.
    """
    from arbora.operators.staging import staged

    low, high = r["length"]
    if r["var"] in rows.scope:
        replay(rows, a, r, b, used, path)
        return
    whole = path or not rows.needs.light(r["var"])
    edges = rows.graph.scan_rels(r["types"], "__r", None if whole else props_of(rows, r), r["dir"])
    if r["props"] is not None:
        inner = rows.child(edges, ["__r"])
        inline(inner, {"var": "__r", "props": r["props"]})
        edges = inner.df
    edges = edges.withColumnsRenamed({"__s": "__vs", "__e": "__ve"})
    kind = T.ArrayType(edges.schema["__r"].dataType)
    fixed = [(o, many) for o, types, many in used if not (r["types"] and types and not set(types) & set(r["types"]))]
    start = rows.df.withColumn("__e", col(a["var"])["_id"]).withColumn(r["var"], F.array().cast(kind))
    nodes_var = None
    if path:
        nodes_var = r["var"] + "__nodes"
        mids = rows.graph.scan_nodes([], "__m", None)
        start = start.withColumn(nodes_var, F.array().cast(T.ArrayType(mids.schema["__m"].dataType)))
    level, found = start, [start] if low == 0 else []
    depth = 0
    while high is None or depth < high:
        depth += 1
        step = level.join(edges, F.col("__e") == F.col("__vs")).where(~F.exists(col(r["var"]), lambda x: x["_id"] == F.col("__r")["_id"]))
        for o, many in fixed:
            step = step.where(~F.exists(col(o), lambda x: x["_id"] == F.col("__r")["_id"]) if many else F.col("__r")["_id"] != col(o)["_id"])
        step = step.withColumn(r["var"], F.array_append(col(r["var"]), F.col("__r"))).withColumn("__e", F.col("__ve")).drop("__r", "__vs", "__ve")
        if path:
            step = step.join(mids, F.col("__e") == F.col("__m._id")).withColumn(nodes_var, F.array_append(col(nodes_var), F.col("__m"))).drop("__m")
        level = step.select(*start.columns)
        if high is None:
            level = staged(level, rows.graph.spark)
            if level.isEmpty():
                break
            if depth >= rows.graph.max_hops:
                raise CypherError(f"trails go on beyond {rows.graph.max_hops} hops; bound the length or raise max_hops")
        if depth >= low:
            found.append(level)
    if not found:
        found = [start.where(F.lit(False))]
    rows.df = reduce(DataFrame.union, found)
    if r.get("turned"):
        rows.with_column(r["var"], F.reverse(col(r["var"])))
    bind(rows, r["var"])
    used.append((r["var"], r["types"], True))
    far_end(rows, r | {"types": r["types"]} if low > 0 else {"types": ["\0none"], "dir": r["dir"]}, b)


def listed(rows: Rows, var: str) -> None:
    """A variable that stands for a length of hops must be a list of relationships; an empty list and null may lack the type."""
    kind = rows.schema_type(var)
    if v.is_null(kind) or v.is_list(kind) and v.is_null(kind.elementType):
        rows.with_column(var, col(var).cast("array<struct<_id: long, _type: string, _src: long, _dst: long>>"))
    elif not v.is_list(kind) or not v.is_rel(kind.elementType):
        raise CypherError(f"{var} is no list of relationships")


def begin_at_list(rows: Rows, n: dict, r: dict) -> None:
    """Bind node n to where the list ``r`` can begin: an end of its first relationship, or any node if it is empty."""
    listed(rows, r["var"])
    first = F.get(col(r["var"]), F.lit(0))
    ends = [first[x] for x in {"out": ("_src",), "in": ("_dst",), "both": ("_src", "_dst")}[r["dir"]]]
    starts = rows.df.withColumn("__e", F.explode(F.array_distinct(F.array(*ends))))
    if r["length"][0] == 0:
        every = rows.graph.scan_nodes(n["labels"], "__n", set()).select(F.col("__n._id").alias("__e"))
        starts = starts.union(rows.df.where(F.size(col(r["var"])) == 0).crossJoin(every))
    rows.df = starts
    far_end(rows, {"types": r["types"] if r["length"][0] > 0 else ["\0none"], "dir": {"out": "in", "in": "out", "both": "both"}[r["dir"]]}, n)


def replay(rows: Rows, a: dict, r: dict, b: dict, used, path: bool) -> None:
    """A list that is bound already is walked as it stands: its relationships name their ends, so
    no trail is looked for. They are read again from the graph only where it may have changed."""
    listed(rows, r["var"])
    low, high = r["length"]
    way = col(r["var"])
    if not rows.steady:
        now = fresh("e")
        again(rows, r, now)
        rows.df = rows.df.where(F.size(col(now)) == F.size(way))
        way = col(now)
    elif r["props"] is not None:
        x = fresh("x")
        for k, e in r["props"][1].items():
            rows.filter(("quant", "all", x, ("var", r["var"]), ("bin", "=", ("prop", ("var", x), k), e)))
    if r.get("turned"):
        way = F.reverse(way)
    ids = F.transform(way, lambda x: x["_id"])
    rows.df = rows.df.where((F.size(way) >= low) & (F.size(F.array_distinct(ids)) == F.size(way)))
    if high is not None:
        rows.df = rows.df.where(F.size(way) <= high)
    if r["types"]:
        rows.df = rows.df.where(F.forall(way, lambda x: x["_type"].isin(r["types"])))
    for o, types, many in used:
        if r["types"] and types and not set(types) & set(r["types"]):
            continue
        rows.df = rows.df.where(~(F.arrays_overlap(ids, F.transform(col(o), lambda x: x["_id"])) if many else F.array_contains(ids, col(o)["_id"])))

    def onward(at: Column, x: Column) -> Column:
        out, back = (x["_src"] == at, x["_dst"]), (x["_dst"] == at, x["_src"])
        return F.when(*out) if r["dir"] == "out" else F.when(*back) if r["dir"] == "in" else F.when(*out).when(*back)

    rows.with_column("__e", F.aggregate(way, col(a["var"])["_id"], onward))
    rows.df = rows.df.where("__e is not null")
    if path:
        # The nodes on the way are looked up once for all rows.
        start = F.array(col(a["var"])["_id"])
        stops = F.aggregate(way, start, lambda ids, x: F.array_append(ids, onward(F.element_at(ids, -1), x)))
        rows.with_column("__stops", F.slice(F.reverse(stops), 2, F.size(way)) if r.get("turned") else F.slice(stops, 2, F.size(way)))
        mids = rows.graph.scan_nodes([], "__m", None)
        gather(rows, "__stops", mids, F.col("__m._id"), F.col("__m"), r["var"] + "__nodes")
    rows.df = rows.df.drop(*[x for x in ("__stops", None if rows.steady else now) if x])
    used.append((r["var"], r["types"], True))
    far_end(rows, r if low > 0 else {"types": ["\0none"], "dir": r["dir"]}, b)


def again(rows: Rows, r: dict, name: str) -> None:
    """Column ``name``: of the list ``r``, the relationships that the graph still has and the pattern admits."""
    edges = rows.graph.scan_rels(r["types"], "__r", set(r["props"][1]) if r["props"] is not None else set(), "out")
    if r["props"] is not None:
        inner = rows.child(edges, ["__r"])
        inline(inner, {"var": "__r", "props": r["props"]})
        edges = inner.df
    rows.with_column("__ids", F.transform(col(r["var"]), lambda x: x["_id"]))
    gather(rows, "__ids", edges, F.col("__r._id"), F.struct(*[F.col("__r")[x].alias(x) for x in ("_id", "_type", "_src", "_dst")]), name)
    rows.df = rows.df.drop("__ids")


def gather(rows: Rows, ids: str, found: DataFrame, key: Column, value: Column, name: str) -> None:
    """Column ``name``: for the ids of a list, in their order, what ``found`` has of them."""
    from arbora.operators.staging import staged

    rows.df = staged(rows.df.withColumn("__w", F.monotonically_increasing_id()), rows.graph.spark)
    found = found.select(key.alias("__id"), value.alias("__value"))
    at = rows.df.select("__w", F.posexplode(ids).alias("__i", "__id")).join(found, "__id").dropDuplicates(["__w", "__i"])
    lists = at.groupBy("__w").agg(F.array_sort(F.collect_list(F.struct("__i", "__value")), lambda x, y: x["__i"] - y["__i"]).alias("__l"))
    lists = lists.select("__w", F.transform("__l", lambda x: x["__value"]).alias("__l"))
    none = F.array().cast(T.ArrayType(found.schema["__value"].dataType))
    rows.df = rows.df.join(lists, "__w", "left").withColumn(name, F.coalesce("__l", none)).drop("__w", "__l")


def finish(rows: Rows, p: dict, nodes, rels) -> None:
    if not p["path"]:
        return
    kinds = rows.graph.property_types("node"), rows.graph.property_types("rel")
    ns, rs = F.array(uniform(rows, nodes[0]["var"], kinds[0])), F.array().cast(T.ArrayType(uniform_type(kinds[1], True)))
    for n, r in zip(nodes[1:], rels, strict=True):
        if r["length"] is None:
            rs = F.array_append(rs, uniform(rows, r["var"], kinds[1]))
            ns = F.array_append(ns, uniform(rows, n["var"], kinds[0]))
        else:
            elem = rows.schema_type(r["var"]).elementType
            rs = F.concat(rs, F.transform(col(r["var"]), recaster(elem, kinds[1], True)))
            mids = r["var"] + "__nodes"
            elem = rows.schema_type(mids).elementType
            ns = F.concat(ns, F.transform(col(mids), recaster(elem, kinds[0], False)))
    missing = reduce(lambda x, y: x | y, [col(e["var"]).isNull() for e in (*nodes, *rels)])
    rows.with_column(p["path"], F.when(~missing, F.struct(ns.alias("_nodes"), rs.alias("_rels"))))
    bind(rows, p["path"])
    gone = [r["var"] + "__nodes" for r in rels if r["length"] is not None]
    if gone:
        rows.df = rows.df.drop(*gone)


def uniform_type(props: dict, rel: bool) -> T.StructType:
    base = [T.StructField("_id", T.LongType())]
    base += [T.StructField("_type", T.StringType()), T.StructField("_src", T.LongType()), T.StructField("_dst", T.LongType())] if rel else [T.StructField("_labels", T.ArrayType(T.StringType()))]
    return T.StructType(base + [T.StructField(k, t) for k, t in sorted(props.items())])


def recast(x: Column, kind: T.StructType, props: dict, rel: bool) -> Column:
    """A node or relationship in the shape that all of the graph share."""
    want = uniform_type(props, rel)
    names = kind.fieldNames()
    fields = [(x[f.name].cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
    return F.when(x.isNotNull(), F.struct(*fields))


def recaster(kind: T.StructType, props: dict, rel: bool):
    return lambda x: recast(x, kind, props, rel)


def uniform(rows: Rows, var: str, props: dict) -> Column:
    kind = rows.schema_type(var)
    return recast(col(var), kind, props, v.is_rel(kind))


def shortest(rows: Rows, p: dict, nodes, rels) -> None:
    """Breadth-first search for all wanted pairs of ends at once.

    A frontier row is (source, reached node) with the relationships on the way;
    nodes reached before are dropped, and a source whose targets are all found
    goes on no more. ``shortestPath`` keeps one way per pair, ``allShortestPaths``
    every way of the least length.
    """
    from arbora.operators.staging import staged

    if len(rels) != 1:
        raise CypherError("a shortest path has one relationship pattern")
    a, r, b = nodes[0], rels[0], nodes[1]
    for n in (a, b):
        if n["var"] in rows.scope:
            narrow(rows, n)
        else:
            scan(rows, n)
    low, high = r["length"] or (1, 1)
    rows.with_column("__a", col(a["var"])["_id"])
    rows.with_column("__b", col(b["var"])["_id"])
    spark = rows.graph.spark
    pairs = staged(rows.df.select("__a", "__b").where("__a is not null and __b is not null").distinct(), spark)
    edges = rows.graph.scan_rels(r["types"], "__r", None, r["dir"]).withColumnsRenamed({"__s": "__vs", "__e": "__ve"})
    if r["props"] is not None:
        inner = rows.child(edges, ["__r"])
        inline(inner, {"var": "__r", "props": r["props"]})
        edges = inner.df
    kinds = rows.graph.property_types("node"), rows.graph.property_types("rel")
    edges = edges.select("__vs", "__ve", recast(F.col("__r"), edges.schema["__r"].dataType, kinds[1], True).alias("__r"))
    mids = rows.graph.scan_nodes([], "__m", None)
    mids = mids.select(F.col("__m._id").alias("__mid"), recast(F.col("__m"), mids.schema["__m"].dataType, kinds[0], False).alias("__m"))
    none = F.array().cast(T.ArrayType(edges.schema["__r"].dataType))
    frontier = pairs.select("__a").distinct().select("__a", F.col("__a").alias("__at"), none.alias("__rs"))
    seen = frontier.select("__a", F.col("__at").alias("__was"))
    hits = [pairs.where("__a = __b").select("__a", "__b", none.alias("__rs"))]
    open_pairs, depth = pairs.where("__a <> __b"), 0
    while high is None or depth < high:
        depth += 1
        step = frontier.join(edges, F.col("__at") == F.col("__vs"))
        step = step.join(seen.withColumnRenamed("__a", "__sa"), (F.col("__a") == F.col("__sa")) & (F.col("__ve") == F.col("__was")), "left_anti")
        step = step.select("__a", F.col("__ve").alias("__at"), F.array_append("__rs", F.col("__r")).alias("__rs"))
        if p["short"] == "one":
            ids = F.transform("__rs", lambda x: x["_id"])
            step = step.groupBy("__a", "__at").agg(F.min_by("__rs", ids).alias("__rs"))
        frontier = staged(step, spark)
        hit = frontier.join(open_pairs.select("__a", F.col("__b").alias("__at")), ["__a", "__at"]).select("__a", F.col("__at").alias("__b"), "__rs")
        hits.append(hit)
        open_pairs = staged(open_pairs.join(hit.select("__a", "__b"), ["__a", "__b"], "left_anti"), spark)
        frontier = frontier.join(open_pairs.select("__a").distinct(), "__a", "left_semi")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("__a", F.col("__at").alias("__was")).distinct())
        if high is None and depth >= rows.graph.max_hops:
            raise CypherError(f"paths go on beyond {rows.graph.max_hops} hops")
    found = reduce(DataFrame.union, hits)
    # The nodes on the way: from each relationship its other end, looked up once for all paths.
    ways = found.withColumn("__w", F.monotonically_increasing_id())
    ways = staged(ways, spark)
    ends = ways.select("__w", "__a", F.expr("aggregate(__rs, array(__a), (acc, x) -> array_append(acc, if(element_at(acc, -1) = x._src, x._dst, x._src)))").alias("__ids"))
    at = ends.select("__w", F.posexplode("__ids").alias("__i", "__id")).join(mids, F.col("__id") == F.col("__mid"))
    listed = at.groupBy("__w").agg(F.array_sort(F.collect_list(F.struct("__i", F.col("__m"))), lambda x, y: x["__i"] - y["__i"]).alias("__l"))
    listed = listed.select("__w", F.transform("__l", lambda x: x["__m"]).alias("__ns"))
    ways = ways.join(listed, "__w").select(F.col("__a").alias("__pa"), F.col("__b").alias("__pb"), "__rs", "__ns")
    rows.df = rows.df.join(ways, (F.col("__a") == F.col("__pa")) & (F.col("__b") == F.col("__pb"))).drop("__pa", "__pb", "__a", "__b")
    if p["path"]:
        rows.with_column(p["path"], F.struct(F.col("__ns").alias("_nodes"), F.col("__rs").alias("_rels")))
        bind(rows, p["path"])
    if not r["anonymous"]:
        rows.with_column(r["var"], F.col("__rs"))
        bind(rows, r["var"])
    rows.df = rows.df.drop("__rs", "__ns")
