"""Files in and out: LOAD CSV, the load procedures, and exports.

Nothing is read or written outside the folder that the graph names as its
``import_root``; without one these sources are closed.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans.lower import CypherError, Rows


def allowed(graph, path: str) -> str:
    """The full path of a file under the import root."""
    if graph.import_root is None:
        raise CypherError("imports and exports are not enabled for this graph")
    path = path.removeprefix("file://")
    full = posixpath.normpath(path if path.startswith("/") else posixpath.join(graph.import_root, path))
    root = posixpath.normpath(graph.import_root)
    if full != root and not full.startswith(root + "/"):
        raise CypherError("the path lies outside the import root")
    return full


def _constant(rows: Rows, e) -> str:
    if e[0] == "lit":
        return e[1]
    if e[0] == "param":
        return rows.params[e[1]]
    raise CypherError("a file name must be a literal or a parameter")


def load_csv(rows: Rows, c: dict) -> None:
    path = allowed(rows.graph, _constant(rows, c["expr"]))
    read = rows.graph.spark.read.option("header", c["headers"]).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("quote", '"').option("escape", '"')
    df = read.csv(path)
    value = F.struct(*[F.col(f"`{n}`").alias(n) for n in df.columns]) if c["headers"] else F.array(*[F.col(f"`{n}`") for n in df.columns])
    df = df.select(value.alias(c["var"]))
    rows.df = df if rows.df is None else rows.df.crossJoin(df)
    rows.scope.append(c["var"])


def csv_rows(graph, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """(lineNo, list, map) of a CSV file; lines are counted from 1 without the header."""
    df = graph.spark.read.option("header", header).option("sep", sep).csv(allowed(graph, path))
    names = df.columns
    items = F.array(*[F.col(f"`{n}`") for n in names])
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), items) if header else F.lit(None).cast("map<string,string>")
    at = df.select(F.monotonically_increasing_id().alias("i"), items.alias("list"), pairs.alias("map"))
    # Line numbers without one task for all lines: counts of the partitions, summed up on the driver.
    part = at.select(F.shiftright("i", 33).alias("p"), F.col("i").bitwiseAND((1 << 33) - 1).alias("k"), "list", "map")
    counts = {r.p: r["count"] for r in part.groupBy("p").count().collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    table = F.map_from_entries(F.array(*[F.struct(F.lit(p), F.lit(o)) for p, o in offsets.items()])) if offsets else None
    line = (F.col("k") + table[F.col("p")] + 1).cast("long") if offsets else F.lit(0).cast("long")
    return part.select(line.alias("lineNo"), "list", "map")


def json_rows(graph, path: str, pointer: str | None = None) -> DataFrame:
    """(value): the objects of a JSON file, one for each item of a top-level array; with a
    JSON pointer, what it points at, one for each item if that is an array."""
    df = graph.spark.read.option("multiLine", True).json(allowed(graph, path))
    df = df.select(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("value"))
    if not pointer:
        return df
    missing = f"the JSON pointer {pointer} leads nowhere"
    if not pointer.startswith("/"):
        raise CypherError(missing)
    steps = [x.replace("~1", "/").replace("~0", "~") for x in pointer[1:].split("/")]
    number = lambda x: x.isascii() and x.isdigit() and (x == "0" or x[0] != "0")
    if len(df.inputFiles()) > 1:
        raise CypherError("a JSON pointer needs a single file")
    # A file of several lines is read by one task: the rows are a top-level array's items in their order.
    head = df.limit(2).count()
    is_array = head != 1 or graph.spark.read.text(allowed(graph, path), wholetext=True).select(F.ltrim(F.regexp_replace("value", r"^[\s\ufeff]+", "")).startswith("[")).first()[0]
    if is_array:
        at = steps.pop(0)
        if not number(at):
            raise CypherError(missing)
        df = df.withColumn("i", F.monotonically_increasing_id()).where(F.col("i") == int(at)).select("value")
        if df.isEmpty():
            raise CypherError(missing)
    value, kind = F.col("value"), df.schema["value"].dataType
    for x in steps:
        if isinstance(kind, T.StructType) and x in kind.names:
            value, kind = value.getField(x), kind[x].dataType
        elif isinstance(kind, T.ArrayType) and number(x):
            there = F.size(value) > int(x)
            value, kind = F.when(there, F.get(value, F.lit(int(x)))).otherwise(F.raise_error(F.lit(missing)).cast(kind.elementType)), kind.elementType
        else:
            raise CypherError(missing)
    return df.select((F.explode(value) if isinstance(kind, T.ArrayType) else value).alias("value"))


def _graph_rows(graph) -> DataFrame:
    """Nodes and relationships in one frame: id, labels, start, end, type, properties as JSON."""
    parts = []
    for t in graph.nodes:
        own = [c for c in t.df.columns if c != "id"]
        parts.append(t.df.select(F.col("id"), F.lit(":" + ":".join(t.labels) if t.labels else "").alias("labels"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"),
                                 F.lit(None).cast("string").alias("type"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in own])).alias("properties") if own else F.lit("{}").alias("properties")))
    for t in graph.rels:
        own = [c for c in t.df.columns if c not in ("id", "src", "dst")]
        parts.append(t.df.select(F.col("id"), F.lit("").alias("labels"), F.col("src").alias("start"), F.col("dst").alias("end"), F.lit(t.type).alias("type"),
                                 F.to_json(F.struct(*[F.col(f"`{c}`") for c in own])).alias("properties") if own else F.lit("{}").alias("properties")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _element_rows(query: DataFrame) -> DataFrame:
    """The nodes and relationships among a query's columns, each once, in the shape of a graph's rows."""
    from arbora.plans import values as v

    parts = []
    for f in query.schema:
        if not v.is_element(f.dataType):
            continue
        x = F.col(f"`{f.name}`")
        own = [n for n in f.dataType.fieldNames() if not n.startswith("_")]
        props = F.to_json(F.struct(*[x[n].alias(n) for n in own])) if own else F.lit("{}")
        none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
        rel = v.is_rel(f.dataType)
        labels = F.lit("") if rel or "_labels" not in f.dataType.fieldNames() else F.concat(F.when(F.size(x["_labels"]) > 0, F.lit(":")).otherwise(F.lit("")), F.array_join(x["_labels"], ":"))
        parts.append(query.where(x.isNotNull()).select(
            x["_id"].alias("id"), labels.alias("labels"), (x["_src"] if rel else none).alias("start"), (x["_dst"] if rel else none).alias("end"),
            (x["_type"] if rel else text).alias("type"), props.alias("properties")))
    if not parts:
        raise CypherError("the query returns no nodes or relationships")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def export(graph, what: str, path: str, query: DataFrame | None = None) -> DataFrame:
    """Write the graph, or a query's rows, as csv, json or cypher; returns one row about it."""
    full = allowed(graph, path)
    df = query if query is not None else _graph_rows(graph)
    if what == "csv":
        flat = df.select(*[(F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])
        flat.write.mode("overwrite").option("header", True).csv(full)
    elif what == "json":
        df.write.mode("overwrite").json(full)
    else:
        if query is not None:
            df = _element_rows(query)
        keyed = F.regexp_replace("properties", r'"([A-Za-z_]\w*)":', "$1: ")
        node = F.concat(F.lit("CREATE ("), F.col("labels"), F.lit(" {_export_id: "), F.col("id").cast("string"), F.when(F.length(keyed) > 2, F.concat(F.lit(", "), F.substring(keyed, 2, 1 << 30))).otherwise(F.lit("}")), F.lit(");"))
        rel = F.concat(F.lit("MATCH (a {_export_id: "), F.col("start").cast("string"), F.lit("}), (b {_export_id: "), F.col("end").cast("string"), F.lit("}) CREATE (a)-[:"), F.col("type"), F.lit(" "), keyed, F.lit("]->(b);"))
        df.select(F.when(F.col("type").isNull(), node).otherwise(rel).alias("value")).write.mode("overwrite").text(full)
    n = sum(t.df.count() for t in graph.nodes) if query is None else 0
    r = sum(t.df.count() for t in graph.rels) if query is None else 0
    return graph.spark.createDataFrame([(full, "graph" if query is None else "query", what, n, r, n + r if query is None else df.count())], "file string, source string, format string, nodes long, relationships long, rows long")
