"""Schema statements: indexes and constraints as catalog entries.

An index here says which properties queries seek by; files laid out by it are
found through Parquet statistics. Constraints are checked whenever a write is
committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans import values as v
from arbora.plans.lower import CypherError


# Names of property types and the data types that hold them.
PROPERTY_TYPES = {
    "STRING": ("string",), "INTEGER": ("bigint", "int", "smallint", "tinyint"), "INT": ("bigint", "int", "smallint", "tinyint"), "FLOAT": ("double", "float"),
    "BOOLEAN": ("boolean",), "BOOL": ("boolean",), "DATE": ("date",), "ZONED DATETIME": ("timestamp",), "DATETIME": ("timestamp",), "LOCAL DATETIME": ("timestamp_ntz",),
    "LOCALDATETIME": ("timestamp_ntz",), "ZONED TIME": (v.TIME.simpleString(),), "TIME": (v.TIME.simpleString(),), "LOCAL TIME": (v.LOCAL_TIME.simpleString(),),
    "LOCALTIME": (v.LOCAL_TIME.simpleString(),), "DURATION": (v.DURATION.simpleString(),), "POINT": (v.POINT.simpleString(),),
}


class ConstraintViolation(CypherError):
    """A write, or the data at the time a constraint is created, breaks it."""


def check(graph, c: dict) -> None:
    tables = [t.df for t in graph.nodes if c["label"] in t.labels] if c["scope"] == "node" else [t.df for t in graph.rels if t.type == c["label"]]
    props = c["properties"]
    frames = [df.select("id", *[(F.col(f"`{p}`") if p in df.columns else F.lit(None).cast("string")).alias(p) for p in props]) for df in tables]
    for df in frames:
        if c["type"] in ("NOT NULL", "NODE KEY") and not df.where(" or ".join(f"`{p}` is null" for p in props)).isEmpty():
            raise ConstraintViolation(f"{c['name']}: a value is missing")
        if c["type"].startswith("IS ::"):
            want = PROPERTY_TYPES.get(c["type"][6:].upper())
            if want is None:
                raise CypherError(f"unknown property type {c['type'][6:]}; there are {', '.join(PROPERTY_TYPES)}")
            for p in props:
                if dict(df.dtypes)[p] not in want and not df.where(f"`{p}` is not null").isEmpty():
                    raise ConstraintViolation(f"{c['name']}: {p} has another type")
    if c["type"] in ("UNIQUE", "NODE KEY") and frames:
        keys = [df.select(*[F.col(f"`{p}`").cast("string").alias(p) for p in props]).where(" and ".join(f"`{p}` is not null" for p in props)) for df in frames]
        every = keys[0]
        for k in keys[1:]:
            every = every.union(k)
        if not every.groupBy(*props).count().where("count > 1").isEmpty():
            raise ConstraintViolation(f"{c['name']}: a value occurs twice")


def check_all(graph) -> None:
    for c in graph.constraints:
        check(graph, c)


def _frame(graph, rows: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return graph.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def run_schema(graph, s: dict) -> DataFrame:
    if s["what"] == "constraint":
        shown = "name string, scope string, label string, properties array<string>, type string"
        if s["verb"] == "show":
            return _frame(graph, graph.constraints, shown)
        if s["verb"] == "create":
            entry = {k: s[k] for k in ("scope", "label", "properties", "type")}
            entry["name"] = s["name"] or f"{s['scope']}_{s['label']}_{'_'.join(s['properties'])}_{s['type'].replace(' ', '_').lower()}"
            if any(c["name"] == entry["name"] or {k: c[k] for k in entry} == entry for c in graph.constraints):
                if not s["guard"]:
                    raise CypherError(f"constraint {entry['name']} exists")
            else:
                check(graph, entry)
                graph.constraints.append(entry)
            return _frame(graph, [entry], shown)
        found = [c for c in graph.constraints if c["name"] == s["name"]]
        if not found and not s["guard"]:
            raise CypherError(f"there is no constraint {s['name']}")
        graph.constraints = [c for c in graph.constraints if c not in found]
        return _frame(graph, found, shown)
    kind = "POINT" if s["what"] == "point_index" else "RANGE"
    shown = "scope string, label string, properties array<string>, type string, state string"
    if s["verb"] == "show":
        return _frame(graph, [i for i in graph.indexes if (i["type"] == "POINT") == (kind == "POINT")], shown)
    entry = {"scope": s["scope"], "label": s["label"], "properties": s["properties"], "type": kind}
    have = [i for i in graph.indexes if {k: i[k] for k in entry} == entry]
    if s["verb"] == "create":
        if not have:
            graph.indexes.append(entry | {"state": "online"})
        return _frame(graph, [entry | {"state": "created" if not have else "online"}], shown)
    graph.indexes = [i for i in graph.indexes if i not in have]
    return _frame(graph, [entry | {"state": "dropped"}], shown)
