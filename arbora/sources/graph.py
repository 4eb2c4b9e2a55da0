"""The graph catalog: typed node tables by label set, relationship tables by type.

A node table has a BIGINT ``id`` and typed property columns; a relationship
table has ``id``, ``src`` and ``dst`` too, and may declare which labels its ends
carry, so that a hop needs no look at the node table when only the end's
identity is asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = 48


class _Table:
    """A table that is made when it is first asked for."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame]):
        self._df = df

    @property
    def df(self) -> DataFrame:
        if callable(self._df) and not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df


class NodeTable(_Table):
    """Nodes that carry exactly ``labels``."""

    def __init__(self, labels: tuple[str, ...], df):
        super().__init__(df)
        self.labels = labels


class RelTable(_Table):
    """Relationships of a type; declared labels are exactly those that all ends of that side have."""

    def __init__(self, type: str, df, src_labels: tuple[str, ...] = (), dst_labels: tuple[str, ...] = ()):
        super().__init__(df)
        self.type, self.src_labels, self.dst_labels = type, src_labels, dst_labels


@dataclass
class Graph:
    """Tables of a property graph, with its schema objects and settings."""

    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    #: Longest unbounded expansion; a longer trail is an error and not a silent cut.
    max_hops: int = 64
    #: What LOAD CSV and the load and export procedures may touch; closed by default.
    import_root: str | None = None
    triggers: dict = field(default_factory=dict)
    procedures: dict = field(default_factory=dict)
    #: The largest id so far and the tables that it covers.
    top_id: int = 0
    seen_tables: dict = field(default_factory=dict)

    def cypher(self, text: str, **params) -> DataFrame:
        from arbora.plans.lower import run

        return run(self, text, params)

    # schema -------------------------------------------------------------------
    def property_types(self, which: str) -> dict[str, T.DataType]:
        """All property names of nodes or relationships, conflicting types widened."""
        out: dict[str, T.DataType] = {}
        for t in self.nodes if which == "node" else self.rels:
            for f in t.df.schema:
                if f.name in ("id", "src", "dst"):
                    continue
                old = out.get(f.name)
                out[f.name] = f.dataType if old in (None, f.dataType) else widened(old, f.dataType)
        return out

    # scans --------------------------------------------------------------------
    def scan_nodes(self, labels: Iterable[str], var: str, props: set[str] | None) -> DataFrame:
        """One struct column ``var`` of the nodes that carry all ``labels``; ``props`` None: all."""
        tables = [t for t in self.nodes if set(labels) <= set(t.labels)]
        types: dict[str, T.DataType] = {}
        for t in tables:
            for f in t.df.schema:
                if f.name != "id" and (props is None or f.name in props):
                    old = types.get(f.name)
                    types[f.name] = f.dataType if old in (None, f.dataType) else widened(old, f.dataType)
        parts = []
        for t in tables:
            cols = [F.col("id").alias("_id"), F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias("_labels")]
            cols += [_as(t.df, name, kind) for name, kind in sorted(types.items())]
            parts.append(t.df.select(F.struct(*cols).alias(var)))
        if not parts:
            kind = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_labels", T.ArrayType(T.StringType()))])
            return self.spark.createDataFrame([], T.StructType([T.StructField(var, kind)]))
        return reduce(DataFrame.union, parts)

    def _sides(self, types: list[str], direction: str, near: set[str], far: set[str]) -> list[tuple[RelTable, str]]:
        """Relationship tables, with the way they are read, whose declared ends can carry the labels."""
        fits = lambda want, declared: not declared or want <= set(declared)
        out = []
        for t in self.rels:
            if types and t.type not in types:
                continue
            if direction in ("out", "both") and fits(near, t.src_labels) and fits(far, t.dst_labels):
                out.append((t, "out"))
            if direction in ("in", "both") and fits(near, t.dst_labels) and fits(far, t.src_labels):
                out.append((t, "in"))
        return out

    def scan_rels(self, types: list[str], var: str, props: set[str] | None, direction: str, near: set[str] = frozenset(), far: set[str] = frozenset()) -> DataFrame:
        """(__s, __e, var): relationships from start to end as the pattern reads them; ``near``
        and ``far`` are labels that the ends must carry, by which whole tables drop out."""
        sides = self._sides(types, direction, set(near), set(far))
        tables = list({id(t): t for t, _ in sides}.values())
        kinds: dict[str, T.DataType] = {}
        for t in tables:
            for f in t.df.schema:
                if f.name not in ("id", "src", "dst") and (props is None or f.name in props):
                    old = kinds.get(f.name)
                    kinds[f.name] = f.dataType if old in (None, f.dataType) else widened(old, f.dataType)
        parts = []
        for t, way in sides:
            cols = [F.col("id").alias("_id"), F.lit(t.type).alias("_type"), F.col("src").alias("_src"), F.col("dst").alias("_dst")]
            cols += [_as(t.df, name, kind) for name, kind in sorted(kinds.items())]
            struct = F.struct(*cols).alias(var)
            if way == "out":
                parts.append(t.df.select(F.col("src").alias("__s"), F.col("dst").alias("__e"), struct))
            else:
                # A loop reads the same both ways and counts once.
                back = t.df.where("src <> dst") if (t, "out") in sides else t.df
                parts.append(back.select(F.col("dst").alias("__s"), F.col("src").alias("__e"), struct))
        if not parts:
            return self.spark.createDataFrame([], f"__s long, __e long, `{var}` struct<_id: long, _type: string, _src: long, _dst: long>")
        return reduce(DataFrame.union, parts)

    def end_labels(self, types: list[str], direction: str, near: set[str] = frozenset(), far: set[str] = frozenset()) -> set[str]:
        """Labels that every far end of such relationships is declared to carry."""
        found: set[str] | None = None
        for t, way in self._sides(types, direction, set(near), set(far)):
            ends = set(t.dst_labels if way == "out" else t.src_labels)
            found = ends if found is None else found & ends
        return found or set()


def _as(df: DataFrame, name: str, kind: T.DataType):
    return (F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, numbers) and isinstance(b, numbers):
        return T.DoubleType() if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)) else T.LongType()
    return T.StringType()


def tables_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The property graph over the star-schema tables: ids are tag * 2^48 + key."""
    read = functools.cache(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))
    tags = {n: i + 1 for i, n in enumerate(("Region", "Nation", "Customer", "Supplier", "Part", "Order", "User", "Event", "Document", "Page"))}
    key = lambda label, col: (F.lit(tags[label] << _TAG).cast("long") + F.col(col).cast("long"))
    edge = lambda tag, col: (F.lit(tag << _TAG).cast("long") + col)
    g = Graph(spark)

    def node(label, table, id_col, **props):
        cols = [key(label, id_col).alias("id"), *[(F.col(c).cast("long") if c == "p_size" else F.col(c)).alias(p) for p, c in props.items()]]
        g.nodes.append(NodeTable((label,), lambda: table().select(*cols)))

    of = lambda n: lambda: read(n)
    node("Region", of("region"), "r_regionkey", name="r_name")
    node("Nation", of("nation"), "n_nationkey", name="n_name")
    node("Customer", of("customer"), "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment")
    node("Supplier", of("supplier"), "s_suppkey", name="s_name", acctbal="s_acctbal")
    node("Part", of("part"), "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice")
    node("Order", of("orders"), "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority")
    node("User", lambda: read("events").select("user_id").distinct(), "user_id", user_id="user_id")
    node("Event", of("events"), "event_id", ts="ts", event_type="event_type", value="value", props="props")
    node("Document", of("documents"), "doc_id", text="text", lang="lang", source="source", n_chars="n_chars")
    node("Page", of("pages"), "page_id", url="url", html="html")

    def rel(kind, tag, source, own, src, dst, props=None):
        def make():
            df = source()
            ident = F.col(own).cast("long") if own else F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in df.columns]), 17)
            cols = [edge(tag, ident).alias("id"), key(*src).alias("src"), key(*dst).alias("dst")]
            cols += [(F.col(c).cast("long") if c in ("l_suppkey", "l_linenumber") else F.col(c)).alias(p) for p, c in (props or {}).items()]
            return df.select(*cols)

        g.rels.append(RelTable(kind, make, (src[0],), (dst[0],)))

    rel("IN_REGION", 1, of("nation"), "n_nationkey", ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    rel("IN_NATION", 2, of("customer"), "c_custkey", ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
    rel("IN_NATION", 3, of("supplier"), "s_suppkey", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
    rel("PLACED", 4, of("orders"), "o_orderkey", ("Customer", "o_custkey"), ("Order", "o_orderkey"))
    # No key of the lines is unique, so a hash over all columns tells parallel lines apart.
    rel("CONTAINS", 5, of("lineitem"), None, ("Order", "l_orderkey"), ("Part", "l_partkey"), {
        "linenumber": "l_linenumber", "suppkey": "l_suppkey", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount",
        "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"})
    rel("SUPPLIES", 6, lambda: read("lineitem").select("l_suppkey", "l_partkey").distinct(), None, ("Supplier", "l_suppkey"), ("Part", "l_partkey"))
    rel("DID", 7, of("events"), "event_id", ("User", "user_id"), ("Event", "event_id"))
    return g
