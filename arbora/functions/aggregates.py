"""Aggregates of the language on Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans import values as v
from arbora.plans.lower import ORDER, CypherError, Rows, Val, col


def _same(c: Column) -> Column:
    return c


def _in_order(x: Column) -> Column:
    """The non-null values of a group in the order of the rows."""
    pairs = F.collect_list(F.when(x.isNotNull(), F.struct(col(ORDER).alias("o"), x.alias("x"))))
    return F.transform(F.array_sort(pairs, lambda a, b: F.when(a["o"] < b["o"], F.lit(-1)).when(a["o"] > b["o"], F.lit(1)).otherwise(F.lit(0))), lambda p: p["x"])


def lower_aggregate(rows: Rows, name: str, e, vals: list[Val], ordered: bool = False) -> tuple[Column, Callable[[Column], Column]]:
    """(aggregate over the columns ``<name>_<i>``, what to do with its result); ``ordered``: rows have a known order."""
    how, distinct = e[1], e[2]
    if how == "count" and e[3] is None:
        return F.count(F.lit(1)), lambda c: F.coalesce(c, F.lit(0).cast("long"))
    x, kind = col(f"{name}_0"), vals[0].type
    if v.is_null(kind):
        x, kind = x.cast("double"), T.DoubleType()
    if how == "count":
        on = x["_id"] if v.is_element(kind) else x
        # An element is null as a whole, not by its id.
        return (F.count_distinct(on) if distinct else F.count(on)), lambda c: F.coalesce(c, F.lit(0).cast("long"))
    if how in ("sum", "avg") and v.is_duration(kind):
        raise CypherError(f"{how} needs numbers")
    if how == "sum":
        to = "double" if v.is_float(kind) else "long"
        return (F.sum_distinct(x.cast(to)) if distinct else F.sum(x.cast(to))), lambda c: F.coalesce(c, F.lit(0).cast(to))
    if how == "avg":
        return (F.expr(f"avg(distinct cast(`{name}_0` as double))") if distinct else F.avg(x.cast("double"))), _same
    if how == "min":
        return F.min(x), _same
    if how == "max":
        return F.max(x), _same
    if how == "collect":
        empty = F.array().cast(T.ArrayType(kind))
        listed = _in_order(x) if ordered else F.collect_list(x)
        if distinct:
            return listed, lambda c: F.coalesce(F.array_distinct(c), empty)
        return listed, lambda c: F.coalesce(c, empty)
    if how in ("stdev", "stdevp"):
        f = F.stddev_samp if how == "stdev" else F.stddev_pop
        return f(x.cast("double")), lambda c: F.coalesce(c, F.lit(0.0))
    if how in ("percentiledisc", "percentilecont"):
        p = rows.known_value(e[3][1])
        if isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 1:
            raise CypherError("a percentile lies between 0 and 1")
        if how == "percentilecont":
            return F.expr(f"percentile(cast(`{name}_0` as double), {float(p)!r}D)"), _same
        cast = (lambda c: c.cast("long")) if v.is_int(kind) else _same
        return F.expr(f"percentile_disc({float(p)!r}D) WITHIN GROUP (ORDER BY `{name}_0`)"), cast
    if how == "apoc.agg.first":
        return (F.min_by(x, F.when(x.isNotNull(), col(ORDER))) if ordered else F.first(x, ignorenulls=True)), _same
    if how == "apoc.agg.last":
        return (F.max_by(x, F.when(x.isNotNull(), col(ORDER))) if ordered else F.last(x, ignorenulls=True)), _same
    if how == "apoc.agg.nth":
        n = rows.known_value(e[3][1])
        if not isinstance(n, int) or n < 0:
            raise CypherError("nth needs 0 or more")
        return (_in_order(x) if ordered else F.collect_list(x)), lambda c: F.get(c, F.lit(n))
    if how == "apoc.agg.median":
        return F.median(x.cast("double")), _same
    if how == "apoc.agg.product":
        if v.is_int(kind):
            return F.collect_list(x), lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(1).cast("long"), lambda a, y: a * y))
        return F.product(x), _same
    raise CypherError(f"unknown aggregate {how}")
