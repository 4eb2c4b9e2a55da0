"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by membership pattern, the set of sources they belong
to. A flow carries words from patterns to the sources' quotas: each pattern
offers its words once for every permitted repetition, and each repetition costs
more than the last (convex costs), so that a flow of least cost repeats as
little as it can. Within a pattern whole documents are then selected in the
order of a seeded hash of (doc_id, text), up to the words routed, and a few more
documents are taken whose sizes close the rest best.

The order needs no sort of a pattern: a histogram over the hash's leading bits
finds the bucket in which the routed words end, a second one the bucket inside
it, and only that bucket is summed up row by row. What leaves the executors is
one row per pattern; the number of patterns is the number of sources and of
their overlaps, not of documents, and more than ``MAX_PATTERNS`` are an error.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; rows that repeat both doc_id and text share a
hash and are taken alike; an empty table gives an empty result; extra columns
are carried along (columns of the names added here are replaced).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.llm.common import WORD, quoted, shielded, staged, table

#: Bits of the hash that each histogram takes: 4,096 buckets a pattern.
BITS = 12
#: So many documents of a pattern at most close the rest after the ordered ones.
CLOSINGS = 4
#: Patterns that the driver plans; more of them are an error.
MAX_PATTERNS = 1_000_000
#: A broadcast of the patterns' cuts is only asked for up to so many patterns.
MAX_BROADCAST_PATTERNS = 100_000


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (5, 2, 1)
    total_percent: int = 150
    max_repeats: int = 2
    seed: int = 20_240_601


def water_fill(sizes: list[int], spec: MixSpec) -> list[float]:
    """Targets in the order of the sources: shares by weight, none above
    ``max_repeats`` times its source's size, the excess reshared by weight."""
    weights = [spec.weights[i % len(spec.weights)] for i in range(len(sizes))]
    left, targets = sum(sizes) * spec.total_percent / 100, [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / whole > spec.max_repeats * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = float(spec.max_repeats * sizes[i])
        left -= sum(targets[i] for i in over)
        free -= set(over)
    return targets


def min_cost_flow(patterns: list[tuple[frozenset[int], int]], quotas: list[int], max_repeats: int) -> dict[tuple[int, int], int]:
    """Words to carry from each pattern (its sources, its words) to each of its sources.

    Sources that no pattern ties together do not meet in a flow, so each group
    of tied sources is solved on its own.
    """
    parent = list(range(len(quotas)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for members, _ in patterns:
        for s in members:
            parent[find(s)] = find(min(members))
    groups: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        if members:
            groups.setdefault(find(min(members)), []).append(p)
    out = {}
    for numbers in groups.values():
        sources = sorted({s for p in numbers for s in patterns[p][0]})
        at = {s: i for i, s in enumerate(sources)}
        part = [(frozenset(at[s] for s in patterns[p][0]), patterns[p][1]) for p in numbers]
        out |= {(numbers[p], sources[s]): x for (p, s), x in _flow(part, [quotas[s] for s in sources], max_repeats).items()}
    return out


def _flow(patterns: list[tuple[frozenset[int], int]], quotas: list[int], max_repeats: int) -> dict[tuple[int, int], int]:
    """The flow of one group of sources.

    Successive cheapest augmenting paths. The cost of a unit is the repetition
    it belongs to, so residual paths with reduced costs are searched by
    Dijkstra; each augmentation fills an edge, so the number of steps follows
    the patterns and sources.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, words) in enumerate(patterns):
        for repeat in range(max_repeats):
            edge(start, p, words, repeat)
        for s in sorted(members):
            edge(p, n + s, max_repeats * words, 0)
    for s, quota in enumerate(quotas):
        edge(n + s, end, quota, 0)
    potential = [0] * len(graph)
    while True:
        far, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (c := d + cost + potential[a] - potential[b]) < far.get(b, float("inf")):
                    far[b], via[b] = c, (a, k)
                    heapq.heappush(heap, (c, b))
        if end not in far:
            break
        for v, d in far.items():
            potential[v] += min(d, far[end])
        for v in range(len(graph)):
            if v not in far:
                potential[v] += far[end]
        room, v = float("inf"), end
        while v != start:
            a, k = via[v]
            room, v = min(room, graph[a][k][1]), a
        v = end
        while v != start:
            a, k = via[v]
            graph[a][k][1] -= room
            graph[v][graph[a][k][3]][1] += room
            v = a
    return {(p, b - n): graph[b][back][1] for p in range(n) for b, _, _, back in graph[p] if n <= b < start and graph[b][back][1]}


def _keyed(docs: DataFrame, sources: str, seed: int) -> DataFrame:
    """Adds _size, _pattern (the sorted set of sources as one string) and _h."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # A set with a null member is told apart from one without; text of members is length-prefixed.
    one = lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x))
    pattern = F.array_join(F.array_sort(F.array_distinct(F.transform(F.col(sources), one))), "")
    return docs.withColumns({"_size": size, "_pattern": pattern, "_h": F.xxhash64(F.lit(seed), "doc_id", "text")})


def plan_mix(narrow: DataFrame, spec: MixSpec) -> tuple[DataFrame, list]:
    """(cuts by pattern, sources): what of each pattern is taken.

    ``narrow`` has _pattern, _sources, _size and _h. Every document of a pattern
    is taken ``full`` times, those with _h < cut or _h in closing once more.
    """
    spark = narrow.sparkSession
    groups = staged(narrow.groupBy("_pattern").agg(F.first("_sources").alias("members"), F.sum("_size").alias("words")), "mix-patterns")
    if (n := groups.count()) > MAX_PATTERNS:
        raise ValueError(f"{n} patterns of sources; a plan takes {MAX_PATTERNS} at most")
    found = groups.orderBy("_pattern").collect()
    names = sorted({s for r in found for s in r.members}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    place = {s: i for i, s in enumerate(names)}
    held = [sum(r.words for r in found if s in r.members) for s in names]
    targets = water_fill(held, spec)
    routed = min_cost_flow([(frozenset(place[s] for s in r.members), r.words) for r in found], [round(t) for t in targets], spec.max_repeats)
    sent = [0] * len(found)
    for (p, _), words in routed.items():
        sent[p] += words
    full = [min(spec.max_repeats, f // r.words) if r.words else 0 for f, r in zip(sent, found)]
    rows = [(r._pattern, k, f - k * r.words) for r, f, k in zip(found, sent, full)]
    need = spark.createDataFrame(rows, "_pattern string, full long, rest long")
    if len(rows) <= MAX_BROADCAST_PATTERNS:
        need = F.broadcast(need)
    sources = [(s, held[i], targets[i]) for i, s in enumerate(names)]
    docs = narrow.join(need.where("rest > 0"), "_pattern").select("_pattern", "_size", "_h", "rest")
    # Two histograms, each over the next bits of the hash; bucket numbers keep the signed order.
    low = docs.withColumn("before", F.lit(0).cast("long"))
    for level in (1, 2):
        bucket = F.shiftright("_h", 64 - BITS * level)
        sums = low.groupBy("_pattern", bucket.alias("b")).agg(F.sum("_size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = F.sum("n").over(W.partitionBy("_pattern").orderBy("b").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
        ends = sums.withColumn("upto", run).where("upto > rest and upto - n <= rest").select("_pattern", "b", (F.col("upto") - F.col("n")).alias("before"))
        low = low.drop("before").join(F.broadcast(ends) if len(rows) <= MAX_BROADCAST_PATTERNS else ends, "_pattern").where(bucket == F.col("b")).drop("b")
    by_hash = low.groupBy("_pattern", "_h").agg(F.sum("_size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = F.sum("n").over(W.partitionBy("_pattern").orderBy("_h").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    # The first hash at which the sum passes the rest; it and all after it stay out.
    cut = by_hash.withColumn("upto", run).where("upto > rest").groupBy("_pattern").agg(
        F.min("_h").alias("cut"), F.expr("min_by(upto - n, _h)").alias("reached"))
    cut = staged(cut, "mix-cuts")
    if len(rows) <= MAX_BROADCAST_PATTERNS:
        cut = F.broadcast(cut)
    # Closing documents, each only if it brings the sum nearer: the largest that still fit,
    # at last whichever is nearest. Rows of one hash count together.
    out = staged(docs.join(cut, "_pattern").where("_h >= cut and _size > 0").groupBy("_pattern", "_h").agg(
        F.sum("_size").alias("n"), (F.first("rest") - F.first("reached")).alias("gap")), "mix-rest")
    close = spark.createDataFrame([], "_pattern string, closing array<long>, filled long")
    for fits in [True] * (CLOSINGS - 1) + [False]:
        left = out.join(F.broadcast(close) if len(rows) <= MAX_BROADCAST_PATTERNS else close, "_pattern", "left")
        left = left.where("not coalesce(array_contains(closing, _h), false)").withColumn("gap", F.expr("gap - coalesce(filled, 0)"))
        best = left.where("n <= gap" if fits else "abs(n - gap) < gap").groupBy("_pattern").agg(F.expr("min_by(struct(_h, n), struct(abs(n - gap), _h))").alias("x"))
        close = staged(close.join(best, "_pattern", "full").selectExpr(
            "_pattern", "concat(coalesce(closing, array()), if(x is null, array(), array(x._h))) as closing", "coalesce(filled, 0L) + coalesce(x.n, 0L) as filled"), "mix-closing")
    cuts = need.join(cut.select("_pattern", "cut"), "_pattern", "left").join(close.select("_pattern", "closing"), "_pattern", "left")
    return staged(cuts.select("_pattern", "full", "rest", "cut", "closing"), "mix-plan"), sources


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), sources: str | None = None) -> tuple[DataFrame, list]:
    """(docs with ``size`` and ``taken``, [(source, its words, its target)]).

    ``sources`` names an array column of the sources that a document belongs
    to; without it the column ``source`` is the one member.
    """
    used = ("doc_id", "text", sources or "source")
    docs, back = shielded(docs.drop("size", "taken"), used, ("size", "taken"))
    df = docs.withColumn("_sources", F.col(sources) if sources else F.array("source"))
    df = _keyed(df, "_sources", spec.seed)
    narrow = staged(df.select("_pattern", "_sources", "_size", "_h"), "mix-sizes")
    cuts, found = plan_mix(narrow, spec)
    if cuts.count() <= MAX_BROADCAST_PATTERNS:
        cuts = F.broadcast(cuts)
    times = F.col("full") + F.expr("if(rest > 0 and (coalesce(_h < cut, true) or coalesce(array_contains(closing, _h), false)), 1L, 0L)")
    df = df.join(cuts, "_pattern").withColumn("size", F.col("_size")).withColumn("taken", F.col("_size") * times)
    return back(df), found


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, found = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    per = spark.createDataFrame(found, "_source string, source_size long, target double")
    out = out.drop("text").join(F.broadcast(per) if len(found) <= MAX_BROADCAST_PATTERNS else per, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row for every time that the mix takes a document."""
    out, _ = mix(docs)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    out, back = shielded(out.withColumn("size", copies), ("size",))
    return back(out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("size"))))).select(*quoted(docs.columns))
