"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Vectors are compared on the unit sphere, where a cosine of at least ``t`` is a
chord of at most sqrt(2 - 2t). Equal vectors of a label collapse to a class with
a weight.

The upper levels of each label's tree are grown level by level: a node of more
than ``BLOCK`` classes gets up to ``FAN`` centres, a nested cover with halving
radii that is fitted on some ``SAMPLE`` of its classes; all its classes go under
their nearest centre, and the covering radius of each child is taken over all of
them. So the number of nodes follows the rows, and only the fit is sampled. Then
both trees are traversed together from the roots down: pairs of nodes whose
centres are farther apart than both radii and the chord are pruned at each level.
Leaves are the blocks (one that cannot be split, such as a tight cluster, is cut
by hash), and each surviving pair of blocks meets in one task, where both get
cover trees of their own and the dual traversal goes on. A node pair wholly
inside the chord counts without being opened.

A task returns a count per vector and the links of a spanning forest, never all
pairs; counts are summed and the forest's components taken.

Defined results: a vector that is null, empty or zero, or holds null or
non-finite components, or has a null label, links with nothing; vectors of
different lengths do not link; rows that repeat a vector count as linked; a null
vec_id counts but names no component; an empty table gives an empty result;
extra columns are ignored. Equal vectors are told by 128 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import connected_components, staged, table

#: Classes of a block, children of a node, and classes of a node that its children are fitted on (about).
BLOCK = 1024
FAN = 64
SAMPLE = 1024
#: Levels that are grown across tasks; a node's number has DIGIT bits for each below those of its label.
DEPTH = 5
DIGIT = 7
#: Classes of a node that are placed in one task.
PLACE = 8192
#: Nodes of so many vectors or fewer are compared whole.
LEAF = 512


class _Node:
    __slots__ = ("center", "radius", "members", "children")

    def __init__(self, center: int, radius: float, members, children: list):
        self.center, self.radius, self.members, self.children = center, radius, members, children


def _cover(x, members, center: int, radius: float) -> list[tuple[int, object]]:
    """Greedy cover of ``members`` by balls of ``radius``; the first centre is ``center`` (nesting)."""
    import numpy as np

    out, left, first = [], members, center
    while len(left):
        d2 = 2 - 2 * (x[left] @ x[first])
        near = d2 <= radius * radius
        near |= left == first
        out.append((first, left[near]))
        left = left[~near]
        first = int(left[0]) if len(left) else -1
    return [(c, np.asarray(m)) for c, m in out]


def cover_tree(x, members=None, center: int | None = None, radius: float = 2.0) -> _Node:
    """A cover tree of unit vectors ``x``: each level's balls have half the radius of the one above."""
    import numpy as np

    members = np.arange(len(x)) if members is None else members
    center = int(members[0]) if center is None else center
    reach = math.sqrt(max(0.0, float(np.max(2 - 2 * (x[members] @ x[center])))))
    node = _Node(center, reach, members, [])
    if len(members) > LEAF and reach > 1e-7:
        while radius >= reach:
            radius /= 2
        parts = _cover(x, members, center, radius)
        node.children = [cover_tree(x, m, c, radius) for c, m in parts]
    return node


def dual_counts(xa, wa, xb, wb, t: float, same: bool):
    """(weighted links of each a, of each b, forest links (i in a, j in b)); ``same``: b is a."""
    import numpy as np

    chord, slack = math.sqrt(2 - 2 * t), 1e-9
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    forest: list[tuple[int, int]] = []
    parent = list(range(len(xa) + (0 if same else len(xb))))
    shift = 0 if same else len(xa)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j + shift)
        if a != b:
            parent[a] = b
            forest.append((i, j))

    def leaf(a: _Node, b: _Node) -> None:
        hit = xa[a.members] @ xb[b.members].T >= t
        if same and a is b:
            hit = np.triu(hit, 1)
        for i, j in np.argwhere(hit):
            i, j = int(a.members[i]), int(b.members[j])
            na[i] += wb[j]
            nb[j] += wa[i]
            join(i, j)

    def whole(a: _Node, b: _Node) -> None:
        na[a.members] += int(wb[b.members].sum())
        nb[b.members] += int(wa[a.members].sum())
        for i in a.members:
            join(int(i), int(b.members[0]))
        for j in b.members:
            join(int(a.members[0]), int(j))

    stack = [(cover_tree(xa), None if same else cover_tree(xb))]
    stack = [(a, a if b is None else b) for a, b in stack]
    while stack:
        a, b = stack.pop()
        itself = same and a is b
        d = 0.0 if itself else math.sqrt(max(0.0, 2 - 2 * float(xa[a.center] @ xb[b.center])))
        if d - a.radius - b.radius > chord + slack:
            continue
        if not itself and d + a.radius + b.radius < chord - 1e-6:
            whole(a, b)
            continue
        if not a.children and not b.children:
            leaf(a, b)
            continue
        left = a.children or [a]
        right = left if itself else b.children or [b]
        ca, cb = np.array([c.center for c in left]), np.array([c.center for c in right])
        ra, rb = np.array([c.radius for c in left]), np.array([c.radius for c in right])
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (xa[ca] @ xb[cb].T))) - ra[:, None] - rb[None, :]
        keep = apart <= chord + slack
        if itself:
            keep = np.triu(keep)
            np.fill_diagonal(keep, True)
        stack.extend((left[i], right[j]) for i, j in np.argwhere(keep))
    if same:
        na = na + nb
    return na, nb, forest


def _valid() -> F.Column:
    return F.expr(
        "label is not null and embedding is not null and size(embedding) > 0 and "
        "forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)"
    )


def _units(vectors):
    import numpy as np

    x = np.array(vectors, np.float64)
    # The largest component first, so that squares neither vanish nor overflow.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column):
    """Vectors of one length, as an Arrow list column, as rows of doubles."""
    import numpy as np

    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _centers(x, k: int):
    """Rows of up to ``k`` centres of a nested cover of unit vectors: those of a level come before the finer ones."""
    import numpy as np

    level, radius, out = [(0, np.arange(len(x)))], 2.0, [0]
    while radius > 1e-3 and len(out) < k:
        radius /= 2
        level = [p for c, m in level for p in _cover(x, m, c, radius)]
        known = set(out)
        out += sorted(c for c, _ in level if c not in known)
    return x[out[:k]]


def _fit(sample: DataFrame) -> DataFrame:
    """(node, child, center) of the nodes whose sampled classes are given as (node, k, embedding)."""
    units, centers = _units, _centers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def close(node, k, vectors):
            # Order must not depend on how rows arrived.
            c = centers(units(sorted(vectors)), k)
            return pa.RecordBatch.from_arrays([pa.array([node] * len(c), pa.int64()), pa.array(range(len(c)), pa.int32()), pa.array(c.tolist(), pa.list_(pa.float64()))], ["node", "child", "center"])

        now, size, vectors = None, 0, []
        for batch in batches:
            for node, k, vector in zip(*(batch.column(c).to_pylist() for c in ("node", "k", "embedding")), strict=True):
                if node != now and vectors:
                    yield close(now, size, vectors)
                    vectors = []
                now, size = node, k
                vectors.append(vector)
        if vectors:
            yield close(now, size, vectors)

    return sample.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, child int, center array<double>")


def _placed(members: DataFrame, nodes: DataFrame, centers: DataFrame, depth: int) -> DataFrame:
    """``members`` of the split ``nodes`` under their nearest centre, with the chord to it as ``far``; a node of many
    classes is placed in several tasks, each of which gets its centres."""
    places = nodes.select("node", F.expr(f"cast(ceil(n / {PLACE}) as int)").alias("places"))
    one = members.join(places, "node").select("node", F.expr("cast(pmod(xxhash64(cid), places) as int)").alias("at"), F.lit(-1).alias("child"), "cid", "w", "embedding", F.lit(None).cast("array<double>").alias("center"))
    kind = members.schema["embedding"].dataType
    all_of = centers.join(places, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at"), (F.col("child") - FAN - 1).alias("child"), F.lit(0).cast("long").alias("cid"), F.lit(0).cast("long").alias("w"),
        F.lit(None).cast(kind).alias("embedding"), "center")
    units, matrix, shift = _units, _matrix, DIGIT * (DEPTH - 1 - depth)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, center = None, []
        names = ["cid", "w", "embedding", "node", "far"]
        for batch in batches:
            node, at, child, cid, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "at", "child", "cid", "w"))
            cut = np.flatnonzero((np.diff(node) != 0) | (np.diff(at) != 0) | ((child[1:] >= -1) != (child[:-1] >= -1))) + 1
            ends = [0, *cut.tolist(), len(node)]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                if child[a] < -1:
                    if key != (node[a], at[a]):
                        key, center = (node[a], at[a]), []
                    center += batch.column("center").slice(a, b - a).to_pylist()
                    continue
                if key != (node[a], at[a]):
                    raise RuntimeError("the centres of a node are missing")
                vectors = batch.column("embedding").slice(a, b - a)
                cos = units(matrix(vectors)) @ np.array(center).T
                best = cos.argmax(1)
                far = np.sqrt(np.maximum(0.0, 2 - 2 * cos[np.arange(b - a), best]))
                yield pa.RecordBatch.from_arrays([pa.array(cid[a:b]), pa.array(w[a:b]), vectors, pa.array(node[a:b] | (best.astype(np.int64) + 1) << shift), pa.array(far)], names)

    meet = one.union(all_of).repartition("node", "at").sortWithinPartitions("node", "at", "child")
    fields = [members.schema[c] for c in ("cid", "w", "embedding", "node")]
    from pyspark.sql import types as T

    return meet.mapInArrow(run, T.StructType([*fields, T.StructField("far", T.DoubleType())]))


def grown(classes: DataFrame, chord: float) -> tuple[DataFrame, DataFrame, int]:
    """(members with their leaf as ``node``, nodes as (node, parent, n, radius, center), levels below the roots)."""
    roots = staged(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "vec-roots").coalesce(1)
    roots = staged(roots.withColumn("node", F.shiftleft(F.monotonically_increasing_id(), DIGIT * DEPTH)), "vec-roots")
    members = classes.join(roots.drop("n"), ["label", "dim"]).select("cid", "w", "embedding", "node")
    none = F.lit(None).cast("array<double>").alias("center")
    level = roots.select("node", F.lit(None).cast("long").alias("parent"), "n", F.lit(2.0).alias("radius"), none)
    nodes, leaves = [level], []
    for depth in range(DEPTH):
        # Classes within half the chord of a centre are all linked: splitting such a node prunes nothing.
        split = staged(level.where(f"n > {BLOCK} and radius > {chord / 2}").select("node", "n", F.expr(f"cast(least({FAN}, ceil(1.5 * n / {BLOCK})) as int)").alias("k")), "vec-split")
        if not split.limit(1).count():
            break
        sample = members.join(split, "node").where(f"pmod(xxhash64({depth}, cid), n) < {SAMPLE}").select("node", "k", "embedding")
        centers = staged(_fit(sample), "vec-centers")
        split = split.join(centers.select("node").distinct(), "node", "left_semi")
        leaves.append(members.join(split, "node", "left_anti").select("cid", "w", "embedding", "node"))
        placed = staged(_placed(members, split, centers, depth), "vec-placed")
        members, shift = placed.drop("far"), DIGIT * (DEPTH - 1 - depth)
        named = centers.select(F.expr(f"node | shiftleft(cast(child + 1 as long), {shift})").alias("node"), F.col("node").alias("parent"), "center")
        level = staged(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(named, "node").select("node", "parent", "n", "radius", "center"), "vec-level")
        nodes.append(level)
    for other in leaves:
        members = members.union(other)
    all_nodes = nodes[0]
    for other in nodes[1:]:
        all_nodes = all_nodes.union(other)
    return staged(members, "vec-members"), staged(all_nodes, "vec-nodes"), len(nodes) - 1


def leaf_pairs(nodes: DataFrame, levels: int, chord: float) -> DataFrame:
    """(i, j), i <= j: pairs of leaves that no bound prunes, from the roots down."""
    inner = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaf = nodes.join(inner, "node", "left_anti")
    kids = nodes.where("parent is not null").union(leaf.withColumn("parent", F.col("node")))
    kids = staged(kids.select("parent", "node", "radius", "center"), "vec-kids")
    side = lambda x: kids.select(F.col("parent").alias(x), F.col("node").alias(f"{x}_kid"), F.col("radius").alias(f"{x}_r"), F.col("center").alias(f"{x}_c"))
    dot = "aggregate(zip_with(i_c, j_c, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    apart = f"coalesce(sqrt(greatest(0D, 2 - 2 * {dot})) - i_r - j_r <= {chord + 1e-7}, true)"
    pairs = nodes.where("parent is null").select(F.col("node").alias("i"), F.col("node").alias("j"))
    for _ in range(levels):  # a leaf that is reached early stays as it is
        pairs = pairs.join(side("i"), "i").join(side("j"), "j").where(f"(i <> j or i_kid <= j_kid) and (i_kid = j_kid or {apart})")
        pairs = staged(pairs.select(F.least("i_kid", "j_kid").alias("i"), F.greatest("i_kid", "j_kid").alias("j")), "vec-pairs")
    return pairs


def near_duplicates(vectors: DataFrame, t: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label").withColumn("dim", F.size("embedding")).withColumn("ok", F.coalesce(_valid(), F.lit(False)))
    same = ["label", "dim", "h", "l"]
    rows = rows.withColumns({"h": F.xxhash64("embedding"), "l": F.xxhash64(F.lit(1), "embedding")})
    classes = rows.where("ok").groupBy(*same).agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    chord = math.sqrt(2 - 2 * t)
    members, nodes, levels = grown(classes, chord)
    pairs = leaf_pairs(nodes, levels, chord)
    sizes = staged(members.groupBy("node").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks")), "vec-sizes")
    other = sizes.select(F.col("node").alias("theirs"), F.col("blocks").alias("their_blocks"))
    both = pairs.select(F.col("i").alias("node"), F.col("j").alias("theirs")).union(pairs.where("i <> j").select("j", "i"))
    meet = members.join(sizes, "node").withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")).drop("blocks")
    meet = meet.join(both.join(other, "theirs"), "node").withColumn("their_block", F.explode(F.expr("sequence(0, their_blocks - 1)")))
    # A pair of blocks is named by its smaller and larger (node, block).
    mine, theirs = F.struct("node", "block"), F.struct(F.col("theirs").alias("node"), F.col("their_block").alias("block"))
    meet = meet.select(F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), (mine > theirs).alias("second"), "cid", "w", "embedding")
    keys = ["i1", "i2", "j1", "j2"]
    meet = meet.select(F.col("i.node").alias("i1"), F.col("i.block").alias("i2"), F.col("j.node").alias("j1"), F.col("j.block").alias("j2"), "second", "cid", "w", "embedding")
    counts, units, matrix = dual_counts, _units, _matrix

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["cid", "n", "u", "v"]

        def close(key, group):
            same = key[:2] == key[2:]
            second, ids, w, x = (np.concatenate(c) for c in zip(*group, strict=True))
            sides = [np.arange(len(ids))] if same else [np.flatnonzero(~second), np.flatnonzero(second)]
            if not all(map(len, sides)):
                return None
            x = units(x)
            p, q = sides[0], sides[-1]
            na, nb, forest = counts(x[p], w[p], x[q], w[q], t, same)
            cid, n = (ids[p], na) if same else (np.concatenate([ids[p], ids[q]]), np.concatenate([na, nb]))
            if not n.any():
                return None
            a, b = pa.array(cid[n > 0]), pa.array(n[n > 0])
            u, v = pa.array([ids[p[i]] for i, _ in forest], pa.int64()), pa.array([ids[q[j]] for _, j in forest], pa.int64())
            none = lambda n: pa.nulls(n, pa.int64())
            return pa.Table.from_arrays([
                pa.chunked_array([a, none(len(u))]), pa.chunked_array([b, none(len(u))]), pa.chunked_array([none(len(a)), u]), pa.chunked_array([none(len(a)), v])], names).combine_chunks().to_batches()

        key, group = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names_of = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in names_of], axis=0)) + 1
            ends = [0, *cut.tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:]):
                now = [int(c[a]) for c in names_of]
                if now != key:
                    if key is not None and (out := close(key, group)):
                        yield from out
                    key, group = now, []
                part = [batch.column(c).slice(a, b - a) for c in ("second", "cid", "w", "embedding")]
                group.append((*(c.to_numpy(zero_copy_only=False) for c in part[:3]), matrix(part[3])))
        if key is not None and (out := close(key, group)):
            yield from out

    found = staged(meet.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "cid long, n long, u long, v long"), "vec-links")
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("u is not null").select("u", "v"))
    named = classes.drop("embedding").join(links, "cid", "left").join(comps, F.col("cid") == F.col("node"), "left")
    named = named.select(*same, F.coalesce("root", "cid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), "low")
    low = named.groupBy("root").agg(F.min("low").alias("component"))
    named = staged(named.join(low, "root").select(*same, "n", "component", F.lit(True).alias("ok")), "vec-names")
    out = rows.select("vec_id", *same, "ok").join(named, [*same, "ok"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
