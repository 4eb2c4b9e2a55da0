"""N-gram Jaccard join: rare-first prefix filtering with length, positional and
suffix filters, joined on prefix n-grams, each pair verified once.

1. A scan hashes every document's word shingles to a sorted set; equal sets are
   one class, and one row of each class stands for it from here on.
2. The shingles of all classes are counted: tasks pack the sorted hashes of
   neighbouring rows by hash range, and each range - as many as the counted
   shingles need, so that one always fits in memory - is counted in one place.
   The frequency class of every shingle that two classes share goes back to
   the places where it occurs.
3. A scan orders each set by frequency class, rarest first, and emits its prefix
   without what no other class has: two sets that reach the threshold share a
   shingle of their prefixes. Of prefix shingles with the same list of classes
   the first one stands for all.
4. Classes are joined on prefix shingles. So that a large group of near copies
   yields no pairs inside it, each class of a list beyond one block is first held
   against one hub of its shingle and length band, at most HUB_ROUNDS times with
   other hubs; lists whose classes are by then connected are done.
5. All other lists are cut into blocks of bounded size by length band, and
   blocks of compatible lengths meet in one task. There, prefix, length,
   positional and suffix filters leave the pairs that are verified on whole sets:
   a pair counts only under its first common shingle, and not if it was held
   against each other before or is connected already.
6. Components over the verified links give each document the smallest doc_id.

A row is known by its file and its place there, so that scans may be split
differently; what a scan needs is handed to it by place through the shared
folder, and only texts of candidates move.

Shingles are compared through 64-bit hashes, classes by a 128-bit hash and the
set's size, lists of classes by 128 bits.

Defined results: a null or empty text, or one of blanks, has the empty set and
is linked with nothing; a text under ``k`` words is one shingle; repeated rows
are one class; a null doc_id takes part but never names a component; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import FILE, ROW, Handover, connected_components, hand_over, located, segments, shielded, slices_of, staged, staged_and_counted, table

#: Shingles of neighbouring rows that are packed together, and bytes of texts hashed at a time.
RUN = 1 << 20
BUFFER = 1 << 18
#: Rows whose shingles are packed together at most, as a power of two.
BUCKET = 10
#: Shingles that a range has on average.
RANGE = 1 << 21
#: Shingles of a range that are counted at a time.
PIECE = 1 << 18
#: Rows whose sets are held at a time, and joined rows that are unpacked at a time.
ROWS = 512
UNPACKED = 64
#: Documents and bytes of a block, and partners of a hub that meet it in one place.
BLOCK_ROWS = 128
BLOCK_BYTES = 8 << 20
PARTNERS = 512
HUB_ROUNDS = 4
SUFFIX_DEPTH = 2
#: Linked classes and new links that the driver solves; beyond that Spark does, step by step.
FEW = 1 << 16


@dataclass(frozen=True)
class JoinSpec:
    """Shingles of ``k`` words; linked where den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100


_BASE = 0x9E3779B97F4A7C15
_SPACES = b" \t\n\x0b\x0c\r"


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Shingler:
    """Sorted distinct shingle hashes of texts, many texts in one sweep over their bytes."""

    def __init__(self, k: int):
        import numpy as np

        self.k = k
        rng = np.random.default_rng(20_240_601)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.letters[65:91] = self.letters[97:123]  # A-Z as a-z
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _upto(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            n = max(n, BUFFER)
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverse = np.cumprod(up), np.cumprod(down)

    def many(self, raws: list[bytes]) -> list:
        """One set for each text."""
        out, first, size = [], 0, 0
        for i, raw in enumerate(raws):
            size += len(raw)
            if size >= BUFFER or i == len(raws) - 1:
                out += self._sweep(raws[first:i + 1])
                first, size = i + 1, 0
        return out

    def _sweep(self, raws: list[bytes]) -> list:
        import numpy as np

        none = np.zeros(0, np.uint64)
        # A blank behind each text keeps words of neighbours apart.
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raws])
        self._upto(len(data) + 1)
        space = self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return [none] * len(raws)
        sums = self.letters[data]
        sums *= self.powers[:len(data)]
        np.cumsum(sums, out=sums)
        # A word's letters times powers from its start on, whatever its place.
        words = sums[ends - 1]
        words[starts > 0] -= sums[starts[starts > 0] - 1]
        del sums
        words *= self.inverse[starts]
        words = _mix(words + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, np.concatenate([[0], stops[:-1]]))
        count = np.diff(np.append(first, len(words)))
        k = self.k
        h = self._chain(words, k) if len(words) >= k else none
        out = []
        for a, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= k:
                out.append(np.unique(h[a:a + n - k + 1]))
            else:
                out.append(self._chain(words[a:a + n], n) if n else none)
        return out

    @staticmethod
    def _chain(words, k: int):
        import numpy as np

        m = len(words) - k + 1
        h = np.full(m, k, np.uint64)
        for i in range(k):
            h = (h ^ words[i:m + i]) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
        return _mix(h)

    def __call__(self, raw: bytes):
        return self._sweep([raw])[0]


def _key(s) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (h >> 64, h & ((1 << 64) - 1)))


def prefix_length(n: int, spec: JoinSpec) -> int:
    return n - -(-spec.num * n // spec.den) + 1


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, raw) with places."""
    rows = located(docs.select("doc_id", "text"), "ngram-docs")
    return rows.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), FILE, ROW)


def _set_batches(batches, shingle):
    """(rows, their sets): a few rows at a time, so that a large batch never has all its sets in memory."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            yield part, shingle.many(part.column("raw").to_pylist())


def _freed(run):
    """``run``, after which the worker gives back what it has no use for: workers wait for later tasks, and memory
    that they keep is missing from the executor."""

    def freed(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return freed


def _unpacked(batches, *names: str):
    """The rows of batches as tuples of Python values, a few at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, UNPACKED):
            part = batch.slice(first, UNPACKED)
            yield from zip(*(part.column(c).to_pylist() for c in names), strict=True)


def _wanted(batches, handed: Handover):
    """(file, rows, what was handed over for them) of the rows for which something was, a few at a time."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for file, a, b in segments(batch):
            place = batch.column(ROW).to_numpy()[a:b]
            if (mine := handed.rows(file, int(place[0]), int(place[-1]))) is None:
                continue
            at = a + np.searchsorted(place, mine.column(ROW).to_numpy())
            for first in range(0, len(at), ROWS):
                yield file, batch.take(pa.array(at[first:first + ROWS])), mine.slice(first, ROWS)


def class_sets(texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """(place, doc_id, n, h, l) of every row: the size and the 128 bits of its set."""
    k, key_of, shingler, set_batches = spec.k, _key, _Shingler, _set_batches

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingle = shingler(k)
        for batch, sets in set_batches(batches, shingle):
            keys = [key_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(FILE), batch.column(ROW), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64())], [FILE, ROW, "doc_id", "n", "h", "l"])

    return texts.mapInArrow(_freed(run), f"{FILE} long, {ROW} long, doc_id long, n long, h long, l long")


def _frequency_classes(heads: list, counts: list) -> list:
    """The frequency class of each head (bit length of its count over all lists, 15 at most), list by list.

    The lists are sorted; a piece of the values is counted at a time, so little beside the lists is in memory.
    """
    import numpy as np

    low, high = min(int(h[0]) for h in heads), max(int(h[-1]) for h in heads) + 1
    pieces = max(1, -(-sum(map(len, heads)) // PIECE))
    bounds = np.array([low + (high - low) * i // pieces for i in range(pieces + 1)], np.uint64)
    cuts = [np.searchsorted(h, bounds).tolist() for h in heads]
    codes = [np.empty(len(h), np.uint8) for h in heads]
    for i in range(pieces):
        mine = [(j, c[i], c[i + 1]) for j, c in enumerate(cuts) if c[i] < c[i + 1]]
        if not mine:
            continue
        _, place = np.unique(np.concatenate([heads[j][a:b] for j, a, b in mine]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([counts[j][a:b] for j, a, b in mine]))
        code, begin = np.minimum(15, np.frexp(total)[1]).astype(np.uint8)[place], 0
        for j, a, b in mine:
            codes[j][a:b] = code[begin:begin + b - a]
            begin += b - a
    return codes


def shared_shingles(texts: DataFrame, classes: Handover, total: int, slices: int, spec: JoinSpec) -> Handover:
    """Count every shingle of the classes; hands to each bucket of rows the 48-bit heads of its shingles
    that two classes or more have, with their frequency class (bit length of the count, 15 at most)."""
    k, wanted, unpacked, classes_of, shingler, bucket, run_size = spec.k, _wanted, _unpacked, _frequency_classes, _Shingler, BUCKET, RUN
    ranges = max(1, -(-total // RANGE))

    def packed(heads):
        """Sorted heads as the first one and steps of 4 or 8 bytes."""
        import numpy as np

        steps = np.diff(heads)
        return int(heads[0]), steps.astype(np.uint32 if not len(steps) or steps.max() < 1 << 32 else np.uint64).tobytes()

    def send(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cut_at = np.array([-(-(r << 48) // ranges) for r in range(ranges + 1)], np.uint64)
        shingle, key, held, size = shingler(k), None, [], 0

        def close():
            heads, counts = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
            cuts, rows = np.searchsorted(heads, cut_at), []
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                part, n = heads[cuts[r]:cuts[r + 1]], np.minimum(counts[cuts[r]:cuts[r + 1]], 255).astype(np.uint8)
                rows.append((r, *key, *packed(part), zlib.compress(n.tobytes(), 1)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["range", FILE, ROW, "first", "steps", "n"])

        for file, rows, _ in wanted(batches, classes):
            for first in range(0, rows.num_rows, 64):
                part = rows.slice(first, 64)
                places = part.column(ROW).to_pylist()
                for place, s in zip(places, shingle.many(part.column("raw").to_pylist()), strict=True):
                    now = (file, place >> bucket << bucket)
                    if held and (now != key or size >= run_size):
                        yield close()
                        held, size = [], 0
                    key = now
                    held.append(s)
                    size += len(s)
        if held:
            yield close()

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def close(blocks):
            codes = classes_of([h for _, _, h, _ in blocks], [n for _, _, _, n in blocks])
            for (file, row, heads, _), mine in zip(blocks, codes, strict=True):
                if len(shared := np.flatnonzero(mine > 1)):
                    first, steps = packed(heads[shared])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file], pa.int64()), pa.array([row], pa.int64()), pa.array([first], pa.int64()),
                        pa.array([steps], pa.binary()), pa.array([mine[shared].tobytes()], pa.binary())], [FILE, ROW, "first", "steps", "codes"])

        now, blocks = None, []
        for r, file, row, first, steps, n in unpacked(batches, "range", FILE, ROW, "first", "steps", "n"):
            if r != now and blocks:
                yield from close(blocks)
                blocks = []
            now, n = r, np.frombuffer(zlib.decompress(n), np.uint8)
            blocks.append((file, row, _heads(first, steps, len(n)), n))
        if blocks:
            yield from close(blocks)

    sent = texts.mapInArrow(_freed(send), f"range int, {FILE} long, {ROW} long, first long, steps binary, n binary")
    counted = sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_freed(count), f"{FILE} long, {ROW} long, first long, steps binary, codes binary")
    return hand_over(counted, "ngram-counts", slices)


def _heads(first: int, steps: bytes, n: int):
    """What ``packed`` packed."""
    import numpy as np

    kind = np.uint32 if len(steps) == 4 * (n - 1) else np.uint64
    return np.cumsum(np.concatenate([[np.uint64(first)], np.frombuffer(steps, kind).astype(np.uint64)]).astype(np.uint64))


def prefixes(texts: DataFrame, classes: Handover, counts: Handover, spec: JoinSpec) -> DataFrame:
    """(token, cid, n, pos, code, own): the shared ones among the rarest shingles of every class, as many as the
    threshold asks for, with their place in the order; ``own`` counts the shingles that no other class has."""
    k, wanted, heads_of, shingler, bucket = spec.k, _wanted, _heads, _Shingler, BUCKET
    length = lambda n: prefix_length(n, spec)
    names = ["token", "cid", "n", "pos", "code", "own"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle, key = shingler(k), None
        known = codes_of = None

        def codes(file, place, sets):
            nonlocal key, known, codes_of
            if key != (file, place):
                key, got = (file, place), counts.rows(file, place, place)
                known, codes_of = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
                if got is not None:
                    rows = list(zip(*(got.column(c).to_pylist() for c in ("first", "steps", "codes")), strict=True))
                    heads, code = np.concatenate([heads_of(f, s, len(c)) for f, s, c in rows]), np.frombuffer(b"".join(c for _, _, c in rows), np.uint8)
                    known, first = np.unique(heads, return_index=True)
                    codes_of = code[first]
            heads = np.concatenate(sets) >> np.uint64(16)
            if not len(known):
                return np.ones(len(heads), np.uint8)
            at = np.minimum(np.searchsorted(known, heads), len(known) - 1)
            return np.where(known[at] == heads, codes_of[at], 1).astype(np.uint8)

        for file, rows, mine in wanted(batches, classes):
            places, cids = rows.column(ROW).to_numpy(), mine.column("cid").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places >> bucket)) + 1).tolist(), len(places)]
            out = [[] for _ in names]
            for a, b in ((x, min(y, x + 64)) for lo, y in zip(cuts, cuts[1:]) for x in range(lo, y, 64)):
                sets = shingle.many(rows.column("raw").slice(a, b - a).to_pylist())
                code, begin = codes(file, int(places[a]) >> bucket << bucket, sets), 0
                for s, cid in zip(sets, cids[a:b].tolist(), strict=True):
                    c = code[begin:begin + len(s)]
                    begin += len(s)
                    m, own = length(len(s)), int((c == 1).sum())
                    # With as many shingles of its own as the prefix is long, a set shares none in it.
                    if own >= m:
                        continue
                    order = np.lexsort((s, c))[own:m]
                    # The sign bit is turned, so tokens order as signed integers the way shingles do.
                    for column, x in zip(out, ((s[order] ^ np.uint64(1 << 63)).view(np.int64), np.full(m - own, cid), np.full(m - own, len(s)), np.arange(own, m), c[order], np.full(m - own, own)), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64 if i != 4 else np.int32)) for i, x in enumerate(out)], names)

    return texts.mapInArrow(_freed(run), "token long, cid long, n long, pos long, code int, own long")


def _fetched(texts: DataFrame, wanted_rows: Handover) -> DataFrame:
    """(cid, raw) of the classes whose rows were handed over."""
    wanted = _wanted

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, rows, mine in wanted(batches, wanted_rows):
            yield pa.RecordBatch.from_arrays([mine.column("cid").combine_chunks(), rows.column("raw")], ["cid", "raw"])

    return texts.mapInArrow(_freed(run), "cid long, raw binary")


def _need(nx: int, ny: int, spec: JoinSpec) -> int:
    """The smallest intersection o with den * o >= num * (nx + ny - o)."""
    return -(-spec.num * (nx + ny) // (spec.num + spec.den))


def _suffix_filter(x, y, allowed: int, depth: int) -> int:
    """A lower bound of the Hamming distance of two sorted lists of ranks; exact parts end early above ``allowed``."""
    if depth > SUFFIX_DEPTH or not x or not y:
        return abs(len(x) - len(y))
    mid = len(y) // 2
    w = y[mid]
    at = bisect_left(x, w)
    same = at < len(x) and x[at] == w
    xl, xr, yl, yr = x[:at], x[at + same:], y[:mid], y[mid + 1:]
    miss = 0 if same else 1
    bound = abs(len(xl) - len(yl)) + abs(len(xr) - len(yr)) + miss
    if bound > allowed:
        return bound
    left = _suffix_filter(xl, yl, allowed - abs(len(xr) - len(yr)) - miss, depth + 1)
    bound = left + abs(len(xr) - len(yr)) + miss
    if bound > allowed:
        return bound
    return left + _suffix_filter(xr, yr, allowed - left - miss, depth + 1) + miss


def local_links(sets: list, skip, spec: JoinSpec) -> list[tuple[int, int]]:
    """Links (a, b) of a spanning forest over the pairs that reach the threshold, without those that ``skip`` names."""
    import numpy as np

    num, den = spec.num, spec.den
    sizes = [len(s) for s in sets]
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    ranked, at = rank[inverse].astype(np.int32), 0
    # Arrays of 4 bytes a shingle; lists and sets of Python integers would take tens of times that.
    lists = []
    for n in sizes:
        lists.append(array("i", np.sort(ranked[at:at + n]).tobytes()))
        at += n
    once = int((counts == 1).sum())  # ranks below are in one set only
    in_a = np.zeros(len(tokens), bool)
    parent = list(range(len(sets)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    links = []
    for a in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        x, nx = lists[a], sizes[a]
        met: dict[int, int] = {}
        for i in range(prefix_length(nx, spec)):
            w = x[i]
            if w < once:
                continue
            for b, j in index[w]:
                seen = met.get(b, 0)
                if seen < 0:
                    continue
                ny = sizes[b]
                need = _need(nx, ny, spec)
                if den * ny < num * nx or skip(a, b) or seen + 1 + min(nx - i - 1, ny - j - 1) < need or (
                        seen == 0 and _suffix_filter(x[i + 1:], lists[b][j + 1:], nx + ny - 2 * need - (i + j), 1) > nx + ny - 2 * need):
                    met[b] = -1
                else:
                    met[b] = seen + 1
            index[w].append((a, i))
        in_a[x] = True
        for b, seen in met.items():
            if seen <= 0 or find(a) == find(b):
                continue
            if np.count_nonzero(in_a[lists[b]]) >= _need(nx, sizes[b], spec):
                links.append((a, b))
                parent[find(a)] = find(b)
        in_a[x] = False
    return links


def postings(pre: DataFrame) -> DataFrame:
    """Rows of ``pre`` for the prefix shingles of two classes or more, one shingle for each list of classes."""
    lists = pre.groupBy("token").agg(
        F.min("cid").alias("low"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("c"), F.first("code").alias("code"),
        F.bit_xor(F.xxhash64("cid")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("b")).where("low < high")
    # A pair's first common shingle is the first of its list, so it is among those that stay.
    kept = lists.groupBy("c", "a", "b").agg(F.min(F.struct("code", "token")).alias("t")).select(F.col("t.token").alias("token"))
    return pre.join(kept, "token")


def _with_partners(lists: DataFrame, spec: JoinSpec) -> DataFrame:
    """Rows that the positional filter leaves a partner in their list, by the sizes there.

    Under a pair's first common shingle at most what follows in either set is
    shared, so the sizes together are bounded by both: ``most`` is the largest
    size that a row's partner can have.
    """
    most = f"cast(floor((n - pos) * {spec.num + spec.den} / {spec.num}) - n as long)"
    now = lists.withColumn("most", F.expr(most)) if spec.num else lists.withColumn("most", F.lit(1 << 62))
    for _ in range(2):
        bounds = now.groupBy("token").agg(F.min("n").alias("low"), F.max("most").alias("high"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        now = now.join(bounds, "token").where("most >= low and n <= high").drop("low", "high")
    alone = now.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    return now.join(alone, "token")


def _held_against(pairs: DataFrame, texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """(u, v) of the pairs (cid, hub) that are linked; a hub of many partners meets them in several places."""
    k, shingler, unpacked = spec.k, _Shingler, _unpacked
    load = pairs.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {PARTNERS}) as int)").alias("places"))
    partners = pairs.join(load, "hub").select("hub", F.expr("cast(pmod(xxhash64(cid), places) as int)").alias("at"), "cid", F.lit(1).alias("side"))
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at"), F.col("hub").alias("cid"), F.lit(0).alias("side"))
    meet = partners.union(hubs).join(texts, "cid")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle, key, hub, ranks = shingler(k), None, None, None
        for batch in batches:
            out = []
            for now, at, side, cid, raw in unpacked([batch], "hub", "at", "side", "cid", "raw"):
                s = shingle(raw)
                if side == 0:
                    key, hub, ranks = (now, at), s, s.tolist()
                    continue
                if key != (now, at):
                    raise RuntimeError("a hub is missing")
                need = _need(len(hub), len(s), spec)
                if need > min(len(hub), len(s)) or _suffix_filter(ranks, s.tolist(), len(hub) + len(s) - 2 * need, 1) > len(hub) + len(s) - 2 * need:
                    continue
                if len(np.intersect1d(hub, s, assume_unique=True)) >= need:
                    out.append((cid, now))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])

    return meet.repartition("hub", "at").sortWithinPartitions("hub", "at", "side").mapInArrow(_freed(run), "u long, v long")


def _rest(now: DataFrame, pairs: DataFrame, texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """(u, v): links among classes of a list that are not yet connected nor held against each other."""
    k, shingler, unpacked = spec.k, _Shingler, _unpacked
    join = lambda sets, skip: local_links(sets, skip, spec)
    open_ = now.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
    now = staged(now.join(open_, "token").select("token", "cid", "n", "most", "code", "band", "root"), "ngram-open")
    # Both lists are bounded by the prefix of their class.
    order = now.groupBy("cid").agg(F.expr("sort_array(collect_list(struct(code, token))).token").alias("order"))
    met = pairs.groupBy("cid").agg(F.collect_list("hub").alias("met"))
    own = order.join(met, "cid", "left").join(texts, "cid")
    # Classes of a component that fills blocks of its own are kept apart from the others,
    # so blocks that are connected inside and with each other never meet.
    where = ["token", "band", "pool"]
    pools = now.groupBy("token", "band", "root").agg(F.count(F.lit(1)).alias("c")).where(f"c > {BLOCK_ROWS}").select("token", "band", "root", F.col("root").alias("pool"))
    now = now.join(pools, ["token", "band", "root"], "left").withColumn("pool", F.coalesce("pool", F.lit(-1).cast("long")))
    sizes = now.groupBy(*where).agg(F.expr(f"cast(ceil(count(*) / {BLOCK_ROWS}) as int)").alias("rows"), F.sum("n").alias("shingles"))
    sizes = staged(sizes.select(*where, F.expr(f"greatest(rows, cast(ceil(8 * shingles / {BLOCK_BYTES}) as int))").alias("blocks")), "ngram-blocks")
    sizes = sizes.join(now.groupBy(*where).agg(F.min("n").alias("low"), F.max("most").alias("high")), where)
    other = sizes.select("token", F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("band").alias("band2"), F.col("pool").alias("pool2"), F.col("blocks").alias("blocks2"))
    # What a row cannot meet by sizes and places goes no further.
    meets = sizes.join(other, "token").where("abs(band - band2) <= 1 and (pool = -1 or pool <> pool2) and low <= high2 and low2 <= high")
    # Blocks are named by a hash of where they are and their number there.
    name = lambda band, pool, at: f"xxhash64({band}, {pool}) - pmod(xxhash64({band}, {pool}), 65536L) + {at}"
    placed = now.join(meets, where).where("n <= high2 and low2 <= most").withColumn("mine", F.expr(name("band", "pool", "pmod(xxhash64(cid), blocks)")))
    placed = placed.withColumn("theirs", F.expr(f"explode(transform(sequence(0L, blocks2 - 1L), x -> {name('band2', 'pool2', 'x')}))"))
    # A block pair of which only one side is there, or that is connected already, needs no texts.
    placed = placed.select("token", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"), "mine", "cid", "root")
    useful = placed.groupBy("token", "i", "j").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("mine").alias("p"), F.max("mine").alias("q"))
    useful = useful.where("x < y and (i = j or p < q)").select("token", "i", "j")
    placed = placed.join(useful, ["token", "i", "j"]).join(own, "cid")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingle = shingler(k)

        def close(key, rows):
            if len(rows) < 2:
                return None
            before = [frozenset(r[3][:r[3].index(key[0])]) for r in rows]
            both = key[1] == key[2]

            def skip(a, b):
                x, y = rows[a], rows[b]
                return (not both and x[0] == y[0]) or x[2] == y[2] or y[1] in x[4] or x[1] in y[4] or not before[a].isdisjoint(before[b])

            got = join([r[5] for r in rows], skip)
            return pa.RecordBatch.from_arrays([pa.array([rows[a][1] for a, _ in got], pa.int64()), pa.array([rows[b][1] for _, b in got], pa.int64())], ["u", "v"]) if got else None

        key, rows = None, []
        for token, i, j, mine, cid, root, order, met, raw in unpacked(batches, "token", "i", "j", "mine", "cid", "root", "order", "met", "raw"):
            if (token, i, j) != key:
                if out := close(key, rows):
                    yield out
                key, rows = (token, i, j), []
            rows.append((mine, cid, root, order, frozenset(met or ()), shingle(raw)))
        if out := close(key, rows):
            yield out

    return placed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_freed(run), "u long, v long")


def _solved_here(here: dict[int, int], links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node of the component of each node, after more links."""
    parent = dict(here)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for u, v in links:
        parent.setdefault(u, u)
        parent.setdefault(v, v)
        u, v = find(u), find(v)
        parent[max(u, v)] = min(u, v)
    return {a: find(a) for a in parent}


def _connected(roots: DataFrame, here: dict[int, int] | None, links: DataFrame, n: int) -> tuple[DataFrame, dict[int, int] | None]:
    """``roots`` (node, root) after ``n`` more links (u, v), of which only what they add is solved. ``here`` has the
    same as ``roots`` as long as it is small: every table that is written costs a file, and for each file processes
    started from the executor, for each partition, however few its rows are."""
    import pyarrow as pa

    if here is not None and len(here) + n <= FEW:
        if n:
            here = _solved_here(here, [(r.u, r.v) for r in links.collect()])
            columns = [pa.array(x, pa.int64()) for x in (list(here), list(here.values()))]
            roots = roots.sparkSession.createDataFrame(pa.Table.from_arrays(columns, ["node", "root"]))
        return roots, here
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    ends = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    more = staged(connected_components(ends), "ngram-more")
    onto = more.select(F.col("node").alias("root"), F.col("root").alias("onto"))
    moved = roots.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    return staged(moved.union(more.join(roots, "node", "left_anti")), "ngram-roots"), None


def linked_classes(lists: DataFrame, texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """(node, root): components of the classes by their links; classes without a link may be absent."""
    spark = lists.sparkSession
    roots, here = spark.createDataFrame([], "node long, root long"), {}
    held = spark.createDataFrame([], "cid long, hub long")
    of_root = lambda: lists.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
    for turn in range(HUB_ROUNDS):
        large = of_root().groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c"))
        large, seen = staged_and_counted(large.where(f"x < y and c > {BLOCK_ROWS}").select("token"), "ngram-large", F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        # The first hubs are those nearest to what the list has in common, later ones are taken by hash.
        rank = "struct(own, cid)" if turn == 0 else f"struct(xxhash64({turn}, cid), cid)"
        part = of_root().join(large, "token")
        hub = part.groupBy("token", "band").agg(F.expr(f"min_by(struct(cid, n, most, root), {rank})").alias("h"))
        pairs = part.join(hub, ["token", "band"]).where("cid <> h.cid and root <> h.root")
        pairs = pairs.where("h.n <= most and n <= h.most")
        pairs = pairs.select("cid", F.col("h.cid").alias("hub")).distinct()
        if turn:
            pairs = pairs.join(held, ["cid", "hub"], "left_anti").join(held.select(F.col("cid").alias("hub"), F.col("hub").alias("cid")), ["cid", "hub"], "left_anti")
        pairs, seen = staged_and_counted(pairs, "ngram-pairs", F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        held = held.union(pairs)
        links, seen = staged_and_counted(_held_against(pairs, texts, spec), "ngram-links", F.count(F.lit(1)).alias("n"))
        roots, here = _connected(roots, here, links, seen["n"])
    links, seen = staged_and_counted(_rest(of_root(), held, texts, spec), "ngram-links", F.count(F.lit(1)).alias("n"))
    return _connected(roots, here, links, seen["n"])[0]


def components(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """(place, doc_id, n, component_id, first_file, first_row) of every row; the first place is that of the row
    that represents the component (smallest doc_id, then place)."""
    return _components(_texts(docs), spec)


def _components(texts: DataFrame, spec: JoinSpec) -> DataFrame:
    slices = slices_of(texts)
    sets = staged(class_sets(texts, spec), "ngram-sets")
    classes = sets.where("n > 0").groupBy("h", "l", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)).alias("first"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    stand = classes.select("cid", f"first.{FILE}", f"first.{ROW}")
    handed = hand_over(stand, "ngram-firsts", slices)
    pre = staged(prefixes(texts, handed, shared_shingles(texts, handed, total, slices, spec), spec), "ngram-prefixes")
    # Sets of one band differ in size by less than the threshold allows; linked ones are in the same or in neighbouring bands.
    band = "n" if spec.num >= spec.den else f"cast(floor(ln(n) / ln({spec.den}D / {spec.num}D) + 1e-9) as long)"
    lists = staged(_with_partners(postings(pre), spec).withColumn("band", F.expr(band)), "ngram-lists")
    wanted = lists.select("cid").distinct().join(stand, "cid")
    found = staged(_fetched(texts, hand_over(wanted, "ngram-wanted", slices)), "ngram-texts")
    linked = linked_classes(lists, found, spec)
    named = classes.join(linked, classes["cid"] == linked["node"], "left").withColumn("root", F.coalesce("root", "cid"))
    low = named.groupBy("root").agg(F.min("first").alias("low"))
    named = named.join(low, "root").select("h", "l", "n", F.col("low.doc_id").alias("low_id"), F.col(f"low.{FILE}").alias("first_file"), F.col(f"low.{ROW}").alias("first_row"))
    out = sets.join(staged(named, "ngram-names"), ["h", "l", "n"], "left")
    return out.select(FILE, ROW, "doc_id", "n", F.coalesce("low_id", "doc_id").alias("component_id"), "first_file", "first_row")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs, JoinSpec(k=3, num=90, den=100)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """``docs`` with one row of each component; empty texts all stay.

    The places to drop are handed to the scan, so no text is shuffled.
    """
    docs, back = shielded(docs, ("doc_id", "text"))
    placed = located(docs, "ngram-docs")
    texts = placed.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), FILE, ROW)
    gone = _components(texts, spec).where(f"n > 0 and ({FILE} <> first_file or {ROW} <> first_row)").select(FILE, ROW)
    dropped, names = hand_over(gone, "ngram-dropped", slices_of(placed)), docs.columns

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for file, a, b in segments(batch):
                place = batch.column(batch.num_columns - 1).to_numpy()[a:b]
                if (mine := dropped.rows(file, int(place[0]), int(place[-1]))) is not None:
                    keep[a + np.searchsorted(place, mine.column(ROW).to_numpy())] = False
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names).filter(pa.array(keep))

    return back(placed.mapInArrow(_freed(run), docs.schema))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one document stays."""
    return one_of_each(docs)
