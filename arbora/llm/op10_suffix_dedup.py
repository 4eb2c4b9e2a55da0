"""Removal of byte strings that repeat anywhere, by a sampled suffix array.

Every ``length``-byte window is owned by its anchor: the leftmost smallest hash
among the k-byte strings inside it. Equal windows have equal anchors at equal
places, so only suffixes at anchors are sorted, one for a run of windows, and no
repeat is lost.

1. A scan emits a row per anchor: the leading 16 bytes of its suffix, a hash of its
   leading k bytes, a hash of the whole run of windows, and where it is.
2. Sampled splitters range-partition the suffixes by their leading bytes, ties by
   the two hashes and the place, so equal suffixes may be split over buckets; there
   are as many buckets as the rows need. A bucket is sorted by multikey quicksort,
   eight bytes a character. Neighbours are compared, within a bucket and, by the
   first and last suffix of each, across its boundaries: equal runs are repeats as a
   whole, a lone suffix is none, and runs that share only their leading k bytes are
   left over.
3. The left-over runs, and one of each equal run beside them, are compared window
   by window: those with few rows of a leading string together, those of a hot one
   as windows in an aggregation that is combined before the shuffle.
4. A last scan joins the repeats of every document and cuts them out.

A document is known by its file and its place there, so scans may be split
differently; what a later scan needs is handed to it by place through the shared
folder, and no text is shuffled. A table that is no plain scan of Parquet files is
written there first.

Strings of k bytes and windows are compared through 64-bit hashes. Defined
results: a null or empty text, or one shorter than ``length``, keeps all its bytes;
every occurrence of a repeat is removed, the first too; repeated rows are repeats
of each other; a null doc_id is kept as it is; an empty table gives an empty
result; extra columns are ignored. ``length - k`` may be 4,095 at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import FILE, ROW, Handover, hand_over, located, segments, slices_of, staged, table

#: Bits of a packed key that hold a place within a buffer; the others order the hashes.
PLACE = 24
#: Bytes of texts that are hashed at a time, and windows of a longer text taken at a time.
BUFFER = 1 << 20
PIECE = 1 << 22
#: Suffixes that a bucket has on average, and rows that the quicksort leaves to a plain sort.
BUCKET = 1 << 19
SMALL = 1 << 12
#: Left-over rows of one leading key that are compared in one place; beyond it they are aggregated.
TOGETHER = 256
#: A broadcast of the hot leading keys is only asked for up to so many.
MAX_BROADCAST_KEYS = 100_000
#: Bits of a packed place for the anchor's offset in its window, and for the number of windows less one.
OFFSET = 12
FULL, LOCAL, HOT, LONE = 0, 1, 2, 3


@dataclass(frozen=True)
class RepeatSpec:
    length: int = 200
    k: int = 48

    def __post_init__(self):
        if not 0 < self.k <= self.length or self.length - self.k >= 1 << OFFSET:
            raise ValueError(f"k must be 1 to length, and length - k under {1 << OFFSET}")


def _hashes(raw, n: int):
    """Polynomial hashes of all n-byte strings of ``raw`` (uint8), by doubling."""
    import numpy as np

    table = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    base = 0x9E3779B97F4A7C15
    have, size, out, done = table[raw], 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = have[:len(raw) - size + 1], size
            else:
                m = len(raw) - done - size + 1
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + have[done:done + m]
                done += size
        if size * 2 > n:
            return out
        m = len(raw) - 2 * size + 1
        have = have[:m] * np.uint64(pow(base, size, 1 << 64)) + have[size:size + m]
        size *= 2


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x, width: int):
    import numpy as np

    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def anchors(raw, starts, ends, spec: RepeatSpec):
    """(document index, window start, windows, offset of the anchor, two leading characters of eight bytes,
    hash of the leading k bytes, run hash) of all anchors in the texts raw[starts[i]:ends[i]] of one buffer."""
    import numpy as np

    length, k = spec.length, spec.k
    counts = np.maximum(0, ends - starts - length + 1)
    if counts.sum() == 0:
        return None
    lead, whole = _mixed(_hashes(raw, k)), _hashes(raw, length)
    low = np.uint64((1 << PLACE) - 1)
    keys = (lead & ~low) | np.arange(len(lead), dtype=np.uint64)
    least = _sliding_min(keys, length - k + 1)
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    windows = first + np.arange(len(first))
    at = (least[windows] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(new, len(at)))
    s, p = windows[new], at[new]
    with np.errstate(over="ignore"):
        run = _mixed(whole[s] * np.uint64(0xD6E8FEB86659FD93) + _mixed(whole[s + n - 1]) + (n << OFFSET | (p - s)).astype(np.uint64))
    doc = owner[new]
    # Characters are big-endian and their sign bit is turned, so signed integers order like bytes;
    # bytes beyond the leading k are not part of the key.
    wide = np.concatenate([raw, np.zeros(16, np.uint8)])
    letters = [wide[p[:, None] + np.arange(8 * c, 8 * c + 8)] * (np.arange(8 * c, 8 * c + 8) < k).astype(np.uint8) for c in (0, 1)]
    first, second = ((x.copy().view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for x in letters)
    return doc, s - starts[doc], n, p - s, first, second, lead[p].view(np.int64), run.view(np.int64)


def _buffers(batches, length: int):
    """(files, rows, buffer, starts, ends, offsets): texts packed into buffers; a long text in pieces that overlap."""
    import numpy as np

    held, size = [], 0

    def pack():
        raw = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        sizes = np.array([len(h[3]) for h in held])
        ends = np.cumsum(sizes)
        file, row, offset = (np.array([h[c] for h in held], np.int64) for c in range(3))
        return file, row, raw, ends - sizes, ends, offset

    for batch in batches:
        for file, row, raw in zip(batch.column(FILE).to_pylist(), batch.column(ROW).to_pylist(), batch.column("raw"), strict=True):
            raw = raw.as_py() or b""
            for offset in range(0, max(1, len(raw) - length + 1), PIECE):
                part = raw[offset:offset + PIECE + length - 1]
                if len(part) >= length:
                    held.append((file, row, offset, part))
                    size += len(part)
                if size >= BUFFER:
                    yield pack()
                    held, size = [], 0
    if held:
        yield pack()


def _scan_of(docs: DataFrame) -> DataFrame:
    """(doc_id, raw) with places."""
    return located(docs.select("doc_id", "text"), "suffix-texts").select("doc_id", F.col("text").cast("binary").alias("raw"), FILE, ROW)


#: What suffixes are ordered by: leading bytes, the leading k bytes, the run; then the place.
_KEYS = ("c0", "c1", "lead", "run")
_PLACE = (FILE, ROW, "place")


def _rows(texts: DataFrame, spec: RepeatSpec) -> DataFrame:
    find, buffers = anchors, _buffers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for file, row, raw, starts, ends, offsets in buffers(batches, spec.length):
            if (got := find(raw, starts, ends, spec)) is None:
                continue
            doc, s, n, off, *keys = got
            place = ((s + offsets[doc]) << 2 * OFFSET) | (off << OFFSET) | (n - 1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*keys, file[doc], row[doc], place))], [*_KEYS, *_PLACE])

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in (*_KEYS, *_PLACE)))


def multikey_order(columns: list, small: int = SMALL):
    """The order of rows by several columns of integers: three-way partitions around a pivot of one column;
    the rows equal to it go on with the next column."""
    import numpy as np

    order = np.arange(len(columns[0]))
    stack = [(0, len(order), 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == len(columns):
            continue
        rows = order[a:b]
        if b - a <= small:
            order[a:b] = rows[np.lexsort([c[rows] for c in reversed(columns[depth:])])]
            continue
        x = columns[depth][rows]
        pivot = np.partition(x[:: max(1, (b - a) // 99)], 49 if b - a >= 99 else 0)[49 if b - a >= 99 else 0]
        low, same = x < pivot, x == pivot
        order[a:b] = np.concatenate([rows[low], rows[same], rows[~(low | same)]])
        m, n = a + int(low.sum()), a + int(low.sum()) + int(same.sum())
        stack += [(a, m, depth), (m, n, depth + 1), (n, b, depth)]
    return order


def _compared(rows: DataFrame) -> DataFrame:
    """(lead, run, place, full, open, at): what the sorted neighbours tell; lone leading keys are gone. The first and
    last suffix of a bucket stay with ``at`` = 2 * bucket and one more; they still miss their neighbour beyond."""
    order_of, names = multikey_order, [*_KEYS, *_PLACE]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        columns = [got.column(c).to_numpy() for c in names]
        del got
        order = order_of(columns[:4])
        c0, c1, lead, run_hash, file, row, place = (c[order] for c in columns)
        del columns
        n, bucket = len(lead), TaskContext.get().partitionId()
        alike = (c0[1:] == c0[:-1]) & (c1[1:] == c1[:-1]) & (lead[1:] == lead[:-1])
        equal = alike & (run_hash[1:] == run_hash[:-1])
        full, beside = np.zeros(n, bool), np.zeros(n, bool)
        for flag, hit in ((full, equal), (beside, alike & ~equal)):
            flag[:-1] |= hit
            flag[1:] |= hit
        at = np.full(n, -1, np.int64)
        at[-1], at[0] = 2 * bucket + 1, 2 * bucket  # a bucket of one suffix has only its first
        keep = np.flatnonzero(full | beside | (at >= 0))
        for first in range(0, len(keep), 1 << 16):
            k = keep[first:first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (c0, c1, lead, run_hash, file, row, place, full, beside, at)], [*names, "full", "open", "at"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", full boolean, open boolean, at long")


def _joined_at_boundaries(compared: DataFrame) -> DataFrame:
    """``compared`` with the first and last suffix of each bucket held against those of its neighbours."""
    # At most two rows a bucket, and buckets hold BUCKET rows: the driver can walk over them.
    edges = [r.asDict() for r in compared.where("at >= 0").orderBy("at").collect()]
    for x, y in zip(edges, edges[1:]):
        if x["at"] >> 1 != y["at"] >> 1 and all(x[c] == y[c] for c in _KEYS[:3]):
            flag = "full" if x["run"] == y["run"] else "open"
            x[flag] = y[flag] = True
    rows = [tuple(r[f] for f in compared.columns) for r in edges if r["full"] or r["open"]]
    return compared.where("at < 0").union(compared.sparkSession.createDataFrame(rows, compared.schema)).drop("at")


def _left_over(texts: DataFrame, handed: Handover, spec: RepeatSpec) -> DataFrame:
    """Cut the left-over runs out of the texts: (lead, place, s, need, bytes) of those to be compared
    together, (hash, place, s, need) for every window of the hot ones."""
    hashes, length, low = _hashes, spec.length, (1 << OFFSET) - 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["lead", FILE, ROW, "s", "need", "bytes", "hash"]
        for batch in batches:
            for file, a, b in segments(batch):
                rows = batch.column(ROW).to_numpy()[a:b]
                if (mine := handed.rows(file, int(rows[0]), int(rows[-1]))) is None:
                    continue
                at = None
                for lead, row, place, hot, need in zip(*(mine.column(c).to_pylist() for c in ("lead", ROW, "place", "hot", "need")), strict=True):
                    if row != at:
                        at, raw = row, batch.column("raw")[a + int(np.searchsorted(rows, row))].as_py()
                    s, n = place >> 2 * OFFSET, (place & low) + 1
                    part = raw[s:s + n - 1 + length]
                    if not hot:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lead]), pa.array([file]), pa.array([row]), pa.array([s]), pa.array([need]), pa.array([part], pa.binary()), pa.nulls(1, pa.int64())], names)
                        continue
                    w = hashes(np.frombuffer(part, np.uint8), length)
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(n, pa.int64()), pa.array(np.full(n, file)), pa.array(np.full(n, row)), pa.array(np.arange(s, s + n)), pa.array(np.full(n, need)),
                        pa.nulls(n, pa.binary()), pa.array(w.view(np.int64))], names)

    return texts.mapInArrow(run, f"lead long, {FILE} long, {ROW} long, s long, need boolean, bytes binary, hash long")


def _together(rows: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(place, s, n): windows among the rows of a leading key that occur twice or more, as ranges."""
    hashes, length = _hashes, spec.length

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def close(rows):
            sizes = np.array([len(r[5]) for r in rows])
            # Texts stand end to end; windows that reach across are left out.
            h = hashes(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), length)
            n = sizes - length + 1
            starts = np.cumsum(sizes) - sizes
            inner = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            _, place, counts = np.unique(h[inner], return_inverse=True, return_counts=True)
            twice = (counts[place] > 1) & np.repeat(np.array([r[4] for r in rows]), n)
            owner = np.repeat(np.arange(len(rows)), n)
            s = np.repeat(np.array([r[3] for r in rows]), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(twice)
            if not len(hit):
                return None
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]))
            file, row = (np.array([r[c] for r in rows], np.int64)[owner[hit[new]]] for c in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(file), pa.array(row), pa.array(s[hit[new]].astype(np.int64)), pa.array(np.diff(np.append(new, len(hit))).astype(np.int64))], [FILE, ROW, "s", "n"])

        held, key = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lead", FILE, ROW, "s", "need", "bytes")), strict=True):
                if row[0] != key and len(held) >= 4096:
                    if out := close(held):
                        yield out
                    held = []
                key = row[0]
                held.append(row)
        if held and (out := close(held)):
            yield out

    return rows.repartition("lead").sortWithinPartitions("lead").mapInArrow(run, f"{FILE} long, {ROW} long, s long, n long")


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with the remaining ``kept`` bytes if asked for."""
    texts = _scan_of(docs)
    slices = slices_of(texts)
    rows = staged(_rows(texts, spec), "suffix-anchors")
    buckets = max(1, -(-rows.count() // BUCKET))
    flagged = _joined_at_boundaries(staged(_compared(rows.repartitionByRange(buckets, *_KEYS, *_PLACE)), "suffix-compared"))
    hot = staged(flagged.where("open").groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where(f"c > {TOGETHER}").select(F.col("lead").alias("hot_lead")), "suffix-hot")
    if hot.count() <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    left = flagged.where("open").join(hot, F.col("lead") == F.col("hot_lead"), "left")
    left = left.select("lead", *_PLACE, F.col("hot_lead").isNotNull().alias("hot"), (~F.col("full")).alias("need"))
    parts = staged(_left_over(texts, hand_over(left, "suffix-left", slices), spec), "suffix-parts")
    local = _together(parts.where("bytes is not null"), spec)
    # A row that needs no judging stands for its equal runs: what only it holds is a repeat already.
    once = [F.count(F.lit(1)).alias("c"), *(F.min(x).alias(x) for x in (FILE, ROW, "s", "need"))]
    lone = parts.where("hash is not null").groupBy("hash").agg(*once).where("c = 1 and need")
    span = [F.shiftright("place", 2 * OFFSET).alias("s"), (F.col("place").bitwiseAND((1 << OFFSET) - 1) + 1).alias("n")]
    repeats = (
        flagged.where("full").select(F.lit(FULL).alias("kind"), FILE, ROW, *span)
        .union(local.select(F.lit(LOCAL), FILE, ROW, "s", "n"))
        .union(left.where("hot and need").select(F.lit(HOT), FILE, ROW, *span))
        .union(lone.select(F.lit(LONE), FILE, ROW, "s", F.lit(1).cast("long")))
    )
    handed, length = hand_over(repeats, "suffix-repeats", slices), spec.length
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def cut(raw: bytes, kind, start, count) -> tuple[int, int, int, bytes]:
        import numpy as np

        if not len(kind):
            return len(raw), 0, 0, raw
        # Kinds come in order: hot runs are marked whole, then their lone windows are taken back.
        again = np.zeros(len(raw) - length + 1, bool)
        for t in np.argsort(kind, kind="stable"):
            again[start[t]:start[t] + count[t]] = kind[t] != LONE
        edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
        gone = np.zeros(len(raw) + 1, np.int32)
        np.add.at(gone, edge[::2], 1)
        np.add.at(gone, edge[1::2] + length - 1, -1)
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        nothing = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for file, a, b in segments(batch):
                rows = batch.column(ROW).to_numpy()[a:b]
                mine = handed.rows(file, int(rows[0]), int(rows[-1]))
                found = (nothing,) * 4 if mine is None else tuple(mine.column(c).to_numpy() for c in (ROW, "kind", "s", "n"))
                lows, highs = np.searchsorted(found[0], rows, "left").tolist(), np.searchsorted(found[0], rows, "right").tolist()
                for i, x, y in zip(range(a, b), lows, highs, strict=True):
                    out.append(cut(batch.column("raw")[i].as_py() or b"", *(c[x:y] for c in found[1:])))
            arrays = [batch.column("doc_id"), *(pa.array([x[c] for x in out], pa.int64()) for c in range(3)), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, pa.array([x[3] for x in out], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return staged(texts.mapInArrow(run, schema), "suffix-result")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
