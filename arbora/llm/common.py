"""What the corpus operators share: the shared folder, staged tables, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import arbora

if not any(os.path.isdir(os.path.join(p, "arbora")) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
    # Workers could not import this package by name, so its functions travel by value.
    cloudpickle.register_pickle_by_value(arbora)

#: White space of the word rule: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in one process a
    temporary folder is made and kept for the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='arbora-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    # Spark and pyarrow must mean the same place, so the file system is named in full.
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that outlives executors, so a lost
    executor costs a re-read and not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_and_counted(df: DataFrame, name: str, *metrics) -> tuple[DataFrame, dict]:
    """As ``staged``, with aggregates over the rows that are taken while they are written."""
    seen = Observation(uuid.uuid4().hex)
    return staged(df.observe(seen, *metrics), name), seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the columns that say where a row is.
FILE, ROW = "__file", "__row"
#: Rows of a file, as a power of two, whose handed-over rows stay together, and the most slices of a handover.
CHUNK = 14
MAX_SLICES = 1 << 16


def quoted(names) -> list:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def shielded(df: DataFrame, used: tuple[str, ...], added: tuple[str, ...] = ()):
    """``df`` with every column but the ``used`` ones under a plain name that no operator gives, and a function that
    returns what a frame still has of them under their own names, followed by the ``added`` ones."""
    names = df.columns
    safe = [c if c in used else f"own{i}" for i, c in enumerate(names)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(s).alias(c) for s, c in zip(safe, names, strict=True) if s in out.columns], *added)

    return df.toDF(*safe), back


def _plain(df: DataFrame) -> bool:
    """Whether ``df`` only picks columns and rows of one Parquet relation, by rules that give the same each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter"):
        if not plan.deterministic():
            return False
        plan = plan.children().apply(0)
    if kind != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"


def located(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of every row: a hash of its file's path and its number in that file.

    A place is the same in every scan, however the files are split. Anything
    but a scan of Parquet files is written to the shared folder first.
    """
    if not _plain(df):
        df = staged(df, name)
    at = df.metadataColumn("_metadata")
    return df.withColumns({FILE: F.xxhash64(at["file_path"]), ROW: at["row_index"]})


class Handover:
    """Rows that were written for places of a later scan: ``path`` and the number of slices.

    A slice holds the rows of whole chunks of files, sorted by place, in small
    row groups; a reader opens the slice of its chunk and decodes only the row
    groups that reach into its rows.
    """

    def __init__(self, path: str, slices: int):
        self.path, self.slices, self._files, self._last = path, slices, {}, (None, None)

    def __reduce__(self):
        return Handover, (self.path, self.slices)

    def _groups(self, number: int) -> list:
        """(file, row group, smallest and largest place) of a slice."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        if number not in self._files:
            system, at = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
            found = system.get_file_info(fs.FileSelector(f"{at}/slice={number}", allow_not_found=True))
            groups = []
            for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
                file = pq.ParquetFile(system.open_input_file(name))
                columns = file.schema_arrow.names
                f, r = columns.index(FILE), columns.index(ROW)
                for g in range(file.num_row_groups):
                    part = file.metadata.row_group(g)
                    a, b = part.column(f).statistics, part.column(r).statistics
                    groups.append((file, g, a.min, a.max, b.min, b.max))
            self._files = {number: groups}
        return self._files[number]

    def rows(self, file: int, low: int, high: int):
        """The rows for places low to high of a file, in order, as one Arrow table, or None."""
        import numpy as np
        import pyarrow as pa

        out = []
        for number in sorted({(file ^ c) % self.slices for c in range(low >> CHUNK, (high >> CHUNK) + 1)}):
            for at, (source, g, f_low, f_high, r_low, r_high) in enumerate(self._groups(number)):
                if not f_low <= file <= f_high or (f_low == f_high and not (r_low <= high and low <= r_high)):
                    continue
                if self._last[0] != (number, at):
                    self._last = (number, at), source.read_row_group(g)
                table = self._last[1]
                files = table.column(FILE).to_numpy()
                a, b = int(np.searchsorted(files, file, "left")), int(np.searchsorted(files, file, "right"))
                row = table.column(ROW).to_numpy()[a:b]
                c, d = np.searchsorted(row, [low, high + 1]).tolist()
                if d > c:
                    out.append(table.slice(a + c, d - c))
        if not out:
            return None
        # A chunk is in one slice; rows of several chunks may come from slices in any order.
        got = pa.concat_tables(out)
        return got.sort_by(ROW) if high >> CHUNK != low >> CHUNK else got


def slices_of(place: DataFrame) -> int:
    """Slices for handovers to the scan ``place``: one for each chunk of its files, MAX_SLICES at most."""
    return max(1, min(MAX_SLICES, place.select(FILE, F.shiftright(ROW, CHUNK).alias("c")).distinct().count()))


def hand_over(rows: DataFrame, name: str, slices: int) -> Handover:
    """Write rows with places, for a later scan of these places."""
    path = new_path(rows.sparkSession, name)
    number = F.pmod(F.col(FILE).bitwiseXOR(F.shiftright(ROW, CHUNK)), F.lit(slices).cast("long")).cast("int")
    rows = rows.withColumn("slice", number).repartition(slices, "slice").sortWithinPartitions("slice", FILE, ROW)
    rows.write.option("parquet.block.size", 4 << 20).partitionBy("slice").parquet(path)
    return Handover(path, slices)


def segments(batch) -> list[tuple[int, int, int]]:
    """(file, begin, end) of the runs of a batch's rows that lie in one file in rising order."""
    import numpy as np

    if not batch.num_rows:
        return []
    file, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in (FILE, ROW))
    cut = np.flatnonzero((file[1:] != file[:-1]) | (row[1:] <= row[:-1])) + 1
    ends = [0, *cut.tolist(), batch.num_rows]
    return [(int(file[a]), a, b) for a, b in zip(ends, ends[1:])]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (u, v); returns (node, root).

    ``root`` is the smallest node of the component. Alternates the large-star
    and small-star steps until the edge set stands still. Each step is an
    aggregation (combined before the shuffle) and an equi-join that Spark may
    split where a node is hot, so no group is ever gathered in one task.
    Self-loops, repeated edges and null ends are dropped.
    """
    marks = F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("h")
    now, mark = staged_and_counted(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "cc", *marks,
    )
    before = None
    while mark["n"] and mark != before:
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").union(low.select(F.col("u").alias("x"), "m"))
        small = small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        now, mark = staged_and_counted(small, "cc", *marks)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
