"""Rows that arrive late, into files by day: new generations of files under a manifest.

A layout keeps the latest row of each key and cuts every day's rows, in order, into Parquet files of equal numbers of rows.
Late rows make days dirty: those where one of them now stands, and those where an older row of its key stood.  Executors write
all files of dirty days anew, with pyarrow, under the name of a new generation; then a new manifest lists these and the files
of all other days, which are neither read whole nor touched; then the driver deletes the superseded paths that the old manifest lists.

    data/__generation=1/__day=19800/0.parquet     rows' own columns only, in their order
    manifest/1/*.json                             day, file_no, generation, path, n_rows; current is the last one that is whole

A run that breaks off before its manifest is whole leaves the old layout in force; what it wrote is one generation that no manifest
names, and the next run removes it.  Tasks write under names of their own and move a file when it is whole, so that a task
that is repeated gives the same files.  No step gathers a day or a key: keys are reduced before the shuffle, places within a day are
counted over a sort of all rows by range, and a file, which must be whole, is streamed by one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarry.llm._shared import place, scratch_dir, sized, staged, table
from quarry.workers import ship

MANIFEST = "day bigint, file_no bigint, generation int, path string, n_rows bigint"
#: Days, and (partition, day) counts, that are broadcast at most.
MOST_DAYS, MOST_COUNTS = 100_000, 500_000
#: Rows of a row group, and of a batch read back.
GROUP, BATCH = 65_536, 65_536


class LateTable:
    """A layout below `base`.

    schema: of the rows, whose columns are what files hold; key: one row is kept of each; arrived: the later wins, null is before
    all else, of equal ones within a delivery the greatest row by `order` and the other columns, across deliveries the later
    delivery; day: long, -1 where it is null; order: of rows within a day, must tell rows of different keys apart.  Null keys
    are one key.  Columns must be of types that can be compared; none may be named __day, __file, __at or __generation."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: str, arrived: str, day: Column, order: list[str], rows_per_file: int):
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema
        self.key, self.arrived, self.day, self.order, self.rows_per_file = key, arrived, F.coalesce(day.cast("long"), F.lit(-1)), order, rows_per_file
        self.columns = schema.fieldNames()

    # -- manifests

    def _numbers(self) -> list[int]:
        fs, path = place(f"{self.base}/manifest")
        names = [x.path for x in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))]
        return sorted(int(p.split("/")[-2]) for p in names if p.endswith("/_SUCCESS"))

    def generation(self) -> int:
        return max(self._numbers(), default=0)

    def manifest(self) -> DataFrame:
        n = self.generation()
        return self.spark.read.schema(MANIFEST).json(f"{self.base}/manifest/{n}") if n else self.spark.createDataFrame([], MANIFEST)

    def _published(self, entries: DataFrame, number: int) -> None:
        entries.select("day", "file_no", "generation", "path", "n_rows").write.mode("overwrite").json(f"{self.base}/manifest/{number}")

    def _swept(self) -> None:
        """Goes: the generation that a broken-off run has left, and paths that are superseded but were not deleted any more."""
        now = self.generation()
        fs, path = place(f"{self.base}/data/__generation={now + 1}")
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)
        if now > 1:
            self._deleted(now - 1)

    def _deleted(self, number: int) -> None:
        """Paths that manifest `number` lists and the current one doesn't are deleted, one after the other as they come."""
        old = self.spark.read.schema(MANIFEST).json(f"{self.base}/manifest/{number}")
        for row in old.join(self.manifest().select("path"), "path", "left_anti").select("path").toLocalIterator():
            fs, path = place(row["path"])
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)

    # -- rows

    def rows(self) -> DataFrame:
        """All rows, and __day."""
        schema = T.StructType([*self.schema.fields, T.StructField("__generation", T.IntegerType()), T.StructField("__day", T.LongType())])
        if not self.generation():
            return self.spark.createDataFrame([], schema).drop("__generation")
        return self.spark.read.schema(schema).parquet(f"{self.base}/data").drop("__generation")

    def newest(self, rows: DataFrame) -> DataFrame:
        """The row of each key that arrived last, and __day.  Reduced before the shuffle, so that a hot key is few rows by then."""
        first = [self.arrived, *[c for c in self.order if c not in (self.key, self.arrived)]]
        others = [c for c in self.columns if c not in (self.key, *first)]
        best = rows.groupBy(self.key).agg(F.max(F.struct(*first, *others)).alias("__r"))
        return best.select(*[F.col(c) if c == self.key else F.col("__r")[c].alias(c) for c in self.columns]).withColumn("__day", self.day)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows (with __day) and __file: place within the day, in order, by rows_per_file.

        A sort of all rows by range; how many rows of its day stand in earlier partitions is a sum over (partition, day) counts."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["__day", *self.order]
        at = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "late-sorted")
        part = F.shiftright("__at", 33)
        counts = at.groupBy(part.alias("__p"), "__day").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
        before = F.sum("__n").over(W.partitionBy("__day").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
        counts, _ = sized(staged(counts.select("__p", "__day", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")), "late-counts"), MOST_COUNTS)
        found = at.withColumn("__p", part).join(counts, ["__p", "__day"])
        return found.select(*self.columns, "__day", F.expr(f"(__at + __shift) div {self.rows_per_file}").alias("__file"))

    def _written(self, rows: DataFrame, generation: int) -> DataFrame:
        """Writes rows (with __day) as files of a generation; their manifest."""
        ship(self.spark)
        n, base, width = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.base, len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = place(base)
            whole = isinstance(fs, pafs.S3FileSystem)  # there an object appears when it is whole
            writer = sink = None
            spot, path, mine, held, n_held, total = None, "", "", [], 0, 0

            def flushed() -> None:
                nonlocal held, n_held
                if held:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=GROUP)
                    held, n_held = [], 0

            def closed() -> pa.RecordBatch:
                flushed()
                writer.close()
                sink.close()
                if mine != path:
                    if fs.get_file_info(path).type != pafs.FileType.NotFound:
                        fs.delete_file(path)
                    fs.move(mine, path)
                uri = base + path[len(root) :]
                return pa.RecordBatch.from_arrays([pa.array([spot[0]], pa.int64()), pa.array([spot[1]], pa.int64()), pa.array([generation], pa.int32()), pa.array([uri]), pa.array([total], pa.int64())], ["day", "file_no", "generation", "path", "n_rows"])

            for b in batches:
                day, no = b.column(width).to_numpy(), b.column(width + 1).to_numpy()
                edges = np.flatnonzero((day[1:] != day[:-1]) | (no[1:] != no[:-1])) + 1
                own = b.select(range(width))
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                    if hi == lo:
                        continue
                    here = int(day[lo]), int(no[lo])
                    if here != spot:
                        if spot is not None:
                            yield closed()
                        folder = f"{root}/data/__generation={generation}/__day={here[0]}"
                        spot, path, total = here, f"{folder}/{here[1]}.parquet", 0
                        mine = path if whole else f"{root}/attempts/{uuid.uuid4().hex}"
                        fs.create_dir(folder, recursive=True)
                        fs.create_dir(f"{root}/attempts", recursive=True)
                        sink = fs.open_output_stream(mine, compression=None)
                        writer = pq.ParquetWriter(sink, own.schema, compression="zstd")
                    held.append(own.slice(lo, hi - lo))
                    n_held, total = n_held + hi - lo, total + hi - lo
                    if n_held >= GROUP:
                        flushed()
            if spot is not None:
                yield closed()

        order = ["__day", "__file", *self.order]
        dealt = self._placed(rows).repartition(n, "__day", "__file").sortWithinPartitions(*order)
        return staged(dealt.mapInArrow(run, MANIFEST), "late-files")

    def _attempts_gone(self) -> None:
        fs, path = place(f"{self.base}/attempts")
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)

    def create(self, rows: DataFrame) -> None:
        """The layout of rows; no rows, no files."""
        self._swept()
        fs, path = place(f"{self.base}/data")
        fs.create_dir(path, recursive=True)
        self._published(self._written(self.newest(rows), 1), 1)
        self._attempts_gone()

    def overwrite(self, late: DataFrame) -> DataFrame:
        """The layout of all rows, late ones included; day of each dirty day."""
        self._swept()
        have = self.rows().select(F.col(self.key).alias("__key"), F.col(self.arrived).alias("__was_at"), F.col("__day").alias("__was"), F.lit(True).alias("__there"))
        both = self.newest(late).join(have, F.col(self.key).eqNullSafe(F.col("__key")), "left")
        older = F.col("__was_at").isNull() | F.coalesce(F.col(self.arrived) >= F.col("__was_at"), F.lit(False))
        won = staged(both.where(F.col("__there").isNull() | older).select(*self.columns, "__day", "__was"), "late-won")
        days = staged(won.select(F.explode(F.array("__day", "__was")).alias("__day")).where("__day is not null").distinct(), "late-days")
        dirty, few = sized(days, MOST_DAYS)
        if few and days.isEmpty():
            return days.select(F.col("__day").alias("day"))
        kept = self.rows().join(dirty, "__day", "left_semi").join(won.select(F.col(self.key).alias("__key")), F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
        number = self.generation() + 1
        files = self._written(kept.select(*self.columns, "__day").unionByName(won.drop("__was")), number)
        clean = self.manifest().join(dirty.withColumnRenamed("__day", "day"), "day", "left_anti")
        self._published(clean.unionByName(files), number)
        self._attempts_gone()
        self._deleted(number - 1)
        return days.select(F.col("__day").alias("day"))


# --- the query over sales ------------------------------------------------------------------------------------------

DIGEST = "day bigint, file_no bigint, n_rows bigint, cents bigint, rows_crc bigint, path string, columns string, ids_sha256 string, rewritten boolean"
FILES, CUT = 1100, "2024-03-20 00:00:00"


def sold_day(sold_at: str = "sold_at") -> Column:
    return F.unix_date(F.col(sold_at).cast("date")).cast("long")


def with_copies(sales: DataFrame) -> DataFrame:
    """sales and changed copies of some of its rows, that arrive later."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    more = sales.where((h % 3 == 0) & (sold_day() % 4 == 0)).withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)})
    return sales.unionByName(more.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in sales.schema.fields]))


def described(files: DataFrame, first: int = 1) -> DataFrame:
    """DIGEST of each listed file, read back in batches from the file itself."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for day, no, generation, uri in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                fs, path = place(uri)
                n = cents = crc = 0
                sha, comma = hashlib.sha256(), b""
                with fs.open_input_file(path) as f:
                    file = pq.ParquetFile(f)
                    names = ",".join(file.schema_arrow.names)
                    for part in file.iter_batches(BATCH, columns=["sale_id", "total", "sold_at", "arrived_at"]):
                        n += len(part)
                        total = part.column("total").cast(pa.float64())
                        cents += int(np.floor(100 * pc.fill_null(total, 0.0).to_numpy(zero_copy_only=False) + 0.5).astype(np.int64).sum())
                        ids = ["" if x is None else str(x) for x in part.column("sale_id").to_pylist()]
                        times = [["" if x is None else str(x) for x in part.column(c).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()] for c in ("sold_at", "arrived_at")]
                        crc += sum(zlib.crc32(f"{i}:{s}:{a}".encode()) for i, s, a in zip(ids, *times, strict=True))
                        sha.update(comma + ",".join(ids).encode())
                        comma = b","
                out.append((day, no, n, cents, crc, uri, names, sha.hexdigest(), generation > first))
            kinds = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.bool_()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("day", "file_no", "generation", "path").repartition(n).mapInArrow(run, DIGEST)


def op11_late_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the layout of all sales, after that of the early ones.  Null sold_at: day -1; null arrived_at: late, and before all that have one."""
    sales = table(spark, sf_dir, "sales")
    ntz = [f.name for f in sales.schema.fields if f.dataType == T.TimestampType()]
    sales = sales.withColumns({c: F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(c, spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd HH:mm:ss.SSSSSS")) for c in ntz}) if ntz else sales
    base = f"{scratch_dir(spark)}/op11-{uuid.uuid4().hex}"
    layout = LateTable(spark, base, sales.schema, "sale_id", "arrived_at", sold_day(), ["sold_at", "sale_id"], 1 + sales.count() // FILES)
    rows, early = with_copies(sales), F.coalesce(F.col("arrived_at") < F.lit(CUT).cast("timestamp_ntz"), F.lit(False))
    layout.create(rows.where(early))
    layout.overwrite(rows.where(~early))
    return described(layout.manifest())
