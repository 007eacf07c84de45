"""What the operators of this folder share: staging in the shared folder, batch limits, checks on columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold; long texts then reach Python a few at a time.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or an own one on a single machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="carelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def limit_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get, so that their memory doesn't follow the text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: The setting of how many bytes of listings of files a session keeps.
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"
#: Paths of the tables staged by this process, in order.
MADE: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, so that a lost executor costs one stage only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    kept = spark.conf.get(LISTINGS)
    spark.conf.set(LISTINGS, "0")  # else the session keeps the list of its files as long as it lives
    try:
        return spark.read.schema(df.schema).parquet(path)
    finally:
        spark.conf.set(LISTINGS, kept)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that no DataFrame needs any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def discard_staged(spark: SparkSession) -> None:
    """Deletes all staged tables and archives of the shared folder, once no DataFrame that reads them is needed any more."""
    discard(spark, [f"{shared_folder(spark)}/{name}" for name in ("staged", "archives")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id) -> object:
    """True for the fifth of the documents from whose labels nothing is learned; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: What worker processes keep from task to task: by name, how it is forgotten.
HELD: dict[str, Callable[[], None]] = {}


def only(name: str | None) -> None:
    """At the start of a task: a worker forgets what other operators' tasks have left in it, and gives the memory back."""
    others = [clear for k, clear in HELD.items() if k != name]
    for clear in others:
        clear()
    if others or name is None:
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system where its allocators can do so."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library, which has no such call


def forget_ended(spark: SparkSession) -> None:
    """The driver's garbage goes: Python's, and the JVM's with what Spark keeps of ended queries until it is collected; the heap shrinks to what is used."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()


def gathered(batches: Iterator[pa.RecordBatch], size: int, most: int = 100 * BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches put together until they have size bytes or most rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size or sum(b.num_rows for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def map_texts(
    df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list[str]], list[tuple]]], schema: str, keeper: str | None = None, gather: int = 0
) -> DataFrame:
    """The columns ``keep`` and, as further columns of ``schema``, what make() gives for the texts of a batch; null texts are empty.

    make is called once in each task, on the executor; keeper names what may be kept there for the next task. Batches below gather bytes are put together. It needs no shuffle: each row is handled where it is read.
    """
    spark = df.sparkSession
    limit_batches(spark)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text_of_row"))
    target = spark.createDataFrame([], schema).schema
    full = type(target)([*[source.schema[c] for c in keep], *target.fields])
    names = [f.name for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        only(keeper)
        own, f = to_arrow_schema(target), make()
        for batch in gathered(batches, gather) if gather else batches:
            rows = f(batch.column(len(keep)).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            made = [pa.array(c, own.field(i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made], names=[*keep, *names])

    return source.mapInArrow(run, full)


#: Rows of fixed width up to which a table goes to all tasks of a join.
SMALL_ROWS = 1_000_000


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with small, a staged table of fixed-width rows: they are counted, and only up to SMALL_ROWS of them are broadcast."""
    return big.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, key, how)


def sorted_groups(df: DataFrame, key: str, run: Callable[[int, list[pa.Array]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that run(key, the other columns) gives for each group of the first column ``key``; groups must be of bounded size.

    The groups are dealt by key and sorted in their task, which walks through them without a frame for each.
    """
    spark = df.sparkSession
    limit_batches(spark)
    target = spark.createDataFrame([], schema).schema
    names = [f.name for f in target.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        only(None)
        own, held = to_arrow_schema(target), []

        def made(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
            rows, at = [], 0
            columns = [c.combine_chunks() for c in table.columns]
            keys = columns[0]
            for end in ends:
                rows += run(keys[at].as_py(), [c.slice(at, end - at) for c in columns[1:]])
                at = end
            values = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(v, own.field(i).type) for i, v in enumerate(values)], names=names)

        for batch in batches:
            held.append(batch)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys) or len(held) > 1 and keys[-1] == held[0].column(0)[held[0].num_rows - 1].as_py():
                continue  # the last group goes on
            table = pa.Table.from_batches(held)
            all_keys = table.column(0).to_numpy()
            ends = (np.nonzero(all_keys[1:] != all_keys[:-1])[0] + 1).tolist()
            if ends:
                yield made(table.slice(0, ends[-1]), ends)
                held = pa.Table.slice(table, ends[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                all_keys = table.column(0).to_numpy()
                yield made(table, [*(np.nonzero(all_keys[1:] != all_keys[:-1])[0] + 1).tolist(), table.num_rows])

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(walk, target)
