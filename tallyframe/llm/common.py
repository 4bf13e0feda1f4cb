"""Helpers shared by the corpus operators.

Intermediate tables are Parquet files in the folder that
``spark.checkpoint.dir`` names (shared by driver and executors): later steps
read the files, so a lost executor costs a re-read, never a recomputation
with other row numbers, and nothing is kept in executor memory or on an
executor's own disk.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TEXTS_AT_ONCE = 256
ROW_BITS = 33  # monotonically_increasing_id: partition in the upper, row in the lower 33 bits


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a
    local session that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tallyframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def staging_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpus/{spark.sparkContext.applicationId}"


SCOPE: ContextVar[str] = ContextVar("scope", default=".")  # the staging folder's part in use


def drop_staged(spark: SparkSession, scope: str = ".") -> None:
    """Delete what this application has staged (in one scope), once its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{staging_folder(spark)}/{scope}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at the end, so what is read later must be staged in a scope of its own."""
    scope = f"scratch-{uuid.uuid4().hex}"
    token = SCOPE.set(scope)
    try:
        yield
    finally:
        SCOPE.reset(token)
        drop_staged(spark, scope)


def staged(df: DataFrame, name: str, compression: str | None = None, scope: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new folder in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{scope or SCOPE.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the operator's own names, so that no
    other column of the input can clash: ``named(df, doc_id="id")``."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for a text (null and empty differ)."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), text).alias("k2")]


def globally_numbered(
    df: DataFrame, order: Sequence[Column], name: str, index: str = "idx"
) -> DataFrame:
    """``df`` staged in the given order with a gapless number from 0.

    Rows are range-partitioned and sorted, then staged with their place in
    the partition; the number is the place plus the sizes of the partitions
    before.  Only one count per partition reaches the driver.  ``order``
    should end in a unique column, so that no value holds a large share of
    the rows and the partitions are even.
    """
    spark = df.sparkSession
    placed = staged(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("_place", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).count().collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total))
        total += row["count"]
    before = spark.createDataFrame(
        offsets,
        T.StructType([T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())]),
    )
    in_part = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # one row per partition
        .withColumn(index, F.col("_before") + in_part)
        .drop("_part", "_before", "_place")
    )


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and idle ones
    share the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_udf(function: Callable[[str | None], object], returns: T.DataType) -> Callable[..., Column]:
    """A function of one text as a column function, by Arrow batches."""
    return texts_udf(lambda texts: map(function, texts), returns)


def texts_udf(function: Callable[[list[str | None]], Iterable[object]], returns: T.DataType) -> Callable[..., Column]:
    """A function of many texts, one result each, as a column function, by Arrow batches.

    A batch stays in Arrow's memory; only ``TEXTS_AT_ONCE`` of its texts are
    Python strings at a time.  A struct is returned as a tuple.
    """
    arrow_type = to_arrow_type(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()  # what the worker's last task has left
        for batch in batches:
            done = []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = function(batch.slice(at, TEXTS_AT_ONCE).to_pylist())
                done.append(pa.array(list(part), arrow_type))
            yield pa.concat_arrays(done) if done else pa.array([], arrow_type)

    return F.arrow_udf(run, returns)
