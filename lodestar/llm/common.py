"""Helpers shared by the corpus operators: text normalisation, shared storage, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow strings are handed to Python workers in slices of about this many code points,
#: so that a worker's memory does not depend on how many rows Spark puts in a batch.
SLICE_CHARS = 2_000_000

_own_dir: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master (tests, a laptop), whose executor is the driver, may do without; it then has a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="lodestar-")
    return "file://" + _own_dir["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts lineage with a copy that outlives any executor.  Results are read from such tables long after an operator
    has returned, so those that aren't released go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    if not _written:
        atexit.register(_release_all)
    _written[path] = spark
    return table


def _deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.pop(path, None)


def _release_all() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may be over, and its JVM gone
            _deleted(spark, path)


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        _deleted(table.sparkSession, table._written_to)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs.

    Spark drops them once their plans are garbage, which a driver with much memory may not notice for long.
    """
    spark.sparkContext._jvm.System.gc()


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id and the whole text, null as empty; other columns (and clashing names) are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def carried(df: DataFrame, names: Iterable[str]) -> str:
    """The schema of columns that a function passes on, to be appended to its own."""
    return "".join(f", `{k}` {df.schema[k].dataType.simpleString()}" for k in names)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``chars`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        start, base = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(sizes.searchsorted(base + chars, side="right")))
            yield batch.slice(start, end - start)
            base, start = int(sizes[end - 1]), end


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text: str | None = "text", chars: int = SLICE_CHARS) -> DataFrame:
    """mapInArrow with a per-task state: ``make()`` runs once a task, its result once a slice.

    The function returns a dict of columns in the order of ``schema``.
    """
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for part in slices(batches, text, chars) if text else batches:
            work = work or make()
            columns = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
