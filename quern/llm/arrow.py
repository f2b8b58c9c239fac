"""Small helpers around ``mapInArrow`` shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.sources.shared import written

#: Bytes of an Arrow batch on its way to a Python worker, where the session has Spark's own limit of 64 MB: both sides of each
#: task hold whole batches.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[..., dict], schema: str | StructType, rows: int = 512, chars: int = 4_000_000) -> DataFrame:
    """Run ``fn(columns: dict of lists) -> dict of columns`` over bounded slices of each Arrow batch.

    A slice has at most ``rows`` rows and, beyond its first row, about ``chars`` characters of strings, so that
    a worker's memory doesn't depend on how rows are batched.
    """
    names = df.columns
    if df.sparkSession.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    types = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, chars):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_pydict(out, schema=types)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory goes back to the system at the end of a task: a worker waits for its next one, of another stage maybe."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, bounded by rows and by bytes."""
    total = batch.num_rows
    start = 0
    step = rows if not total else max(1, min(rows, int(total * chars / max(1, batch.nbytes))))
    while start < total:
        n = min(step, total - start)
        part = batch.slice(start, n)
        while n > 1 and part.nbytes > 2 * chars:
            n = n // 2
            part = batch.slice(start, n)
        yield part
        start += n


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there: short lineage, survives lost executors."""
    return written(df, **{"compression": "zstd", "parquet.block.size": 16 << 20})


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32 of the document id written as text leaves ``remainder``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder
