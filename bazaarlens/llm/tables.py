"""Reading the corpus tables and storing intermediate results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bazaarlens.session import work_path


#: Bytes of a batch that Python workers get at once. Ten thousand rows, the other limit, can be long texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches of this session by bytes, so that a worker holds little text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def corpus(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table of the corpus; sets the batch size that its texts need."""
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result below ``spark.checkpoint.dir`` and read it back.

    The rows survive the loss of any executor, and what is built on them starts from files instead of
    repeating the work above.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a column, nothing for a null; one text at a time is copied."""
    for raw in column.cast(pa.large_binary()):
        yield raw.as_py() or b""
