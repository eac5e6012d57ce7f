"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]+``, the white space of the word rules (a fixed value of the contracts).
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session on one machine may do without
    it; on a cluster a folder of our own would be each machine's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/leakwise"
    return folder.rstrip("/")


#: The tables written within each open :func:`scope`.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that were written within it, but those that are put in the list it gives."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        forget(*[df for df in made if all(df is not k for k in kept)])
        if _scopes:
            _scopes[-1].extend(kept)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, so a lost executor costs no recomputation.

    The table goes when the driver's JVM ends in order, or before by :func:`scope` or :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leakwise-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._leakwise_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` which no later step reads."""
    for df in frames:
        path = getattr(df, "_leakwise_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow text column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes, so that memory is bounded by bytes, not by rows."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        part = np.cumsum(size) // limit if len(size) else size
        for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1) if len(size) else []:
            yield batch.slice(int(rows[0]), len(rows))
