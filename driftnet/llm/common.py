"""Helpers that the operators share: table reads, lineage cuts in the shared folder, broadcasts, word splits."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts the lineage, so that a lost executor costs a re-read and no recomputation, and gives later joins a
    measured size. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftnet-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have, near to those wanted."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(col) -> object:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of each run k, run after run."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def listed(values: pa.Array | pa.ChunkedArray) -> list:
    """The values as Python objects; far quicker than to_pylist for strings and binaries."""
    return values.to_numpy(zero_copy_only=False).tolist() if isinstance(values, pa.Array) else values.to_numpy().tolist()


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; all else is left as it is."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def give_back() -> None:
    """Freed memory goes back to the system. Workers idle on while later steps run, and what the allocators keep would count beside those."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def trimmed(run):
    """run over batches, then give_back."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        del batches
        give_back()

    return out


LIVING: dict = {}


def living(key, make):
    """What a Python worker keeps from task to task under a key. Only the last key is kept: workers outlive the
    operators of a pipeline, and their tables must not add up."""
    if key not in LIVING:
        LIVING.clear()
        LIVING[key] = make()
    return LIVING[key]
