"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``, else the one that was set as the checkpoint directory.
    Where neither is there, a session on one machine (tests) gets a temporary folder; on a cluster, whose
    machines share no temporary folder, that is an error.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        # the setting itself can't be changed in a running session
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="postlark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/postlark-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names by which Spark calls a store that Arrow calls otherwise.
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}


def _store(uri: str):
    """Arrow's file system of an address and the path there; it knows files, HDFS, S3, Google and Azure stores."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{_SAME_STORE.get(scheme, scheme)}://{rest}" if rest else uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file from a task: under a name of its own first, so that a repeated attempt replaces it whole."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, path)


def open_file(uri: str):
    """A seekable file for reading, in any store that Arrow knows."""
    store, path = _store(uri)
    return store.open_input_file(path)


def give_back() -> None:
    """Hand memory that a worker has freed back to the machine; workers live on from stage to stage."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to hand back


#: Bytes of text that a task works on at once, and the row that exceeds them.
PART = 1 << 21


def parts(batch: pa.RecordBatch, text: int | str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about ``size`` bytes of a text column. A row isn't divided; a batch without rows is one slice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(ends // size)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def by_parts(batches: Iterator[pa.RecordBatch], text: int | str, made: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is made of each slice of the batches; between batches and in the end the worker's free memory is handed back."""
    for batch in batches:
        yield from map(made, parts(batch, text, PART))
        del batch
        give_back()
    give_back()  # the last batch was held where it came from


def as_uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"


def packed(values: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte of their places."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
