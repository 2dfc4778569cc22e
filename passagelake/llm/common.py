"""Helpers shared by the operators of this subpackage.

* :func:`shared_dir` / :func:`written` - cut lineage through a Parquet table in
  the folder that all executors share (``spark.checkpoint.dir``).
* :func:`bounded_batches` - Arrow batches limited by bytes, so that one batch of
  very long texts fits a Python worker.
* :func:`text_buffers` - the UTF-8 bytes of an Arrow string column without a copy.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch or one bucket of documents holds.
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Reads ``spark.checkpoint.dir``;
    only on a local master, where that is unset (tests, one machine), a temporary one is
    set. On a cluster a machine's own folder would lose rows, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ctx = spark.sparkContext
        found = ctx.getCheckpointDir()
        if not found:
            if not ctx.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
            ctx.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pl_shared_"))
            found = ctx.getCheckpointDir()
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
        except Exception:  # the session may be gone; its folder goes with it
            return


atexit.register(_remove_written)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/passagelake/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def open_folder(uri: str):
    """(file system, path) of a folder; local, HDFS or S3 under any of Spark's names for it."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri.removeprefix("file:"))


def create_file(folder: str, name: str):
    """A new file for writing in a folder that is made if need be."""
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    return files.open_output_stream(f"{root}/{name}", compression=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage
    that survives the loss of an executor."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"pl_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, nbytes: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(nbytes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A small one that lies in fewer files than there are cores
    would be worked on by as few tasks: its rows are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * (64 << 20) and len(df.inputFiles()) < cores // 2:
        return df.repartition(cores)
    return df


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i+1]].
    Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def total_text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text); an exact aggregate, two numbers to the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column).cast("bigint")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


#: About so many keys at most are looked up by broadcast in :func:`hub_join`.
HUBS = 4096


def hub_join(rows: DataFrame, lookup: DataFrame, key: str, total: int, least: int = 256) -> DataFrame:
    """``rows`` joined with ``lookup`` by ``key`` where some keys may have a large share
    of the rows. ``lookup`` has one row a key and, in the column ``many``, the number of
    its rows; ``total`` is the number of all. The keys with more than total / HUBS rows
    are fewer than HUBS whatever the input, so they are broadcast and their rows stay where
    they are; the others are shuffled."""
    hot = F.col("many") > max(least, total // HUBS)
    hubs, others = lookup.where(hot).drop("many"), lookup.where(~hot).drop("many")
    apart = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    return apart.join(others, key).unionByName(rows.join(F.broadcast(hubs), key))
