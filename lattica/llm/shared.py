"""Files that the driver and all executors share, and a few column helpers.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``. Only where that setting is
absent (local tests) is a folder of our own made. Python code opens these files through
``pyarrow.fs``, so that the folder may lie in any store that pyarrow can address by URI.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_RESIDENT: list = []
#: Removed rows that one bucket holds on average, and rows of a file that share a bucket.
BUCKET_ROWS = 500_000
BLOCK_BITS = 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI; made for this application where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, _OWN[app], True)
        spark.sparkContext.setCheckpointDir(f"file://{_OWN[app]}/checkpoints")
    return f"file://{_OWN[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI, or of a plain local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def remove(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a stored table."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that nothing refers to any more: it finds them when the driver collects garbage."""
    spark.range(1).count()  # the last query is held until the next
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def release(but: Callable | None = None) -> None:
    """Give back the memory that this process holds for tasks of other operators: Python workers outlive their tasks, and so would it."""
    for kept in _RESIDENT:
        if kept is not but:
            kept.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def resident(maxsize: int) -> Callable[[Callable], Callable]:
    """``lru_cache`` for what is large and stays in a Python worker; making one drops those of all other functions marked so."""

    def mark(make: Callable) -> Callable:
        @lru_cache(maxsize)
        @wraps(make)
        def kept(*args):
            release(but=kept)
            return make(*args)

        _RESIDENT.append(kept)
        return kept

    return mark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_files(df: DataFrame) -> bool:
    """Whether df is a Parquet table as read, whose rows are known by file and number."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet"


def bucket_of(file: Column, row: Column, buckets: int, block_bits: int) -> Column:
    """The bucket of a row's block: a task of the scan meets few of them."""
    return F.pmod(F.xxhash64(file, F.shiftright(row, block_bits)), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, buckets: int, block_bits: int, uri: str) -> None:
    """Write df (file, row and more columns) in buckets, sorted, for ``read_bucket``."""
    dealt = df.withColumn("bucket", bucket_of(F.col("file"), F.col("row"), buckets, block_bits)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "file", "row")
    dealt.write.partitionBy("bucket").parquet(uri)


@lru_cache(maxsize=4)
def read_bucket(uri: str, bucket: int, file: int) -> tuple[np.ndarray, pa.Table | None]:
    """The sorted row numbers of a file in a bucket, and the other columns in that order."""
    fs, path = open_fs(f"{uri}/bucket={bucket}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return np.zeros(0, np.int64), None
    found = pq.read_table(path, filesystem=fs, filters=[("file", "=", file)], partitioning=None).drop_columns("file").combine_chunks()
    order = np.argsort(found["row"].to_numpy(), kind="stable")
    found = found.take(pa.array(order)).combine_chunks()
    return found["row"].to_numpy(), found.drop_columns("row")


class Rows:
    """A table's rows, each with a key of its own: a hash of its file's name, and its number in the file.

    Decisions carry this key, so that a row is removed for its own sake, whatever other rows have its id. A
    table that isn't one of Parquet files as read is written first.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs if is_files(docs) else stored(docs, "rows")
        self.file, self.row = fresh(docs, "row_file"), fresh(docs, "row_number")
        self.key = [self.file, self.row]

    def keyed(self) -> DataFrame:
        """The table with the two key columns."""
        meta = self.docs.metadataColumn("_metadata")
        return self.docs.select("*", F.xxhash64(meta["file_path"]).alias(self.file), meta["row_index"].alias(self.row))

    def without(self, gone: DataFrame) -> DataFrame:
        """The table without the rows whose keys are in gone; no row of the table is shuffled.

        The keys are written in buckets by (file, block of rows), of which a task of the scan opens those of its own rows.
        """
        uri = scratch(self.docs.sparkSession, "gone")
        gone = stored(gone.toDF("file", "row"), "gone-rows")
        buckets = max(1, gone.count() // BUCKET_ROWS)
        write_buckets(gone, buckets, BLOCK_BITS, uri)

        @F.pandas_udf("boolean")
        def is_gone(bucket: pd.Series, file: pd.Series, row: pd.Series) -> pd.Series:
            out = np.zeros(len(row), bool)
            for (b, f), at in row.groupby([bucket, file]).indices.items():
                out[at] = np.isin(row.to_numpy()[at], read_bucket(uri, int(b), int(f))[0])
            return pd.Series(out)

        file, row = F.col(self.file), F.col(self.row)
        return self.keyed().where(~is_gone(bucket_of(file, row, buckets, BLOCK_BITS), file, row)).drop(*self.key)
