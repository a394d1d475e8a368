"""Shared plumbing of the corpus operators: scratch tables, files that every executor sees, words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests, a local master) a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        _scratch.append((spark, base))
    return base if "://" in base else f"file://{base}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed by ``release`` or when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/graphloom-{what}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def release() -> None:
    """Remove all scratch paths; results that are still lazy can't be read afterwards."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            continue


atexit.register(release)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends, lost executors cost nothing."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) for a URI as any executor can open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes | Iterable[bytes]) -> None:
    """Write a whole file under another name, then move it: a lost or repeated task leaves no half of a file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for x in [data] if isinstance(data, bytes) else data:
            out.write(x)
    fs.move(part, path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 2000


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, whatever else docs has.

    Texts go to Python BATCH_ROWS at a time, unless the session has a number of its own: both sides of the
    pipe hold a whole batch.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def batches(it: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what a batch makes stays small."""
    for b in it:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    trim()


def carried(columns: tuple[str, ...]) -> list:
    """The named columns as one struct, so that their names can't clash with an operator's own."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    return [F.struct(*quoted).alias("carried")] if columns else []


def trim() -> None:
    """Give free memory back: a worker lives on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Output:
    """A file under another name until close(), which moves it into place."""

    def __init__(self, uri: str):
        self._fs, self._path = open_fs(uri)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._part = f"{self._path}.{uuid.uuid4().hex}"
        self._out, self.size = self._fs.open_output_stream(self._part), 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which data begins."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._part, self._path)
