"""Tables and files in the folder that driver and executors share.

The folder is the one named by spark.checkpoint.dir. Where the setting is absent (tests, a local
session) a private folder is made once and set as the checkpoint folder; on a cluster its absence is an error.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


#: Rows of a few short columns that one task handles at least, in tables whose number of rows is known.
TASK_ROWS = 32_768
#: Bytes of a row group of tables that Python workers write.
GROUP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="braid-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; unique, so that repeated runs never meet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends, lost executors cost nothing."""
    path = fresh(df.sparkSession, name)
    if _scopes():
        _scopes()[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.braid_path = path
    return out


def packed(df: DataFrame, rows: int, a_task: int = TASK_ROWS) -> DataFrame:
    """The same rows in as many tasks, and so files, at most as `rows` rows of them need; nothing is shuffled for it.

    Where adaptive execution doesn't merge small partitions, a table of few rows is a file for each of them.
    """
    return df.coalesce(max(1, -(-rows // a_task)))


def stored(df: DataFrame, name: str, function=None, schema=None) -> DataFrame:
    """written(df), or written(map_arrow(df, function, schema)), with its number of rows as braid_rows.

    In a mounted folder the Python workers write the files. Spark would do it through Hadoop, which without its native
    library starts three programs (chmod) for each file, and while one starts, its process holds the executor's whole
    memory as its own, so that an executor counts twice. A task's file is named by its partition and appears whole, so a task
    that runs again replaces it.
    """
    schema = schema or df.schema
    path = fresh(df.sparkSession, name)
    folder = _local(path)
    if folder is None:
        out = written(map_arrow(df, function, schema) if function else df, name)
        out.braid_rows = out.count()
        return out
    if _scopes():
        _scopes()[-1].append(path)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows = _write_parquet(f"{folder}/part-{TaskContext.get().partitionId():06d}.parquet", function(batches) if function else batches)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    rows = sum(r.rows for r in map_arrow(df, run, "rows long").collect())
    out = df.sparkSession.read.schema(schema).parquet(path) if rows else df.sparkSession.createDataFrame([], schema)
    out.braid_path, out.braid_rows = path, rows
    return out


def _write_parquet(path: str, batches) -> int:
    """Write Arrow batches to a Parquet file that appears whole or, without rows, not at all; returns the number of rows."""
    import pyarrow as pa
    from pyarrow import parquet

    part = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"  # Spark passes over names that begin so
    writer, held, rows = None, [], 0

    def flush():
        nonlocal writer
        table = pa.Table.from_batches(held)
        if writer is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            writer = parquet.ParquetWriter(part, table.schema)
        writer.write_table(table)
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if sum(b.nbytes for b in held) >= GROUP_BYTES:
                flush()
    if held:
        flush()
    if writer is not None:
        writer.close()
        os.replace(part, path)
    pa.default_memory_pool().release_unused()  # the worker lives on
    return rows


_HELD = threading.local()


def _scopes() -> list[list[str]]:
    """The scopes around, of this thread: queries in other threads have their own."""
    if not hasattr(_HELD, "scopes"):
        _HELD.scopes = []
    return _HELD.scopes


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are written in this scope go at its end, but for those given to the function it yields.

    What leaves the scope must not depend on other tables of it. Tables that are kept pass to the scope around.
    """
    paths: list[str] = []
    _scopes().append(paths)

    def keep(table: DataFrame) -> DataFrame:
        paths.remove(table.braid_path)
        if len(_scopes()) > 1:
            _scopes()[-2].append(table.braid_path)
        return table

    try:
        yield keep
    finally:
        _scopes().pop()
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, chunks) -> int:
    """Write the chunks to a file that appears whole or not at all; returns its size."""
    path, size = _local(uri), 0
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            for chunk in chunks:
                size += out.write(chunk)
        os.replace(part, path)
        return size
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def read_range(uri: str, offset: int, length: int) -> bytes:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def mapped(uri: str):
    """A read-only buffer over a whole file: a memory map of a mounted file, else a fetched copy."""
    import mmap

    path = _local(uri)
    if path is None:
        store, path = _store(uri)
        with store.open_input_file(path) as f:
            return f.read()
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""


_SHIPPED: dict[str, str] = {}


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, once this package is where the workers can import it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED[context.applicationId] = path = _zipped()
        context.addPyFile(path)
    return df.mapInArrow(function, schema)


def _zipped() -> str:
    """A zip file of the package's modules, for the executors of a cluster that doesn't have it installed."""
    import zipfile

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="braid-code-"), "braidgraph_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    return path
