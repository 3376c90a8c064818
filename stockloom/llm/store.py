"""Materialising intermediate results where every executor can read them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and
    all runs on one machine, a folder beside the warehouse is used.
    """
    found = spark.conf.get(CHECKPOINT_SETTING, None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.stages"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage: a lost executor costs no recomputation of what lies
    before, and ids made while writing stay the same. With ``keep`` the table
    outlives the innermost ``scratch``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _scopes[0 if keep else -1].append(path)
    # what is still there when the driver ends goes then
    _on_path(spark, path, lambda files, at: files.deleteOnExit(at))
    return spark.read.schema(df.schema).parquet(path)


def _on_path(spark: SparkSession, path: str, do) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def drop(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _on_path(df.sparkSession, name, lambda files, at: files.delete(at, True))


_scopes: list[list[str]] = [[]]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was materialised within, once nothing reads it any more."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _on_path(spark, path, lambda files, at: files.delete(at, True))


_shipped: set[str] = set()
#: Rows and bytes of a batch that goes to Python: texts are long, and both sides hold a batch in memory.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> None:
    """Give the executors this library's Python files and set the size of Arrow batches, once a session.

    Their workers import the operators by name; a cluster has no copy.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    for setting, value in ARROW_BATCHES.items():
        spark.conf.set(setting, value)
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()  # the driver's own; it serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, source.relative_to(top.parent))
    context.addPyFile(str(target))
