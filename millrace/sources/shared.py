"""The shared folder of the cluster, used to cut lineage and to stage stream input."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder; on a cluster a
    machine-local folder would not be seen by the other machines, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


#: Paths made within the innermost open block of `temporary_copies` of this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def temporary_copies(spark: SparkSession) -> Iterator[None]:
    """Owner of the copies stored within the block: they are deleted at its end, so the actions
    that read them belong into the block."""
    made: list[str] = []
    outer = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(outer)
        for path in made:
            delete_folder(spark, path)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """`df` computed once, written to the shared folder as Parquet and read back.

    Later uses read the written rows, so a lost executor can neither recompute nor change them.
    The copy stays until the surrounding `temporary_copies` ends, or else until the folder is cleared.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """True when the path exists on its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
