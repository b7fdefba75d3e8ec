"""Tables written to the folder that driver and executors share, to end a lineage.

A folder lives until discard() or the end of the process: a result that is read from it may be worked out at any time.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders made here that are still there, with the Hadoop objects that delete them.
_folders: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and Spark runs in this process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not path:
        if not held.isDefined() and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="brookline-")
    if not held.isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    _folders[path] = place, context._jsc.hadoopConfiguration()
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder and read again; it survives a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of staged frames that nothing will read again."""
    for df in frames:
        _delete(df.staged_at)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, staged; the folders that making it took go at once."""
    before = set(_folders)
    made = staged(make(), name)
    for path in set(_folders) - before - {made.staged_at}:
        _delete(path)
    return made


def _delete(path: str) -> None:
    place, conf = _folders.pop(path, (None, None))
    if place is not None:
        place.getFileSystem(conf).delete(place, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_folders):
        with contextlib.suppress(Exception):  # Spark's process may have ended before this one
            _delete(path)
