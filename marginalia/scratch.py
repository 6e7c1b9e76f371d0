"""A folder all executors share, for tables written on the way."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="marginalia-")


# The folder of each application's tables, by its id and the folder it lies in.
_ROOTS: dict[tuple[str, str], str] = {}


def _files(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def _root(spark: SparkSession) -> str:
    """The folder that holds all tables of this application, there until the driver ends or ``clear`` is called.

    A driver that is killed leaves it behind; its name carries the application's id.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    key = (spark.sparkContext.applicationId, root)
    if key not in _ROOTS:
        folder = f"{root.rstrip('/')}/marginalia-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        files, path = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[key] = folder
    return _ROOTS[key]


def clear(spark: SparkSession) -> None:
    """Deletes all tables written on the way so far. For sessions that live long, once results that read them are stored elsewhere."""
    for key in [k for k in _ROOTS if k[0] == spark.sparkContext.applicationId]:
        files, path = _files(spark, _ROOTS.pop(key))
        files.delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where the session names none and has no executors elsewhere."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def written_once(frame: DataFrame) -> DataFrame:
    """The frame's rows as a table in the shared folder, for steps that use them several times."""
    folder = shared_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)
