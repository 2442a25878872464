"""Tables written between the stages of a job, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}
_open = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local[*] session, which has
    no other machine to share with, may leave it unset."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_roots[app]


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/loglantern-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_open, "scopes", ()):
        made.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove the scratch tables made inside when it ends; what was read from them must be done by then."""
    scopes = _open.__dict__.setdefault("scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield
    finally:
        scopes.remove(made)
        for path in made:
            _remove(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application, once its results are written."""
    _remove(spark, _folder(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table and read it back: the plan so far runs once, later stages
    see its real size, and a lost executor costs a read instead of a recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
