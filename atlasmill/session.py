"""Session settings and the shared scratch folder that lineage cuts are written to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on (time zone, duplicate map keys) or that every job here profits from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "atlasmill", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller's own session is used instead."""
    builder = SparkSession.builder.master(master).appName(app).config(map=SETTINGS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="atlasmill-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written_so_far(spark: SparkSession) -> list[str]:
    """The scratch tables of this application that are still there."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, before: list[str], *kept: DataFrame) -> None:
    """Delete the scratch tables written after `before` was taken, but for those that the kept tables are read from."""
    held = {path for df in kept for path in df.inputFiles()}
    mine = _written.get(spark.sparkContext.applicationId, [])
    for path in [p for p in mine if p not in before]:
        inside = path.split("://", 1)[-1]
        if not any(f"{inside}/" in file for file in held):
            discard(spark, path)
            mine.remove(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables of this application, and give their number: for the end of a job, when its results are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        discard(spark, path)
    return len(paths)


#: Places of one task where whole ones are sorted or merged. A place is small when compressed and takes some 8 KB in a merge.
TASK_ROWS = 25_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key over so many partitions that a task of `rows` rows in all has TASK_ROWS on average.

    Adaptive execution joins partitions by their compressed bytes, so that tasks of wide rows grow with the input; it
    leaves these as they are.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts the lineage where a loop or several consumers would run it again; unlike an executor-local cache
    the files outlive the executors that wrote them, until drop_scratch() or the end of a local session.
    """
    return stored(df, scratch_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
