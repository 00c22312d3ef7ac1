"""Session settings the library relies on, and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_REQUIRED = {
    # Instants are built from wall-clock values; the session zone must not move them.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a parsed "key: value" cell keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: How copies are compressed.
COPY_CODEC = "zstd"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the SQL settings the column functions assume, and return the session."""
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A local session without one (tests) gets a temporary folder; a cluster without
    one is an error, because a machine-local folder would not survive a lost executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="timeloom-"))
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """The folder inside the shared one that holds all that this application writes for itself."""
    return f"{shared_folder(spark).rstrip('/')}/timeloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the run folder that nothing has been written to."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Later readers get a columnar scan with pruning, and a lost executor costs a
    re-read instead of a re-run of everything upstream. The copy stays until ``release``.
    Ids are hex digits, which a codec that codes single characters halves.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", COPY_CODEC).parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.copy_path = path
    return copy


def discard(copy: DataFrame) -> None:
    """Delete a copy that ``materialize`` has made, once nothing reads it any more."""
    _delete(copy.sparkSession, copy.copy_path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written for itself; tables read from it are void then."""
    _delete(spark, run_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
