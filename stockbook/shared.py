"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: a temporary one if this machine is the whole cluster
    (tests), else one in the warehouse, which then has to be in a store that all executors see."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] == "local":
            at = tempfile.mkdtemp(prefix="stockbook-")
        else:
            at = f"{spark.conf.get('spark.sql.warehouse.dir')}/stockbook-{uuid.uuid4().hex}"
            where = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
            if where.getScheme() == "file":
                raise RuntimeError("spark.checkpoint.dir is unset and the warehouse is a local folder: name a folder that all executors share in spark.checkpoint.dir")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of what settled has written, and nobody has cleared, by owner.
_SETTLED: dict[str, list[str]] = {}
_OWNER = [""]


@contextlib.contextmanager
def owned_by(owner: str):
    """Tables that settled writes meanwhile belong to this owner."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def clear_settled(spark: SparkSession, owner: str = "") -> None:
    """Delete an owner's settled tables, for when its results are written elsewhere: frames that read them can't be used afterwards."""
    for path in _SETTLED.pop(owner, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """The shuffle files of a write go as soon as it is done; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: what reads them twice computes them once, and rounds of a
    loop start from files that outlive executors. They stay there until clear_settled, as results are lazy.

    by: a column of few values, each of which gets a folder, so that what reads one value reads no others' files.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _SETTLED.setdefault(_OWNER[-1], []).append(path)
    with shuffles_removed(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    out.settled_at = path
    return out


def once(df: DataFrame) -> DataFrame:
    """The frame itself if it is one of settled's, else settled."""
    return df if hasattr(df, "settled_at") else settled(df)
