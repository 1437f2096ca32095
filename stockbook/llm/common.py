"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.shared import shared_dir

#: What separates words everywhere in this subpackage: the ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By owner, (table name or '', path) of what settle and bucketed have written and nobody has cleared.
_SCRATCH: dict[str, list[tuple[str, str]]] = {}
_OWNER = [""]


@contextlib.contextmanager
def scratch_of(owner: str):
    """Scratch tables written meanwhile belong to this owner."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def clear_scratch(spark: SparkSession, owner: str) -> None:
    """Delete an owner's scratch tables. For owners whose results so far are written elsewhere: the frames that
    read these tables can't be used afterwards."""
    for name, path in _SCRATCH.pop(owner, []):
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete what settle wrote for this frame, if it is one of settle's: all that reads it must be settled by now."""
    path = getattr(df, "settled_at", None)
    if path:
        _delete(df.sparkSession, path)


def settle(df: DataFrame, scratch: bool = True) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    if scratch:
        _SCRATCH.setdefault(_OWNER[-1], []).append(("", path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def words(text: Column) -> Column:
    """All words of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n: the folds of labelled rows."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % n


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write the rows into the shared folder in buckets of a key; joins on it then need no shuffle of them."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    _SCRATCH.setdefault(_OWNER[-1], []).append((name, path))
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def lean_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Fewer rows and bytes per Arrow batch: texts in one batch cost each worker many times their size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
