"""Shared helpers: the folder all executors see, written tables, and Arrow batch mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where the setting is unset in a local session (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and return a scan of it: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_settled_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; whatever else the table has cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about most_bytes of the column each, for outputs larger than inputs."""
    col = batch.column(batch.schema.get_field_index(column))
    begin = used = 0
    for i, value in enumerate(col):
        n = len(value.as_buffer()) if value.is_valid else 0
        if used and used + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, used = i, 0
        used += n
    if batch.num_rows > begin:
        yield batch.slice(begin)
