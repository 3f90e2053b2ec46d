"""Exact deduplication by a stateful stream over keyed state on disk.

The table is first written as arrivals: the rows with the SHA-256 of their normalised text. A Structured Streaming
query then reads the arrivals and keeps, in a RocksDB state store without expiry, one entry for each digest:
the smallest stable identifier seen so far with its content locator (file and row of the arrivals), and a count.
The final state is read back as a table. Rows whose digest was hit more than once are checked by their full bytes:
they are regrouped by digest and text, and a digest with two texts is resolved by that regrouping. All of it is
DataFrame code; equal rows meet in partial sums before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, settle

SPACE = r"[\x20\x09-\x0D]+"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hit digests up to this many are broadcast (32 bytes each) to read only the rows hit; beyond it all rows are regrouped.
BROADCAST_DIGESTS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _whole(sha: Column) -> Column:
    return F.unhex(sha)


class ExactDedup:
    """Classes of equal texts of docs. digest(sha) -> key: the state's key, shortened in tests to force collisions.

    Null and empty texts are equal. Of equal texts the smallest doc_id stays, a null doc_id last; of repeated
    rows with the same doc_id and text exactly one stays. An empty table gives empty results. Further columns of
    docs, whatever their names (but for the prefix __dedup_), are carried in the arrivals.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = _whole, bytes_per_trigger: int = 8 << 30):
        self.columns, self.id_col, self.text_col = docs.columns, id_col, text_col
        self.digest, self.bytes_per_trigger = digest, bytes_per_trigger
        sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
        self.arrivals = settle(docs.withColumn("__dedup_sha", sha), "arrivals", "zstd")
        self.state = self._stream()
        self.classes = self._checked()

    def _located(self, df: DataFrame) -> DataFrame:
        """The narrow columns of arrivals: key, sha and the locator, which orders by stable identifier first."""
        where = F.struct(
            F.col(self.id_col).isNull().alias("none"),
            F.col(self.id_col).cast("long").alias("id"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        )
        return df.select(self.digest(F.col("__dedup_sha")).alias("__dedup_key"), "__dedup_sha", where.alias("__dedup_at"), *self.columns)

    def _stream(self) -> DataFrame:
        spark = self.arrivals.sparkSession
        own, at = spark.newSession(), new_path(spark, "dedup-state")
        own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else 4 MB and more ahead for each of many small stores
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
        source = own.readStream.schema(self.arrivals.schema).option("maxBytesPerTrigger", str(self.bytes_per_trigger)).parquet(self.arrivals._settled_path)
        keyed = self._located(source).groupBy("__dedup_key").agg(F.min("__dedup_at").alias("first"), F.count(F.lit(1)).alias("n"))
        query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress is None and not self.arrivals.isEmpty():
            raise RuntimeError("the stream ended without reading the arrivals")
        if self.arrivals.isEmpty():
            return self._located(self.arrivals).groupBy("__dedup_key").agg(F.min("__dedup_at").alias("first"), F.count(F.lit(1)).alias("n"))
        state = spark.read.format("statestore").load(at)
        first, n = (F.col("value")[f.name] for f in state.schema["value"].dataType.fields)
        return settle(state.select(F.col("key")["__dedup_key"].alias("__dedup_key"), first.alias("first"), n.alias("n")), "dedup-final")

    def _checked(self) -> DataFrame:
        """(key, sha or null, first, n): the state, where a key with several texts is replaced by a row for each text."""
        hit = self.state.where("n > 1").select("__dedup_key")
        rows = self._located(self.arrivals).withColumn("__dedup_text", normalised(F.col(self.text_col)))
        if (hits := hit.count()) <= BROADCAST_DIGESTS:
            rows = rows.join(F.broadcast(hit), "__dedup_key", "left_semi")
        texts = rows.groupBy("__dedup_key", "__dedup_text").agg(F.min("__dedup_at").alias("first"), F.count(F.lit(1)).alias("n"), F.min("__dedup_sha").alias("sha"))
        texts = settle(texts.select("__dedup_key", "sha", F.md5(F.col("__dedup_text").cast("binary")).alias("mark"), "first", "n"), "dedup-texts") if hits else None
        self.collided = settle(texts.groupBy("__dedup_key").count().where("count > 1").select("__dedup_key"), "dedup-collided") if hits else None
        plain = self.state.select("__dedup_key", F.lit(None).cast("string").alias("sha"), "first", "n")
        if not hits or self.collided.isEmpty():
            return plain
        if texts.count() != texts.select("__dedup_key", "sha").distinct().count():
            raise RuntimeError("two different texts share a SHA-256")
        return plain.join(self.collided, "__dedup_key", "left_anti").unionByName(
            texts.join(self.collided, "__dedup_key", "left_semi").select("__dedup_key", "sha", "first", "n")
        )

    def _joined(self) -> DataFrame:
        rows = self._located(self.arrivals)
        found = self.classes.select("__dedup_key", F.col("sha").alias("__dedup_own"), F.col("first").alias("__dedup_first"), F.col("n").alias("__dedup_n"))
        if self.collided is None or self.collided.isEmpty():
            return rows.join(found, "__dedup_key")
        return rows.join(found, (rows["__dedup_key"] == found["__dedup_key"]) & (F.coalesce(found["__dedup_own"], rows["__dedup_sha"]) == rows["__dedup_sha"])).drop(found["__dedup_key"])

    def report(self) -> DataFrame:
        """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
        at, first = F.col("__dedup_at"), F.col("__dedup_first")
        return self._joined().select(
            at["id"].alias("doc_id"),
            first["id"].alias("keep_id"),
            F.col("__dedup_n").alias("group_size"),
            ((at["file"] == first["file"]) & (at["row"] == first["row"])).alias("kept"),
            F.col("__dedup_sha").alias("text_sha256"),
        )

    def kept(self) -> DataFrame:
        """The rows of docs that stay, with the columns of docs."""
        stay = self.classes.select(F.col("first")["file"].alias("__dedup_file"), F.col("first")["row"].alias("__dedup_row"))
        rows = self.arrivals.withColumns({"__dedup_file": F.col("_metadata.file_name"), "__dedup_row": F.col("_metadata.row_index")})
        return rows.join(stay, ["__dedup_file", "__dedup_row"], "left_semi").select(self.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
