"""A state table that a stream keeps: one row per key in buckets, of which a batch rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowmill.session import materialize

BUCKET, BATCH = "_bucket", "_batch"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class StateTable:
    """The newest row of each key, by ``order``, with ``sums`` added up; a Parquet folder by hash bucket.

    A batch is merged by :meth:`merge` with its number. Each row remembers the last batch that changed it, so a batch that
    is repeated, wholly or after it was merged in part, changes nothing twice; numbers must grow, as those of
    a stream do. The merged buckets are written beside the table first and then put in place of the old
    ones (dynamic partition overwrite); if the driver is lost between, the next merge puts them in place again.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    order: Sequence[str]
    sums: Sequence[str] = ()
    buckets: int = 64

    @property
    def _pending(self) -> str:
        # Folders that start like this are no part of the table for Spark's readers.
        return f"{self.path}/_pending"

    @property
    def _full(self) -> StructType:
        return StructType([*self.schema.fields]).add(BATCH, "long").add(BUCKET, "integer")

    def _stored(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self._full)
        return self.spark.read.schema(self._full).parquet(self.path)

    def read(self) -> DataFrame:
        """The state after all batches that were merged."""
        self._put_in_place()
        return self._stored().select(*self.schema.fieldNames())

    def _put_in_place(self) -> None:
        if not _exists(self.spark, f"{self._pending}/_SUCCESS"):
            return
        merged = self.spark.read.schema(self._full).parquet(self._pending)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        _delete(self.spark, self._pending)

    def merge(self, rows: DataFrame, number: int) -> list[int]:
        """Merge one row per key; the buckets that were rewritten are returned."""
        self._put_in_place()
        names = self.schema.fieldNames()
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        sent = materialize(rows.select(*names).withColumn(BUCKET, bucket), "state-batch")
        touched = sorted(r[BUCKET] for r in sent.select(BUCKET).distinct().collect())
        if not touched:
            return []
        held = self._stored().where(F.col(BUCKET).isin(touched))
        others = [n for n in names if n != self.key]
        old = held.select(F.col(BUCKET), F.col(self.key), *(F.col(n).alias(f"o_{n}") for n in others), F.col(BATCH).alias("o_batch"))
        new = sent.select(F.col(BUCKET), F.col(self.key), *(F.col(n).alias(f"n_{n}") for n in others), F.lit(True).alias("n_sent"))
        both = old.join(new, [BUCKET, self.key], "full_outer")
        counts = F.col("n_sent").isNotNull() & (F.col("o_batch").isNull() | (F.col("o_batch") < number))
        newer = counts & (F.col("o_batch").isNull() | (self._place("n_") > self._place("o_")))
        out: list[Column] = [F.col(self.key)]
        for n in others:
            if n in self.sums:
                added = F.coalesce(F.col(f"o_{n}"), F.lit(0)) + F.when(counts, F.coalesce(F.col(f"n_{n}"), F.lit(0))).otherwise(0)
                out.append(added.cast(self.schema[n].dataType).alias(n))
            else:
                out.append(F.when(newer, F.col(f"n_{n}")).otherwise(F.col(f"o_{n}")).alias(n))
        merged = both.select(*out, F.when(counts, F.lit(number)).otherwise(F.col("o_batch")).cast("long").alias(BATCH), BUCKET)
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._pending)
        self._put_in_place()
        return touched

    def _place(self, side: str) -> Column:
        return F.struct(*(F.col(f"{side}{n}").alias(n) for n in self.order))
