"""Documents as they arrive: a catalogue that takes in each new one once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.sources.documents import READERS
from rowmill.streaming.state_table import StateTable

TEXTS = ("csv", "tsv", "json")
CATALOGUE = (
    "digest string, document string, ext string, size_bytes bigint, arrived timestamp, first_before bigint, note string, arrivals bigint"
)


def arriving_documents(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream over the documents below a folder, with their content; Spark hands on no files without bytes."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return reader.schema(schema).load(path)


def described(files: DataFrame) -> DataFrame:
    """A row of ``CATALOGUE`` per file: digest of the content, name, kind, size, arrival, and what is wrong with it."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise("")
    rows = files.select(
        F.sha2("content", 256).alias("digest"), name.alias("document"), ext.alias("ext"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("arrived"), "content",
    )
    note = F.when(~F.col("ext").isin(*READERS), "unknown format").when(
        F.col("ext").isin(*TEXTS) & ~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8"
    )
    before = (-F.unix_micros("arrived")).alias("first_before")
    return rows.select("digest", "document", "ext", "size_bytes", "arrived", before, note.alias("note"), F.lit(1).cast("bigint").alias("arrivals"))


def new_documents(files: DataFrame) -> DataFrame:
    """:func:`described`, one row per content: the first arrival, with how often it came."""
    rows = described(files)
    others = [c for c in rows.columns if c not in ("digest", "arrivals")]
    first = F.min_by(F.struct(*others), F.struct("arrived", "document")).alias("f")
    grouped = rows.groupBy("digest").agg(first, F.sum("arrivals").alias("arrivals"))
    return grouped.select("digest", *(F.col(f"f.{c}") for c in others), "arrivals")


def catalogue_table(spark: SparkSession, path: str, buckets: int = 64) -> StateTable:
    """A catalogue by content; of several arrivals the first one gives name and time."""
    schema = spark.createDataFrame([], CATALOGUE).schema
    return StateTable(spark, path, schema, "digest", ["first_before", "document"], ["arrivals"], buckets)


def take_in(stream: DataFrame, catalogue: StateTable, log: str) -> None:
    """Add what has arrived since the position in ``log``; only the catalogue's buckets of new contents are rewritten."""

    def add(batch: DataFrame, number: int) -> None:
        catalogue.merge(new_documents(batch), number)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()


def listed(catalogue: StateTable, search: str | None = None) -> DataFrame:
    """The catalogue, newest first; ``search`` keeps names that contain it in any case."""
    rows = catalogue.read().drop("first_before")
    if search:
        rows = rows.where(F.lower("document").contains(search.lower()))
    return rows.orderBy(F.col("arrived").desc_nulls_last(), "document", "digest")
