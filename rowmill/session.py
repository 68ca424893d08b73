"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that results or plans depend on; everything else is left to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods of more bytes; a stage that would need one runs operator by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Many small files are listed by so many tasks at most, each taking its share, not by one task per path.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


# Settings that only take effect when the session starts. Capturing the Python call site of every
# column expression doubles the time it takes to build wide plans.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "rowmill", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in START_CONF.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


# Scratch of this process, in the folder named by the session.
_RUN = uuid.uuid4().hex
_to_clear: set[str] = set()


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete the scratch of this process when it ends."""
    if folder in _to_clear:
        return
    _to_clear.add(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def clear() -> None:
        try:
            files.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now; what is left is scratch
            pass

    atexit.register(clear)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``, deleted when the process ends.

    Only a local session may fall back to a temporary folder: on a cluster the executors would
    each see a different one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="rowmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/rowmill/{_RUN}"
    _clear_at_exit(spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result must not be recomputed (row numbers taken from a physical layout): the
    written files survive lost executors, and columns stay prunable.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    # Scratch is read a few times and deleted: smaller files are worth the slower packing.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    """Name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"
