"""Immutable table versions.

A load writes its tables to fresh folders and then publishes one manifest; readers follow the newest
manifest, so several tables change at once or not at all. A snapshot is a manifest number, restoring
is publishing its rows again. Manifests hold one row per table folder, never data. One writer per
project is assumed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowmill.errors import Conflict
from rowmill.operators.proposal import load_matches
from rowmill.operators.catalog import column_rows

_PARALLEL_WRITES = 8
_WHOLE = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
_MANIFEST = "table string, path string, schema string, part int"
_SNAPSHOT = "version long, state string, at long"


class VersionStore:
    """Versions of one project's tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._known: dict[int, dict[str, list[tuple]]] = {}

    # -- manifests -----------------------------------------------------------------------------

    def manifests(self) -> DataFrame:
        """Every published row with its ``version``."""
        schema = f"{_MANIFEST}, version long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/manifests")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """Number of the live manifest, 0 before the first load."""
        return self.manifests().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def _rows(self, version: int) -> dict[str, list[tuple]]:
        if version in self._known:
            return dict(self._known[version])
        out: dict[str, list[tuple]] = {}
        found = self.manifests().filter((F.col("version") == version) & (F.col("table") != ""))
        for r in found.orderBy("table", "part").collect():
            out.setdefault(r["table"], []).append((r["path"], r["schema"]))
        # A published manifest never changes.
        if version:
            self._known[version] = out
        return dict(out)

    def _publish(self, rows: Mapping[str, Sequence[tuple]], after: int | None = None) -> int:
        version = (self.version() if after is None else after) + 1
        # The unnamed row keeps a manifest without tables visible.
        flat = [("", "", "", 0)]
        flat += [(t, path, schema, i) for t, parts in rows.items() for i, (path, schema) in enumerate(parts)]
        out = self.spark.createDataFrame(flat, _MANIFEST).coalesce(1)
        out.write.mode("errorifexists").parquet(f"{self.root}/manifests/version={version}")
        return version

    # -- tables --------------------------------------------------------------------------------

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._rows(self.version() if version is None else version))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The live (or an older) version of a table; columns a part lacks read as NULL."""
        parts = self._rows(self.version() if version is None else version).get(table)
        if not parts:
            raise Conflict(f"table {table!r} does not exist")
        # Appended parts never bring new columns, so the first part has the table's schema.
        schema = StructType.fromJson(json.loads(parts[0][1]))
        return self.spark.read.schema(schema).parquet(*[p for p, _ in parts])

    def stage(self, tables: Mapping[str, DataFrame]) -> dict[str, tuple]:
        """Write tables to fresh folders without making them visible.

        The writes are submitted together, so the tail of one table does not leave the cluster idle.
        """

        def write(name: str, df: DataFrame) -> tuple:
            path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
            df.write.mode("errorifexists").parquet(path)
            return (path, df.schema.json())

        if not tables:
            return {}
        with ThreadPoolExecutor(max_workers=min(len(tables), _PARALLEL_WRITES)) as pool:
            jobs = {name: pool.submit(write, name, df) for name, df in tables.items()}
            return {name: job.result() for name, job in jobs.items()}

    def staged(self, staged: Mapping[str, tuple]) -> dict[str, DataFrame]:
        """Read staged tables back, for validation before publishing."""
        return {t: self.spark.read.parquet(path) for t, (path, _) in staged.items()}

    def publish(self, staged: Mapping[str, tuple], append: Sequence[str] = (), drop: Sequence[str] = ()) -> int:
        """Make staged tables live in one step; tables in ``append`` gain a part, others are replaced."""
        live = self.version()
        rows = {t: parts for t, parts in self._rows(live).items() if t not in drop}
        for t, part in staged.items():
            rows[t] = [*rows.get(t, []), part] if t in append else [part]
        return self._publish(rows, live)

    def load(self, tables: Mapping[str, DataFrame]) -> int:
        """Create or replace tables, all in one version."""
        return self.publish(self.stage(tables))

    def fitted(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` in the column types of the table; refused if a column is unknown or would lose values.

        Whole numbers may be narrower than the stored ones, or wider as long as all values fit, and small
        enough ones may join floating numbers.
        """
        known = self.read(table)
        wrong = load_matches(column_rows(self.spark, {table: known}), column_rows(self.spark, {table: rows}))
        differ = {r["column"] for r in wrong.filter("problem <> 'missing'").collect()}
        stored, sent = dict(known.dtypes), dict(rows.dtypes)
        bad, wider = set(), {}
        for c in differ:
            to, of = stored.get(c), sent[c]
            if to in _WHOLE and of in _WHOLE:
                if _WHOLE[of] > _WHOLE[to]:
                    wider[c] = F.coalesce(F.max(F.col(f"`{c}`").try_cast(to).isNull() & F.col(f"`{c}`").isNotNull()), F.lit(False)).alias(c)
            elif not (to == "double" and (of == "float" or _WHOLE.get(of, 8) < 8)):
                bad.add(c)
        if wider:
            bad |= {c for c, lost in rows.agg(*wider.values()).first().asDict().items() if lost}
        if bad:
            raise Conflict(f"columns do not fit table {table!r}: {', '.join(sorted(bad))}")
        return rows.select(*[F.col(f"`{c}`").cast(stored[c]).alias(c) if c in differ else F.col(f"`{c}`") for c in rows.columns])

    def append(self, table: str, rows: DataFrame) -> int:
        """Add rows to a stored table; the existing files are not rewritten, missing columns become NULL."""
        shaped = self.read(table).limit(0).unionByName(self.fitted(table, rows), allowMissingColumns=True)
        return self.publish(self.stage({table: shaped}), append=[table])

    def drop_all(self) -> int:
        """Remove every table of the project from the live version."""
        return self._publish({})

    # -- snapshots -----------------------------------------------------------------------------

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SNAPSHOT).parquet(f"{self.root}/snapshots")
        except AnalysisException:
            return self.spark.createDataFrame([], _SNAPSHOT)

    def _note(self, version: int, state: str) -> None:
        row = self.spark.createDataFrame([(version, state, time.time_ns())], _SNAPSHOT)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")

    def snapshots(self) -> DataFrame:
        """``version`` of every usable snapshot."""
        state = self._log().groupBy("version").agg(F.max_by("state", "at").alias("state"))
        return state.filter("state = 'kept'").select("version")

    def snapshot(self) -> int:
        """Keep the live version restorable."""
        version = self.version()
        self._note(version, "kept")
        return version

    def has_snapshot(self, version: int) -> bool:
        return not self.snapshots().filter(F.col("version") == version).isEmpty()

    def drop_snapshot(self, version: int) -> None:
        """Give a snapshot up; dropping it twice is harmless."""
        if self.has_snapshot(version):
            self._note(version, "dropped")

    def restore(self, version: int) -> int:
        """Make a snapshot live again; it is used up by that."""
        if not self.has_snapshot(version):
            raise Conflict(f"snapshot {version} has expired")
        new = self._publish(self._rows(version))
        self._note(version, "consumed")
        return new

    def unreferenced(self) -> DataFrame:
        """Folders that neither the live version nor a usable snapshot needs."""
        rows = self.manifests().filter("table <> ''")
        needed = self.snapshots().unionByName(self.spark.createDataFrame([(self.version(),)], "version long")).distinct()
        used = rows.join(needed, "version", "left_semi").select("path").distinct()
        return rows.select("path").distinct().join(used, "path", "left_anti")

    def sizes(self) -> DataFrame:
        """``version, size_bytes`` of each usable snapshot, from a file listing without contents."""
        rows = self.manifests().filter("table <> ''").join(self.snapshots(), "version", "left_semi")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/tables")
        folder = F.regexp_extract("path", "/tables/([^/]+/[^/]+)/[^/]+$", 1)
        per_folder = files.select(folder.alias("folder"), "length").groupBy("folder").agg(F.sum("length").alias("bytes"))
        keyed = rows.select("version", F.regexp_extract("path", "/tables/([^/]+/[^/]+)$", 1).alias("folder"))
        joined = keyed.join(per_folder, "folder", "left").groupBy("version")
        return joined.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("size_bytes"))
