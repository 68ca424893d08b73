"""Allow and block rules for urls, found in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.attach import FREQUENT, attach
from rowmill.llm.table import fresh, lowered, replace, saved

# The rules of a trie travel to every task with the function, so their number is bounded; it takes some 500 bytes each.
# More rules, or rules in a table, are joined.
MOST_RULES = 100_000

Rule = tuple[str, str, str]


class Trie:
    """Rules by reversed host labels, then whole path segments, then the unfinished last segment.

    Keys of a node are host labels as (".", label) and path segments as ("/", segment); ``ends`` holds what
    follows the last slash of a rule's path -> verdict and rule, ``longest`` the longest of these.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault((".", label), {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(("/", segment), {})
            ends = node.setdefault("ends", {})
            if last not in ends or verdict == "block":
                ends[last] = (verdict, host + path)
            node["longest"] = max(node.get("longest", 0), len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the longest rule that fits: most host labels first, then the longest path."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get((".", label))
            if node is None:
                break
            best = self._in_path(node, segments) or best
        return best

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if "ends" in node:
                # Longest beginning of this segment that ends a rule.
                tries = range(min(len(segment), node["longest"]), -1, -1)
                best = next((node["ends"][segment[:n]] for n in tries if segment[:n] in node["ends"]), best)
            node = node.get(("/", segment))
            if node is None:
                break
        return best


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lowered(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, rules: Iterable[Rule] | DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules`` are (verdict, host, path), as a list or a table of these columns. Up to ``MOST_RULES`` of a list are looked up
    in a trie, more and tables are joined; both give the same. A rule fits its host and all subdomains if the url's path starts with
    its path. The longest rule decides: more host labels first, then the longer path; where allow and block are
    given for the same place, block. Without a rule, ``rule`` is NULL and the verdict is ``default``. NULL urls
    and urls without ``://`` have an empty host and path, and no rule. Columns of these four names are
    replaced; any other column is kept.
    """
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        return _joined(df, rules, url_column, default)
    rules = list(rules)
    if len(rules) > MOST_RULES:
        return _joined(df, spark.createDataFrame(rules, "verdict string, host string, path string"), url_column, default)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def look_up(host: pa.ChunkedArray, path: pa.ChunkedArray) -> Iterator[tuple[str, str] | None]:
        find = trie.value.find
        return (find(h, p) if h else None for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True))

    @F.arrow_udf("struct<verdict:string,rule:string>")
    def match(host: pa.Array, path: pa.Array) -> pa.Array:
        found = list(look_up(host, path))
        return pa.StructArray.from_arrays(
            [pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string())],
            ["verdict", "rule"],
        )

    h, p, m = fresh(df, "url_host", "url_path", "url_match")
    url = F.col(f"`{url_column}`")
    parts = df.withColumns({h: host_of(url), p: path_of(url)})
    found = parts.withColumn(m, match(F.col(h), F.col(p)))
    out = replace(
        found,
        {
            "host": F.col(h), "path": F.col(p), "rule": F.col(m)["rule"],
            "verdict": F.coalesce(F.col(m)["verdict"], F.lit(default)),
        },
    )
    return out.drop(h, p, m)


def _joined(df: DataFrame, rules: DataFrame, url_column: str, default: str, frequent: int = FREQUENT) -> DataFrame:
    """:func:`judge` by joins, for any number of rules.

    The endings of each url's host are joined to the hosts that have rules, which tell the lengths of their paths; the
    beginnings of the url's path of these lengths are joined to the rules, and the longest stays. Endings such as ``com``
    and the paths of a large site occur in a large part of all rows: their facts are sent to every task
    instead (see ``attach``). Rules with a NULL in them are none.
    """
    row, h, p = fresh(df, "url_row", "url_host", "url_path")
    url = F.col(f"`{url_column}`")
    parts = saved(df.select("*", host_of(url).alias(h), path_of(url).alias(p), F.monotonically_increasing_id().alias(row)), "url-parts")
    known = (
        rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    )
    known = saved(known.select("*", F.concat("host", F.lit("\x00"), "path").alias("place"), F.concat("host", "path").alias("rule")), "url-rules")
    by_host = known.groupBy(F.col("host").alias("ending")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    labels = F.split("host", "[.]")
    starts = F.sequence(F.lit(1), F.size(labels))
    endings = parts.where(F.col(h) != "").select(F.col(row).alias("row"), F.col(h).alias("host"), F.col(p).alias("path"))
    endings = endings.select(
        "row", "path", F.explode(F.transform(starts, lambda i: F.struct((F.size(labels) - i).alias("labels"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("ending")))).alias("e")
    ).select("row", "path", "e.*")
    met = saved(attach(endings, "ending", _counted(endings, "ending", by_host), ["lengths"], frequent=frequent).where("lengths IS NOT NULL"), "url-endings")
    places = met.select("row", "labels", "ending", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    places = places.select("row", "labels", "n", F.concat("ending", F.lit("\x00"), F.substring("path", F.lit(1), F.col("n"))).alias("place"))
    by_place = known.select("place", "verdict", "rule")
    fits = attach(places, "place", _counted(places, "place", by_place), ["verdict", "rule"], frequent=frequent).where("rule IS NOT NULL")
    best = fits.groupBy("row").agg(F.max_by(F.struct("verdict", "rule"), F.struct("labels", "n")).alias("best"))
    best_name, best_row = fresh(parts, "url_best", "url_best_row")
    found = parts.join(best.select(F.col("row").alias(best_row), F.col("best").alias(best_name)), F.col(row) == F.col(best_row), "left")
    out = replace(
        found,
        {
            "host": F.col(h), "path": F.col(p), "rule": F.col(best_name)["rule"],
            "verdict": F.coalesce(F.col(best_name)["verdict"], F.lit(default)),
        },
    )
    return out.drop(h, p, row, best_name, best_row)


def _counted(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """The facts of keys that occur, with the number of rows of each; stored, as they are read twice."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return saved(facts.join(counts, key), "url-facts")
