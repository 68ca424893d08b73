"""Structure from data: keys, dependencies, clusters, enumerations, foreign keys, reuse of tables.

Every operator returns evidence rows; thresholds come from ``ImportOptions``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.names import plural, singular
from rowmill.operators.infer import type_name
from rowmill.operators.profile import (
    column_facts,
    column_stats,
    long_cells,
    rate,
    union_all,
    value_counts,
)
from rowmill.options import ImportOptions
from rowmill.session import quoted

DEFAULTS = ImportOptions()
_GROUPED = re.compile(r"^(.+?)_(\d+)_(.+)$")


def candidate_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column whether it could be the primary key: unique, non-null, whole number or text."""
    facts = column_facts(tables)
    seen = F.col("distinct_values") + F.when(F.col("null_count") > 0, 1).otherwise(0)
    return facts.select("region", "column", "row_count", seen.cast("long").alias("distinct_count"), unique_column().alias("is_key"))


def unique_column() -> Column:
    """Whether the exact counts of ``column_facts`` allow a column as a key: no gap at all, and no value twice."""
    return (
        F.col("inferred_type").isin("int", "string")
        & (F.col("row_count") > 0)
        & (F.col("null_count") == 0)
        & (F.col("distinct_values") == F.col("row_count"))
    )


def prefix_clusters(columns: Iterable[str]) -> dict[str, list[str]]:
    """Columns sharing the text before their first underscore, two or more of them."""
    out: dict[str, list[str]] = {}
    for name in columns:
        head, sep, tail = name.partition("_")
        if sep and head and tail and not _GROUPED.match(name):
            out.setdefault(head, []).append(name)
    return {k: v for k, v in out.items() if len(v) > 1}


def repeated_identifiers(df: DataFrame, options: ImportOptions = DEFAULTS) -> DataFrame:
    """Evidence that a column identifies something occurring on many rows.

    ``column, row_count, distinct_values, repetition, largest_group, repeated``.
    """
    groups = value_counts(df).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("n").alias("filled"),
        F.max("n").alias("largest_group"),
    )
    out = groups.withColumn("repetition", F.col("filled") / F.col("distinct_values"))
    return out.select(
        "column",
        "distinct_values",
        "largest_group",
        "repetition",
        (F.col("repetition") >= options.min_repetition).alias("repeated"),
    )


def functional_deps(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """``key, attribute, groups, violations, holds``: does each key value fix each attribute?

    Distinct combinations come first: where the dependency holds, repetition collapses on the map side
    in a hash aggregate, and little is left for the second grouping. There a key agrees on an attribute
    when smallest and largest value are equal and the attribute is missing everywhere or nowhere.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(attributes):
        c = F.col(f"`{a}`")
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count(c).alias(f"n{i}")]
    rows = df.filter(F.col(f"`{key}`").isNotNull()).select(f"`{key}`", *[f"`{a}`" for a in attributes]).distinct()
    groups = rows.groupBy(f"`{key}`").agg(*aggs)
    bad = []
    for i in range(len(attributes)):
        agree = (F.col(f"n{i}") == 0) | ((F.col(f"n{i}") == F.col("n")) & (F.col(f"lo{i}") == F.col(f"hi{i}")))
        bad.append(F.count_if(~agree).alias(f"bad{i}"))
    rows = [
        F.struct(
            F.lit(key).alias("key"),
            F.lit(a).alias("attribute"),
            F.col("groups"),
            F.col(f"bad{i}").alias("violations"),
            (F.col(f"bad{i}") == 0).alias("holds"),
        )
        for i, a in enumerate(attributes)
    ]
    return groups.agg(F.count(F.lit(1)).alias("groups"), *bad).select(F.inline(F.array(*rows)))


def cluster_rows(df: DataFrame) -> dict[str, DataFrame]:
    """The distinct combinations of each prefix cluster's columns, with how often they occur as ``_n``."""
    return {
        head: df.groupBy(*[F.col(f"`{m}`") for m in names]).agg(F.count(F.lit(1)).alias("_n"))
        for head, names in prefix_clusters(df.columns).items()
    }


def cluster_evidence(df: DataFrame, options: ImportOptions = DEFAULTS, groups: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Sub-entity candidates: for every prefix cluster, each member considered as the key of the others.

    ``cluster, key, attributes, row_count, distinct_values, tested, combinations, is_entity``. A member
    is an entity key when it has no gaps, repeats often enough and fixes all other members, and the
    document is not too small to be worth splitting.

    Distinct counts come first and rule most members out: a key cannot fix a column that has more
    distinct values than itself. A remaining key fixes its cluster when there are as many distinct
    combinations of the cluster as key values - a hash aggregate that collapses repetition on the map
    side. With the stored ``groups`` of :func:`cluster_rows` all counts come from these.
    """
    clusters = prefix_clusters(df.columns)
    if not clusters:
        raise ValueError("no columns share a prefix")
    if groups is None:
        members = [m for ms in clusters.values() for m in ms]
        facts = {r["column"]: r.asDict() for r in column_facts({"": df}, members).collect()}
    else:
        facts = _facts_of_groups(groups)
    rows, combined = [], []
    for head, names in clusters.items():
        widest = max(facts[m]["distinct_values"] for m in names)
        whole = df.select(*[f"`{m}`" for m in names]).distinct() if groups is None else groups[head]
        whole = whole.agg(F.count(F.lit(1)).alias("combinations"))
        tested_any = False
        for key in names:
            f = facts[key]
            tested = (
                f["null_count"] == 0
                and f["row_count"] >= options.flat_below_rows
                and f["row_count"] >= f["distinct_values"] * options.min_repetition
                and f["distinct_values"] >= widest
            )
            tested_any = tested_any or tested
            rows.append((head, key, len(names) - 1, f["row_count"], f["distinct_values"], tested))
        if tested_any:
            combined.append(whole.select(F.lit(head).alias("cluster"), "combinations"))
    schema = "cluster string, key string, attributes long, row_count long, distinct_values long, tested boolean"
    candidates = df.sparkSession.createDataFrame(rows, schema)
    if not combined:
        return candidates.withColumns({"combinations": F.lit(0).cast("long"), "is_entity": F.lit(False)})
    # One row per cluster of the schema bounds the broadcast.
    out = candidates.join(F.broadcast(union_all(combined)), "cluster", "left")
    found = F.when(F.col("tested"), F.col("combinations")).otherwise(F.lit(0))
    return out.select(
        *candidates.columns,
        found.alias("combinations"),
        (F.col("tested") & (F.col("combinations") == F.col("distinct_values"))).alias("is_entity"),
    )


def _facts_of_groups(groups: Mapping[str, DataFrame]) -> dict[str, dict]:
    """Distinct values, gaps and rows of the columns of :func:`cluster_rows`."""
    facts = {r["column"]: r.asDict() for r in column_facts({h: g.drop("_n") for h, g in groups.items()}).collect()}
    counts = []
    for head, g in groups.items():
        members = [c for c in g.columns if c != "_n"]
        gaps = F.array(*(F.coalesce(F.sum(F.when(F.col(f"`{m}`").isNull(), F.col("_n"))), F.lit(0)) for m in members))
        counts.append(g.agg(F.lit(head).alias("head"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), gaps.alias("gaps")))
    for r in union_all(counts).collect():
        for m, gap in zip((c for c in groups[r["head"]].columns if c != "_n"), r["gaps"], strict=True):
            facts[m] |= {"row_count": r["n"], "null_count": gap}
    return facts


# Name endings that mark an identifier, best first.
_ID_ENDINGS = ("_id", "_key", "_code", "_email", "_sku", "_number")


def identifier_rank(name: str) -> int:
    """How little a name looks like an identifier's: the place of its ending, the number of endings for others."""
    place = [i for i, e in enumerate(_ID_ENDINGS) if name.endswith(e)]
    return place[0] if place else len(_ID_ENDINGS)


def choose_entities(evidence: DataFrame) -> dict[str, str]:
    """Prefix -> key column from the evidence: identifier-like names first, then column order."""
    found: dict[str, list[str]] = {}
    for r in evidence.filter("is_entity").select("cluster", "key").collect():
        found.setdefault(r["cluster"], []).append(r["key"])

    def preference(name: str) -> tuple[int, str]:
        return (identifier_rank(name), name)

    return {head: min(keys, key=preference) for head, keys in sorted(found.items())}


def enum_columns(df: DataFrame, options: ImportOptions = DEFAULTS) -> DataFrame:
    """Text columns that stay inline: few short values, listed for a check constraint.

    The value set is collected only after a column is known to have at most ``enum_max_values``.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c, t in df.dtypes if t == "string"]
    long = df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL")
    # One text that is too long rules its column out, so longer ones need not be told apart.
    size = F.length("value")
    short = F.when(size <= options.enum_max_length, F.col("value")).alias("value")
    counts = long.groupBy("column", short).agg(F.max(size).alias("length"))
    stats = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.max("length").alias("max_length")
    )
    counts = counts.select("column", "value")
    small = stats.filter(
        (F.col("distinct_values") <= options.enum_max_values) & (F.col("max_length") <= options.enum_max_length)
    )
    # ``small`` has one row per column of the schema, which bounds the broadcast.
    listed = counts.join(F.broadcast(small), "column").groupBy("column", "distinct_values", "max_length")
    return listed.agg(F.concat_ws("|", F.sort_array(F.collect_set("value"))).alias("allowed"))


def keep_flat(df: DataFrame, columns: Sequence[str], options: ImportOptions = DEFAULTS) -> DataFrame:
    """``column, decision, reason``: split a column's entity out, or keep the table flat."""
    stats = column_facts({"": df}, columns)
    tiny = F.col("row_count") < options.flat_below_rows
    unique = F.col("distinct_values") * options.min_repetition > F.col("row_count") - F.col("null_count")
    reason = F.when(tiny, "small document").when(unique, "no repetition").otherwise("repeated entity")
    return stats.select(
        "column", F.when(tiny | unique, "flat").otherwise("split").alias("decision"), reason.alias("reason")
    )


def _bare(table: str, column: str) -> str:
    """Column name without a leading table abbreviation (``o_custkey`` of orders -> ``custkey``)."""
    head, sep, tail = column.partition("_")
    names = {table[:1], table[:2], singular(table), table}
    initials = "".join(w[:1] for w in table.split("_"))
    if sep and tail and (head in names or head == initials or len(head) <= 2):
        return tail
    return column


def names_agree(child_table: str, child: str, parent_table: str, parent: str) -> bool:
    """Same name once table prefixes are dropped, or ``<singular>_id`` against ``<plural>.id``."""
    left, right = _bare(child_table, child), _bare(parent_table, parent)
    if left == right and left != "id":
        return True
    one = singular(parent_table)
    return child in (f"{one}_{parent}", f"{one}_id") and parent in ("id", f"{one}_id", child)


FK_COLUMNS = (
    "child_table string, child_column string, parent_table string, parent_column string, child_distinct long, matched long, "
    "coverage double, is_fk boolean"
)


def fk_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign keys the data supports: every child value occurs in a parent key of agreeing name.

    All columns share one grouping by value: each value carries a bit per column it occurs in, so
    inclusion of any pair is a bit test in one aggregate - no value join and no pairs per value. A parent is a key when
    it has as many distinct values as filled cells. Without a pair of agreeing names there are no rows.
    ``child_table, child_column, parent_table, parent_column, child_distinct, matched, coverage, is_fk``.
    """
    kinds = {
        (t, name): type_name(dtype)
        for t, df in tables.items()
        for name, dtype in df.dtypes
        if dtype == "string" or type_name(dtype) == "int"
    }
    pairs = [
        (child, parent)
        for child, kind in kinds.items()
        for parent, other in kinds.items()
        if child[0] != parent[0] and kind == other and names_agree(*child, *parent)
    ]
    if not pairs:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], FK_COLUMNS)
    used = {column for pair in pairs for column in pair}
    ids, cells = long_cells(tables, lambda t, name, _: (t, name) in used)
    number = {column: i for i, column in enumerate(ids)}
    found = inclusion(cells, [(c, p, number[c], number[p]) for c, p in pairs])
    filled = union_all(
        [
            column_stats(tables[t].select(*[f"`{n}`" for tt, n in ids if tt == t])).select(
                F.lit(t).alias("parent_table"),
                F.col("column").alias("parent_column"),
                (F.col("row_count") - F.col("null_count")).alias("filled"),
            )
            for t in sorted({t for t, _ in ids})
        ]
    )
    found = found.join(filled, ["parent_table", "parent_column"])
    complete = (F.col("child_distinct") > 0) & (F.col("matched") == F.col("child_distinct"))
    return found.select(
        "child_table",
        "child_column",
        "parent_table",
        "parent_column",
        "child_distinct",
        "matched",
        rate(F.col("matched"), F.col("child_distinct")).alias("coverage"),
        (complete & (F.col("parent_distinct") == F.col("filled"))).alias("is_fk"),
    )


# Columns per mask word; a signed 64-bit word keeps its sign bit free.
_WORD = 62


def inclusion(cells: DataFrame, pairs: list[tuple[tuple[str, str], tuple[str, str], int, int]]) -> DataFrame:
    """Distinct values of child and parent, and how many of the child's the parent has, of each pair of columns.

    A pair is (child, parent) as (table, column) and their numbers in ``cells`` (see ``long_cells``).
    """
    used = sorted({i for _, _, c, p in pairs for i in (c, p)})
    words = sorted({i // _WORD for i in used})
    masks = [
        F.expr(f"bit_or(CASE WHEN cid DIV {_WORD} = {w} THEN shiftleft(1L, cid % {_WORD}) ELSE 0L END) AS m{w}")
        for w in words
    ]
    per_value = cells.groupBy("as_long", "as_text").agg(*masks)

    def has(i: int) -> str:
        return f"(m{i // _WORD} & {1 << (i % _WORD)}L) <> 0"

    aggs = [F.expr(f"count_if({has(i)}) AS d{i}") for i in used]
    aggs += [F.expr(f"count_if({has(c)} AND {has(p)}) AS n{c}_{p}") for _, _, c, p in pairs]
    rows = ", ".join(
        f"struct({quoted(child[0])} AS child_table, {quoted(child[1])} AS child_column, {quoted(parent[0])} AS parent_table, "
        f"{quoted(parent[1])} AS parent_column, d{c} AS child_distinct, n{c}_{p} AS matched, d{p} AS parent_distinct)"
        for child, parent, c, p in pairs
    )
    return per_value.agg(*aggs).selectExpr(f"inline(array({rows}))")


def reconcile(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """How well each incoming table fits each stored one, by column name and type.

    Both sides are proposal rows (``table, column, type``).
    ``incoming, existing, shared, incoming_columns, coverage, compatible`` for pairs that share a column.
    """
    a = incoming.select(F.col("table").alias("incoming"), "column", "type")
    b = existing.select(F.col("table").alias("existing"), "column", "type")
    shared = a.join(b, ["column", "type"]).groupBy("incoming", "existing").agg(F.count(F.lit(1)).alias("shared"))
    width = a.groupBy("incoming").agg(F.count(F.lit(1)).alias("incoming_columns"))
    out = shared.join(width, "incoming")
    return out.select(
        "incoming",
        "existing",
        "shared",
        "incoming_columns",
        rate(F.col("shared"), F.col("incoming_columns")).alias("coverage"),
        (F.col("shared") == F.col("incoming_columns")).alias("compatible"),
    )


def repeating_groups(columns: Iterable[str]) -> tuple[dict[int, dict[str, str]], list[str]]:
    """``item_1_name`` style columns as group number -> {field: column}, and the field order."""
    groups: dict[int, dict[str, str]] = {}
    fields: list[str] = []
    for name in columns:
        m = _GROUPED.match(name)
        if m:
            field = m.group(3)
            groups.setdefault(int(m.group(2)), {})[field] = name
            if field not in fields:
                fields.append(field)
    return dict(sorted(groups.items())), fields


def table_name_for(prefix: str) -> str:
    """Table for a prefix cluster."""
    return plural(prefix)
