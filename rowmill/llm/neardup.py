"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.components import components
from rowmill.llm.table import KeyFilter, ready, saved
from rowmill.llm.words import BETWEEN_SPACES, grams, mix, words

SHINGLE_WORDS = 5
# Documents are linked from this share of common shingles on, in percent.
PERCENT = 75
# 32 bands of 4 samples: two sets that share three quarters are in no common band once in 190,000 times.
BANDS, BAND_ROWS = 32, 4
SAMPLES = BANDS * BAND_ROWS
# The odd sketch: a bit per place, flipped by each sample that falls there. Two sets that share three quarters differ in
# 50 bits on average, give or take 7; unrelated ones in 128, give or take 8. More than 88 are not compared further.
SKETCH_BITS = 256
MOST_DIFFERENT = 88
# Bits of the parity bitmap of a full set, which bounds the difference of two sets from below.
PARITY_BITS = 2048
# Members of a bucket are dealt into blocks of about so many; no task holds more than two blocks of one bucket.
BLOCK_MEMBERS = 256

_rng = np.random.default_rng(20240601)
_XOR = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)[:, None]
_FACTOR = (_rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_SAMPLE_NO = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_BAND_NO = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_BAND_FACTOR = _rng.integers(0, 1 << 63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct 64-bit shingle hashes of each text; texts without words have an empty set."""
    for w in words(texts, BETWEEN_SPACES):
        hashes = w.hashes()
        runs = grams(hashes, SHINGLE_WORDS)
        for r in range(w.rows):
            first, last = int(w.bounds[r]), int(w.bounds[r + 1])
            n = last - first
            if n >= SHINGLE_WORDS:
                yield w.row + r, np.unique(runs[first : last - SHINGLE_WORDS + 1])
            else:
                yield w.row + r, grams(hashes[first:last], n) if n else np.empty(0, np.uint64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that two different sets share only by chance."""
    one, two = mix(shingles), mix(shingles ^ np.uint64(0x6A09E667F3BCC909))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int((two * (one | np.uint64(1))).sum(dtype=np.uint64).view(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[None, i : i + 1024] ^ _XOR) * _FACTOR).min(axis=1), out=out)
    return out


def parity(values: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of 64-bit values at each of ``bits`` places, as 64-bit words."""
    places = (values >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of MinHash samples, each with its number."""
    return parity(mix(samples + _SAMPLE_NO), SKETCH_BITS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    return mix((mix(samples).reshape(BANDS, BAND_ROWS) * _BAND_FACTOR).sum(axis=1, dtype=np.uint64) + _BAND_NO).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, id, text_key, n, d1, d2, sketch, bands`` of (id, text_key, text)."""
    no = TaskContext.get().partitionId() << 40
    for batch in batches:
        n, d1, d2, sketch, bands = [], [], [], [], []
        for _, shingles in shingle_sets(batch.column(2)):
            n.append(len(shingles))
            if not len(shingles):
                one, two, mins = 0, 0, None
            else:
                (one, two), mins = digest(shingles), minima(shingles)
            d1.append(one)
            d2.append(two)
            sketch.append(None if mins is None else odd_sketch(mins))
            bands.append(None if mins is None else band_keys(mins))
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(no, no + rows), pa.int64()), batch.column(0), batch.column(1), pa.array(n, pa.int64()),
             pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            names=["row", "id", "text_key", "n", "d1", "d2", "sketch", "bands"],
        )
        no += rows


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, set`` of the wanted classes, from one text of each, found again by its hash.

    Texts of other classes stay in their tasks, but for the few that the bit filter takes for wanted.
    """
    may = KeyFilter.of(wanted, "text_key", wanted.count())
    sent = docs.sparkSession.sparkContext.broadcast(may)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            _, first = np.unique(keys, return_index=True)
            first = np.sort(first[sent.value(keys[first])])
            texts = batch.column(1).take(pa.array(first))
            d1, d2, sets, parities = [], [], [], []
            for _, shingles in shingle_sets(texts):
                one, two = digest(shingles)
                d1.append(one)
                d2.append(two)
                sets.append(shingles.view(np.int64))
                parities.append(parity(shingles, PARITY_BITS))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sets, lists), pa.array(parities, lists)],
                names=["d1", "d2", "set", "parity"],
            )

    found = docs.mapInArrow(rows, "d1 bigint, d2 bigint, set array<bigint>, parity array<bigint>")
    once = found.join(wanted.select("d1", "d2", "rep"), ["d1", "d2"]).groupBy("rep").agg(
        F.any_value("set").alias("set"), F.any_value("parity").alias("parity")
    )
    return saved(once, "shingle-sets")


def _alike(a: str, b: str) -> Column:
    """Whether sizes and odd sketches leave a link possible."""
    sizes = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * PERCENT
    different = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        different = different + F.bit_count(F.get(f"{a}_sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}_sketch", F.lit(i))))
    return sizes & (different <= MOST_DIFFERENT)


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("rep").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets share enough."""
    close = pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").where(_alike("a", "b")).select("a", "b")
    both = close.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("a_set")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("set").alias("b_set")), "b"
    )
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return saved(both.where(common * 100 >= union * PERCENT).select("a", "b"), "links")


def _possible(a: str, b: str) -> Column:
    """Whether the parities of the full sets leave a link possible: never false for a link.

    Each shingle that only one of the sets has flips one bit, so at least as many differ as bits do.
    """
    different = F.lit(0)
    for i in range(PARITY_BITS // 64):
        different = different + F.bit_count(F.get(f"{a}_parity", F.lit(i)).bitwiseXOR(F.get(f"{b}_parity", F.lit(i))))
    return (F.col(f"{a}_n") + F.col(f"{b}_n")) * (100 - PERCENT) >= different * (100 + PERCENT)


def _blocks(size: str) -> Column:
    """Number of blocks of a bucket."""
    return F.ceil(F.col(size) / BLOCK_MEMBERS).cast("int")


def _with_block(members: DataFrame) -> DataFrame:
    """Rows ``size, rep`` with the block of each member."""
    return members.withColumn("block", F.pmod(F.xxhash64("rep"), _blocks("size")).cast("int"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components ``node, comp`` after adding links between nodes."""
    if links.isEmpty():
        return comps
    if comps is None:
        return components(links)
    known = comps.select(F.col("node").alias("x"), F.col("comp").alias("y"))
    sides = links
    for side in ("a", "b"):
        sides = sides.join(known, sides[side] == known["x"], "left").withColumn(side, F.coalesce("y", side)).drop("x", "y")
    up = components(sides).select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    # Nodes that were in no component before are their own old component.
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(comps, "node", "left_anti")
    every = comps.unionByName(fresh.withColumn("comp", F.col("node")))
    return saved(every.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "components")


def _links(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Components of the classes that have a link.

    A band's bucket may be large, so its pairs are not listed. Every member is first compared to one leader (the
    same for most buckets of a group), then, in buckets that still hold several components, to a leader of the
    bucket's own. What is left are pairs of different components in one bucket. These are joined, but for pairs whose
    odd sketches, of the samples or of the full sets, rule a link out: every candidate pair ends up linked, ruled
    out, or within one component. A bucket is met block by block (see ``BLOCK_MEMBERS``), so however many members it
    has, its work is spread over tasks of one size.
    """
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    leader = F.min(F.struct(F.xxhash64("rep").alias("order"), F.col("rep").alias("lead")))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), leader.alias("first")).where("size > 1")
    members = saved(buckets.join(shared, "key").select("key", "size", "rep", F.col("first.lead").alias("lead")), "band-members")
    tested = saved(members.where("rep <> lead").select(*_pair("rep", "lead")).distinct(), "pairs")
    if tested.isEmpty():
        return None
    wanted = saved(members.select("rep").distinct().join(classes, "rep").select("rep", "text_key", "d1", "d2"), "wanted")
    sets = _sets_of(docs, wanted)
    comps = _joined(None, _confirmed(tested, classes, sets))
    for last in (False, True):
        left = members.where("size > 2").select("key", "size", "rep")
        if comps is not None:
            left = left.join(comps, left["rep"] == comps["node"], "left").select("key", "size", "rep", F.coalesce("comp", "rep").alias("comp"))
        else:
            left = left.withColumn("comp", F.col("rep"))
        own = F.min(F.struct(F.xxhash64("key", "rep").alias("order"), F.col("rep").alias("lead"), F.col("comp").alias("lead_comp")))
        split = left.groupBy("key").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), own.alias("own"), F.any_value("size").alias("size")
        ).where("low <> high")
        # Each block of a bucket meets what is known of the bucket by itself.
        split = split.select("key", "own.lead", "own.lead_comp", F.explode(F.sequence(F.lit(0), _blocks("size") - 1)).alias("block"))
        left = _with_block(left)
        if last:
            mixed = saved(left.join(split.select("key", "block"), ["key", "block"]), "mixed-buckets")
            if mixed.isEmpty():
                break
            known = sets.select("rep", F.col("parity").alias("a_parity")).join(_side(classes, "rep").withColumnsRenamed({"rep_n": "a_n", "rep_sketch": "a_sketch"}), "rep")
            # Two members meet where their blocks do, and members of one block where it meets itself.
            one = mixed.join(known, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), _blocks("size") - 1)))
            one = one.select(
                "key", F.least("block", "with").alias("one_block"), F.greatest("block", "with").alias("other_block"), F.col("block").alias("a_block"),
                F.col("rep").alias("a"), F.col("comp").alias("a_comp"), "a_n", "a_sketch", "a_parity",
            )
            place = ["key", "one_block", "other_block"]
            other = one.withColumnsRenamed({c: "b" + c[1:] for c in one.columns if c not in place})
            differ = (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp"))
            here = (F.col("one_block") == F.col("other_block")) | (F.col("a_block") != F.col("b_block"))
            pairs = one.join(other, place).where(here & differ & _possible("a", "b") & _alike("a", "b")).select("a", "b")
        else:
            pairs = left.join(split, ["key", "block"]).where("comp <> lead_comp").select(*_pair("rep", "lead"))
        new = saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            continue
        comps = _joined(comps, _confirmed(new, classes, sets))
        tested = tested.unionByName(new)
    return comps


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, text_key, n_shingles, component_id, kept, part`` for every row; ``part`` tells apart components of one id.

    Words are runs between ASCII white space, A-Z lowered; a set holds the distinct runs of five words, or the whole
    text if it has one to four. Sets are linked from a Jaccard similarity of 0.75 on, exactly; the component id
    is the smallest id reachable over links, and rows whose id it is are kept. Rows with equal sets are one class,
    whatever their number; only classes are compared. Candidates come from MinHash bands (see ``BANDS``), so a link at the
    threshold is missed once in 190,000 times, and one whose odd sketches differ by more than ``MOST_DIFFERENT`` bits (five deviations) too,
    unless other links join the two.

    Texts without words, or NULL, are linked with nothing: their component is their own id. Ids may repeat: rows of one id
    need not be linked. NULL ids take part, but are only a component's id if it has no other.
    """
    ready(docs.sparkSession)
    picked = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.xxhash64(f"`{text_column}`"), F.lit(0)).alias("text_key"),
        F.col(f"`{text_column}`").alias("text"),
    )
    own = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", picked.schema["id"].dataType)])
    rest = T.StructType.fromDDL("text_key bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>, bands array<bigint>")
    marked = saved(picked.mapInArrow(_signatures, T.StructType([*own, *rest])), "signatures")
    classes = saved(
        marked.where("n > 0").groupBy("d1", "d2", "n").agg(
            F.min("row").alias("rep"), F.min("id").alias("min_id"), F.min(F.struct("row", "text_key"))["text_key"].alias("text_key"),
            F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"),
        ),
        "classes",
    )
    comps = _links(classes, picked.select("text_key", "text"))
    named = classes.select("d1", "d2", "n", "rep", "min_id")
    if comps is None:
        named = named.withColumn("component_id", F.col("min_id")).withColumn("comp", F.col("rep"))
    else:
        named = named.join(comps, named["rep"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "rep"))
        ids = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
        named = named.join(ids, "comp")
    named = named.select("d1", "d2", "n", "component_id", F.col("comp").alias("part"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (
        marked.select("id", "text_key", "n", "d1", "d2")
        .join(named, ["d1", "d2", "n"], "left")
        .select("id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "part")
    )


def document_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: one row of each group, and every text without words.

    Of rows that repeat the id of their group, one text stays, and of rows that repeat id and text, any one.
    """
    found = saved(near_duplicates(docs, id_column, text_column), "near-duplicates")
    kept = found.where("kept AND n_shingles > 0").groupBy("part", "id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    stay = kept.groupBy("part").agg(F.min("text_key").alias("stays"))
    kept = saved(kept.join(stay, "part"), "kept")
    gone = found.where("NOT kept").select("id", "text_key").distinct().unionByName(kept.where("text_key <> stays").select("id", "text_key"))
    key = F.coalesce(F.xxhash64(f"`{text_column}`"), F.lit(0))

    def among(pairs: DataFrame) -> Column:
        return docs[id_column].eqNullSafe(pairs["id"]) & (key == pairs["text_key"])

    out = docs.join(gone, among(gone), "left_anti")
    again = kept.where("rows > 1 AND text_key = stays").select("id", "text_key")
    if again.isEmpty():
        return out
    return out.join(again, among(again), "left_anti").unionByName(out.join(again, among(again), "left_semi").dropDuplicates([id_column, text_column]))
