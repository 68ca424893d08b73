"""The stages of the corpus pipeline: each takes and returns rows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import decontaminate, lines, neardup, sentencepiece
from rowmill.llm import quality as quality_model
from rowmill.llm.table import fresh, read, ready, replace, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good stay.

    It is trained on the labels of rows that are not held out, among the documents that are there.
    """
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality_model.train(docs, labels.where(~quality_model.held_out(F.col("doc_id"))))
    score, = fresh(docs, "quality_score")
    return quality_model.score(docs, model, name=score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document, or the document itself, already has are cut out.

    Windows of three lines go first, then runs of sentences of 50 words or more in what is left, so that a long passage is
    found however it is broken into lines. ``n_chars`` follows the text. Documents of which nothing is left go, as
    copies of what came before; those that were empty stay.
    """
    ready(spark)
    lines_removed, pieces_removed = "lines_removed", "pieces_removed"
    # The documents' own columns of these names step aside.
    aside = iter(fresh(docs, *(f"own_{i}" for i in range(len(docs.columns)))))
    own = docs.toDF(*(next(aside) if c.lower() in (lines_removed, pieces_removed) else c for c in docs.columns))
    cut = saved(lines.drop_repeats(own), "line-windows")
    cut = lines.drop_passages(cut).where(f"({lines_removed} = 0 AND {pieces_removed} = 0) OR trim(text) <> ''")
    changed = (F.col(lines_removed) > 0) | (F.col(pieces_removed) > 0)
    return cut.select(
        *(
            (F.when(changed, F.length("text")).otherwise(F.col(c)) if c == "n_chars" else F.col(f"`{c}`")).alias(name)
            for c, name in zip(own.columns, docs.columns, strict=True)
        )
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def sentencepiece_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces, the number of pieces (``n_pieces``), and whether decoding restores the text (``restored``).

    Columns of these names, and ``pieces``, are replaced.
    """
    vocabulary = sentencepiece.Vocabulary.load()
    encoded = sentencepiece.encode(docs, vocabulary)
    restored, = fresh(encoded, "decoded")
    decoded = sentencepiece.decode(encoded, vocabulary, name=restored)
    found = replace(
        decoded,
        {
            "n_pieces": F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint"),
            "restored": F.col(f"`{restored}`").eqNullSafe(F.col("text")),
        },
    )
    return found.drop(restored) if restored.lower() != "restored" else found
