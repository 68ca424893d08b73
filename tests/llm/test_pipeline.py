"""Queries and stages on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from rowmill.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages benchmark labels embeddings".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_twin(llm, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](llm, FOLDER)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want


def test_registered():
    found = entry_points.queries()
    assert "pipeline" in found and len([n for n in found if n.startswith("op")]) == 13


def test_stages_keep_columns_and_nest(llm):
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, current, FOLDER)
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left <= ids and left
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids, current = left, out
    assert current.where("NOT restored").count() == 0


def test_stages_take_awkward_rows(llm, awkward, nothing):
    for _, stage in corpus_pipeline.STAGES:
        for rows in (awkward, nothing):
            out = stage(llm, rows, FOLDER)
            assert set(awkward.columns) <= set(out.columns) and out.count() <= rows.count()


def test_run_equals_its_stages_by_brute_force(llm):
    from pyspark.sql import functions as F

    from rowmill.llm import quality, sentencepiece

    from .test_filters import deduplicated, hits
    from .test_passages import without_passages
    from .test_models import groups

    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    labels = llm.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    rows = [(r["doc_id"], r["text"]) for r in quality.score(docs, model).where("score >= 0.5").collect()]
    rows = [(i, t, removed) for i, t, removed in deduplicated(rows)]
    again = {i: (t, removed) for i, t, removed in without_passages([(i, t) for i, t, _ in rows])}
    rows = [(i, again[i][0]) for i, t, removed in rows if not (removed or again[i][1]) or (again[i][0] or "").strip(" ")]
    kept = {i for i, _, _, keep in groups(rows) if keep}
    items = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {i: t for i, t in rows if i in kept and not hits(t, items)[-1]}
    got = corpus_pipeline.run(llm, FOLDER)
    decoded = sentencepiece.decode(got, sentencepiece.Vocabulary.load(), name="again").collect()
    assert len(decoded) == len(want) and {r["doc_id"]: r["text"] for r in decoded} == want
    assert all(r["again"] == r["text"] for r in decoded)
