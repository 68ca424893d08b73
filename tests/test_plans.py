"""The physical plans that large inputs depend on."""

import os

import pytest
from pyspark.sql import functions as F

from rowmill.operators import browse, runlog
from rowmill.plans import catalogue
from rowmill.plans import views as V
from rowmill.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture
def plan(capsys):
    def text(df):
        df.explain("formatted")
        return capsys.readouterr().out

    return text


def test_filter_and_columns_reach_the_scan(spark, plan):
    df = read_table(spark, FOLDER, "orders", ["o_orderkey", "o_totalprice"])
    text = plan(df.filter(browse.predicate(df, ["o_totalprice:gte:1000"])))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_pages_are_top_k_and_start_at_the_key(spark, plan):
    df = read_table(spark, FOLDER, "conversations", ["conv_id", "turn"])
    text = plan(browse.browse(df, ["conv_id", "turn"], cursor=(5, 1)).probe)
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(conv_id,5)" in text


def test_retention_limits_ranks_before_the_shuffle(spark, plan):
    text = plan(runlog.expired_by_count(V.runs(spark, FOLDER)))
    assert text.index("WindowGroupLimit") and "Partial" in text


def test_catalogue_listing_reads_no_contents(spark, plan, tmp_path):
    from rowmill.sources.documents import document_catalogue

    (tmp_path / "a.csv").write_text("x")
    assert "content" not in plan(document_catalogue(spark, str(tmp_path))).split("ReadSchema")[1].splitlines()[0]


SCHEMA_SIZED = {"schema_diff", "reconcile_tables"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_query_multiplies_rows(spark, plan, name):
    text = plan(catalogue.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    if name not in SCHEMA_SIZED:
        assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_hot_groups_are_not_numbered_in_one_task(spark, plan):
    from rowmill.operators.ranking import numbered

    df = spark.range(1000).select(F.lit(1).alias("g"), "id")
    out = numbered(df, ["g"], ["id"], "n")
    # The only window left runs over the per-task marks.
    assert "_part" in plan(out) and out.filter("n <> id + 1").isEmpty() and out.count() == 1000


def test_stored_events_shrink_before_the_shuffle(spark, plan):
    from rowmill.streaming.events import wait_timeouts

    text = plan(wait_timeouts(V.run_events(spark, FOLDER), ["error"]))
    assert "partial_max" in text and "SessionWindow" not in text


def test_flat_items_are_joined_twice(spark):
    """Orders take in their customers before the items come, so items go through two joins, not three."""
    plan = V.flat_sales(spark, FOLDER)._jdf.queryExecution().analyzed()
    joins = []

    def walk(node, above):
        above += node.nodeName() == "Join"
        children = [node.children().apply(i) for i in range(node.children().size())]
        if not children and "l_orderkey" in node.toString():
            joins.append(above)
        for child in children:
            walk(child, above)

    walk(plan, 0)
    assert joins == [2]
