import pytest
from pyspark.sql import functions as F

from rowmill.errors import BadFilter, BadSort, Conflict, ValidationFailed
from rowmill.operators import browse, catalog, changes, proposal, validate
from rowmill.operators.versions import VersionStore
from rowmill.options import ImportOptions
from rowmill.plans import importer
from rowmill.session import scratch_dir


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Alma", 30), (2, "Bob", 25), (3, "Cara", 42), (4, "Dan", 18), (5, "Eve", None)], "id int, name string, age int")


def _names(page):
    return [r["name"] for r in page.fetch()[0]]


def test_contains_and_sort(people):
    assert _names(browse.browse(people, ["id"], ["name:contains:A"], "age", "desc")) == ["Cara", "Alma", "Dan"]


def test_range_leaves_null_out(people):
    assert sorted(_names(browse.browse(people, ["id"], ["age:gte:25", "age:lt:42"]))) == ["Alma", "Bob"]
    assert sorted(_names(browse.browse(people, ["id"], ["age:neq:25"]))) == ["Alma", "Cara", "Dan"]


def test_null_order(people):
    assert _names(browse.browse(people, ["id"], sort="age"))[-1] == "Eve"
    assert _names(browse.browse(people, ["id"], sort="age", direction="desc"))[0] == "Eve"


@pytest.mark.parametrize("bad", ["ghost:eq:x", "age:eq:old", "age:near:3", "age:eq"])
def test_bad_filters(people, bad):
    with pytest.raises(BadFilter):
        browse.browse(people, ["id"], [bad])


def test_bad_sorts_and_limits(people):
    with pytest.raises(BadSort):
        browse.browse(people, sort="ghost")
    with pytest.raises(BadSort):
        browse.browse(people, sort="age", direction="up")
    for limit in (0, 501):
        with pytest.raises(BadFilter):
            browse.browse(people, limit=limit)


def test_boolean_date_and_literal_filters(spark):
    df = spark.sql("SELECT * FROM VALUES (1, true, date'2024-01-05', '50%'), (2, false, date'2024-02-05', '500') AS t(id, ok, day, s)")
    assert df.filter(browse.predicate(df, ["ok:eq:T", "day:lt:2024-02-01"])).count() == 1
    assert df.filter(browse.predicate(df, ["s:contains:0%"])).count() == 2
    assert df.filter(browse.predicate(df, ["s:contains:0%"], literal=True)).count() == 1
    assert df.filter(browse.predicate(df, ["day:contains:-02-"])).count() == 1
    with pytest.raises(BadFilter):
        browse.predicate(df, ["ok:eq:yes"])
    assert (browse.default_operator("string"), browse.default_operator("date")) == ("contains", "eq")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7])
def test_key_pages_cover_everything_once(spark, size):
    data = sorted((a, b) for a in range(3) for b in range(4))
    df = spark.createDataFrame(data, "a int, b int").repartition(3)
    seen, cursor = [], None
    while True:
        got, cursor = browse.browse(df, ["a", "b"], cursor=cursor, limit=size).fetch()
        assert got
        seen += [tuple(r) for r in got]
        if cursor is None:
            break
    assert seen == data


def test_offset_pages_are_stable_on_ties(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(11)], "id int, v int").repartition(3)
    seen, cursor = [], None
    while True:
        got, cursor = browse.browse(df, ["id"], sort="v", cursor=cursor, limit=4).fetch()
        seen += [r["id"] for r in got]
        if cursor is None:
            break
    assert seen == [0, 2, 4, 6, 8, 10, 1, 3, 5, 7, 9]


def test_no_extra_page_after_a_full_last_one(people):
    assert browse.browse(people, ["id"], limit=5).fetch()[1] is None


def test_read_query(spark, people):
    people.createOrReplaceTempView("people_t")
    answer = browse.read_query(spark, "WITH x AS (SELECT * FROM people_t) SELECT id, age FROM x ORDER BY id;")
    assert answer.head.columns == ["id", "age"] and tuple(answer.head.collect()[-1]) == (5, None) and answer.total is None
    long = browse.read_query(spark, "SELECT id FROM range(53)")
    assert long.head.count() == 50 and long.total == 53
    assert browse.read_query(spark, "SELECT 1 WHERE false").head.isEmpty()
    with pytest.raises(browse.BadFilter):
        browse.read_query(spark, "  ")


@pytest.mark.parametrize(
    "sql",
    ["DROP VIEW people_t", "CREATE TABLE z AS SELECT 1", "INSERT INTO people_t VALUES (1)", "SELECT 1; SELECT 2", "SET a = b", "SELECT ghost FROM people_t"],
)
def test_read_query_refuses_writes(spark, people, sql):
    people.createOrReplaceTempView("people_t")
    with pytest.raises(browse.BadFilter):
        browse.read_query(spark, sql)
    assert spark.table("people_t").count() == 5


def test_catalogue(spark, rows):
    customers = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, email string")
    orders = spark.createDataFrame([(1, 1, 2.5), (2, 2, 3.5)], "id int, customer_id int, total double")
    rules = catalog.constraints(spark, {"customers": ["id"], "orders": ["id"]}, [("orders", "customer_id", "customers", "id")], {"customers": ["name"]})
    tables = {"orders": orders, "customers": customers}
    assert [tuple(r) for r in catalog.table_list(tables).collect()] == [("customers", 2, 3), ("orders", 2, 3)]
    detail = {(r["table"], r["column"]): r for r in catalog.schema_view(spark, tables, rules).collect()}
    assert (detail[("customers", "name")]["nullable"], detail[("customers", "email")]["nullable"]) == (False, True)
    fk = detail[("orders", "customer_id")]
    assert (fk["ref_table"], fk["ref_column"], fk["is_pk"], fk["type"], fk["row_count"], fk["editable"]) == ("customers", "id", False, "integer", 2, False)
    assert rows(catalog.fk_edges(rules)) == [("orders", "customer_id", "customers", "id")]
    assert catalog.load_order(tables, rules) == ["customers", "orders"]


def test_upsert_rules(spark, rows):
    stored = spark.createDataFrame([(1, "a", 1, None), (2, "b", None, "old"), (3, "c", 3, "old")], "k int, v string, first int, note string")
    sent = spark.createDataFrame([(1, None, 9, "n"), (2, "B", 9, None), (4, "d", 4, "n")], "k int, v string, first int, note string")
    plain = catalog.upsert(stored, sent, ["k"], keep_first=["first"])
    assert rows(plain) == [(1, None, 1, "n"), (2, "B", 9, None), (3, "c", 3, "old"), (4, "d", 4, "n")]
    partial = catalog.upsert(stored, sent, ["k"], partial=True)
    assert rows(partial, "k", "v", "note") == [(1, "a", "n"), (2, "B", "old"), (3, "c", "old"), (4, "d", "n")]
    guarded = catalog.upsert(stored, sent, ["k"], guard="old_note IS NULL")
    assert rows(guarded, "k", "v", "note") == [(1, None, "n"), (2, "b", "old"), (3, "c", "old"), (4, "d", "n")]


def test_proposal_from_data(spark):
    customers = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, name string, email string")
    orders = spark.createDataFrame([(1, 1, 2**40), (2, 1, 5)], "id long, customer_id long, ref long")
    p = {(r["table"], r["column"]): r for r in proposal.propose({"customers": customers, "orders": orders}).collect()}
    assert p[("customers", "id")]["is_pk"] and not p[("customers", "name")]["is_pk"]
    assert (p[("orders", "ref")]["type"], p[("orders", "id")]["type"]) == ("bigint", "integer")
    assert p[("customers", "email")]["nullable"]
    assert (p[("orders", "customer_id")]["ref_table"], p[("orders", "customer_id")]["ref_column"]) == ("customers", "id")


def test_validation_messages(spark):
    good = spark.createDataFrame([(1, None), (2, None)], "id int, e string")
    empty = good.limit(0)
    v = validate.validate_load(spark, {"good": good}, ["good"], 2).first()
    assert (v["ok"], v["total_rows"], v["errors"]) == (True, 2, [])
    assert v["warnings"] == ["Table 'good' has no value at all in e"]
    v = validate.validate_load(spark, {"good": good}, ["ghost", "good"], 3).first()
    assert not v["ok"] and "ghost" in v["errors"][0] and len(v["warnings"]) == 2
    v = validate.validate_load(spark, {"good": good}, ["good"], 1, rows_before=1).first()
    assert len(v["warnings"]) == 1
    v = validate.validate_load(spark, {"empty": empty}, ["empty"]).first()
    assert (v["ok"], v["errors"], v["warnings"]) == (False, ["The load has no rows."], [])
    v = validate.validate_load(spark, {}, ["ghost"]).first()
    assert (v["ok"], len(v["errors"])) == (False, 2)


def test_orphans_and_keys(spark, rows):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9), (4, 9), (5, 8)], "id int, p int")
    assert rows(validate.orphans(child, "p", parent, "id"), "id") == [(3,), (4,), (5,)]
    report = validate.orphan_report({"c": child, "p": parent}, [("c", "p", "p", "id")], examples=1).first()
    assert tuple(report) == ("c", "p", 3, 2, "8")
    twice = child.select("p")
    assert rows(validate.key_violations(twice, ["p"])) == [(9, 2, "duplicate key"), (None, 1, "null key")]


# -- versions ------------------------------------------------------------------------------------


@pytest.fixture
def store(spark):
    return VersionStore(spark, scratch_dir(spark, "store"))


def _marker(store, version=None):
    return [r["v"] for r in store.read("marker", version).orderBy("v").collect()]


def test_snapshot_is_isolated_and_restorable(spark, store):
    one, two = (spark.createDataFrame([(v,)], "v string") for v in ("one", "two"))
    store.load({"marker": one})
    kept = store.snapshot()
    store.load({"marker": two, "extra": one})
    assert _marker(store) == ["two"] and _marker(store, kept) == ["one"]
    assert store.sizes().first()["size_bytes"] > 0
    store.restore(kept)
    assert _marker(store) == ["one"] and store.tables() == ["marker"]
    with pytest.raises(Conflict):
        store.restore(kept)
    gone = store.snapshot()
    store.drop_snapshot(gone)
    store.drop_snapshot(gone)
    assert not store.has_snapshot(gone)
    assert store.unreferenced().count() == 2


def test_several_tables_change_at_once_or_not_at_all(spark, store):
    good = spark.createDataFrame([(1,)], "a int")
    bad = good.select(F.raise_error(F.lit("boom")).cast("int").alias("a"))
    store.load({"t": good})
    with pytest.raises(Exception, match="boom"):
        store.load({"t": good.union(good), "u": bad})
    assert store.tables() == ["t"] and store.read("t").count() == 1


def test_append_adds_a_part(spark, store, rows):
    store.load({"t": spark.createDataFrame([(1, "a")], "id int, name string")})
    store.append("t", spark.createDataFrame([(2,)], "id int"))
    store.append("t", spark.createDataFrame([("c", 3)], "name string, id int"))
    assert rows(store.read("t")) == [(1, "a"), (2, None), (3, "c")]
    for schema in ("id string", "id int, other int"):
        with pytest.raises(Conflict):
            store.append("t", spark.createDataFrame([], schema))


def test_drop_all(spark, store):
    store.load({"t": spark.range(3)})
    store.drop_all()
    assert store.tables() == []
    with pytest.raises(Conflict):
        store.read("t")


# -- changes -------------------------------------------------------------------------------------


@pytest.fixture
def book(spark, store):
    store.load({"people": spark.createDataFrame([(1, "A@X.org"), (2, "b@x.org"), (3, "C@X.org"), (4, None)], "id int, email string")})
    return changes.ChangeBook(store)


LOWER = changes.Change("people", "update", "email <> lower(email)", {"email": "lower(email)"})


def _emails(store):
    return [r["email"] for r in store.read("people").orderBy("id").collect()]


def test_change_life_cycle(store, book):
    change_id = book.propose(LOWER)
    state = book.current().first()
    assert (state["status"], state["affected_rows"], state["total_rows"]) == ("proposing", 2, 4)
    assert _emails(store)[0] == "A@X.org"
    assert book.apply(change_id) == 2
    assert _emails(store) == ["a@x.org", "b@x.org", "c@x.org", None]
    with pytest.raises(Conflict):
        book.apply(change_id)
    book.undo(change_id)
    assert _emails(store) == ["A@X.org", "b@x.org", "C@X.org", None]
    assert book.current().first()["status"] == "reverted"


def test_rejected_change_stays_rejected(store, book):
    change_id = book.propose(LOWER)
    book.reject(change_id)
    with pytest.raises(Conflict):
        book.apply(change_id)
    assert _emails(store)[0] == "A@X.org"


def test_only_the_newest_change_can_be_undone(store, book):
    first = book.propose(LOWER)
    book.apply(first)
    second = book.propose(changes.Change("people", "delete", "email LIKE 'b%'"))
    assert book.apply(second) == 1
    with pytest.raises(Conflict):
        book.undo(first)
    book.undo(second)
    assert _emails(store) == ["a@x.org", "b@x.org", "c@x.org", None]


def test_failing_change_leaves_the_data(store, book):
    change_id = book.propose(changes.Change("people", "add_column", values={"n": "cast(email as int)"}))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        book.apply(change_id)
    assert book.current().first()["status"] == "failed"
    assert store.read("people").columns == ["id", "email"]


def test_counts_and_previews(spark, rows):
    df = spark.createDataFrame([(1, "A", 1), (2, "b", 2), (3, None, 3)], "id int, s string, n int")
    up = changes.Change("t", "update", "n >= 1", {"s": "lower(s)"})
    assert tuple(up.dry_run(df).first()) == (3, 3)
    assert rows(changes.preview(df, up, ["id"]), "id", "column", "before", "after") == [(1, "s", "A", "a")]
    more = spark.createDataFrame([(3, "z"), (9, "y")], "id int, s string")
    assert tuple(changes.Change("t", "merge", rows=more, keys=["id"]).dry_run(df).first()) == (2, 3)
    assert tuple(changes.Change("t", "drop_column", values={"n": ""}).dry_run(df, 7).first()) == (7, 3)
    merged = changes.Change("t", "merge", rows=more, keys=["id"]).apply(df)
    assert rows(merged) == [(1, "A", 1), (2, "b", 2), (3, "z", 3), (9, "y", None)]
    assert rows(changes.row_diff(df, merged, ["id"])) == [(3, "update"), (9, "insert")]
    assert rows(changes.cell_diff(df, merged, ["id"])) == [(3, "s", None, "z")]


# -- import --------------------------------------------------------------------------------------


def test_import_flow(spark, store):
    raw = spark.createDataFrame([("1", " a ", "N/A"), ("2", "", "x")], ["Id", "Full Name", "Note"])
    done = importer.run_import(store, {"Person List": raw}).first()
    assert (done["rows_imported"], done["tables"]) == (2, ["person_lists"])
    assert [tuple(r) for r in store.read("person_lists").orderBy("id").collect()] == [("1", "a", None), ("2", None, "x")]
    again = importer.run_import(store, {"Person List": raw}, options=ImportOptions(append=True)).first()
    assert again["rows_imported"] == 2 and store.read("person_lists").count() == 4
    with pytest.raises(Conflict):
        importer.run_import(store, {"Person List": raw.withColumn("More", F.lit(1))}, options=ImportOptions(append=True))


def test_bad_import_changes_nothing(spark, store):
    parent = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(1, 1), (2, 5)], "id int, p int")
    with pytest.raises(ValidationFailed, match="orphans"):
        importer.run_import(store, {}, lambda _: {"p": parent, "c": child}, foreign=[("c", "p", "p", "id")])
    with pytest.raises(ValidationFailed, match="no rows"):
        importer.run_import(store, {}, lambda _: {"p": parent.limit(0)})
    assert store.version() == 0


def test_import_can_be_undone(spark, store):
    importer.run_import(store, {}, lambda _: {"t": spark.range(2)})
    importer.run_import(store, {}, lambda _: {"t": spark.range(5)})
    kept = max(r["version"] for r in store.snapshots().collect())
    store.restore(kept)
    assert store.read("t").count() == 2
