import pytest
from catalogs import catalog
from pyspark.sql import functions as F

from tablecheck.model import ForeignKey, TableRef
from tablecheck.operators import purge
from tablecheck.sources.store import TableStore


def edges(spark, *pairs):
    return spark.createDataFrame([(("public", p), ("public", c)) for p, c in pairs], purge.EDGE_DDL)


def ordered(df):
    return [r.table.name for r in purge.deletion_order(df).collect()]


def test_children_come_first(spark):
    graph = edges(
        spark, ("ship", "deck"), ("ship", "log"), ("deck", "cabin"), ("fleet", "ship"), ("ship", "cabin"), ("port", "cabin"),
    )
    order = ordered(purge.closure(graph, TableRef("public", "ship")))
    assert sorted(order) == ["cabin", "deck", "log", "ship"]
    assert order.index("cabin") < order.index("deck") < order.index("ship") == 3
    assert order.index("log") < 3
    assert ordered(purge.closure(graph, TableRef("public", "lone"))) == ["lone"]


def test_cycles_are_named(spark):
    graph = edges(spark, ("hen", "egg"), ("egg", "hen"))
    with pytest.raises(ValueError, match=r"public\.egg -> public\.hen -> public\.egg"):
        purge.closure(graph, TableRef("public", "hen"))
    graph = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"))
    with pytest.raises(ValueError, match=r"public\.b -> public\.c -> public\.d -> public\.b"):
        purge.closure(graph, TableRef("public", "a"))


def test_edges_of_a_catalog(spark, rows):
    def fk(table, parent, name="fk", schema=None):
        return {"table_name": table, "constraint_name": name, "constraint_type": "f", "referenced_table": parent, "referenced_schema": schema}

    c = catalog(spark, constraints=[fk("a", "b"), fk("a", "b", "again"), fk("b", "b"), fk("b", "c", schema="other"),
                                    {"table_name": "a", "constraint_name": "p", "constraint_type": "p"}])
    got = {(tuple(r.parent), tuple(r.child)) for r in purge.fk_edges(c).collect()}
    assert got == {(("public", "b"), ("public", "a")), (("other", "c"), ("public", "b"))}


FKS = (
    ForeignKey("i_o", "items", ("order_id",), "orders", ("id",)),
    ForeignKey("n_i", "notes", ("item_id",), "items", ("id",)),
    ForeignKey("n_o", "notes", ("order_id",), "orders", ("id",)),
)


@pytest.fixture
def store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"))
    s.publish({
        "orders": spark.range(2),
        "items": spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "id INT, order_id INT"),
        "notes": spark.createDataFrame([(1, 1, 1), (2, 3, 1), (3, None, 0), (4, None, None)], "id INT, item_id INT, order_id INT"),
        "apart": spark.range(5),
    })
    return s


@pytest.fixture
def plan(spark, store):
    return purge.store_plan(store, purge.rule_edges(spark, FKS), "orders")


def test_plan(spark, plan):
    assert [t.name for t in plan.order] == ["notes", "items", "orders"]
    assert plan.total_rows == 10
    assert [(r.ord, r.name, r.row_count) for r in plan.to_df(spark).collect()] == [(1, "notes", 4), (2, "items", 4), (3, "orders", 2)]


def test_purge_empties_the_closure(store, plan):
    deleted = purge.cascade_purge(store, plan, FKS)
    assert {t.name: n for t, n in deleted.items()} == {"notes": 4, "items": 4, "orders": 2}
    assert {t: df.count() for t, df in store.read_all().items()} == {"apart": 5, "items": 0, "notes": 0, "orders": 0}
    assert store.read("items").columns == ["id", "order_id"]


def test_purge_of_some_rows(store, plan):
    deleted = purge.cascade_purge(store, plan, FKS, where=F.col("id") == 0)
    assert {t.name: n for t, n in deleted.items()} == {"notes": 2, "items": 2, "orders": 1}
    assert sorted(r.id for r in store.read("notes").collect()) == [2, 4]


def test_drop(store, plan):
    assert [t.name for t in purge.cascade_drop(store, plan)] == ["notes", "items", "orders"]
    assert store.tables() == ["apart"]


def test_plan_of_another_side(store, plan):
    with pytest.raises(ValueError, match="another side"):
        purge.cascade_purge(store, plan, FKS, side="source")
    with pytest.raises(ValueError, match="another side"):
        purge.cascade_drop(store, plan, side="source")
    assert store.read("orders").count() == 2


def test_a_publish_in_between_stops_a_purge(spark, store, plan):
    store.publish({"items": spark.createDataFrame([(9, 1)], "id INT, order_id INT")})
    for action in (lambda: purge.cascade_purge(store, plan, FKS), lambda: purge.cascade_drop(store, plan)):
        with pytest.raises(RuntimeError, match="Another publish"):
            action()
    assert store.read("orders").count() == 2 and [r.id for r in store.read("items").collect()] == [9]
    unversioned = purge.purge_plan(store.read_all(), purge.rule_edges(spark, FKS), "orders")
    with pytest.raises(ValueError, match="which version"):
        purge.cascade_drop(store, unversioned)
    assert {t.name: n for t, n in purge.cascade_purge(store, unversioned, FKS).items()} == {"notes": 4, "items": 1, "orders": 2}


def test_a_publish_while_a_purge_runs_stops_it(spark, store, plan, monkeypatch):
    staged = store.stage

    def late(table, df):
        monkeypatch.setattr(store, "stage", staged)
        store.publish({"apart": spark.range(7)})
        return staged(table, df)

    monkeypatch.setattr(store, "stage", late)
    with pytest.raises(RuntimeError, match="Another publish"):
        purge.cascade_purge(store, plan, FKS, where=F.col("id") == 0)
    assert {t: df.count() for t, df in store.read_all().items()} == {"apart": 7, "items": 4, "notes": 4, "orders": 2}


def below(rows, first, links):
    """Ids lost: ``rows`` are (id, other id per link), ``links`` say which place refers to which."""
    lost = {r for r in rows if first(r)}
    while True:
        more = {r for r in rows if r not in lost and any(r[c] is not None and any(x[p] == r[c] for x in lost) for c, p in links)}
        if not more:
            return sorted(r[0] for r in lost)
        lost |= more


@pytest.mark.parametrize("shape", ["chain", "tree", "loop", "two links"])
def test_purge_of_a_table_that_refers_to_itself(spark, shape):
    n = 12
    boss = {"chain": lambda i: i - 1 if i else None, "tree": lambda i: (i - 1) // 2 if i else None, "loop": lambda i: (i + 1) % 5 if i < 5 else i - 1,
            "two links": lambda i: i - 3 if i >= 3 else None}[shape]
    rows = [(i, boss(i), f"k{i}", f"k{i - 5}" if shape == "two links" and i >= 5 else None) for i in range(n)] + [(50, None, None, None)]
    staff = spark.createDataFrame(rows, "id INT, boss INT, code STRING, mate STRING")
    keys = (ForeignKey("b", "staff", ("boss",), "staff", ("id",)), ForeignKey("m", "staff", ("mate",), "staff", ("code",)), ForeignKey("w", "work", ("who",), "staff", ("id",)))
    work = spark.range(n).selectExpr("id AS who")
    for start in (0, 2, 11):
        flagged = purge.doomed_rows({"staff": staff, "work": work}, keys, ["staff", "work"], F.col("id") == start)
        expected = below(rows, lambda r: r[0] == start, [(1, 0), (3, 2)])
        assert sorted(r.id for r in flagged["staff"].filter("doomed").collect()) == expected
        assert sorted(r.who for r in flagged["work"].filter("doomed").collect()) == expected


def test_components_are_all_found(spark):
    from tablecheck.operators import graph

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "y"), ("q", "a"),
             ("s", "s"), ("l1", "l2"), ("l2", "l3")]
    found = graph.components(edges(spark, *pairs)).collect()
    assert sorted((r.component.name, r.table.name) for r in found) == [
        ("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e"), ("x", "x"), ("x", "y"), ("x", "z")]
    assert graph.components(edges(spark, ("a", "b"), ("b", "c"))).collect() == []


def test_edges_of_servers_with_equal_names(spark):
    usage = spark.createDataFrame([("m1", "s", "child", "s", "parent"), ("m1", "s", "child", "s", "parent"), ("m2", "s", "other", "s", "parent"),
                                   ("m1", "s", "own", "s", "own"), ("m1", "s", "plain", None, None)],
                                  "env STRING, TABLE_SCHEMA STRING, TABLE_NAME STRING, REFERENCED_TABLE_SCHEMA STRING, REFERENCED_TABLE_NAME STRING")
    every = purge.key_usage_edges(usage)
    assert sorted((r.env, r.parent.name, r.child.name) for r in every.collect()) == [("m1", "parent", "child"), ("m2", "parent", "other")]
    assert [r.child.name for r in purge.key_usage_edges(usage, "m2").collect()] == ["other"]
    with pytest.raises(ValueError, match="one environment"):
        purge.closure(every, TableRef("s", "parent"))
    keys = spark.createDataFrame([("s", 2, 1)], "env STRING, parent_object_id INT, referenced_object_id INT")
    tables = spark.createDataFrame([("s", 1, 7, "parent"), ("s", 2, 8, "child")], "env STRING, object_id INT, schema_id INT, name STRING")
    schemas = spark.createDataFrame([("s", 7, "dbo"), ("s", 8, "web")], "env STRING, schema_id INT, name STRING")
    assert [(tuple(r.parent), tuple(r.child)) for r in purge.object_edges(keys, tables, schemas, "s").collect()] == [(("dbo", "parent"), ("web", "child"))]
