import pytest
from catalogs import catalog

from tablecheck import testkit
from tablecheck.model import ForeignKey, Key, Required, RuleSet
from tablecheck.operators import integrity
from tablecheck.sources.catalog import catalog_from_dataframes

FK = ForeignKey("c_p", "c", ("k1", "k2"), "p", ("k1", "k2"), ("k1", "k2"), ("k1", "k2"))
RULES = RuleSet(
    (Required("c", "id"), Required("c", "note", text=True), Required("absent", "x"), Required("c", "absent")),
    (Key("c_pk", "c", ("id",)), Key("c_k", "c", ("k1", "k2"), "u"), Key("no", "c", ("absent",))),
    (FK, ForeignKey("c_audit", "c", ("changed_by",), "u", ("id",), ("changed_by",), ())),
)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "p": spark.createDataFrame([(1, "a"), (2, "b"), (None, "z")], "k1 INT, k2 STRING"),
        "u": spark.createDataFrame([(1,)], "id INT"),
        "c": spark.createDataFrame(
            [
                (1, 1, "a", 1, "x"), (1, 1, "a", 9, "  "), (None, 2, "q", None, "\t"), (None, None, "z", 1, None),
                (None, 2, "q", 9, ""), (7, None, None, None, "x"), (8, 2, "b", 1, "x"),
            ],
            "id INT, k1 INT, k2 STRING, changed_by INT, note STRING",
        ),
    }


def found(df):
    return {(r.type, r.rule_name): (r.impact, r["count"]) for r in df.collect()}


def test_all_checks(tables):
    assert found(integrity.check(tables, RULES, audit=("changed_by",))) == {
        ("REQUIRED_NULL_VALUES", "id"): ("CRITICAL", 3),
        ("REQUIRED_NULL_VALUES", "note"): ("CRITICAL", 1),
        ("REQUIRED_EMPTY_TEXT", "note"): ("MEDIUM", 2),
        ("FK_NULL_RELATION", "c_p"): ("HIGH", 2),
        ("FK_NULL_RELATION", "c_audit"): ("LOW", 2),
        ("FK_ORPHAN_ROWS", "c_p"): ("CRITICAL", 2),
        ("FK_ORPHAN_ROWS", "c_audit"): ("LOW", 2),
        # NULL is a group of its own for a primary key and is ignored by UNIQUE.
        ("DUPLICATE_KEY_VALUES", "c_pk"): ("CRITICAL", 3),
        ("DUPLICATE_KEY_VALUES", "c_k"): ("CRITICAL", 2),
    }


def test_zero_counts_on_request(tables):
    rules = RuleSet(keys=(Key("p_pk", "p", ("k1",)),))
    assert integrity.check(tables, rules).isEmpty()
    assert found(integrity.check(tables, rules, include_zero=True)) == {("DUPLICATE_KEY_VALUES", "p_pk"): ("CRITICAL", 0)}


def test_statements(tables):
    texts = {(r.type, r.rule_name): (r.review_sql, r.fix_sql) for r in integrity.check(tables, RULES, schema="s", audit=("changed_by",)).collect()}
    review, fix = texts["FK_ORPHAN_ROWS", "c_p"]
    assert review == (
        'SELECT c.* FROM "s"."c" c WHERE c."k1" IS NOT NULL AND c."k2" IS NOT NULL AND NOT EXISTS '
        '(SELECT 1 FROM "s"."p" p WHERE p."k1" = c."k1" AND p."k2" = c."k2") LIMIT 50;'
    )
    assert fix.startswith('UPDATE "s"."c" c\nSET "k1" = NULL, "k2" = NULL\nWHERE')
    assert texts["FK_ORPHAN_ROWS", "c_audit"][1].startswith("-- No automatic fix")
    assert 'WHERE "k1" IS NOT NULL AND "k2" IS NOT NULL GROUP BY' in texts["DUPLICATE_KEY_VALUES", "c_k"][0]


def test_samples(tables, rows):
    c, p = tables["c"], tables["p"]
    assert len(rows(integrity.review_nulls(c, ["k1", "k2"]))) == 2
    assert len(rows(integrity.review_blanks(c, "note"))) == 2
    assert [r[1:3] for r in rows(integrity.review_orphans(c, p, FK))] == [(2, "q"), (2, "q")]
    assert rows(integrity.review_orphans(c, p, FK, limit=1))[0][3] is None
    groups = integrity.review_duplicates(c, Key("c_k", "c", ("k1", "k2"), "u")).collect()
    assert [tuple(r) for r in groups] == [(1, "a", 2), (2, "q", 2)]


def test_repair_then_check_again(tables):
    fixed = integrity.repair_orphans(tables["c"], tables["p"], FK)
    assert fixed.filter("repaired").count() == 2
    again = integrity.check({**tables, "c": fixed.drop("repaired")}, RuleSet(foreign_keys=(FK,)), kinds=("FK_ORPHAN_ROWS",))
    assert again.isEmpty()
    partly = ForeignKey("c_p", "c", ("k1", "k2"), "p", ("k1", "k2"), (), ("k1",))
    kept = integrity.repair_orphans(tables["c"], tables["p"], partly)
    assert kept.filter("repaired").isEmpty() and kept.drop("repaired").exceptAll(tables["c"]).isEmpty()


def test_missing_parent_skips_the_rule(tables):
    only = {"c": tables["c"]}
    assert integrity.check(only, RuleSet(foreign_keys=(FK,)), include_zero=True, kinds=("FK_ORPHAN_ROWS", "FK_NULL_RELATION")).count() == 1


def test_rules_from_catalogs(spark):
    source = catalog(
        spark, tables=[{"table_name": "a"}, {"table_name": "b"}],
        columns=[
            {"table_name": "a", "column_name": "id", "is_nullable": "NO"},
            {"table_name": "a", "column_name": "name", "is_nullable": "NO", "data_type": "text"},
            {"table_name": "a", "column_name": "b_id"},
            {"table_name": "b", "column_name": "id", "is_nullable": "NO"},
        ],
        constraints=[
            {"constraint_name": "fk", "table_name": "a", "constraint_type": "f", "columns": ["b_id"], "referenced_table": "b",
             "referenced_columns": ["id"]},
            {"constraint_name": "pk", "table_name": "b", "constraint_type": "p", "columns": ["id"]},
            {"constraint_name": "uk", "table_name": "a", "constraint_type": "u", "columns": ["gone"]},
        ],
    )
    target = catalog(
        spark, tables=[{"table_name": "a"}],
        columns=[
            {"table_name": "a", "column_name": "id"}, {"table_name": "a", "column_name": "b_id", "is_nullable": "NO"},
            {"table_name": "a", "column_name": "name"},
        ],
    )
    rules = integrity.rules_from_catalogs(source, target)
    assert rules.required == (Required("a", "id", False), Required("a", "name", True))
    assert rules.keys == ()
    assert rules.foreign_keys == (ForeignKey("fk", "a", ("b_id",), "b", ("id",), ("b_id",), ()),)
    flags = {r.rule_name: (r.applicable, r.parent_applicable) for r in integrity.catalog_rules(source, target).collect() if r.kind == "f"}
    assert flags == {"fk": (True, False)}


def test_lake_catalog_gives_back_its_rules(spark):
    tables = testkit.load(spark, "/root/testdata/sf0.001")
    rules = testkit.rules()
    made = catalog_from_dataframes(spark, tables, rules)
    read = integrity.rules_from_catalogs(made, made)
    assert {(r.table, r.column) for r in read.required} == {(r.table, r.column) for r in rules.required}
    assert {(k.name, k.columns, k.kind) for k in read.keys} == {(k.name, k.columns, k.kind) for k in rules.keys}
    # A column no rule requires is nullable.
    required = {(r.table, r.column) for r in rules.required}
    assert {(f.name, f.parent, f.source_nullable) for f in read.foreign_keys} == {
        (f.name, f.parent, tuple(c for c in f.columns if (f.table, c) not in required)) for f in rules.foreign_keys
    }


def test_no_rules_give_no_findings(spark):
    for tables in ({}, {"t": spark.range(2)}):
        found = integrity.check(tables, RuleSet())
        assert found.collect() == [] and found.columns == integrity.check({"t": spark.range(2)}, RuleSet(required=(Required("t", "id"),))).columns


def test_bitmaps_find_the_orphans_that_joins_find(spark):
    import random

    from tablecheck.operators import keybits

    draw = random.Random(4)
    pool = [0, -1, 1, 63, 64, -64, -65, 2**63 - 1, -(2**63), *[draw.randint(-500, 500) for _ in range(200)], *[draw.randint(-(2**60), 2**60) for _ in range(50)]]
    child = spark.createDataFrame([(draw.choice([None, *pool]), draw.choice([None, *range(-40, 40)])) for _ in range(3000)], "k long, m int")
    parent = spark.createDataFrame([(p, draw.choice([None, *range(-30, 30)])) for p in [None, *pool[::2]]], "k long, m int")
    fks = [ForeignKey("a", "child", ("k",), "parent", ("k",)), ForeignKey("b", "child", ("m",), "parent", ("m",)), ForeignKey("c", "parent", ("m",), "parent", ("k",))]
    tables = {"child": child, "parent": parent}
    expected = {f.name: integrity.orphan_count(tables[f.table], tables[f.parent], f).first().n for f in fks}
    found = integrity.check(tables, RuleSet(foreign_keys=tuple(fks)), include_zero=True, kinds=("FK_ORPHAN_ROWS",), bitmaps=True)
    assert {r.rule_name: r["count"] for r in found.collect()} == expected
    keys = keybits.orphan_keys(keybits.orphan_words(tables, {0: fks[0]})).collect()
    assert sorted(r.key for r in keys) == sorted(r.k for r in integrity.parent_lookup(child, fks[0], parent).collect())
    # Beyond the broadcast threshold rows are counted per key first; nothing lost, nothing found twice.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = {r.rule_id: r.n for r in keybits.orphan_counts(tables, dict(enumerate(fks))).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [counted.get(i, 0) for i in range(3)] == [expected[f.name] for f in fks]
    assert not keybits.fits(ForeignKey("d", "child", ("k", "m"), "parent", ("k", "m")), child, parent)


def test_all_keys_of_a_table_are_counted_in_one_scan(spark):
    rows = [(1, "a", None), (1, "a", 2), (None, "a", 2), (None, None, None), (3, None, None), (3, "b", 2)]
    df = spark.createDataFrame(rows, "i int, s string, n int")
    keys = (Key("p1", "t", ("i",)), Key("u1", "t", ("i",), "u"), Key("p2", "t", ("s", "n")), Key("u2", "t", ("n", "s"), "u"), Key("u3", "t", ("s",), "u"))
    found = integrity.check({"t": df}, RuleSet(keys=keys), include_zero=True)
    assert {r.rule_name: r["count"] for r in found.collect()} == {k.name: integrity.duplicate_count(df, k).first().n for k in keys}
    counted = integrity.duplicate_counts(df, dict(enumerate(keys)))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") == 1


def test_samples_of_every_rule(spark):
    parent = spark.createDataFrame([(k,) for k in range(5)], "k int")
    child = spark.createDataFrame([(None if i % 4 == 0 else i % 9, " " if i % 5 == 0 else f"s{i:03}", 1.5) for i in range(400)] * 2, "k int, s string, d double")
    rules = RuleSet(
        (Required("child", "k"), Required("child", "s", True)), (Key("child_s", "child", ("s",), "u"), Key("child_k", "child", ("k",))),
        (ForeignKey("child_k_fk", "child", ("k",), "parent", ("k",), ("k",)),),
    )
    found = integrity.samples({"child": child, "parent": parent}, rules, limit=7)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault((r.type, r.rule_name), []).append(r)
    assert {k: [r.place for r in v] for k, v in got.items()} == dict.fromkeys([
        ("REQUIRED_NULL_VALUES", "k"), ("REQUIRED_EMPTY_TEXT", "s"), ("FK_NULL_RELATION", "child_k_fk"), ("FK_ORPHAN_ROWS", "child_k_fk"),
        ("DUPLICATE_KEY_VALUES", "child_s"), ("DUPLICATE_KEY_VALUES", "child_k")], [*range(1, 8)])
    text = lambda r: [None if v is None else str(v) for v in r]
    orphans = integrity.review_orphans(child, parent, rules.foreign_keys[0], 7).collect()
    assert [r.sample for r in got["FK_ORPHAN_ROWS", "child_k_fk"]] == [text(r) for r in orphans]
    most = integrity.review_duplicates(child, rules.keys[0], 7).collect()
    assert [r.sample for r in got["DUPLICATE_KEY_VALUES", "child_s"]] == [text(r) for r in most]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
