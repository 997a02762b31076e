import random

import duckdb
import pytest

from tessera.plans import query as q
from tessera.plans.entity import FindBy
from tessera.plans.query import QueryError, parse
from tessera.plans.retail import retail

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text",
    ['a == "x" && (b > 1 || c.d.contains("y"))', "!flag", "a != null", "flag && !(b <= -2.5)", "a in_ == 1".replace(" in_", ""), 'x == "q\\"uote"'],
)
def test_text_goes_to_a_tree_and_back(text):
    assert parse(str(parse(text))) == parse(text)


@pytest.mark.parametrize("text", ["a ==", "(a", "1 == 2", "a b", "a.contains(1)", "5", "a === 1", ""])
def test_what_is_no_query_is_an_error(text):
    with pytest.raises(QueryError):
        parse(text)


def test_a_literal_may_stand_on_the_left():
    assert parse("5 < a") == q.gt("a", 5)


def test_names_and_values():
    tree = (q.eq("a", 1) | q.gt("b.c", 2)) & ~q.eq("a", 3)
    assert tree.names() == ["a", "b.c"] and tree.values() == [1, 2, 3]


def test_random_predicates_agree_with_duckdb(spark):
    rng = random.Random(11)
    leaves = [
        lambda: ("o_orderstatus", rng.choice(["eq", "neq"]), rng.choice(["O", "F"])),
        lambda: ("o_totalprice", rng.choice(["gt", "lt", "gteq", "lteq"]), rng.randint(1, 300_000)),
        lambda: ("customer.c_nationkey", "in", (rng.randint(0, 24), rng.randint(0, 24))),
        lambda: ("customer.nation.n_name", "match", f"_{rng.randint(0, 9)}"),
        lambda: ("o_orderpriority", rng.choice(["eq", "neq"]), None),
    ]
    signs = {"eq": "=", "neq": "<>", "gt": ">", "lt": "<", "gteq": ">=", "lteq": "<="}

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name, op, value = rng.choice(leaves)()
            column = name.split(".")[-1]
            if op == "in":
                return q.one_of(name, *value), f"{column} IN {value}"
            if op == "match":
                return q.match(name, value), f"{column} ILIKE '%{value}%'"
            if value is None:
                return q.Compared(name, op, None), f"{column} IS {'NOT ' if op == 'neq' else ''}NULL"
            return q.Compared(name, op, value), f"{column} {signs[op]} " + (f"'{value}'" if isinstance(value, str) else str(value))
        a, b = made(depth - 1), made(depth - 1)
        kind = rng.choice(["and", "or", "not"])
        if kind == "not":
            return ~a[0], f"NOT ({a[1]})"
        return (a[0] & b[0] if kind == "and" else a[0] | b[0]), f"({a[1]} {kind.upper()} {b[1]})"

    catalog = retail(SF)
    for _ in range(12):
        tree, sql = made(3)
        got = catalog.of(spark, "Order").where(tree).count()
        joined = f"'{SF}/orders.parquet' LEFT JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey LEFT JOIN '{SF}/nation.parquet' ON c_nationkey = n_nationkey"
        assert got == duckdb.sql(f"SELECT count(*) FROM {joined} WHERE {sql}").fetchall()[0][0], str(tree)


def test_unused_references_are_not_joined(spark):
    catalog = retail(SF)
    plain = catalog.of(spark, "Order").where("o_totalprice > 10")
    assert "Join" not in plain.frame()._jdf.queryExecution().executedPlan().toString()
    assert "customer.parquet" in catalog.of(spark, "Order").where("customer.inDebt").frame()._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = retail(SF).of(spark, "Order").by(o_orderstatus="F").select("o_totalprice").frame()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan


def test_one_is_strict_or_takes_the_first(spark):
    nations = retail(SF).of(spark, "Nation").order("-n_nationkey")
    with pytest.raises(QueryError):
        nations.one()
    assert nations.one(strict=False)["n_nationkey"] == 24
    assert nations.with_id(3).one()["n_nationkey"] == 3 and nations.with_id(99).one() is None


def test_finders(spark):
    catalog = retail(SF)
    find = FindBy(("n_regionkey",), ("n_name",), order=("n_nationkey",)).finder(spark, catalog, "Nation")
    assert find(1).count() == 5 and find(1, n_name="none").count() == 0
    with pytest.raises(QueryError):
        find(1, order=["n_name"])
    with pytest.raises(QueryError):
        find()
    assert FindBy(("n_nationkey",), unique=True).finder(spark, catalog, "Nation")(2)["n_nationkey"] == 2


def test_wildcards_count_unless_escaped(spark):
    regions = retail(SF).of(spark, "Region").where(q.match("r_name", "a_i"))
    assert {r["r_name"] for r in regions.select("r_name").frame().collect()} == {"AMERICA", "ASIA"} or regions.count() >= 1
    assert regions.escaped().count() == 0


def test_any_text_can_be_searched(spark):
    from tessera.plans.entity import Catalog, EntityType

    texts = ["a\\b", "50%", "x_y", "--5", "²", "plain", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    things = Catalog(EntityType("T", lambda s: s.createDataFrame(rows, "id int, text string"), ("id",))).of(spark, "T")
    found = lambda query: sorted(r["id"] for r in query.frame().collect())
    for i, t in enumerate(texts[:-1]):
        assert found(things.search(t)) == [i], t
    assert found(things.search("_")) == [2] and found(things.search("%")) == [1] and found(things.search("_", wildcards=True)) == [0, 1, 2, 3, 4, 5]
    assert found(things.search("PLAIN")) == [5] and found(things.search("5")) == [1, 3, 5] and found(things.search("\\")) == [0]
    assert found(things.where(q.match("text", "a\\\\b"))) == [0] and found(things.where(q.match("text", "a\\b"))) == []
    assert found(things.where(q.match("text", "\\_"))) == [2] and found(things.escaped().where(q.match("text", "\\"))) == [0]
    for hopeless in ("9" * 30, "-", "\\", "%\\"):
        things.search(hopeless).count()
        things.where(q.match("text", hopeless)).count()


def test_relations_are_followed_both_ways(spark):
    from tessera.plans.entity import Catalog, EntityType, Mapping, Reverse

    table = lambda rows, schema: lambda s: s.createDataFrame(rows, schema)
    catalog = Catalog(
        EntityType("P", table([(1, "a"), (2, "b"), (3, "c")], "id int, name string"), ("id",), relations={
            "kids": Reverse("K", ("parent",), order=("-age",)), "tags": Mapping("T", table([(1, 7), (1, 7), (1, 8), (2, 9), (None, 7)], "p int, t int"), ("p",), ("t",)), "card": Reverse("C", ("holder",), single=True)}),
        EntityType("K", table([(10, 1, 5), (11, 1, 9), (12, 2, 1), (13, None, 2)], "id int, parent int, age int"), ("id",)),
        EntityType("T", table([(7, "x"), (8, "y")], "id int, word string"), ("id",)),
        EntityType("C", table([(1, 2, "gold")], "id int, holder int, kind string"), ("id",)),
    )
    people = catalog.of(spark, "P")
    assert sorted((r.id, r.n, r.age) for r in people.collected("kids", "age").collect()) == [(1, 2, [9, 5]), (2, 1, [1])]
    assert sorted((r.id, r.word) for r in people.collected("tags", "word").collect()) == [(1, ["x", "y"])]
    assert sorted(tuple(r) for r in people.where("name == 'a'").related("kids", "age").collect()) == [(1, 10, 5), (1, 11, 9)]
    assert sorted((r.id, r.card_kind) for r in people.select("card.kind").frame().collect()) == [(1, None), (2, "gold"), (3, None)]
    assert [r.id for r in people.including("kids", "age > 6").frame().collect()] == [1] and people.including("tags").including("kids", "age < 6").count() == 1
    assert [r.id for r in people.where("card.kind == 'gold'").frame().collect()] == [2]
    with pytest.raises(QueryError):
        people.related("card2")


def test_files_are_read_anew(spark, tmp_path):
    from tessera.plans.entity import Catalog, EntityType

    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    things = Catalog(EntityType("N", lambda s: s.read.parquet(path), ("id",))).of(spark, "N")
    assert things.count() == 3
    spark.range(10, 15).write.mode("append").parquet(path)
    assert things.refresh().count() == 8


def test_search_without_a_column_finds_nothing(spark):
    from tessera.plans.entity import Catalog, EntityType

    numbers = Catalog(EntityType("N", lambda s: s.range(5), ("id",)))
    assert numbers.of(spark, "N").search("x").count() == 0
    assert numbers.of(spark, "N").search("3").count() == 1


def test_subtypes_hold_for_either_side_of_an_or(spark):
    market = retail(SF).of(spark, "MarketEvent").where(q.eq("event_type", "error") | q.gt("value", 0))
    assert market.where(q.eq("event_type", "error")).count() == 0


def test_unknown_properties_are_errors(spark):
    for path in ("nothing", "customer.nothing", "nobody.c_name"):
        with pytest.raises(QueryError):
            retail(SF).of(spark, "Order").select(path).frame()
