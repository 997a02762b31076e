"""The registered queries of the engine over the retail tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import dml, setops, stats
from tessera.plans import query as q
from tessera.plans.entity import Catalog, FindBy
from tessera.plans.retail import retail, tables
from tessera.sources import files

Build = Callable[..., DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def over_catalog(name: str, sql: str):
    """Registers a query that is built from (spark, catalog)."""

    def take(build: Build) -> Build:
        QUERIES[name] = lambda spark, sf_dir: build(spark, retail(sf_dir))
        SQL[name] = sql
        return build

    return take


def over_tables(name: str, sql: str | None, *names: str):
    """Registers a query that is built from the named tables' frames."""

    def take(build: Build) -> Build:
        QUERIES[name] = lambda spark, sf_dir: build(*tables(spark, sf_dir, *names))
        if sql:
            SQL[name] = sql
        return build

    return take


# Scans and finders


@over_catalog("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark: SparkSession, c: Catalog) -> DataFrame:
    return c.of(spark, "Order").select("o_custkey", "o_totalprice").frame()


@over_catalog("find_by_id", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(spark, c):
    return c.of(spark, "Order").with_id(7).frame()


@over_catalog("find_by_composite_id", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def _(spark, c):
    return c.of(spark, "Conversation").with_id(3, 1).frame()


@over_catalog("find_by_ids", "SELECT * FROM customer WHERE c_custkey IN (1, 5, 9, 1000000)")
def _(spark, c):
    return c.of(spark, "Customer").with_ids([1, 5, 9, 1_000_000]).frame()


@over_catalog("find_all_paged", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def _(spark, c):
    return c.of(spark, "Customer").select("c_name").order("c_custkey").page(20, 10).frame()


@over_catalog(
    "order_by_multi",
    "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 50",
)
def _(spark, c):
    return c.of(spark, "Customer").select("c_nationkey", "c_acctbal").order("c_nationkey", "-c_acctbal", "c_custkey").page(0, 50).frame()


@over_catalog("find_by_props", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def _(spark, c):
    return c.of(spark, "Customer").by(c_mktsegment="BUILDING", c_nationkey=3).frame()


@over_catalog("match_proto", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(spark, c):
    prototype = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_totalprice": 1.0}
    return c.of(spark, "Order").like(prototype, ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority").frame()


@over_catalog("match_one", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) LIMIT 2")
def _(spark, c):
    name = c.of(spark, "Nation").select("n_name").order("n_name", "n_nationkey").page(0, 1).one()["n_name"]
    return c.of(spark, "Nation").by(n_name=name).page(0, 2).frame()


@over_catalog("find_by_options", "SELECT * FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 5")
def _(spark, c):
    find = FindBy(("c_nationkey",), ("c_mktsegment", "c_name"), order=None, paged=True).finder(spark, c, "Customer")
    return find(5, c_mktsegment="MACHINERY", order=["-c_acctbal", "c_custkey"], most=5).frame()


# Predicates


@over_catalog(
    "query_and_or",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 100000.0) OR (o_orderpriority = '5-LOW' AND NOT (o_totalprice >= 50000.0))",
)
def _(spark, c):
    a = q.eq("o_orderstatus", "O") & q.gt("o_totalprice", 100_000.0)
    b = q.eq("o_orderpriority", "5-LOW") & ~q.gteq("o_totalprice", 50_000.0)
    return c.of(spark, "Order").where(a | b).select("o_totalprice").frame()


@over_catalog("pred_eq", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang = 'en'")
def _(spark, c):
    return c.of(spark, "Document").where(q.eq("quality", None) & q.eq("lang", "en")).select("quality").frame()


@over_catalog("pred_neq", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND quality <> 1")
def _(spark, c):
    return c.of(spark, "Document").where(q.neq("quality", None) & q.neq("quality", 1)).select("quality").frame()


@over_catalog("pred_range", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950.0 AND p_retailprice <= 1200.0")
def _(spark, c):
    tests = q.all_of(q.gteq("p_size", 10), q.lt("p_size", 20), q.gt("p_retailprice", 950.0), q.lteq("p_retailprice", 1200.0))
    return c.of(spark, "Part").where(tests).select("p_size").frame()


@over_catalog("pred_in", "SELECT * FROM nation WHERE n_regionkey IN (1, 3)")
def _(spark, c):
    return c.of(spark, "Nation").where(q.one_of("n_regionkey", 1, 3)).frame()


@over_catalog("pred_match_ilike", "SELECT page_id, url FROM pages WHERE url ILIKE '%EXAMPLE.org%'")
def _(spark, c):
    return c.of(spark, "Page").where(q.match("url", "EXAMPLE.org")).select("url").frame()


@over_catalog("pred_not", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT (o_totalprice < 150000.0)")
def _(spark, c):
    return c.of(spark, "Order").where(~(q.eq("o_orderstatus", "F") | q.eq("o_orderstatus", "P")) & ~q.lt("o_totalprice", 150_000.0)).select("o_orderstatus").frame()


@over_catalog("pred_bool_prop", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 AND NOT (floor(c_acctbal / 1000) = -2)")
def _(spark, c):
    return c.of(spark, "Customer").where(q.is_true("inDebt") & ~q.eq("balanceClass", -2)).select("c_acctbal").frame()


@over_catalog(
    "expr_text_query",
    """SELECT o_orderkey, o_totalprice, c_name AS customer_c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey""",
)
def _(spark, c):
    orders = c.of(spark, "Order").where('customer.c_mktsegment == "BUILDING" && o_totalprice > 1000')
    return orders.select("o_totalprice", "customer.c_name").order("-o_totalprice", "o_orderkey").frame()


@over_catalog("search_text", "SELECT * FROM customer WHERE c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%'")
def _(spark, c):
    return c.of(spark, "Customer").search("build").frame()


@over_catalog("search_numeric", "SELECT * FROM customer WHERE (c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%' OR c_custkey = 12 OR c_nationkey = 12) AND c_mktsegment = 'BUILDING'")
def _(spark, c):
    return c.of(spark, "Customer").search("12", c_mktsegment="BUILDING").frame()


@over_catalog("search_count", "SELECT count(*) AS n FROM pages WHERE url ILIKE '%page=2%' OR html ILIKE '%page=2%'")
def _(spark, c):
    return c.of(spark, "Page").search("page=2").count_frame()


@over_catalog("subtype_filter", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'click') AND (value > 90 OR value < 1)")
def _(spark, c):
    return c.of(spark, "MarketEvent").where(q.gt("value", 90) | q.lt("value", 1)).select("event_type", "value").frame()


@over_catalog("subtype_project", "SELECT event_id, event_type, c_mktsegment AS user_c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type IN ('purchase', 'click')")
def _(spark, c):
    return c.of(spark, "MarketEvent").select("event_type", "user.c_mktsegment").frame()


@over_catalog(
    "path_predicate",
    """SELECT o_orderkey, n_name AS customer_nation_n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 5000""",
)
def _(spark, c):
    return c.of(spark, "Order").where('customer.nation.region.r_name == "ASIA" && customer.c_acctbal > 5000').select("customer.nation.n_name").frame()


@over_catalog("computed_predicate", "SELECT o_orderkey, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000.0 AND NOT (c_acctbal < 0)")
def _(spark, c):
    return c.of(spark, "Order").where("large && !customer.inDebt").select("o_totalprice").frame()


@over_catalog("computed_eq", "SELECT c_custkey, CAST(floor(c_acctbal / 1000) AS INTEGER) AS balanceClass FROM customer WHERE floor(c_acctbal / 1000) = 3")
def _(spark, c):
    return c.of(spark, "Customer").where("balanceClass == 3").select("balanceClass").frame()


@over_tables("bitmask_predicate", "SELECT p_partkey, p_size FROM part WHERE (p_size & 6) <> 0", "part")
def _(part):
    return part.where(S.bit_is_set(F.col("p_size"), 6)).select("p_partkey", "p_size")


@over_tables("bitmask_set", "SELECT p_partkey, p_size | 8 AS with_bit, p_size & ~8 AS without_bit, CASE WHEN p_partkey % 2 = 0 THEN p_size | 1 ELSE p_size & ~1 END AS by_parity FROM part", "part")
def _(part):
    size = F.col("p_size")
    return part.select(
        "p_partkey", S.bit_set(size, 8, True).alias("with_bit"), S.bit_set(size, 8, False).alias("without_bit"), S.bit_set(size, 1, F.col("p_partkey") % 2 == 0).alias("by_parity")
    )


@over_catalog("json_path_predicate", "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(spark, c):
    return c.of(spark, "Event").where(q.eq("props.k", "7")).select("props").frame()


@over_catalog("dyn_project_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, c):
    return c.of(spark, "Event").select("k").frame()


@over_catalog("dyn_predicate_json", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 AND event_type = 'view'")
def _(spark, c):
    return c.of(spark, "Event").where('k > 50 && event_type == "view"').select("event_type", "k").frame()


@over_tables("dyn_update_json", """SELECT event_id, '{"k":"' || (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) || '","seen":"' || event_type || '"}' AS props FROM events""", "events")
def _(events):
    change = F.create_map(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") + 1).cast("string"), F.lit("seen"), F.col("event_type"))
    return events.select("event_id", dml.json_merged(F.col("props"), change).alias("props"))


@over_tables("struct_path", "SELECT c_custkey, c_name || '!' AS changed, c_nationkey AS nation FROM customer", "customer")
def _(customer):
    boxed = customer.select("c_custkey", F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("info")).alias("box"))
    moved = boxed.withColumn("box", F.col("box").withField("info.name", F.concat("box.info.name", F.lit("!"))))
    return moved.select("c_custkey", F.col("box.info.name").alias("changed"), F.col("box.info.nation").alias("nation"))


# Joins


@over_catalog("ref_join_eager", "SELECT c_custkey, n_nationkey AS nation_n_nationkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, c):
    return c.of(spark, "Customer").group("nation").frame()


@over_catalog("ref_join_two_level", "SELECT s_suppkey, n_name AS nation_n_name, r_name AS nation_region_r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, c):
    return c.of(spark, "Supplier").select("nation.n_name", "nation.region.r_name").frame()


@over_catalog(
    "self_join_alias",
    """SELECT l_orderkey, l_linenumber, c.n_name AS customer_nation, s.n_name AS supplier_nation FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation c ON c_nationkey = c.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey WHERE l_quantity > 49""",
)
def _(spark, c):
    return c.of(spark, "Lineitem").where("l_quantity > 49").select("order.customer.nation.n_name as customer_nation", "supplier.nation.n_name as supplier_nation").frame()


@over_catalog(
    "composite_key_join",
    "SELECT b.conv_id, b.turn, a.role AS previous_role, b.role FROM conversations b LEFT JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1",
)
def _(spark, c):
    return c.of(spark, "NextTurn").select("previous.role", "role").frame()


@over_catalog("fetch_group_aux", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, c):
    return c.of(spark, "Document").group("labels").frame()


@over_tables(
    "upsert_aux",
    """WITH n AS (SELECT doc_id, 1 AS quality, 0 AS toxic FROM documents WHERE doc_id % 5 = 0)
       SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""",
    "documents",
    "labels",
)
def _(documents, labels):
    new = documents.where("doc_id % 5 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return dml.upserted(labels, new, ["doc_id"])


@over_catalog(
    "reverse_one_to_many",
    "SELECT o_custkey AS c_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
)
def _(spark, c):
    rows = c.of(spark, "Customer").collected("orders", "o_orderkey")
    return rows.select("c_custkey", "n", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("orders"))


@over_catalog(
    "many_to_many",
    """SELECT p_brand, count(DISTINCT o_orderkey) AS n_orders FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) m JOIN part ON p_partkey = l_partkey
       JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY p_brand""",
)
def _(spark, c):
    links = c.of(spark, "Part").related("orders", where=q.eq("o_orderstatus", "F"))
    part = c.of(spark, "Part").select("p_brand").frame()
    return links.join(part, F.col("owner_p_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("o_orderkey").alias("n_orders"))


@over_catalog("many_to_many_list", "SELECT l_orderkey AS o_orderkey, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY l_orderkey")
def _(spark, c):
    rows = c.of(spark, "Order").where(q.eq("o_orderpriority", "1-URGENT")).collected("parts", "p_name")
    return rows.select("o_orderkey", "n", F.array_join(F.sort_array(F.array_distinct("p_name")), ",").alias("names"))


@over_catalog("one_to_one_reverse", "SELECT d.doc_id, l.quality AS label_quality, l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, c):
    rows = c.of(spark, "Document").select("label.quality", "label.doc_id as owner").frame()
    return rows.select("doc_id", "label_quality", F.col("owner").isNotNull().alias("has_label"))


@over_catalog("includes_item_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = 5)")
def _(spark, c):
    return c.of(spark, "Order").including("lines", "l_partkey == 5").select().frame()


def _cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of the registry; joins between them are Spark's, whatever they are."""
    sources = files.Sources()
    sources.add(files.DataSource("customers", folder=sf_dir, read_only=True))
    sources.add(files.DataSource("activity", folder=sf_dir, read_only=True))
    errors = sources["activity"].table(spark, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("k"))
    customer = sources["customers"].table(spark, "customer")
    return customer.join(errors, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


QUERIES["cross_source_join"] = _cross_source
SQL["cross_source_join"] = "SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' GROUP BY c_custkey"


# Counts


@over_catalog("count_all", "SELECT count(*) AS n FROM lineitem")
def _(spark, c):
    return c.of(spark, "Lineitem").count_frame()


@over_catalog("count_query", "SELECT count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (1, 2, 3) AND o_totalprice > 100000")
def _(spark, c):
    return c.of(spark, "Order").where(q.one_of("customer.c_nationkey", 1, 2, 3) & q.gt("o_totalprice", 100_000)).count_frame()


@over_tables("array_length", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings", "embeddings")
def _(embeddings):
    return embeddings.select("vec_id", S.array_length(F.col("embedding")).alias("n"))


@over_tables(
    "perf_stats",
    "SELECT event_type AS name, round(sum(value), 4) AS total, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "events",
)
def _(events):
    return stats.operation_stats(events, "event_type", "value").withColumn("total", F.round("total", 4))


# Sets and differences


@over_tables(
    "merge_results",
    """SELECT c_custkey, c_acctbal, 'primary' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL
       SELECT c_custkey, c_acctbal, 'other' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""",
    "customer",
)
def _(customer):
    pick = lambda n, origin: customer.where(F.col("c_custkey") % n == 0).select("c_custkey", "c_acctbal", F.lit(origin).alias("origin"))
    return setops.merged_results(pick(3, "primary"), pick(2, "other"), ["c_custkey"])


_LISTS = """o AS (SELECT DISTINCT l_orderkey AS parent, l_partkey AS child FROM lineitem),
n AS (SELECT parent, child FROM o WHERE child % 2 = 1 UNION SELECT parent, child + 1000000 FROM o WHERE child % 5 = 0)"""


def _lists(lineitem):
    old = lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")).distinct()
    new = old.where("child % 2 = 1").union(old.where("child % 5 = 0").select("parent", F.col("child") + 1_000_000)).distinct()
    return old, new


@over_tables(
    "list_diff",
    f"WITH {_LISTS} SELECT parent, child, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT parent, child, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)",
    "lineitem",
)
def _(lineitem):
    return dml.list_changes(*_lists(lineitem), ["parent", "child"])


@over_tables(
    "ordered_list_diff",
    f"""WITH {_LISTS}, a AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS pos FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS pos FROM n)
    SELECT coalesce(a.parent, b.parent) AS parent, coalesce(a.child, b.child) AS child, a.pos AS old_pos, b.pos AS new_pos,
    CASE WHEN a.pos IS NULL THEN 'insert' WHEN b.pos IS NULL THEN 'remove' WHEN a.pos <> b.pos THEN 'move' ELSE 'keep' END AS change FROM a FULL JOIN b ON a.parent = b.parent AND a.child = b.child""",
    "lineitem",
)
def _(lineitem):
    place = F.row_number().over(Window.partitionBy("parent").orderBy("child")).cast("long")
    old, new = (x.withColumn("pos", place) for x in _lists(lineitem))
    return setops.ordered_changes(old, new, "parent", "pos", "child")


@over_tables(
    "prop_set_ops",
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'acctbal,name,nation' ELSE 'name,nation' END AS merged,
       CASE WHEN c_nationkey % 2 = 0 THEN 'acctbal' ELSE '' END AS added FROM customer""",
    "customer",
)
def _(customer):
    own = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("name"), F.lit("acctbal"))).otherwise(F.array(F.lit("name")))
    base = F.array(F.lit("name"), F.lit("nation"))
    return customer.select(
        "c_custkey", F.array_join(F.sort_array(F.array_union(own, base)), ",").alias("merged"), F.array_join(F.array_except(own, base), ",").alias("added")
    )


@over_tables(
    "schema_diff",
    "SELECT * FROM (VALUES ('nation', 'n_comment', 'missing'), ('nation', 'n_name', 'type'), ('region', 'r_name', 'extra')) t(table_name, column_name, problem)",
    "nation",
    "region",
)
def _(nation, region):
    spark = nation.sparkSession
    columns = ["table_name", "column_name", "data_type"]
    found = spark.createDataFrame(setops.schema_columns({"nation": nation, "region": region}), columns)
    wanted = [("nation", "n_nationkey", "int"), ("nation", "n_name", "int"), ("nation", "n_regionkey", "int"), ("nation", "n_comment", "string"), ("region", "r_regionkey", "int")]
    return setops.schema_changes(spark.createDataFrame(wanted, columns), found)


# Changes to tables


@over_tables(
    "tx_insert",
    """SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
       SELECT CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name, r_regionkey) AS INTEGER), 'NEW_' || r_name, r_regionkey FROM region""",
    "nation",
    "region",
)
def _(nation, region):
    rows = region.select(F.concat(F.lit("NEW_"), "r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    out = dml.inserted(nation, rows, "n_nationkey")
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


_ORDERS = "o AS (SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 3 AS INTEGER) AS version FROM orders), c AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, CAST(CASE WHEN o_orderkey % 21 = 0 THEN 9 ELSE o_orderkey % 3 END AS INTEGER) AS version FROM orders WHERE o_orderkey % 7 = 0)"


def _versioned(orders):
    base = orders.select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).cast("int").alias("version"))
    stale = F.when(F.col("o_orderkey") % 21 == 0, F.lit(9)).otherwise(F.col("o_orderkey") % 3).cast("int")
    return base, orders.where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), stale.alias("version"))


@over_tables(
    "tx_update_versioned",
    f"""WITH {_ORDERS} SELECT o.o_orderkey, coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice, CAST(o.version + (c.o_orderkey IS NOT NULL)::INTEGER AS INTEGER) AS version
        FROM o LEFT JOIN c ON c.o_orderkey = o.o_orderkey AND c.version = o.version""",
    "orders",
)
def _(orders):
    base, delta = _versioned(orders)
    return dml.updated(base, delta, ["o_orderkey"], "version")


@over_tables("tx_stale_rows", f"WITH {_ORDERS} SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_orderkey = c.o_orderkey AND o.version = c.version)", "orders")
def _(orders):
    return dml.stale_rows(*_versioned(orders), ["o_orderkey"], "version")


@over_tables("tx_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 11 <> 0", "orders")
def _(orders):
    return dml.deleted(orders, orders.where("o_orderkey % 11 = 0").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@over_tables("multi_insert_explode", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS child FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(embedding)", "embeddings")
def _(embeddings):
    return dml.exploded(embeddings, "vec_id", "embedding")


@over_tables("multi_delete", f"WITH {_LISTS} SELECT parent, child FROM o WHERE parent % 20 <> 0 AND NOT (child % 2 = 0)", "lineitem")
def _(lineitem):
    old, _ = _lists(lineitem)
    all_gone = dml.list_without(old, old.where("parent % 20 = 0"), ["parent"])
    return dml.list_without(all_gone, old.where("child % 2 = 0"), ["parent", "child"])


@over_tables("tx_read_your_writes", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 9 <> 0", "customer")
def _(customer):
    tx = dml.Transaction({"customer": customer.select("c_custkey", "c_acctbal")})
    tx.update("customer", customer.where("c_custkey % 4 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), ["c_custkey"])
    tx.delete("customer", customer.where("c_custkey % 9 = 0"), ["c_custkey"])
    return tx.read("customer")


@over_tables(
    "upsert_classify",
    """SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey,
       CASE WHEN c_custkey % 10 = 0 THEN 'insert' WHEN c_custkey % 2 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM customer""",
    "customer",
)
def _(customer):
    key = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    rows = customer.select(key.alias("c_custkey"), name.alias("c_name"), "c_nationkey")
    return dml.classified(customer, rows, ["c_custkey"])


@over_tables(
    "validate_rows",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'c_acctbal=negative;' END, '') || coalesce(CASE WHEN length(c_mktsegment) > 8 THEN 'c_mktsegment=too long;' END, '') AS errors FROM customer""",
    "customer",
)
def _(customer):
    rules = dml.Validators().required("c_name").add("c_acctbal", lambda c: c < 0, "negative").add("c_mktsegment", lambda c: F.length(c) > 8, "too long")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return rules.check(customer).select("c_custkey", shown.alias("errors"))


@over_tables(
    "cache_match_nullsafe",
    "SELECT a.doc_id FROM documents a LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT DISTINCT FROM NULL AND (abs(n_chars - 100.00000000001) < 1e-10 OR n_chars > 2000)",
    "documents",
    "labels",
)
def _(documents, labels):
    rows = documents.join(labels, "doc_id", "left")
    chars = S.equal_objects(F.col("n_chars").cast("double"), F.lit(100.00000000001), numeric=True) | (F.col("n_chars") > 2000)
    return rows.where(S.equal_objects(F.col("quality"), F.lit(None).cast("int")) & chars).select("doc_id")


@over_tables("named_query", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000.0 GROUP BY c_mktsegment", "customer")
def _(customer):
    named = files.NamedQueries()
    named.add("richBySegment", "SELECT c_mktsegment, count(*) AS n FROM {t} WHERE c_acctbal > :least GROUP BY c_mktsegment")
    return named.run(customer.sparkSession, "richBySegment", {"t": customer}, least=1000.0)
