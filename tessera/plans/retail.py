"""The retail model: the driver's tables as entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.entity import Auxiliary, Catalog, EntityType, Mapping, Reference, Reverse
from tessera.sources.files import DataSource



def retail(sf_dir: str) -> Catalog:
    """The catalog over the tables of a folder. Every frame is read when a query that needs it is built."""
    source = DataSource("retail", folder=sf_dir, read_only=True)

    def table(name: str):
        return lambda spark: source.table(spark, name)

    catalog = Catalog(
        EntityType("Region", table("region"), ("r_regionkey",)),
        EntityType("Nation", table("nation"), ("n_nationkey",), {"region": Reference("Region", ("n_regionkey",))}),
        EntityType(
            "Customer",
            table("customer"),
            ("c_custkey",),
            {"nation": Reference("Nation", ("c_nationkey",))},
            relations={"orders": Reverse("Order", ("o_custkey",))},
            computed={"inDebt": lambda p: p("c_acctbal") < 0, "balanceClass": lambda p: F.floor(p("c_acctbal") / 1000).cast("int")},
        ),
        EntityType("Supplier", table("supplier"), ("s_suppkey",), {"nation": Reference("Nation", ("s_nationkey",))}),
        EntityType("Part", table("part"), ("p_partkey",), relations={"orders": Mapping("Order", table("lineitem"), ("l_partkey",), ("l_orderkey",))}),
        EntityType(
            "Order",
            table("orders"),
            ("o_orderkey",),
            {"customer": Reference("Customer", ("o_custkey",))},
            {"lines": Reverse("Lineitem", ("l_orderkey",)), "parts": Mapping("Part", table("lineitem"), ("l_orderkey",), ("l_partkey",))},
            computed={"large": lambda p: p("o_totalprice") > 200_000.0},
            groups={"price": ("o_totalprice", "o_orderpriority")},
        ),
        EntityType(
            "Lineitem",
            table("lineitem"),
            ("l_orderkey", "l_linenumber"),
            {"order": Reference("Order", ("l_orderkey",)), "part": Reference("Part", ("l_partkey",)), "supplier": Reference("Supplier", ("l_suppkey",))},
        ),
        EntityType("Event", table("events"), ("event_id",), {"user": Reference("Customer", ("user_id",))}, dynamic={"k": ("props", "$.k", "int")}, on_demand=frozenset({"props"})),
        EntityType("Label", table("labels"), ("doc_id",), {"document": Reference("Document", ("doc_id",))}),
        EntityType("Document", table("documents"), ("doc_id",), relations={"label": Reverse("Label", ("doc_id",), single=True)}, auxiliaries={"labels": Auxiliary(table("labels"), ("doc_id",), ("quality", "toxic"))}, on_demand=frozenset({"text"})),
        EntityType("Conversation", table("conversations"), ("conv_id", "turn")),
        EntityType("NextTurn", lambda spark: table("conversations")(spark).withColumn("before", F.col("turn") - 1), ("conv_id", "turn"), {"previous": Reference("Conversation", ("conv_id", "before"))}),
        EntityType("Embedding", table("embeddings"), ("vec_id",)),
        EntityType("Page", table("pages"), ("page_id",)),
        EntityType("BenchmarkItem", table("benchmark"), ("item_id",)),
    )
    catalog.subtype("Event", "MarketEvent", "event_type", "purchase", "click")
    return catalog


def tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    source = DataSource("retail", folder=sf_dir, read_only=True)
    return tuple(source.table(spark, n) for n in names)
