"""Parquet tables as an entity store."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import EntityStore
from ..plans.model import EntityType, Index, Link


def read(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def backup(df: DataFrame, path: str) -> None:
    """A copy that read.parquet restores."""
    df.write.mode("errorifexists").parquet(path)


_stores: WeakKeyDictionary[SparkSession, dict[str, EntityStore]] = WeakKeyDictionary()


def trade_store(spark: SparkSession, at: str) -> EntityStore:
    """The store over the tables at a place, opened once in a session."""
    own = _stores.setdefault(spark, {})
    if at not in own:
        own[at] = open_trade_store(spark, at)
    return own[at]


def open_trade_store(spark: SparkSession, at: str) -> EntityStore:
    """The order tables as entities; lineitem rows, which have no key, are the edges from orders to parts and suppliers.

    Customer and Supplier are subtypes of Party.  Some properties and links are derived so that values and links may be missing.
    """
    t = {n: read(spark, at, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "labels", "documents")}
    edges = lambda dst: t["lineitem"].select(F.col("l_orderkey").alias("src"), F.col(dst).alias("dst"))
    own = lambda df, key: {c: c for c in df.columns if c != key}
    few = F.when(F.col("c_nationkey") > 5, F.col("c_nationkey"))
    part_set = t["lineitem"].groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_returnflag").alias("flags"))
    return EntityStore(
        spark,
        [
            EntityType("Region", t["region"], "r_regionkey", {"name": "r_name"}),
            EntityType("Nation", t["nation"], "n_nationkey", {"name": "n_name"}, links=(Link("region", "Region", "n_regionkey"), Link("customers", "Customer", edges=t["customer"].select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst")), cardinality="0..n"))),
            EntityType("Party", links=(Link("nation", "Nation", F.col("nationkey")),), abstract=True),
            EntityType("Customer", t["customer"].withColumn("nationkey", F.col("c_nationkey")), "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment", "debtor": F.col("c_acctbal") < 0}, links=(Link("home", "Nation", few), Link("orders", "Order", opposite="customer", cardinality="0..n")), parent="Party", indices=(Index(("name",)),)),
            EntityType("Supplier", t["supplier"].withColumn("nationkey", F.col("s_nationkey")), "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}, parent="Party"),
            EntityType("Part", t["part"], "p_partkey", {c[2:]: c for c in own(t["part"], "p_partkey")}),
            EntityType(
                "Order",
                t["orders"],
                "o_orderkey",
                {"custkey": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority", "open": F.nullif(F.col("o_orderstatus"), F.lit("F"))},
                links=(Link("customer", "Customer", "o_custkey"), Link("parts", "Part", edges=edges("l_partkey"), cardinality="0..n"), Link("suppliers", "Supplier", edges=edges("l_suppkey"), cardinality="0..n")),
            ),
            EntityType("Basket", part_set, "l_orderkey", {"parts": "parts", "flags": "flags"}, links=(Link("order", "Order", "l_orderkey"),)),
            EntityType("Document", t["documents"], "doc_id", {"lang": "lang", "source": "source", "chars": "n_chars"}, {"text": F.when(F.col("lang") != "en", F.col("text"))}),
            EntityType("Label", t["labels"], "doc_id", {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, links=(Link("document", "Document", "doc_id"),)),
        ],
    )
