"""One query per operator over the order tables, each with SQL that gives the same rows.

Queries whose result is ordered carry `pos`, the place of each row from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import id_parts, id_text, set_contains, set_max, set_min, set_minus, set_size
from .operators.bitmap import Bitmap
from .operators.entities import EntitySet, EntityStore, Frame
from .operators.keyvalue import KeyValueStore
from .operators.writes import add_links, delete_blob, delete_entities, delete_type, insert_entities, link_violations, rename_type, set_blob, set_link, set_property, unique_key_violations
from .plans.predicates import All, Between, Contains, Equals, HasBlob, HasLink, LinkIs, LinkTo, Predicate, Present, StartsWith
from .sources.tables import trade_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: the orders' own properties as SQL sees them
OPEN = "nullif(o_orderstatus, 'F')"
FEW = "CASE WHEN c_nationkey > 5 THEN c_nationkey END"


def query(sql: str | None) -> Callable[[Callable[[EntityStore], DataFrame]], Callable[[EntityStore], DataFrame]]:
    def add(f: Callable[[EntityStore], DataFrame]) -> Callable[[EntityStore], DataFrame]:
        QUERIES[f.__name__] = lambda spark, at: f(trade_store(spark, at))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ids(s: EntitySet) -> DataFrame:
    return s.df.select(F.col("local_id").alias("id"))


def typed(s: EntitySet) -> DataFrame:
    return s.df.select("type_id", F.col("local_id").alias("id"))


def placed(s: EntitySet) -> DataFrame:
    return s.positions().select(F.col("local_id").alias("id"), F.col("pos").cast("bigint").alias("pos"))


def ordered(rows: str, by: str) -> str:
    """SQL: id and pos of rows(id, ...) in an order."""
    return f"SELECT id, row_number() OVER (ORDER BY {by}) - 1 AS pos FROM ({rows})"


# --- scans and predicates ---


@query("SELECT o_orderkey AS id FROM orders")
def get_all(s):
    return ids(s["Order"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def find_ids_range(s):
    return ids(s.find_ids("Order", 100, 5000))


@query("SELECT o_orderkey AS id, o_totalprice AS total, o_orderpriority AS priority FROM orders WHERE lower(o_orderpriority) = '1-urgent'")
def prop_eq_ci(s):
    return s.query("Order", Equals("priority", "1-URGENT")).values("total", "priority").select(F.col("local_id").alias("id"), "total", "priority")


@query("SELECT doc_id AS id FROM labels WHERE NOT coalesce(toxic = 1, false)")
def prop_eq_bool_false(s):
    return ids(s.query("Label", Equals("toxic", False)))


@query("SELECT doc_id AS id FROM labels WHERE quality = 1")
def prop_eq_bool_true(s):
    return ids(s.query("Label", Equals("good", True)))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 1000.0 AND 150000.0")
def prop_range(s):
    return ids(s.query("Order", Between("total", 1000.0, 150000.0)))


@query("SELECT c_custkey AS id FROM customer WHERE lower(c_mktsegment) BETWEEN 'automobile' AND 'furniture'")
def prop_range_ci(s):
    return ids(s.query("Customer", Between("segment", "AutoMobile", "FURNITURE")))


@query("SELECT 'true, true' AS range, doc_id AS id FROM labels WHERE toxic = 1 UNION ALL SELECT 'false, true', doc_id FROM labels")
def prop_range_false_false(s):
    """All four ranges of booleans: from true to true, from false to true, and the two that find nothing."""
    found = [ids(s.query("Label", Between("toxic", low, high))).select(F.lit(f"{low}, {high}".lower()).alias("range"), "id") for low in (False, True) for high in (False, True)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("SELECT p_partkey AS id FROM part WHERE starts_with(lower(p_brand), 'brand#1')")
def prop_starts_with(s):
    return ids(s.query("Part", StartsWith("brand", "BRAND#1")))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_type), 'an')")
def prop_contains_ci(s):
    return ids(s.query("Part", Contains("type", "STEEL") | Contains("type", "an", ignore_case=False)))


@query(f"SELECT o_orderkey AS id FROM orders WHERE {OPEN} IS NOT NULL")
def prop_not_null(s):
    return ids(s.query("Order", Present("open")))


@query(f"SELECT o_orderkey AS id FROM orders WHERE {OPEN} IS NULL")
def prop_is_null(s):
    return ids(s.query("Order", Equals("open", None)))


@query("SELECT doc_id AS id, octet_length(encode(text)) AS size FROM documents WHERE lang <> 'en'")
def has_blob(s):
    return s.query("Document", HasBlob("text")).blob_sizes("text").select(F.col("local_id").alias("id"), F.col("size").cast("bigint").alias("size"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE NOT coalesce({OPEN} = 'O', false)")
def not_complement_with_nulls(s):
    return ids(s.query("Order", ~Equals("open", "o")))


@query(f"SELECT o_orderkey AS id FROM orders WHERE ({OPEN} = 'P' OR o_totalprice BETWEEN 0.0 AND 50000.0) AND NOT coalesce(lower(o_orderpriority) LIKE '5%', false)")
def and_or_not_tree(s):
    return ids(s.query("Order", (Equals("open", "P") | Between("total", 0.0, 50000.0)) & ~StartsWith("priority", "5")))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'")
def set_any_eq(s):
    return ids(s.query("Basket", Equals("flags", "r")))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey BETWEEN 10 AND 40")
def set_any_range(s):
    return ids(s.query("Basket", Between("parts", 10, 40)))


@query(
    """SELECT id, len(p) AS size, list_min(p) AS least, list_max(p) AS most, list_contains(p, 7) AS has_7, len(list_filter(p, lambda x: x <> least)) AS rest
       FROM (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS p, min(l_partkey) AS least FROM lineitem GROUP BY 1)"""
)
def set_algebra(s):
    p = F.col("p_parts")
    return s["Basket"].df.select(F.col("local_id").alias("id"), set_size(p).cast("bigint").alias("size"), set_min(p).alias("least"), set_max(p).alias("most"), set_contains(p, 7).alias("has_7"), set_size(set_minus(p, F.array(set_min(p)))).cast("bigint").alias("rest"))


@query(ordered("SELECT DISTINCT l_orderkey AS id, lower(l_returnflag) AS v FROM lineitem", "v, id"))
def with_property_sorted(s):
    return placed(s.with_property_sorted("Basket", "flags"))


@query("SELECT c_custkey AS id, '3-' || c_custkey AS text, c_custkey AS back FROM customer")
def id_texts(s):
    t = s["Customer"].df.select(F.col("local_id").alias("id"), id_text(F.col("type_id"), F.col("local_id")).alias("text"))
    return t.select("id", "text", id_parts(F.col("text"))[1].alias("back"))


@query(f"SELECT o_orderkey AS id, CASE WHEN {OPEN} IS NULL THEN 'custkey,date,priority,status,total' ELSE 'custkey,date,open,priority,status,total' END AS names FROM orders")
def property_names(s):
    return s["Order"].names_present().select(F.col("local_id").alias("id"), F.array_join("names", ",").alias("names"))


# --- links ---


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7")
def link_eq(s):
    return ids(s.query("Order", LinkIs("customer", 7)))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12'")
def find_links_set(s):
    return ids(s["Order"].find_links("parts", s.query("Part", Equals("brand", "brand#12"))))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0.0 AND 5000.0)")
def links_nested_subquery(s):
    return ids(s.query("Order", LinkTo("customer", Equals("segment", "building") & Between("balance", 0.0, 5000.0))))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (3, 5, 7, 9, 11) AND o_orderstatus <> 'O'")
def link_list(s):
    some = LinkIs("customer", 3) | LinkIs("customer", 5) | LinkIs("customer", 7) | LinkIs("customer", 9) | LinkIs("customer", 11)
    return ids(s.query("Order", some - Equals("status", "O")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def with_links(s):
    return ids(s.query("Order", HasLink("parts")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def without_links(s):
    return ids(s.query("Order", LinkIs("parts", None)))


@query(f"SELECT c_custkey AS id FROM customer WHERE {FEW} IS NULL")
def without_fk(s):
    return ids(s.query("Customer", LinkIs("home", None)))


@query("SELECT DISTINCT l_orderkey AS id, l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def link_pairs(s):
    return s.edges("Order", "parts", True).select(F.col("local_id").alias("id"), "target")


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey = 1")
def links_from(s):
    return ids(s.links_from("Order", 1, "parts"))


@query("SELECT type_id, id, min_by(link, n) AS link FROM (SELECT 5 AS type_id, l_partkey AS id, 'parts' AS link, 0 AS n FROM lineitem WHERE l_orderkey = 1 UNION ALL SELECT 4, l_suppkey, 'suppliers', 1 FROM lineitem WHERE l_orderkey = 1) GROUP BY 1, 2")
def links_from_set(s):
    t = s.links_from_set("Order", 1, ["parts", "suppliers"])
    return t.df.select("type_id", F.col("local_id").alias("id"), "link")


@query(f"SELECT DISTINCT {FEW} AS id FROM customer")
def select_distinct_null(s):
    return ids(s["Customer"].select_distinct("home"))


@query("SELECT DISTINCT p AS id FROM (SELECT o_orderkey, min(l_partkey) AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def select_distinct_first(s):
    return ids(s["Order"].select_distinct("parts"))


@query("SELECT DISTINCT l_partkey AS id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def select_many_distinct(s):
    return ids(s["Order"].select_many_distinct("parts"))


@query("SELECT l_partkey AS id FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def select_many_dups(s):
    return ids(s["Order"].select_many("parts"))


@query("SELECT l_partkey AS id, min(o_orderkey) AS source_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def source_mapping(s):
    return s["Order"].with_sources("parts").select(F.col("local_id").alias("id"), "source_id")


# --- set operators ---


def _cheap(s):
    return s.query("Order", Between("total", 0.0, 120000.0))


def _urgent(s):
    return s.query("Order", StartsWith("priority", "1"))


def _of_brand(s, brand):
    return s["Order"].find_links("parts", s.query("Part", StartsWith("brand", brand)))


_BRAND = "SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand LIKE '{}%'"


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 0 AND 120000 AND o_orderpriority LIKE '1%'")
def intersect(s):
    return ids(_cheap(s).intersect(_urgent(s)))


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN ({_BRAND.format("Brand#11")}) AND o_orderkey IN ({_BRAND.format("Brand#2")})")
def intersect_joined(s):
    return ids(_of_brand(s, "Brand#11").intersect(_of_brand(s, "Brand#2")))


@query(ordered(f"SELECT o_orderkey AS id, o_totalprice AS t FROM orders WHERE o_orderkey IN ({_BRAND.format("Brand#3")})", "t DESC, id"))
def intersect_saving_order(s):
    return placed(_of_brand(s, "Brand#3").intersect_saving_order(s["Order"].sort("total", ascending=False)))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 0 AND 120000 OR o_orderpriority LIKE '1%'")
def union_distinct(s):
    return ids(_cheap(s).union(_urgent(s)))


@query(f"SELECT {FEW} AS id FROM customer UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 3")
def union_with_null(s):
    return ids(s["Customer"].select_many("home").union(s.find_ids("Nation", 0, 2)))


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 0 AND 120000 AND o_orderkey NOT IN ({_BRAND.format("Brand#4")})")
def minus(s):
    return ids(_cheap(s).minus(_of_brand(s, "Brand#4")))


@query(f"SELECT {FEW} AS id FROM customer WHERE {FEW} IS NULL OR {FEW} >= 10")
def minus_keeps_dups(s):
    return ids(s["Customer"].select_many("home").minus(s.find_ids("Nation", 0, 9)))


@query(ordered("SELECT o_orderkey AS id, 0 AS b, -o_totalprice AS t FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey, 1, 0 FROM orders WHERE o_totalprice BETWEEN 0 AND 120000", "b, t, id"))
def concat_dups(s):
    return placed(_urgent(s).sort("total", ascending=False).concat(_cheap(s)))


@query(ordered("SELECT id, min_by(b, (b, t)) AS b, min_by(t, (b, t)) AS t FROM (SELECT o_orderkey AS id, 0 AS b, -o_totalprice AS t FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey, 1, 0 FROM orders WHERE o_totalprice BETWEEN 0 AND 120000) GROUP BY id", "b, t, id"))
def distinct_first(s):
    return placed(_urgent(s).sort("total", ascending=False).concat(_cheap(s)).distinct())


@query(ordered(f"SELECT DISTINCT {FEW} AS id, 0 AS b FROM customer WHERE {FEW} > 0 UNION ALL SELECT NULL, 1", "b, id"))
def add_null(s):
    homes = s["Customer"].select_distinct("home")
    return placed(homes.exclude_null().add_null_of(homes))


@query(f"SELECT DISTINCT {FEW} AS id FROM customer")
def filter_type_keeps_null(s):
    return ids(s["Customer"].select_distinct("home").concat(s["Region"]).of_type("Nation"))


# --- order ---


@query(ordered(f"SELECT o_orderkey AS id, lower({OPEN}) AS v FROM orders", "v ASC NULLS LAST, id"))
def sort_asc_nulls_last(s):
    return placed(s["Order"].sort("open"))


@query(ordered(f"SELECT o_orderkey AS id, lower({OPEN}) AS v FROM orders", "v DESC NULLS LAST, id"))
def sort_desc_nulls_last(s):
    return placed(s["Order"].sort("open", ascending=False))


@query(ordered(f"SELECT o_orderkey AS id, lower({OPEN}) AS v, o_totalprice AS t FROM orders", "v NULLS LAST, t DESC, id"))
def sort_stable_two_keys(s):
    return placed(s["Order"].sort("total", ascending=False).sort("open"))


@query(ordered("SELECT o_orderkey AS id, o_totalprice % 1000 AS k FROM orders", "k DESC, id"))
def sort_by_expression(s):
    return placed(s["Order"].sort_by(F.col("p_total") % 1000, ascending=False))


@query(ordered("SELECT o_orderkey AS id, c_acctbal AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "v NULLS LAST, id"))
def sort_by_link_prop(s):
    return placed(s["Order"].sort_by_link("customer", "balance"))


@query(ordered("SELECT o_orderkey AS id, max(p_retailprice) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1", "v DESC NULLS LAST, id"))
def sort_by_multilink(s):
    return placed(s["Order"].sort_by_link("parts", "retailprice", ascending=False))


@query(ordered("SELECT o_orderkey AS id, c.r, o_totalprice AS t FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_mktsegment <> 'MACHINERY') c ON o_custkey = c_custkey", "r NULLS LAST, t, id"))
def sort_links_ranked(s):
    targets = s.query("Customer", ~Equals("segment", "machinery")).sort("balance", ascending=False)
    return placed(s["Order"].sort("total").sort_links("customer", targets))


@query("SELECT type_id, id, row_number() OVER (ORDER BY v, type_id, id) - 1 AS pos FROM (SELECT 3 AS type_id, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 4, s_suppkey, s_acctbal FROM supplier)")
def merge_sorted_types(s):
    merged = s.merge_sorted([s["Customer"].sort("balance"), s["Supplier"].sort("balance")], "balance")
    return merged.positions().select("type_id", F.col("local_id").alias("id"), F.col("pos").cast("bigint").alias("pos"))


@query(ordered("SELECT o_orderkey AS id, o_totalprice AS t FROM orders ORDER BY t DESC, id LIMIT 100", "t DESC, id"))
def take_top_k(s):
    return placed(s["Order"].sort("total", ascending=False).take(100))


@query(ordered("SELECT o_orderkey AS id, o_orderdate AS t FROM orders ORDER BY t, id LIMIT 50 OFFSET 1000", "t, id"))
def skip_take_page(s):
    return placed(s["Order"].sort("date").page(1000, 50))


@query(ordered("SELECT o_orderkey AS id, o_orderdate AS t FROM orders ORDER BY t, id OFFSET 100", "t, id"))
def skip(s):
    return placed(s["Order"].sort("date").skip(100))


@query(ordered(f"SELECT o_orderkey AS id, lower({OPEN}) AS v FROM orders", "v DESC NULLS FIRST, id DESC"))
def reverse_nulls_first(s):
    return placed(s["Order"].sort("open").reverse())


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def first(s):
    return ids(s["Order"].sort("total").first())


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def last(s):
    return ids(s["Order"].sort("total").last())


@query("SELECT count(*) AS index FROM orders, (SELECT o_totalprice AS t FROM orders WHERE o_orderkey = 77) WHERE o_totalprice < t OR (o_totalprice = t AND o_orderkey < 77)")
def index_of(s):
    return s["Order"].sort("total").index_of(s.model.ids["Order"], 77)


@query(f"SELECT count(*) AS size FROM orders WHERE {OPEN} = 'O'")
def size(s):
    return s.query("Order", Equals("open", "O")).size_frame()


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)")
def newest_of_segment(s):
    """Orders of one customer segment but the open ones, newest first, the first 20."""
    segment = s["Order"].find_links("customer", s.query("Customer", Equals("segment", "building")))
    return placed(segment.minus(s.query("Order", Equals("status", "O"))).sort("date", ascending=False).take(20))


# --- hierarchy, keys, writes ---


# --- of a user's own ---


@dataclass(frozen=True)
class LongerThan(Predicate):
    """A text property has more than n characters."""

    name: str
    n: int

    def column(self, frame: Frame) -> Column:
        return F.char_length(frame.prop(self.name)) > self.n


@query("SELECT p_partkey AS id FROM part WHERE length(p_type) > 18 AND NOT coalesce(length(p_name) > 25, false)")
def own_predicate(s):
    return ids(s.query("Part", LongerThan("type", 18) & ~LongerThan("name", 25)))


@query(ordered("SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 30 WHEN '2' THEN 20 WHEN '3' THEN 10 END AS k FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3')", "k, id"))
def own_type_sorted(s):
    """A type with an order of its own is a property whose values keep that order: here urgency, greatest for the first priority."""
    level = F.substring("o_orderpriority", 1, 1)
    urgency = F.when(level == "1", 30).when(level == "2", 20).when(level == "3", 10).otherwise(0)
    return placed(set_property(s, "Order", "urgency", urgency).query("Order", Between("urgency", 10, 30)).sort("urgency"))


@query(
    """WITH o AS (SELECT o_orderstatus = 'F' AS f, o_custkey IN (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building') AS b FROM orders)
       SELECT 0 AS place, 0 AS depth, 'Order' AS type, 'And' AS node, (SELECT count(*) FROM o WHERE f AND NOT b) AS n
       UNION ALL SELECT 1, 1, 'Order', 'Equals(name=''status'', value=''F'')', (SELECT count(*) FROM o WHERE f)
       UNION ALL SELECT 2, 1, 'Order', 'Not', (SELECT count(*) FROM o WHERE NOT b)
       UNION ALL SELECT 3, 2, 'Order', 'LinkTo(''customer'')', (SELECT count(*) FROM o WHERE b)
       UNION ALL SELECT 4, 3, 'Customer', 'Equals(name=''segment'', value=''building'')', (SELECT count(*) FROM customer WHERE lower(c_mktsegment) = 'building')"""
)
def explained(s):
    """How many entities each node of a tree holds for."""
    return s.explain("Order", Equals("status", "F") & ~LinkTo("customer", Equals("segment", "building")))


@query("SELECT 3 AS type_id, c_custkey AS id FROM customer WHERE c_acctbal BETWEEN -100.0 AND 3000.0 UNION ALL SELECT 4, s_suppkey FROM supplier WHERE s_acctbal BETWEEN -100.0 AND 3000.0")
def hierarchy_union(s):
    return typed(s.query("Party", Between("balance", -100.0, 3000.0)))


@query("SELECT 3 AS type_id, c_custkey AS id FROM customer WHERE c_acctbal BETWEEN -100.0 AND 3000.0 AND c_mktsegment = 'BUILDING'")
def hierarchy_narrowed(s):
    return typed(s.query("Party", Between("balance", -100.0, 3000.0)).intersect(s.query("Customer", Equals("segment", "BUILDING"))))


@query("SELECT o_custkey AS custkey, o_orderpriority AS priority, count(*) AS n, false AS has_null FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_violations_of_orders(s):
    return unique_key_violations(s, "Order", ["custkey", "priority"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 500 AND CASE WHEN o_totalprice > 100000 THEN 'big' ELSE o_orderstatus END = 'big'")
def write_set_delete(s):
    changed = set_property(s, "Order", "status", F.lit("Big"), F.col("o_totalprice") > 100000)
    changed = delete_entities(changed, "Order", s.find_ids("Order", 0, 500).df.select("local_id"))
    return ids(changed.query("Order", Equals("status", "BIG")))


@query("SELECT o_orderkey AS id FROM orders WHERE CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE o_custkey END = 1 OR o_orderstatus = 'P'")
def write_links(s):
    some = s.query("Order", Equals("priority", "1-urgent")).df.select(F.col("local_id").alias("src"), F.lit(1).cast("bigint").alias("dst"))
    more = s.query("Order", Equals("status", "P")).df.select(F.col("local_id").alias("src"), F.lit(-9).cast("bigint").alias("dst"))
    changed = add_links(set_link(s, "Order", "customer", some), "Order", "parts", more)
    return ids(changed.query("Order", LinkIs("customer", 1) | LinkIs("parts", -9)))


@query("SELECT 3 AS type_id, c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 0.0 AND 5000.0")
def write_delete_type(s):
    """Of two subtypes one is deleted: the supertype's entities are the other's."""
    return typed(delete_type(s, "Supplier").query("Party", Between("balance", 0.0, 5000.0)))


@query("SELECT 3 AS type_id, c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def write_rename_type(s):
    """Under its new name the type has its links, and others' links lead to it still."""
    changed = rename_type(s, "Customer", "Client")
    return typed(changed["Client"].intersect(changed.query("Order", Equals("status", "F")).select_distinct("customer")))


@query("SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'Kurz' END AS text FROM documents WHERE source IS NOT NULL")
def write_blobs(s):
    changed = set_blob(delete_blob(s, "Document", "text"), "Document", "text", F.when(F.col("lang") == "de", F.lit("Kurz")))
    return changed.query("Document", Present("source")).blob_texts("text").select(F.col("local_id").alias("id"), "text")


@query("SELECT 'name' AS key, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT c_name || ' II' FROM customer WHERE c_mktsegment = 'BUILDING')")
def write_unique(s):
    """Customers that are inserted under names of their own; a name that is there is refused."""
    building = s.model.types["Customer"].df.where("c_mktsegment = 'BUILDING'").withColumn("c_custkey", -F.col("c_custkey") - 1)
    changed = insert_entities(s, "Customer", building.withColumn("c_name", F.concat("c_name", F.lit(" II"))))
    try:
        insert_entities(s, "Customer", building)
    except ValueError:
        return changed["Customer"].size_frame().select(F.lit("name").alias("key"), F.col("size").alias("n"))
    raise AssertionError("a repeated name was inserted")


@query("SELECT 6 AS type_id, o_orderkey AS id, 'parts' AS link, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(DISTINCT l_partkey) > 1")
def link_cardinalities(s):
    """With at most one part an order, which orders have too many."""
    t = s.model.types["Order"]
    one = EntityStore(s.spark, [replace(x, links=tuple(replace(k, cardinality="0..1") if k.name == "parts" else k for k in x.links)) if x is t else x for x in s.model.types.values()])
    return link_violations(one, "Order").select("type_id", F.col("local_id").alias("id"), "link", "n")


# --- single entities, empty sets, catalog ---


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey <> 7")
def minus_single(s):
    return ids(s["Customer"].minus(s.single("Customer", 7)))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")
def union_with_empty(s):
    closed = s.query("Order", Equals("status", "F"))
    return ids(closed.union(s.empty()).minus(s.empty()).union(closed.intersect(s.empty())))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (1, 4, 7, 10, 13)")
def find_links_of_ids(s):
    return ids(s["Order"].find_links("customer", s.of_ids("Customer", [13, 1, 4, 7, 10, 7])))


@query("SELECT 3 AS type_id, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey = 7")
def get_entity(s):
    return s.entity("Customer", 7).select("type_id", F.col("local_id").alias("id"), F.col("p_name").alias("name"), F.col("p_balance").alias("balance"))


@query("""SELECT i AS type_id, n AS name, p AS parent, c AS size FROM (VALUES
            (0, 'Region', NULL, (SELECT count(*) FROM region)), (1, 'Nation', NULL, (SELECT count(*) FROM nation)), (2, 'Party', NULL, 0), (3, 'Customer', 'Party', (SELECT count(*) FROM customer)),
            (4, 'Supplier', 'Party', (SELECT count(*) FROM supplier)), (5, 'Part', NULL, (SELECT count(*) FROM part)), (6, 'Order', NULL, (SELECT count(*) FROM orders)),
            (7, 'Basket', NULL, (SELECT count(DISTINCT l_orderkey) FROM lineitem)), (8, 'Document', NULL, (SELECT count(*) FROM documents)), (9, 'Label', NULL, (SELECT count(*) FROM labels))) AS t(i, n, p, c)""")  # fmt: skip
def entity_types(s):
    return s.catalog()


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey FROM orders")
def all_is_neutral(s):
    """All entities AND a condition, then all entities OR it."""
    return ids(s.query("Order", All() & Equals("status", "p"))).unionByName(ids(s.query("Order", All() | Equals("status", "p"))))


@query("SELECT 'none' AS which, true AS empty UNION ALL SELECT 'some', false")
def is_empty(s):
    none, some = s.query("Order", Between("total", -2.0, -1.0)), s.query("Order", Equals("status", "F"))
    return none.is_empty_frame().select(F.lit("none").alias("which"), "empty").unionByName(some.is_empty_frame().select(F.lit("some").alias("which"), "empty"))


@query(f"SELECT lower({OPEN}) AS value, count(*) AS n FROM orders WHERE {OPEN} IS NOT NULL GROUP BY 1")
def counts_by_value(s):
    return s["Order"].value_counts("open")


@query("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def counts_by_target(s):
    return s["Order"].target_counts("parts").select(F.col("local_id").alias("id"), "n")


# --- links over a hierarchy, opposite links, values along links ---

_PARTY = "(SELECT 3 AS type_id, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 4, s_suppkey, s_nationkey, s_acctbal FROM supplier)"


@query(f"SELECT type_id, id FROM (SELECT * FROM {_PARTY} ORDER BY type_id, id LIMIT (SELECT count(*) - 4 FROM {_PARTY})) WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def hierarchy_find_links(s):
    """Of both subtypes, but the last four, those of one region's nations; their ids overlap."""
    party = s["Party"]
    return typed(party.minus(party.reverse().take(4)).find_links("nation", s.query("Nation", LinkIs("region", 1))))


@query(f"SELECT DISTINCT nation AS id FROM {_PARTY} WHERE balance BETWEEN 0.0 AND 100.0")
def hierarchy_select_distinct(s):
    return ids(s.query("Party", Between("balance", 0.0, 100.0)).select_distinct("nation"))


@query(f"SELECT nation AS id FROM {_PARTY}")
def hierarchy_select_many(s):
    return ids(s["Party"].select_many("nation"))


@query(f"SELECT DISTINCT nation AS id FROM {_PARTY} WHERE balance BETWEEN 0.0 AND 100.0")
def hierarchy_select_many_distinct(s):
    return ids(s.query("Party", Between("balance", 0.0, 100.0)).select_many_distinct("nation"))


@query(f"SELECT nation AS id, type_id AS source_type, id AS source_id FROM {_PARTY}")
def hierarchy_sources(s):
    """Where each row of select_many comes from."""
    return s["Party"].with_sources("nation", distinct=False).select(F.col("local_id").alias("id"), "source_type", "source_id")


@query(f"SELECT type_id, id, row_number() OVER (ORDER BY n_name, type_id, id) - 1 AS pos FROM {_PARTY} JOIN nation ON nation = n_nationkey")
def hierarchy_sort_by_link(s):
    return s["Party"].sort_by_link("nation", "name").positions().select("type_id", F.col("local_id").alias("id"), F.col("pos").cast("bigint").alias("pos"))


@query(f"SELECT type_id, id, row_number() OVER (ORDER BY balance DESC, type_id, id) - 1 AS pos FROM {_PARTY}")
def hierarchy_sort(s):
    return s["Party"].sort("balance", ascending=False).positions().select("type_id", F.col("local_id").alias("id"), F.col("pos").cast("bigint").alias("pos"))


@query("SELECT c_nationkey AS id FROM customer WHERE c_custkey = 1")
def hierarchy_links_from(s):
    return ids(s.links_from("Party", 1, "nation"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def with_opposite_links(s):
    """Customers with orders, by the orders' links to them."""
    return ids(s.query("Customer", HasLink("orders")))


@query("SELECT c_custkey AS id, o_orderkey AS target, o_orderdate AS date FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN orders ON o_orderkey = k")
def first_links(s):
    """The first order of each customer, and its date."""
    customers = s["Customer"]
    dates = customers.linked_values("orders", "date").select(F.col("local_id").alias("id"), "date")
    return customers.first_links("orders").select(F.col("local_id").alias("id"), "target").join(dates, "id").select("id", "target", "date")


@query("SELECT o_orderkey AS id, CASE WHEN l_orderkey IS NULL THEN 'customer' ELSE 'customer,parts,suppliers' END AS names FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def link_names(s):
    return s["Order"].names_present("l").select(F.col("local_id").alias("id"), F.array_join("names", ",").alias("names"))


@query("SELECT doc_id AS id, text FROM documents WHERE lang <> 'en'")
def blob_texts(s):
    return s.query("Document", HasBlob("text")).blob_texts("text").select(F.col("local_id").alias("id"), "text")


@query(f"SELECT DISTINCT {FEW} AS id FROM customer WHERE {FEW} IS NOT NULL")
def select_linked(s):
    return ids(s["Customer"].select_linked("home"))


@query(ordered(f"SELECT o_orderkey AS id, lower({OPEN}) AS v FROM orders", "v NULLS LAST, id DESC"))
def sort_marked(s):
    """A set that is marked as a sort's result keeps its order among ties."""
    return placed(s["Order"].reverse().as_sort_result().sort("open"))


@query(ordered(f"SELECT o_orderkey AS id, lower({OPEN}) AS v, lower(o_orderpriority) AS p, o_custkey AS c, lower(o_orderstatus) AS st FROM orders", "p, v NULLS LAST, c, st, id"))
def sort_four_of_five(s):
    """Of five nested sorts the last four count."""
    out = s["Order"].sort("total")
    for p in ("status", "custkey", "open", "priority"):
        out = out.sort(p)
    return placed(out)


@query("SELECT type_id, id, row_number() OVER (ORDER BY v, type_id, id) - 1 AS pos FROM (SELECT 3 AS type_id, c_custkey AS id, -c_acctbal AS v FROM customer UNION ALL SELECT 5, p_partkey, p_retailprice FROM part)")
def merge_sorted_by_keys(s):
    merged = s.merge_sorted([s["Customer"], s["Part"]], [-F.col("p_balance"), F.col("p_retailprice")])
    return merged.positions().select("type_id", F.col("local_id").alias("id"), F.col("pos").cast("bigint").alias("pos"))


# --- key/value stores and bitmaps ---


def _prices(s):
    return KeyValueStore(s["Order"].df.select(F.col("l_customer").alias("key"), F.col("p_total").alias("value")), duplicates=True)


@query("SELECT o_custkey AS key, o_totalprice AS value FROM orders WHERE o_custkey >= 11 ORDER BY 1, 2 LIMIT 1")
def kv_seek_range(s):
    return _prices(s).seek(11)


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1")
def kv_dup_counts(s):
    return _prices(s).dup_counts()


@query("SELECT o_custkey AS key, min(o_totalprice) AS value FROM orders GROUP BY 1")
def kv_no_dup(s):
    return _prices(s).no_dup()


@query("SELECT o_custkey AS key, o_totalprice AS value, lag(o_totalprice) OVER w AS previous, lead(o_totalprice) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
def kv_neighbours(s):
    return _prices(s).neighbours()


@query("SELECT o_custkey AS key, min(o_totalprice) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def kv_put(s):
    store = KeyValueStore(_prices(s).no_dup())
    return store.put(s.query("Customer", Equals("segment", "building")).df.select(F.col("local_id").alias("key"), F.col("p_balance").alias("value"))).df


@query("SELECT o_custkey AS key, o_totalprice AS value, lag(o_custkey) OVER w AS previous_key, lag(o_totalprice) OVER w AS previous, lead(o_custkey) OVER w AS next_key, lead(o_totalprice) OVER w AS next FROM orders WINDOW w AS (ORDER BY o_custkey, o_totalprice)")
def kv_steps(s):
    """A cursor's previous and next pair, across keys."""
    return _prices(s).steps().select("key", "value", F.col("previous.key").alias("previous_key"), F.col("previous.value").alias("previous"), F.col("next.key").alias("next_key"), F.col("next.value").alias("next"))


@query("SELECT o_custkey AS key, min(o_totalprice) AS value FROM orders WHERE o_custkey = 7 GROUP BY 1")
def kv_get(s):
    return _prices(s).get(7)


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey BETWEEN 10 AND 900")
def bitmap_count_range(s):
    return Bitmap.of(s["Order"].df, "l_customer").count(10, 900)


@query("SELECT min(o_custkey) AS first, max(o_custkey) AS last, count(DISTINCT o_custkey) AS n FROM orders")
def bitmap_ends(s):
    return Bitmap.of(s["Order"].df, "l_customer").ends()


@query("SELECT DISTINCT o_custkey AS bit FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bitmap_clear(s):
    building = s.query("Customer", Equals("segment", "BUILDING")).df.select(F.col("local_id").alias("bit"))
    return Bitmap.of(s["Order"].df, "l_customer").clear(building)[0].df


