"""Semantics on small hand-made entities."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import writes
from graphloom.operators.entities import EntityStore
from graphloom.operators.jobs import Cancelled, cancelling
from graphloom.operators.writes import add_entities, add_links, delete_entities, delete_links, delete_property, delete_type, insert_entities, link_violations, rename_type, set_blob, set_link, set_property, unique_key_violations
from graphloom.plans.model import EntityType, Index, Link, Model
from graphloom.plans.predicates import All, And, Between, Contains, Equals, HasBlob, HasLink, LinkIn, LinkIs, LinkTo, Or, Present, StartsWith
from graphloom.streaming import matching


@pytest.fixture(scope="module")
def store(spark):
    issues = spark.createDataFrame([(i, f"Test issue #{i % 10}", f"Test issue #{i}", 99 - i, True if i == 3 else False if i == 4 else None, ["Eugene", "MAX", "SlaVa"] if i == 5 else [] if i == 6 else None, [i, 2 * i], None if i % 2 else f"d{i}") for i in range(100)], "id long, name string, full string, size int, deleted boolean, who array<string>, nums array<int>, half string")
    users = spark.createDataFrame([(i, f"user{i}", i if i < 5 else None) for i in range(10)], "id long, login string, boss long")
    assignee = spark.createDataFrame([(0, 2), (0, 1), (1, 2), (2, 3)], "src long, dst long")
    return EntityStore(
        spark,
        [
            EntityType("Issue", issues.where("id < 100"), "id", {c: c for c in ("name", "full", "size", "deleted", "who", "nums", "half")}, {"body": "half"}, (Link("assignee", "User", edges=assignee, cardinality="0..n"),)),
            EntityType("User", users, "id", {"login": "login"}, links=(Link("boss", "User", "boss"),)),
            EntityType("Animal", abstract=True),
            EntityType("Cat", spark.createDataFrame([(1, "Tom", 3), (2, "Felix", 9)], "id long, name string, lives int"), "id", {"name": "name", "lives": "lives"}, parent="Animal", interfaces=("Pet",)),
            EntityType("Pet", abstract=True),
            EntityType("Dog", spark.createDataFrame([(1, "tom")], "id long, name string"), "id", {"name": "name"}, parent="Animal"),
        ],
    )


def got(s):
    return sorted((r[0] for r in s.df.select("local_id").collect()), key=lambda x: (x is None, x))


def placed(s):
    return [r["local_id"] for r in s.positions().orderBy("pos").collect()]


def n(store, p, name="Issue"):
    return store.query(name, p).size()


def test_ranges_are_closed_and_fold_case(store):
    assert n(store, Between("size", 0, 9)) == 10
    assert n(store, Between("name", "TEST ISSUE #2", "test issue #4")) == 30
    assert n(store, Equals("name", "tEST iSSUE #7")) == 10


def test_prefix(store):
    assert n(store, StartsWith("full", "test issue #1")) == 11
    assert n(store, StartsWith("full", "")) == 100
    assert n(store, Contains("full", "ISSUE #9")) == 11
    assert n(store, Contains("full", "ISSUE", ignore_case=False)) == 0
    assert n(store, Contains("half", "", present=True)) == 50


def test_false_is_absent(store):
    assert n(store, Equals("deleted", True)) == 1
    assert n(store, Equals("deleted", False)) == 99
    assert n(store, Present("deleted")) == 1
    assert n(store, Between("deleted", False, True)) == 100
    assert n(store, Between("deleted", False, False)) == 0


def test_sets_match_by_item(store):
    assert got(store.query("Issue", Equals("who", "max"))) == [5]
    assert got(store.query("Issue", StartsWith("who", "sl"))) == [5]
    assert got(store.query("Issue", Between("nums", 197, 198))) == [99]
    assert n(store, Present("who")) == 1


def test_unknown_names_and_classes_find_nothing(store):
    assert n(store, Equals("nothing", 1)) == 0
    assert n(store, Equals("size", "5")) == 0
    assert n(store, HasLink("nothing")) == 0
    assert n(store, LinkIs("nothing", None)) == 100
    assert store["Nothing"].size() == 0
    assert n(store, HasBlob("body")) == 50


def test_complement_has_the_nulls(store):
    assert n(store, ~Equals("half", "d2")) == 99
    assert n(store, ~~Equals("half", "d2")) == 1
    assert n(store, Equals("half", None)) == 50
    assert n(store, ~Present("half") | Equals("half", "D4")) == 51


def test_rewrites():
    a, b = Equals("a", 1), Equals("b", 2)
    assert (All() & a) == a and (a & a & b) == And((a, b))
    assert (All() | a) == All() and (a | b | a) == Or((a, b))
    assert (LinkIs("l", 1) | LinkIs("l", 2) | LinkIs("l", 1)) == LinkIn("l", (1, 2))


def test_links_with_nulls(store):
    some = store.find_ids("Issue", 0, 3)
    assert got(some.select_distinct("assignee")) == [1, 2, 3, None]
    assert got(some.select_many_distinct("assignee")) == [1, 2, 3, None]
    assert got(some.select_many("assignee")) == [1, 2, 2, 3, None]
    assert got(some.select_linked("assignee")) == [1, 2, 3]
    assert got(some.select_distinct("nothing")) == [None]
    assert got(some.select_many_distinct("nothing")) == []
    assert got(store.query("Issue", LinkTo("assignee", Equals("login", "USER2")))) == [0, 1]
    assert got(store.query("Issue", HasLink("assignee") & ~LinkIs("assignee", 2))) == [2]
    assert got(store.query("Issue", LinkIs("assignee", None)))[:2] == [3, 4]
    one, two = (store["Issue"].find_links("assignee", store.of_ids("User", [k])) for k in (1, 2))
    assert got(one.intersect(two)) == [0]
    assert got(store.links_from("Issue", 0, "assignee")) == [1, 2]
    assert store.links_from_set("Issue", 0, ["assignee", "nothing"]).size() == 2


def test_set_operators(store):
    a, b = store.query("Issue", Equals("name", "test issue #1")), store.query("Issue", Equals("name", "test issue #2"))
    assert a.union(b).size() == 20 and a.intersect(b).size() == 0
    assert store["Issue"].minus(a).size() == 90
    assert store["Issue"].concat(store["Issue"]).size() == 200
    assert store["Issue"].concat(store["Issue"]).minus(a).size() == 180
    assert store["Issue"].concat(store["User"]).size() == 110
    assert store["Issue"].union(store["User"]).size() == 110
    assert store["Issue"].concat(a).distinct().size() == 100


def test_null_element(store):
    some = store.find_ids("Issue", 0, 3).select_distinct("assignee")
    assert got(some.exclude_null()) == [1, 2, 3]
    assert placed(some.exclude_null().add_null_of(some)) == [1, 2, 3, None]
    assert got(some.intersect(store.single(None, None))) == [None]
    assert got(some.of_type("Issue")) == [None]
    assert store.single("User", 3).size() == 1


def test_sort(store):
    s = store.find_ids("Issue", 0, 7).sort("half")
    assert placed(s) == [0, 2, 4, 6, 1, 3, 5, 7]
    assert placed(store.find_ids("Issue", 0, 7).sort("half", ascending=False)) == [6, 4, 2, 0, 1, 3, 5, 7]
    assert placed(s.reverse()) == [7, 5, 3, 1, 6, 4, 2, 0]
    assert placed(store.find_ids("Issue", 0, 5).sort("size").sort("deleted")) == [3, 5, 4, 2, 1, 0]
    assert placed(store.find_ids("Issue", 0, 3).sort("nothing")) == [0, 1, 2, 3]
    assert placed(store["Issue"].sort("size").take(3)) == [99, 98, 97]
    assert placed(store["Issue"].sort("size").skip(98)) == [1, 0]
    assert placed(store["Issue"].sort("size").page(1, 2)) == [98, 97]
    assert got(store["Issue"].sort("size").last()) == [0]
    assert got(store["Issue"].take(0)) == [] and store["Issue"].skip(-1).size() == 100
    assert store["Issue"].sort("size").index_of(0, 99).first()[0] == 0
    assert store["Issue"].index_of(0, 1000).first()[0] == -1


def test_at_most_four_sorts(store):
    s = store["Issue"]
    for p in ("name", "full", "size", "half", "deleted"):
        s = s.sort(p)
    assert sum(k.sort for k in s.order) == 4


def test_stability(store):
    plain = store.of_ids("Issue", [5, 3, 1])
    assert placed(plain.sort("deleted")) == [3, 1, 5]
    assert placed(plain.as_sort_result().sort("deleted")) == [3, 5, 1]
    assert placed(plain) == [5, 3, 1]


def test_link_sorts(store):
    some = store.find_ids("Issue", 0, 3)
    assert placed(some.sort_by_link("assignee", "login")) == [0, 1, 2, 3]
    assert placed(some.sort_by_link("assignee", "login", ascending=False)) == [2, 0, 1, 3]
    assert placed(some.sort_links("assignee", store.of_ids("User", [3, 2]))) == [2, 0, 1, 3]
    assert placed(some.sort_links("assignee", store.of_ids("User", [3, None, 2]))) == [2, 3, 0, 1]
    assert placed(some.sort_links("assignee", store.of_ids("User", []))) == [0, 1, 2, 3]


def test_hierarchy(store):
    assert store.query("Animal", Equals("name", "TOM")).size() == 2
    assert store["Animal"].intersect(store.query("Cat", Equals("lives", 9))).size() == 1
    assert store.query("Pet", Present("lives")).size() == 2
    m = store.model
    assert m.subtypes("Animal") == ["Cat", "Dog"] and m.supertypes("Cat") == ["Pet", "Animal"]
    assert m.is_a("Cat", "Pet") and m.narrower("Animal", "Dog") == "Dog" and m.narrower("Cat", "Dog") is None
    assert [t for t, _ in m.incoming("User")] == ["Issue", "User"]
    with pytest.raises(ValueError):
        Model([EntityType("a", parent="b"), EntityType("b", parent="a")])
    assert Model([EntityType("a", indices=(Index(("x",)),)), EntityType("b", parent="a")]).indices_of_field("b", "x")


def test_counts(store):
    s = store.query("Issue", Equals("name", "test issue #3"))
    assert s.size() == 10 and "test issue #3" in s.describe()
    assert not s.is_empty() and s.contains(0, 13) and not s.contains(0, 14)
    assert s.values("deleted").where("deleted IS NULL").count() == 0


def test_writes(spark, store):
    s = set_property(store, "Issue", "name", F.lit("X"), F.col("id") == 7)
    assert got(s.query("Issue", Equals("name", "x"))) == [7] and n(store, Equals("name", "x")) == 0
    assert delete_property(s, "Issue", "name").query("Issue", Present("name")).size() == 0
    s = delete_entities(store, "Issue", store.find_ids("Issue", 0, 0).df)
    assert s["Issue"].size() == 99 and s.edges("Issue", "assignee").count() == 2
    s = delete_entities(store, "User", store.find_ids("User", 2, 2).df)
    assert got(s.find_ids("Issue", 1, 1).select_distinct("assignee")) == [2]  # it dangles
    e = spark.createDataFrame([(1, 9), (1, 8)], "src long, dst long")
    assert got(add_links(store, "Issue", "assignee", e).links_from("Issue", 1, "assignee")) == [2, 8, 9]
    assert got(set_link(store, "Issue", "assignee", e).links_from("Issue", 1, "assignee")) == [8]
    assert got(set_link(store, "User", "boss", e).links_from("User", 1, "boss")) == [8]
    assert delete_links(store, "Issue", "assignee").query("Issue", HasLink("assignee")).size() == 0
    s = rename_type(store, "User", "Person")
    assert got(s.find_ids("Issue", 2, 2).select_distinct("assignee")) == [3] and s["User"].size() == 0
    assert delete_type(store, "User")["User"].size() == 0
    assert set_blob(store, "User", "cv", F.lit("é")).query("User", HasBlob("cv")).blob_sizes("cv").first()["size"] == 2
    new = spark.createDataFrame([(3, "three"), (77, "new")], "id long, login string")
    assert add_entities(store, "User", new)["User"].size() == 11
    assert {tuple(r) for r in unique_key_violations(store, "Issue", ["name"]).collect()} == {(f"Test issue #{k}", 10, False) for k in range(10)}
    assert unique_key_violations(store, "Issue", ["size", "full"]).isEmpty()


def test_links_between_types(spark):
    """Entities of two types with one id, and links that lead to either."""
    cats, dogs = (spark.createDataFrame([(1, x), (2, x + "2")], "id long, name string") for x in ("cat", "dog"))
    likes = spark.createDataFrame([("Cat", 1, "Dog", 1), ("Cat", 1, "Cat", 2), ("Dog", 1, "Cat", 1), ("Dog", 1, "Cat", 1), ("Dog", 2, "Dog", 2)], "src_type string, src long, dst_type string, dst long")
    boss = spark.createDataFrame([(1, 1, "Dog"), (2, 1, "Cat")], "id long, boss long, kind string")
    animal = EntityType("Animal", links=(Link("likes", "Animal", edges=likes, cardinality="0..n"), Link("liked", "Animal", opposite="likes", cardinality="0..n")), abstract=True)
    s = EntityStore(spark, [animal, EntityType("Cat", cats, "id", {"name": "name"}, parent="Animal"), EntityType("Dog", dogs, "id", {"name": "name"}, parent="Animal"), EntityType("Man", boss, "id", links=(Link("boss", "Animal", "boss", target_kind="kind", cardinality="1"),))])
    pairs = lambda x: sorted(map(tuple, x.df.select("type_id", "local_id").collect()))
    assert sorted(map(tuple, s["Animal"].with_sources("likes", distinct=False).collect()), key=str) == sorted([(2, 1, 1, 1), (1, 2, 1, 1), (1, 1, 2, 1), (2, 2, 2, 2), (None, None, 1, 2)], key=str)
    assert pairs(s["Animal"].find_links("likes", s.query("Cat"))) == [(1, 1), (2, 1)]
    assert pairs(s["Dog"].find_links("likes", s.query("Dog"))) == [(2, 2)] and pairs(s["Cat"].select_many_distinct("liked").exclude_null()) == [(1, 1), (2, 1)]
    assert pairs(s.query("Man", LinkTo("boss", Equals("name", "dog")))) == [(3, 1)] and pairs(s["Man"].select_distinct("boss")) == [(1, 1), (2, 1)]
    assert placed(s["Man"].sort_by_link("boss", "name", ascending=False)) == [1, 2]
    assert pairs(s.links_from("Animal", 1, "likes")) == [(1, 2), (2, 1)] and pairs(s.links_from("Dog", 1, "likes")) == [(1, 1)]
    assert [tuple(r) for r in s["Cat"].first_links("likes").where("local_id = 1").collect()] == [(1, 1, 1, 2)]
    assert {tuple(r) for r in s["Man"].linked_values("boss", "name").collect()} == {(3, 1, "dog"), (3, 2, "cat")}
    assert {(r.type_id, r.local_id, tuple(r.names)) for r in s["Animal"].names_present("l").collect()} == {(1, 1, ("liked", "likes")), (1, 2, ("liked",)), (2, 1, ("liked", "likes")), (2, 2, ("liked", "likes"))}
    assert {tuple(r) for r in s["Animal"].target_counts("likes").collect()} == {(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)}
    assert delete_entities(s, "Cat", s.find_ids("Cat", 1, 1).df)["Cat"].size() == 1
    assert link_violations(s, "Man").isEmpty() and s.model.link_names() == ["likes", "liked", "boss"]
    with pytest.raises(KeyError):
        s.entity("Cat", 3)
    with pytest.raises(ValueError):
        EntityStore(spark, [animal, EntityType("Cat", cats, "id", parent="Animal"), EntityType("Dog", dogs, "id", parent="Animal"), EntityType("Man", boss, "id", links=(Link("boss", "Animal", "boss"),))])["Man"].size()


def test_link_violations(spark, monkeypatch):
    """Against a count by hand: repeated and null ids, repeated edges, edges from nothing and to null, a type with a subtype."""
    r = random.Random(3)
    rows = {k: [(None if r.random() < 0.1 else r.randrange(30), r.choice([None, 1, 2])) for _ in range(40)] for k in ("Cat", "Lynx")}
    edges = [(r.choice(["Cat", "Lynx", "Gone"]), r.choice([None, *range(40)]), "Cat", r.choice([None, 1, 2, 3])) for _ in range(150)]
    ends = spark.createDataFrame(edges, "src_type string, src long, dst_type string, dst long")
    frames = {k: spark.createDataFrame(v, "id long, boss long") for k, v in rows.items()}
    kinds = {"likes": "1..n", "eats": "0..1", "sees": "0..n", "boss": "1"}
    links = (*[Link(k, "Cat", edges=ends, cardinality=kinds[k]) for k in ("likes", "eats", "sees")], Link("boss", "Man", "boss", cardinality="1"))
    s = EntityStore(spark, [EntityType("Man", spark.createDataFrame([(1,)], "id long"), "id"), EntityType("Cat", frames["Cat"], "id", links=links), EntityType("Lynx", frames["Lynx"], "id", parent="Cat")])
    want = set()
    for kind in rows:
        for i, times in Counter(i for i, _ in rows[kind]).items():
            targets = len({(t, d) for k, j, t, d in edges if (k, j) == (kind, i) and None not in (i, d)})
            bosses = sum(i is not None and (i, b) == (j, b) and b is not None for j, b in rows[kind])
            for link, n in (("likes", times * targets), ("eats", times * targets), ("boss", times * bosses)):
                if n < int(kinds[link][0]) or n > 1 and not kinds[link].endswith("n"):
                    want.add((s.model.ids[kind], i, link, n))
    assert {x[2] for x in want} == {"likes", "eats", "boss"} and any(x[1] is None for x in want)
    for most in (500_000, 7):
        monkeypatch.setattr(writes, "EDGES", most, raising=False)
        found = [tuple(x) for x in link_violations(s, "Cat").collect()]
        assert len(found) == len(want) and set(found) == want
    for kind in ("Cat", "Man"):
        assert link_violations(s, kind).dtypes == [("type_id", "int"), ("local_id", "bigint"), ("link", "string"), ("n", "bigint")]
    assert link_violations(s, "Man").isEmpty()


def test_link_violations_in_bounded_tasks(spark, monkeypatch):
    """No join or sort holds edges; they are dealt out by their number, whatever the session's partitions, and a link of any number isn't read."""
    edges = spark.range(5000).selectExpr("id % 900 AS src", "id AS dst")
    s = EntityStore(spark, [EntityType("A", spark.range(1000).toDF("id"), "id", links=(Link("b", "A", edges=edges), Link("any", "A", edges=edges.selectExpr("src", "raise_error('read') AS dst"), cardinality="0..n")))])
    monkeypatch.setattr(writes, "EDGES", 100, raising=False)
    df = link_violations(s, "A")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan and re.findall(r"hashpartitioning\(local_id#\d+L?, target#\d+L?, (\d+)\), REPARTITION", plan) == ["50"]
    assert plan.count("Exchange") == 2 and df.count() == 900


def test_insert_with_unique_keys(spark, store):
    users = store.model.types["User"]
    s = EntityStore(spark, [EntityType("User", users.df, "id", users.properties, indices=(Index(("login",)),))])
    row = lambda i, login: spark.createDataFrame([(i, login)], "id long, login string")
    assert insert_entities(s, "User", row(50, "new"))["User"].size() == 11 and insert_entities(s, "User", row(3, "user3"))["User"].size() == 10
    for wrong in (row(50, "USER4".lower()), row(50, None)):
        with pytest.raises(ValueError):
            insert_entities(s, "User", wrong)


def test_scratch_is_removed(spark):
    from graphloom.sources.shared import scratch, spool

    with scratch(spark):
        kept = spool(spark.range(5), "some")
        assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist"):
        kept.count()


def test_predicate_over_a_stream(spark, store, tmp_path):
    t = store.model.types["User"]
    t.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.df.schema).parquet(str(tmp_path / "in"))
    q = matching(stream, EntityType("User", None, "id", {"login": "login"}), StartsWith("login", "USER")).writeStream.format("memory").queryName("matched").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("matched").count() == 10


def test_explain_counts_every_node(store):
    rows = {r.place: r for r in store.explain("Issue", Equals("half", "d2") | LinkTo("assignee", ~Equals("login", "user1")) | LinkTo("nothing", Equals("x", 1))).collect()}
    assert [(rows[i].depth, rows[i].type, rows[i].node, rows[i].n) for i in range(len(rows))] == [
        (0, "Issue", "Or", 3), (1, "Issue", "Equals(name='half', value='d2')", 1), (1, "Issue", "LinkTo('assignee')", 3),
        (2, "User", "Not", 9), (3, "User", "Equals(name='login', value='user1')", 1), (1, "Issue", "LinkTo('nothing')", 0),
    ]


def test_cancelling(spark):
    slow = lambda: spark.range(0, 1 << 40, 1, 4).selectExpr("sum(hash(id) % 7)").collect()
    began = time.monotonic()
    with pytest.raises(Cancelled), cancelling(spark, lambda: time.monotonic() > began + 1, every=0.1):
        slow()
    assert time.monotonic() < began + 60
    with pytest.raises(Cancelled, match="lost"), cancelling(spark, lambda: {}["lost"], every=0.1):
        slow()
    with cancelling(spark, lambda: False, every=0.1):
        assert spark.range(10).count() == 10
    with pytest.raises(ZeroDivisionError), cancelling(spark, lambda: False):
        raise ZeroDivisionError
