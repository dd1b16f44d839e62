"""Changes to a store: each gives new frames, the old ones stay as they were."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import EntityType, Link
from .entities import ID, EntityStore

#: Edges that one task makes distinct.
EDGES = 500_000


def _changed(store: EntityStore, *types: EntityType) -> EntityStore:
    new = {t.name: t for t in types}
    return EntityStore(store.spark, [new.get(n, t) for n, t in store.model.types.items()])


def add_entities(store: EntityStore, name: str, rows: DataFrame) -> EntityStore:
    """Rows of the type's own frame; an id that is there already is replaced."""
    t = store.model.types[name]
    rest = t.df.join(rows.select(F.col(t.id_column).alias("i_")), F.col(t.id_column) == F.col("i_"), "left_anti")
    return _changed(store, replace(t, df=rest.unionByName(rows, allowMissingColumns=True)))


def delete_entities(store: EntityStore, name: str, ids: DataFrame) -> EntityStore:
    """Without the entities of ids(local_id): their properties, blobs and outgoing links go; links to them stay and dangle."""
    t = store.model.types[name]
    gone = ids.select(F.col("local_id").alias("i_")).distinct()
    own = lambda e: (F.col("src") == F.col("i_")) & (F.col("src_type") == name if "src_type" in e.columns else F.lit(True))
    links = tuple(replace(k, edges=k.edges.join(gone, own(k.edges), "left_anti")) if k.edges is not None else k for k in t.links)
    return _changed(store, replace(t, df=t.df.join(gone, F.col(t.id_column) == F.col("i_"), "left_anti"), links=links))


def set_property(store: EntityStore, name: str, prop: str, value: Column, where: Column | None = None) -> EntityStore:
    """A property (or, with null, its absence) where a condition over the type's frame holds."""
    t = store.model.types[name]
    column = t.properties.get(prop, F.lit(None))
    old = F.col(column) if isinstance(column, str) else column
    df = t.df.withColumn(f"set_{prop}", value if where is None else F.when(where, value).otherwise(old))
    return _changed(store, replace(t, df=df, properties=t.properties | {prop: f"set_{prop}"}))


def delete_property(store: EntityStore, name: str, prop: str) -> EntityStore:
    t = store.model.types[name]
    return _changed(store, replace(t, properties={p: c for p, c in t.properties.items() if p != prop}))


def set_blob(store: EntityStore, name: str, blob: str, value: Column) -> EntityStore:
    t = store.model.types[name]
    return _changed(store, replace(t, df=t.df.withColumn(f"set_{blob}", value), blobs=t.blobs | {blob: f"set_{blob}"}))


def delete_blob(store: EntityStore, name: str, blob: str) -> EntityStore:
    t = store.model.types[name]
    return _changed(store, replace(t, blobs={b: c for b, c in t.blobs.items() if b != blob}))


def _ends(link: Link) -> list[str]:
    return [c for c in ("src_type", "src", "dst_type", "dst") if c in link.edges.columns]


def add_links(store: EntityStore, name: str, link: str, edges: DataFrame) -> EntityStore:
    """Edges (src, dst) of a multiple link; those that are there already change nothing."""
    t = store.model.types[name]
    links = tuple(replace(k, edges=k.edges.select(*_ends(k)).unionByName(edges.select(*_ends(k))).distinct()) if k.name == link else k for k in t.links)
    return _changed(store, replace(t, links=links))


def set_link(store: EntityStore, name: str, link: str, edges: DataFrame) -> EntityStore:
    """Edges (src, dst) in place of whatever their sources had; of several for one source the least."""
    t = store.model.types[name]
    one = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    old = next(k for k in t.links if k.name == link)
    if old.edges is not None:
        new = replace(old, edges=old.edges.select("src", "dst").join(one.select(F.col("src").alias("s_")), F.col("src") == F.col("s_"), "left_anti").unionByName(one))
        return _changed(store, replace(t, links=tuple(new if k is old else k for k in t.links)))
    column = F.col(old.column) if isinstance(old.column, str) else old.column
    df = t.df.join(one.select(F.col("src").alias("s_"), F.col("dst").alias("d_")), F.col(t.id_column) == F.col("s_"), "left")
    df = df.withColumn(f"set_{link}", F.coalesce("d_", column.cast("bigint"))).drop("s_", "d_")
    return _changed(store, replace(t, df=df, links=tuple(replace(old, column=f"set_{link}") if k is old else k for k in t.links)))


def delete_links(store: EntityStore, name: str, link: str, edges: DataFrame | None = None) -> EntityStore:
    """Without these edges (src, dst) of a multiple link, or without the link."""
    t = store.model.types[name]
    if edges is None:
        return _changed(store, replace(t, links=tuple(k for k in t.links if k.name != link)))
    gone = edges.select(F.col("src").alias("s_"), F.col("dst").alias("d_"))
    links = tuple(replace(k, edges=k.edges.join(gone, (F.col("src") == F.col("s_")) & (F.col("dst") == F.col("d_")), "left_anti")) if k.name == link else k for k in t.links)
    return _changed(store, replace(t, links=links))


def rename_type(store: EntityStore, old: str, new: str) -> EntityStore:
    """Under a new name; its id, and what links or inherits from it, stay."""
    types = []
    for t in store.model.types.values():
        t = replace(t, name=new if t.name == old else t.name, parent=new if t.parent == old else t.parent, interfaces=tuple(new if i == old else i for i in t.interfaces))
        types.append(replace(t, links=tuple(replace(k, target=new) if k.target == old else k for k in t.links)))
    return EntityStore(store.spark, types)


def delete_type(store: EntityStore, name: str) -> EntityStore:
    """The type's entities go; its id isn't given to another."""
    return _changed(store, EntityType(name))


def unique_key_violations(store: EntityStore, name: str, fields: Sequence[str]) -> DataFrame:
    """Key values that come more than once over a type and its subtypes, or have a null: the fields, how often, and which it is."""
    df = store.query(name).values(*fields)
    null = F.greatest(*[F.col(f).isNull() for f in fields]) if len(fields) > 1 else F.col(fields[0]).isNull()
    return df.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).withColumn("has_null", null).where("n > 1 OR has_null")


def insert_entities(store: EntityStore, name: str, rows: DataFrame) -> EntityStore:
    """Rows of the type's own frame, by add_entities, which may also change entities; an error if a unique key of the type then comes twice or has a null."""
    changed = add_entities(store, name, rows)
    for index in store.model.indices(name):
        top = next((t for t in (*reversed(store.model.supertypes(name)), name) if index in store.model.types[t].indices), name)
        if not unique_key_violations(changed, top, index.fields).isEmpty():
            raise ValueError(f"{name}: {', '.join(index.fields)} must be unique and not null")
    return changed


def _dealt(edges: DataFrame) -> DataFrame:
    """Equal edges in one task, and no more than about EDGES edges in each, however many there are; they are counted first."""
    n = -(-edges.count() // EDGES)
    return edges.repartition(max(n, edges.sparkSession.sparkContext.defaultParallelism), "local_id", "target")  # types may be constants, by which Spark would deal again


def link_violations(store: EntityStore, name: str) -> DataFrame:
    """type_id, local_id, link and n of the entities that have fewer or more targets of a link than its cardinality says.

    Repeated edges of a frame count once, those to null not at all; rows that share an id multiply its count.  Nothing is joined or sorted: edges
    are made distinct dealt out by both ends, and counted by source before they meet the entities.  A link that may have any number isn't read.
    """
    links = [k for k in store.model.links(name).values() if k.cardinality != "0..n"]
    if not links:
        return store.empty().df.select(*ID, F.lit("").alias("link"), F.lit(0).cast("bigint").alias("n"))
    own, frame, found = store[name].df, store.frame(name), [f"n{i}" for i in range(len(links))]
    linked = lambda k: F.lit(0) if frame.fk(k.name) is None else (frame.fk(k.name).isNotNull() & F.col("local_id").isNotNull()).cast("int")
    parts = [own.select(*ID, F.lit(1).alias("rows"), *[linked(k).alias(c) for c, k in zip(found, links, strict=True)])]
    for c, link in zip(found, links, strict=True):
        for edges in store.edge_frames(name, link.name):
            edges = _dealt(edges.where("type_id IS NOT NULL AND local_id IS NOT NULL AND target IS NOT NULL")).distinct()
            parts.append(edges.select(*ID, F.lit(0).alias("rows"), *[F.lit(int(d == c)).alias(d) for d in found]))
    total = reduce(DataFrame.unionByName, parts).groupBy(*ID).agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in found]).where("rows > 0")
    wrong = []
    for c, link in zip(found, links, strict=True):
        n = F.col("rows") * F.col(c)
        outside = (n < int(link.cardinality[0])) | (F.lit(False) if link.cardinality.endswith("n") else n > 1)
        wrong.append(F.when(outside, F.struct(F.lit(link.name).alias("link"), n.alias("n"))))
    return total.select(*ID, F.inline(F.array_compact(F.array(*wrong))))
