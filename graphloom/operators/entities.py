"""Entity stores and entity sets: ordered sets of ids, compiled to DataFrame plans.

An EntitySet stays a predicate over its type's frame as long as it can: intersecting, uniting or subtracting two such sets of one type combines
their conditions into one filter, without a join.  Otherwise the operators are semi- and anti-joins on (type_id, local_id).  Order is a list of
keys carried beside the rows; nothing is sorted until positions are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fold, normal
from ..plans import predicates as P
from ..plans.model import EntityType, Link, Model
from ..plans.order import BY_ID, Key, expressions, flipped, prepended
from ..sources.shared import spool

ID = ("type_id", "local_id")
#: Rows that one task may number.
FEW = 1_000_000
ID_SCHEMA = "type_id int, local_id bigint"


class Frame:
    """A type with its subtypes as one DataFrame: type_id, local_id, p_<property>, b_<blob>, l_<link> and k_<link>, the type that it leads to."""

    def __init__(self, store: EntityStore, name: str):
        self.store, self.name = store, name
        model = store.model
        self.names = model.with_subtypes(name) if name in model.types else []
        frames = [self._one(model.types[n]) for n in self.names]
        empty = store.spark.createDataFrame([], ID_SCHEMA)
        self.df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else empty

    def _one(self, t: EntityType) -> DataFrame:
        model = self.store.model
        lineage = [model.types[n] for n in (t.name, *model.supertypes(t.name)) if n in model.types]
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        out: dict[str, Column] = {}
        for u in lineage:
            for p, c in u.properties.items():
                out.setdefault(f"p_{p}", as_column(c))
            for b, c in u.blobs.items():
                out.setdefault(f"b_{b}", as_column(c))
        for link in model.links(t.name).values():
            if link.column is not None:
                out[f"l_{link.name}"] = as_column(link.column).cast("bigint")
                kind = F.lit(self.store.only(link)).cast("int") if link.target_kind is None else model.id_of(as_column(link.target_kind))
                out[f"k_{link.name}"] = F.when(out[f"l_{link.name}"].isNotNull(), kind)
        df = t.df.select(F.lit(model.ids[t.name]).alias("type_id"), F.col(t.id_column).cast("bigint").alias("local_id"), *[c.alias(n) for n, c in out.items()])
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return df.withColumns({n: normal(F.col(n), kinds[n]) for n in out if n.startswith("p_") and isinstance(kinds[n], (T.BooleanType, T.ArrayType))})

    @cached_property
    def kinds(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}

    def kind(self, prop: str) -> T.DataType | None:
        return self.kinds.get(f"p_{prop}")

    def prop(self, name: str) -> Column:
        return F.col(f"p_{name}")

    def blob(self, name: str) -> Column | None:
        return F.col(f"b_{name}") if f"b_{name}" in self.kinds else None

    def link(self, name: str) -> Link | None:
        for n in (self.name, *self.names):
            if n in self.store.model.types and (found := self.store.model.links(n).get(name)):
                return found
        return None

    def fk(self, name: str) -> Column | None:
        return F.col(f"l_{name}") if f"l_{name}" in self.kinds else None


class EntityStore:
    """A model over a Spark session.  Unknown types, properties and links are empty, never an error."""

    def __init__(self, spark: SparkSession, types: Iterable[EntityType]):
        self.spark, self.model = spark, Model(types)
        self._frames: dict[str, Frame] = {}

    def frame(self, name: str) -> Frame:
        if name not in self._frames:
            self._frames[name] = Frame(self, name)
        return self._frames[name]

    def __getitem__(self, name: str) -> EntitySet:
        return self.query(name)

    def query(self, name: str, predicate: P.Predicate | None = None) -> EntitySet:
        """The entities of a type and its subtypes for which the predicate holds; by id."""
        frame, predicate = self.frame(name), predicate or P.All()
        condition = predicate.column(frame)
        if condition is not None:
            return EntitySet(self, name, frame.df.where(condition), predicate=predicate, full=True)
        return self._joined(name, predicate)

    def explain(self, name: str, predicate: P.Predicate) -> DataFrame:
        """One row for each node of a predicate's tree, parents first: place, depth, type, node, and how many entities of the type it holds for.

        Nodes that are filters are counted together, in one scan of each type; the others by one join each.
        """
        nodes: list[tuple[int, int, str, P.Predicate]] = []

        def walk(kind: str, p: P.Predicate, depth: int) -> None:
            nodes.append((len(nodes), depth, kind, p))
            link = self.frame(kind).link(p.link) if isinstance(p, P.LinkTo) else None
            for child in () if isinstance(p, P.LinkTo) and link is None else p.children():
                walk(link.target if link else kind, child, depth + 1)

        walk(name, predicate, 0)
        row = lambda at, depth, kind, p, n: F.struct(F.lit(at).alias("place"), F.lit(depth).alias("depth"), F.lit(kind).alias("type"), F.lit(p.label()).alias("node"), n.alias("n"))
        parts = []
        for kind in dict.fromkeys(k for _, _, k, _ in nodes):
            frame = self.frame(kind)
            own = [(x, x[3].column(frame)) for x in nodes if x[2] == kind]
            plain = [(x, c) for x, c in own if c is not None]
            if plain:
                counts = frame.df.agg(*[F.count_if(c).alias(f"n{x[0]}") for x, c in plain])
                parts.append(counts.select(F.inline(F.array(*[row(*x, F.col(f"n{x[0]}")) for x, _ in plain]))))
            parts += [self.query(kind, x[3]).size_frame().select(F.inline(F.array(row(*x, F.col("size"))))) for x, c in own if c is None]
        return reduce(DataFrame.unionByName, parts)

    def _joined(self, name: str, p: P.Predicate) -> EntitySet:
        if isinstance(p, P.And):
            plain = [x for x in p.parts if x.column(self.frame(name)) is not None]
            rest = [x for x in p.parts if x.column(self.frame(name)) is None]
            # what a filter can do comes first, so that joins see fewer rows; a negated part is subtracted, not complemented
            out = self.query(name, reduce(P.both, plain, P.All()))
            for x in rest:
                out = out.minus(self.query(name, x.inner)) if isinstance(x, P.Not) else out.intersect(self.query(name, x))
            return out
        if isinstance(p, P.Or):
            return reduce(lambda a, b: a.union(b), [self.query(name, x) for x in p.parts])
        if isinstance(p, P.Not):
            return self.query(name).minus(self.query(name, p.inner))
        if isinstance(p, P.LinkTo):
            link = self.frame(name).link(p.link)
            return self.query(name).find_links(p.link, self.query(link.target, p.inner))
        if isinstance(p, P.HasLink):
            return self.query(name)._sources(self.edges(name, p.link))
        if isinstance(p, P.LinkIs) and p.target is None:
            return self.query(name).minus(self.query(name, P.HasLink(p.link)))
        targets = p.targets if isinstance(p, P.LinkIn) else (p.target,)
        return self.query(name)._sources(self.edges(name, p.link).where(F.col("target").isin(*targets)))

    def only(self, link: Link) -> int:
        """The id of the one type that a link leads to."""
        names = self.model.with_subtypes(link.target) or [link.target]
        if len(names) > 1:
            raise ValueError(f"link {link.name} leads to several types: name them")
        return self.model.ids.get(names[0], -1)

    def edges(self, name: str, link: str, distinct: bool = False) -> DataFrame:
        """(type_id, local_id, target_type, target) of a link of a type and its subtypes; distinct: without repeats that a frame of edges has."""
        frame, parts = self.frame(name), []
        if frame.fk(link) is not None:
            parts.append(frame.df.select(*ID, F.col(f"k_{link}").alias("target_type"), frame.fk(link).alias("target")).where("target IS NOT NULL"))
        more = self.edge_frames(name, link)
        if not parts and not more:
            return self.spark.createDataFrame([], ID_SCHEMA + ", target_type int, target bigint")
        return reduce(DataFrame.unionByName, parts + [e.distinct() for e in more] if distinct else parts + more)

    def edge_frames(self, name: str, link: str) -> list[DataFrame]:
        """The edges of a link that are frames, not a column, as edges gives them; repeats stay."""
        owners: dict[int, tuple[Link, list[str]]] = {}
        for n in self.frame(name).names:
            found = self.model.links(n).get(link)
            if found is not None and found.multiple:
                owners.setdefault(id(found), (found, []))[1].append(n)
        return [self._edges(found, names) for found, names in owners.values()]

    def _edges(self, link: Link, names: list[str]) -> DataFrame:
        if link.opposite is not None:
            back = self.edges(link.target, link.opposite)
            own = back.select(F.col("target_type").alias("type_id"), F.col("target").alias("local_id"), F.col("type_id").alias("target_type"), F.col("local_id").alias("target"))
            return own.where(F.col("type_id").isin(*[self.model.ids[n] for n in names]))
        e = link.edges
        if "src_type" not in e.columns and len(names) > 1:
            raise ValueError(f"link {link.name} is of several types: name them")
        source = self.model.id_of(F.col("src_type")) if "src_type" in e.columns else F.lit(self.model.ids[names[0]]).cast("int")
        target = self.model.id_of(F.col("dst_type")) if "dst_type" in e.columns else F.lit(self.only(link)).cast("int")
        e = e.where("src_type IN (" + ", ".join(f"'{n}'" for n in names) + ")") if "src_type" in e.columns else e
        return e.where("dst IS NOT NULL").select(source.alias("type_id"), F.col("src").cast("bigint").alias("local_id"), target.alias("target_type"), F.col("dst").cast("bigint").alias("target"))

    # --- sources ---

    def find_ids(self, name: str, low: int, high: int) -> EntitySet:
        return self.query(name, P.IdBetween(low, high))

    def single(self, type_name: str | None, local_id: int | None) -> EntitySet:
        """One element, which may be the null one."""
        row = [(self.model.ids.get(type_name) if local_id is not None else None, local_id)]
        return EntitySet(self, type_name or "", self.spark.createDataFrame(row, ID_SCHEMA))

    def of_ids(self, name: str, ids: Sequence[int | None]) -> EntitySet:
        """These entities, in this order, repeats kept."""
        rows = [(None if i is None else self.model.ids[name], i, n) for n, i in enumerate(ids)]
        return EntitySet(self, name, self.spark.createDataFrame(rows, ID_SCHEMA + ", given bigint"), (Key("given"),))

    def empty(self, name: str = "") -> EntitySet:
        return EntitySet(self, name, self.spark.createDataFrame([], ID_SCHEMA))

    def with_property_sorted(self, name: str, prop: str) -> EntitySet:
        """Entities that have the property, ascending by folded value; a set counts once for each item."""
        frame = self.frame(name)
        kind = frame.kind(prop)
        if kind is None:
            return self.empty(name)
        value = fold(frame.prop(prop), kind)
        value = F.explode(value) if isinstance(kind, T.ArrayType) else value
        df = frame.df.where(frame.prop(prop).isNotNull()).select(*ID, value.alias("value"))
        return EntitySet(self, name, df, (Key("value", sort=True), *BY_ID), sort_result=True)

    def _of_one(self, name: str, local_id: int, link: str) -> DataFrame:
        """Edges of one entity: of a type with subtypes, the one whose type comes first."""
        edges = self.edges(name, link, True).where(F.col("local_id") == local_id)
        if len(self.frame(name).names) < 2:
            return edges
        first = self.frame(name).df.where(F.col("local_id") == local_id).agg(F.min("type_id").alias("first"))
        return edges.join(F.broadcast(first), F.col("type_id") == F.col("first")).drop("first")  # one row

    def links_from(self, name: str, local_id: int, link: str) -> EntitySet:
        """Targets of one entity's link."""
        found = self.frame(name).link(link)
        if found is None:
            return self.empty()
        return EntitySet(self, found.target, self._of_one(name, local_id, link).select(F.col("target_type").alias("type_id"), F.col("target").alias("local_id")))

    def links_from_set(self, name: str, local_id: int, links: Sequence[str]) -> EntitySet:
        """Targets over several links, once each, with the first of the links that leads there as `link`."""
        frame, parts = self.frame(name), []
        for n, link in enumerate(links):
            if frame.link(link):
                parts.append(self._of_one(name, local_id, link).select(F.col("target_type").alias("type_id"), F.col("target").alias("local_id"), F.lit(n).alias("n"), F.lit(link).alias("link")))
        if not parts:
            return self.empty()
        df = reduce(DataFrame.unionByName, parts).groupBy(*ID).agg(F.min_by("link", "n").alias("link"))
        return EntitySet(self, name, df)

    def entity(self, type_name: str, local_id: int) -> DataFrame:
        """The one row of an entity, all its columns; an error if there is none."""
        found = self.frame(type_name).df.where(F.col("local_id") == local_id)
        if found.isEmpty():
            raise KeyError(f"no {type_name} {local_id}")
        return found

    def catalog(self) -> DataFrame:
        """type_id, name, parent and how many entities each type has of its own."""
        sizes = self.spark.createDataFrame([], "type_id int, size bigint")
        for name, t in self.model.types.items():
            if t.df is not None:
                sizes = sizes.unionByName(t.df.agg(F.lit(self.model.ids[name]).cast("int").alias("type_id"), F.count(F.lit(1)).alias("size")))
        types = self.spark.createDataFrame([(self.model.ids[n], n, t.parent) for n, t in self.model.types.items()], "type_id int, name string, parent string")
        return types.join(sizes, "type_id", "left").select("type_id", "name", "parent", F.coalesce("size", F.lit(0)).alias("size"))

    def merge_sorted(self, sets: Sequence[EntitySet], value: str | Sequence[Column], ascending: bool = True) -> EntitySet:
        """Sets of any types as one, by a property that each has under this name, or by a key each: an expression over the type's columns."""
        parts = []
        for n, s in enumerate(sets):
            frame = self.frame(s.type)
            own = [f"p_{value}"] if isinstance(value, str) else [c for c in frame.kinds if c not in ID]
            key = fold(F.col(f"p_{value}"), frame.kind(value)) if isinstance(value, str) else value[n]
            parts.append(s._with(*own).select(*ID, key.alias("merged")))
        return EntitySet(self, "", reduce(DataFrame.unionByName, parts), (Key("merged", ascending, sort=True), *BY_ID), sort_result=True)


@dataclass(frozen=True)
class EntitySet:
    """Rows (type_id, local_id) of df in the order of its keys; `full` says that df has all columns of the type's frame."""

    store: EntityStore
    type: str
    df: DataFrame
    order: tuple[Key, ...] = BY_ID
    sort_result: bool = False
    predicate: P.Predicate | None = None
    full: bool = False
    few: bool = False  # a take or a page of no more than FEW

    # --- plumbing ---

    def _keys(self) -> list[str]:
        return [k.column for k in self.order if k.column not in ID]

    def _set(self, df: DataFrame, order: tuple[Key, ...] = BY_ID, **more: Any) -> EntitySet:
        return replace(self, df=df, order=order, predicate=None, **{"full": False, "few": False} | more)

    @cached_property
    def ids(self) -> DataFrame:
        return self.df.select(*ID, *self._keys())

    def _fresh(self, prefix: str = "k") -> str:
        n = 0
        while f"{prefix}{n}" in self.df.columns:
            n += 1
        return f"{prefix}{n}"

    def _with(self, *columns: str) -> DataFrame:
        """ids with these columns of the type's frame; null where an id isn't among the type's entities."""
        frame = self.store.frame(self.type)
        have = [c for c in columns if c in frame.kinds]
        missing = [F.lit(None).alias(c) for c in columns if c not in frame.kinds]
        if self.full:
            return self.df.select(*ID, *self._keys(), *have, *missing)
        if not have:
            return self.ids.select("*", *missing)
        side = frame.df.select(F.col("type_id").alias("t_"), F.col("local_id").alias("i_"), *have)
        return self.ids.join(side, (F.col("type_id") == F.col("t_")) & (F.col("local_id") == F.col("i_")), "left").select(*ID, *self._keys(), *have, *missing)

    def _same(self, other: EntitySet) -> bool:
        return self.predicate is not None and other.predicate is not None and self.type == other.type and self.order == BY_ID == other.order

    def _match(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Join on ids, the null element being equal to itself."""
        r = right.select(F.col("type_id").alias("t_"), F.col("local_id").alias("i_"))
        return left.join(r, F.col("type_id").eqNullSafe(F.col("t_")) & F.col("local_id").eqNullSafe(F.col("i_")), how)

    def _sources(self, ids: DataFrame) -> EntitySet:
        r = ids.select(F.col("type_id").alias("t_"), F.col("local_id").alias("i_"))
        return replace(self, df=self.df.join(r, (F.col("type_id") == F.col("t_")) & (F.col("local_id") == F.col("i_")), "left_semi"), predicate=None)

    # --- set operators ---

    def intersect(self, other: EntitySet) -> EntitySet:
        """Elements of both, by id.  Of two types in one hierarchy the narrower is asked."""
        name = self.store.model.narrower(self.type, other.type) if self.type in self.store.model.types and other.type in self.store.model.types else None
        if self.predicate is not None and other.predicate is not None and name and self.order == BY_ID == other.order:
            return self.store.query(name, P.both(self.predicate, other.predicate))
        out = replace(self, df=self._match(self.df, other.df, "left_semi"), predicate=None, order=BY_ID, sort_result=False)
        return replace(out, type=name or self.type, full=self.full and (name or self.type) == self.type)

    def intersect_saving_order(self, other: EntitySet) -> EntitySet:
        """Elements of both, in the other's order."""
        return replace(other, df=self._match(other.df, self.df, "left_semi"), predicate=None)

    def union(self, other: EntitySet) -> EntitySet:
        """Elements of either, once, by id."""
        if self._same(other):
            return self.store.query(self.type, P.either(self.predicate, other.predicate))
        return self._set(self.df.select(*ID).unionByName(other.df.select(*ID)).distinct(), sort_result=False)

    def minus(self, other: EntitySet) -> EntitySet:
        """Elements of this one that the other lacks; order and repeats stay."""
        if self._same(other):
            return self.store.query(self.type, P.both(self.predicate, ~other.predicate))
        return replace(self, df=self._match(self.df, other.df, "left_anti"), predicate=None)

    def concat(self, other: EntitySet) -> EntitySet:
        """This one, then the other, each in its own order, repeats kept."""
        keys: list[Key] = [Key("branch")]
        frames = []
        for n, s in enumerate((self, other)):
            own = s.ids.select(*ID, F.lit(n).alias("branch"), *[F.col(k.column).alias(f"o{n}_{i}") for i, k in enumerate(s.order)])
            keys += [replace(k, column=f"o{n}_{i}", sort=False) for i, k in enumerate(s.order)]
            frames.append(own)
        return self._set(frames[0].unionByName(frames[1], allowMissingColumns=True), tuple(keys), sort_result=False)

    def distinct(self) -> EntitySet:
        """The first of each element's places."""
        if self.predicate is not None:
            return self
        if self.order == BY_ID:
            return self._set(self.df.select(*ID).distinct(), sort_result=self.sort_result)
        first = W.partitionBy(*ID).orderBy(*expressions(self.order))
        return self._set(self.ids.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_"), self.order)

    def exclude_null(self) -> EntitySet:
        return replace(self, df=self.df.where("local_id IS NOT NULL"))

    def add_null_of(self, other: EntitySet) -> EntitySet:
        """This one, and behind it the null element if the other has it and this one hasn't."""
        null = lambda s: s.df.where("local_id IS NULL").select(F.lit(None).cast("int").alias("type_id"), F.lit(None).cast("bigint").alias("local_id")).limit(1)
        more = null(other).join(null(self).select(F.lit(1).alias("has")), F.lit(True), "left_anti")
        df = self.ids.withColumn("last_", F.lit(0)).unionByName(more.withColumn("last_", F.lit(1)), allowMissingColumns=True)
        return self._set(df, (Key("last_"), *self.order))

    def of_type(self, name: str) -> EntitySet:
        """Elements of one type, and the null element."""
        return replace(self, df=self.df.where(F.col("local_id").isNull() | (F.col("type_id") == self.store.model.ids.get(name, -1))), predicate=None)

    # --- links ---

    def find_links(self, link: str, targets: EntitySet) -> EntitySet:
        """Elements whose link leads to one of the targets.  Spark broadcasts the targets if their size allows."""
        found = self.store.frame(self.type).link(link)
        if found is None:
            return replace(self, df=self.df.where(F.lit(False)), predicate=None)
        t = targets.df.select(F.col("type_id").alias("t_"), F.col("local_id").alias("i_"))
        fk = self.store.frame(self.type).fk(link)
        if fk is not None and self.full and not any(self.store.model.links(n)[link].multiple for n in self.store.frame(self.type).names if link in self.store.model.links(n)):
            return replace(self, df=self.df.join(t, (F.col(f"k_{link}") == F.col("t_")) & (fk == F.col("i_")), "left_semi"), predicate=None)
        edges = self.store.edges(self.type, link)
        return self._sources(edges.join(t, (F.col("target_type") == F.col("t_")) & (F.col("target") == F.col("i_")), "left_semi"))

    def _targets(self, link: str, how: str, first: bool) -> DataFrame:
        """(type_id, local_id, source_type, source_id) along a link: the first target of each source, or all."""
        sources = self.df.select(F.col("type_id").alias("source_type"), F.col("local_id").alias("source_id"))
        edges = self.store.edges(self.type, link, not first).select(F.col("type_id").alias("t_"), F.col("local_id").alias("s_"), "target_type", "target")
        found = self.store.frame(self.type).link(link)
        if first and found is not None and found.multiple:
            edges = edges.groupBy("t_", "s_").agg(F.min(F.struct("target_type", "target")).alias("x")).select("t_", "s_", "x.*")
        out = sources.join(edges, (F.col("source_type") == F.col("t_")) & (F.col("source_id") == F.col("s_")), how)
        return out.select(F.col("target_type").alias("type_id"), F.col("target").alias("local_id"), "source_type", "source_id")

    def _along(self, df: DataFrame, link: str) -> EntitySet:
        found = self.store.frame(self.type).link(link)
        return EntitySet(self.store, found.target if found else "", df)

    def select_distinct(self, link: str) -> EntitySet:
        """The sources' first (least) targets, once each, and the null element if some source has none."""
        return self._along(self._targets(link, "left", True).select(*ID).distinct(), link)

    def select_many_distinct(self, link: str) -> EntitySet:
        """All targets, once each, and the null element if some source has none; of an unknown link nothing."""
        how = "left" if self.store.frame(self.type).link(link) else "inner"
        return self._along(self._targets(link, how, False).select(*ID).distinct(), link)

    def select_many(self, link: str) -> EntitySet:
        """All targets of all sources, repeats kept, and a null element for each source without one."""
        return self._along(self._targets(link, "left", False).select(*ID), link)

    def select_linked(self, link: str) -> EntitySet:
        """First targets once each, without the null element."""
        return self._along(self._targets(link, "inner", True).select(*ID).distinct(), link)

    def with_sources(self, link: str, many: bool = True, distinct: bool = True) -> DataFrame:
        """Targets with where each comes from: the least (source_type, source_id) that leads to it, or, not distinct, one row for each source."""
        t = self._targets(link, "left", not many)
        if not distinct:
            return t
        return t.groupBy(*ID).agg(F.min(F.struct("source_type", "source_id")).alias("x")).select(*ID, "x.*")

    def first_links(self, link: str) -> DataFrame:
        """ids with the first (least) target of each, null without one: target_type, target."""
        t = self._targets(link, "left", True)
        return t.select(F.col("source_type").alias("type_id"), F.col("source_id").alias("local_id"), F.col("type_id").alias("target_type"), F.col("local_id").alias("target"))

    def linked_values(self, link: str, *names: str) -> DataFrame:
        """ids with properties of the first linked entity."""
        found = self.store.frame(self.type).link(link)
        target = self.store[found.target].values(*names) if found else self.store.empty().values(*names)
        target = target.select(F.col("type_id").alias("t_"), F.col("local_id").alias("i_"), *names)
        out = self.first_links(link).join(target, (F.col("target_type") == F.col("t_")) & (F.col("target") == F.col("i_")), "left")
        return out.select(*ID, *names)

    # --- order ---

    def sort(self, prop: str, ascending: bool = True, stable: bool | None = None) -> EntitySet:
        """By a property, folded, nulls last either way.  Ties keep this set's order if it is a sort's result (or stable is given), else id order."""
        kind = self.store.frame(self.type).kind(prop)
        if kind is None:
            return self
        name = self._fresh()
        df = self._with(f"p_{prop}").withColumn(name, fold(F.col(f"p_{prop}"), kind)).drop(f"p_{prop}")
        return self._sorted(df, Key(name, ascending, sort=True), stable)

    def _sorted(self, df: DataFrame, key: Key, stable: bool | None) -> EntitySet:
        keep = self.sort_result if stable is None else stable
        return self._set(df, prepended(key, self.order if keep else BY_ID), sort_result=True)

    def sort_by(self, key: Column, ascending: bool = True, stable: bool | None = None) -> EntitySet:
        """By an expression over the type's columns (p_<property>, b_<blob>, l_<link>)."""
        name = self._fresh()
        frame = self.store.frame(self.type)
        own = [c for c in frame.kinds if c not in ID]
        df = self._with(*own).withColumn(name, key).drop(*own)
        return self._sorted(df, Key(name, ascending, sort=True), stable)

    def sort_by_link(self, link: str, prop: str, ascending: bool = True) -> EntitySet:
        """By a property of the linked entity: the least over several links, descending the greatest; without one last."""
        found = self.store.frame(self.type).link(link)
        kind = self.store.frame(found.target).kind(prop) if found else None
        if kind is None:
            return self
        target = self.store.frame(found.target)
        values = target.df.select(F.col("type_id").alias("vt_"), F.col("local_id").alias("vi_"), fold(target.prop(prop), kind).alias("v_"))
        name = self._fresh()
        edges = self.store.edges(self.type, link).select(F.col("type_id").alias("t_"), F.col("local_id").alias("s_"), "target_type", "target")
        edges = edges.join(values, (F.col("target_type") == F.col("vt_")) & (F.col("target") == F.col("vi_")))
        best = edges.groupBy("t_", "s_").agg((F.min("v_") if ascending else F.max("v_")).alias(name)) if found.multiple else edges.select("t_", "s_", F.col("v_").alias(name))
        df = self.ids.join(best, (F.col("type_id") == F.col("t_")) & (F.col("local_id") == F.col("s_")), "left").drop("t_", "s_")
        return self._sorted(df, Key(name, ascending, sort=True), self.sort_result)

    def sort_links(self, link: str, targets: EntitySet) -> EntitySet:
        """By the place of the linked entity among the targets, in this set's order within it; without a link at the place of null, or last."""
        ranked = targets.positions("rank_").select(F.col("type_id").alias("rt_"), F.col("local_id").alias("i_"), "rank_").groupBy("rt_", "i_").agg(F.min("rank_").alias("rank_"))
        name = self._fresh()
        edges = self.store.edges(self.type, link).select(F.col("type_id").alias("t_"), F.col("local_id").alias("s_"), "target_type", "target")
        # one row a source: the best rank, null if it has links but none of them is ranked
        rank = edges.join(ranked, (F.col("target_type") == F.col("rt_")) & (F.col("target") == F.col("i_")), "left").groupBy("t_", "s_").agg(F.min("rank_").alias("r_"))
        null = ranked.where("i_ IS NULL").agg(F.min("rank_").alias("null_rank"))
        df = self.ids.join(rank, (F.col("type_id") == F.col("t_")) & (F.col("local_id") == F.col("s_")), "left").join(F.broadcast(null))  # one row
        df = df.withColumn(name, F.when(F.col("s_").isNull(), F.col("null_rank")).otherwise(F.col("r_"))).drop("t_", "s_", "r_", "null_rank")
        return self._set(df, prepended(Key(name, sort=True), self.order), sort_result=True)

    def as_sort_result(self) -> EntitySet:
        return replace(self, sort_result=True)

    def reverse(self) -> EntitySet:
        """The exact reversal: directions and null places flip."""
        return replace(self, order=flipped(self.order), predicate=None)

    def take(self, n: int) -> EntitySet:
        if n <= 0:
            return self._set(self.ids.where(F.lit(False)), self.order)
        return self._set(self.ids.orderBy(*expressions(self.order)).limit(n), self.order, few=n <= FEW)

    def skip(self, n: int) -> EntitySet:
        if n <= 0:
            return self
        return self._set(self.positions("skip_").where(F.col("skip_") >= n).drop("skip_"), self.order)

    def page(self, skip: int, take: int) -> EntitySet:
        """take(skip + take), then skip: sorts in bounded memory."""
        return self._set(self.ids.orderBy(*expressions(self.order)).limit(max(0, skip) + take).offset(max(0, skip)), self.order, few=take <= FEW)

    def first(self) -> EntitySet:
        return self.take(1)

    def last(self) -> EntitySet:
        return self.reverse().take(1)

    def positions(self, name: str = "pos") -> DataFrame:
        """ids, order keys and each row's place from 0.

        Sorted in ranges of the keys; a row's place is its place in its range after the rows of the ranges before, a table of one row a range.
        A take or a page, being in one partition, is numbered there.
        """
        keys = expressions(self.order)
        if self.few:
            return self.ids.withColumn(name, (F.row_number().over(W.orderBy(*keys)) - 1).cast("bigint"))
        n = int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = self.ids.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = spool(ranged.select("*", F.spark_partition_id().alias("range_"), local.alias("at_")), "positions")
        before = W.orderBy("r_").rowsBetween(W.unboundedPreceding, -1)
        starts = placed.groupBy(F.col("range_").alias("r_")).agg(F.count(F.lit(1)).alias("n_")).select("r_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
        return placed.join(starts, F.col("range_") == F.col("r_")).select(*ID, *self._keys(), (F.col("start_") + F.col("at_")).alias(name))

    def index_of(self, type_id: int | None, local_id: int | None) -> DataFrame:
        """One row: the first place of an entity, -1 without it."""
        me = F.col("local_id").isNull() if local_id is None else (F.col("local_id") == local_id) & (F.col("type_id") == type_id)
        return self.positions().where(me).agg(F.coalesce(F.min("pos"), F.lit(-1)).alias("index"))

    def contains(self, type_id: int | None, local_id: int | None) -> bool:
        me = F.col("local_id").isNull() if local_id is None else (F.col("local_id") == local_id) & (F.col("type_id") == type_id)
        return not self.df.where(me).isEmpty()

    # --- values and counts ---

    def values(self, *names: str) -> DataFrame:
        """ids with properties in stored case, false where a boolean is absent."""
        frame = self.store.frame(self.type)
        df = self._with(*[f"p_{n}" for n in names])
        boolean = lambda n: isinstance(frame.kind(n), T.BooleanType)
        return df.select(*ID, *[(F.coalesce(f"p_{n}", F.lit(False)) if boolean(n) else F.col(f"p_{n}")).alias(n) for n in names])

    def names_present(self, kind: str = "p") -> DataFrame:
        """ids with the names of the properties (p), blobs (b) or links (l) that each entity has."""
        frame = self.store.frame(self.type)
        own = [c for c in frame.kinds if c.startswith(f"{kind}_")]
        found = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c[2:])) for c in own])) if own else F.array().cast("array<string>")
        out = self._with(*own).select(*ID, found.alias("names"))
        many = list(dict.fromkeys(n for t in frame.names for n, x in self.store.model.links(t).items() if x.multiple)) if kind == "l" else []
        if many:
            edges = reduce(DataFrame.unionByName, [self.store.edges(self.type, n).select(F.col("type_id").alias("t_"), F.col("local_id").alias("i_"), F.lit(n).alias("n_")) for n in many])
            edges = edges.groupBy("t_", "i_").agg(F.collect_set("n_").alias("more_"))
            out = out.join(edges, (F.col("type_id") == F.col("t_")) & (F.col("local_id") == F.col("i_")), "left")
            out = out.select(*ID, F.array_distinct(F.concat("names", F.coalesce("more_", F.array().cast("array<string>")))).alias("names"))
        return out.select(*ID, F.array_sort("names").alias("names"))

    def blob_sizes(self, name: str) -> DataFrame:
        return self._with(f"b_{name}").select(*ID, F.octet_length(F.col(f"b_{name}")).alias("size"))

    def blob_texts(self, name: str) -> DataFrame:
        """ids with a blob as text, null without one."""
        return self._with(f"b_{name}").select(*ID, F.col(f"b_{name}").cast("string").alias("text"))

    def value_counts(self, prop: str) -> DataFrame:
        """How many elements have each folded value of a property; a set counts once for each item."""
        kind = self.store.frame(self.type).kind(prop)
        value = fold(F.col(f"p_{prop}"), kind) if kind is not None else F.lit(None).cast("string")
        df = self._with(f"p_{prop}").select((F.explode(value) if isinstance(kind, T.ArrayType) else value).alias("value")).where("value IS NOT NULL")
        return df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))

    def target_counts(self, link: str) -> DataFrame:
        """How many elements lead to each target of a link."""
        return self._targets(link, "inner", False).groupBy(*ID).agg(F.count(F.lit(1)).alias("n"))

    def describe(self) -> str:
        """A text of how a set is built: its type, its predicate if it is one still, and its order."""
        return f"{self.type}|{self.predicate.describe() if self.predicate is not None else 'joined'}|{self.order}"

    def size_frame(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("size"))

    def size(self) -> int:
        return self.size_frame().first()["size"]

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def is_empty_frame(self) -> DataFrame:
        """One row: whether there is no element, for which one is looked for only."""
        return self.df.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
