"""Entity types, their links and their hierarchy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """A named link to entities of type target or its subtypes: a column of the type's own frame, a frame of edges, or the opposite of a link of target.

    edges has columns src and dst.  Where entities of several types have the link, or several types are led to, the names of the types
    stand in src_type and dst_type, or beside a column in the column target_kind.  cardinality is "0..1", "1", "0..n" or "1..n".
    """

    name: str
    target: str
    column: str | Column | None = None
    edges: DataFrame | None = None
    cardinality: str = "0..1"
    opposite: str | None = None
    target_kind: str | Column | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.column, self.edges, self.opposite)) != 1:
            raise ValueError(f"link {self.name}: either a column, edges or an opposite")

    @property
    def multiple(self) -> bool:
        return self.column is None


@dataclass(frozen=True)
class Index:
    """A unique key: the fields whose values together may come once over a type and its subtypes."""

    fields: tuple[str, ...]


@dataclass(frozen=True)
class EntityType:
    """A type: frame, id column, properties and blobs (name to column), links, and its place in the hierarchy."""

    name: str
    df: DataFrame | None = None
    id_column: str | None = None
    properties: dict[str, str | Column] = field(default_factory=dict)
    blobs: dict[str, str | Column] = field(default_factory=dict)
    links: tuple[Link, ...] = ()
    parent: str | None = None
    interfaces: tuple[str, ...] = ()
    abstract: bool = False
    indices: tuple[Index, ...] = ()


class Model:
    """Types by name, with ids in the order given.  Links, properties and indices of supertypes and interfaces hold for subtypes."""

    def __init__(self, types: Iterable[EntityType]):
        self.types = {t.name: t for t in types}
        self.ids = {name: n for n, name in enumerate(self.types)}
        for t in self.types.values():
            seen, up = {t.name}, t.parent
            while up:
                if up not in self.types:
                    raise ValueError(f"{t.name}: no type {up}")
                if up in seen:
                    raise ValueError(f"{t.name} is among its own supertypes")
                seen.add(up)
                up = self.types[up].parent

    def supertypes(self, name: str) -> list[str]:
        """Nearest first: parents, each followed by its interfaces."""
        out, at = [], name
        while at:
            t = self.types[at]
            out += [x for x in (*((at,) if at != name else ()), *t.interfaces) if x not in out]
            at = t.parent
        return out

    def subtypes(self, name: str) -> list[str]:
        """All types below, at any depth, by id."""
        return [t for t in self.types if t != name and name in self.supertypes(t)]

    def with_subtypes(self, name: str) -> list[str]:
        return [t for t in (name, *self.subtypes(name)) if t in self.types and not self.types[t].abstract and self.types[t].df is not None]

    def is_a(self, name: str, other: str) -> bool:
        return name == other or other in self.supertypes(name)

    def narrower(self, a: str, b: str) -> str | None:
        """Of two types the one that is a subtype of the other, if one is."""
        return a if self.is_a(a, b) else b if self.is_a(b, a) else None

    def links(self, name: str) -> dict[str, Link]:
        """A type's links, inherited ones included; the nearest definition counts."""
        out: dict[str, Link] = {}
        for t in (name, *self.supertypes(name)):
            for link in self.types[t].links if t in self.types else ():
                out.setdefault(link.name, link)
        return out

    def link_names(self) -> list[str]:
        return list(dict.fromkeys(link.name for t in self.types.values() for link in t.links))

    def incoming(self, name: str) -> list[tuple[str, Link]]:
        """(type, link) of the links that may lead to entities of this type."""
        wide = {name, *self.supertypes(name)}
        return [(t.name, link) for t in self.types.values() for link in t.links if link.target in wide]

    def properties(self, name: str) -> list[str]:
        return list(dict.fromkeys(p for t in (name, *self.supertypes(name)) if t in self.types for p in self.types[t].properties))

    def indices(self, name: str) -> list[Index]:
        return [i for t in (name, *self.supertypes(name)) if t in self.types for i in self.types[t].indices]

    def indices_of_field(self, name: str, field_name: str) -> list[Index]:
        return [i for i in self.indices(name) if field_name in i.fields]

    def id_of(self, kind: Column) -> Column:
        """Type id of a type's name."""
        return F.create_map(*[F.lit(x) for name, i in self.ids.items() for x in (name, i)])[kind].cast("int")

    def type_name(self, type_id: int) -> str | None:
        return next((n for n, i in self.ids.items() if i == type_id), None)
