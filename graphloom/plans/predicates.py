"""Predicates over one type's entities.

A predicate is total: it holds or it doesn't, and its negation is its complement.  Inside AND and OR a null is as good as false, so only NOT
closes nulls, and the rest stays in the form that Catalyst can push into a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import comparable, fold, fold_value

if TYPE_CHECKING:
    from ..operators.entities import Frame

Never: Callable[[], Column] = lambda: F.lit(False)


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return either(self, other)

    def __invert__(self) -> Predicate:
        return self.inner if isinstance(self, Not) else Not(self)

    def __sub__(self, other: Predicate) -> Predicate:
        return both(self, ~other)

    def column(self, frame: Frame) -> Column | None:
        """The condition over the frame's own columns, or None if it takes a join."""
        raise NotImplementedError

    def describe(self) -> str:
        return repr(self)

    def children(self) -> tuple[Predicate, ...]:
        return ()

    def label(self) -> str:
        """The node without its children."""
        return repr(self) if not self.children() else type(self).__name__


@dataclass(frozen=True)
class All(Predicate):
    """Neutral in AND, absorbing in OR."""

    def column(self, frame: Frame) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Equals(Predicate):
    """Property equals a value, in any case; on a set, some item does.  None: the property is absent; False likewise."""

    name: str
    value: Any

    def column(self, frame: Frame) -> Column:
        kind = frame.kind(self.name)
        if self.value is None:
            return F.lit(True) if kind is None else frame.prop(self.name).isNull()
        if kind is None:
            return F.lit(self.value is False)
        if not comparable(self.value, kind):
            return Never()
        p = frame.prop(self.name)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(p, F.lit(False)) == F.lit(self.value)
        if isinstance(kind, T.ArrayType):
            return F.array_contains(fold(p, kind), fold_value(self.value))
        return fold(p, kind) == F.lit(fold_value(self.value))


@dataclass(frozen=True)
class Between(Predicate):
    """Property in a closed range, in any case; on a set, some item is.

    Booleans: from true to true finds true ones, from false to true finds all; any other range finds none, false being absent.
    """

    name: str
    low: Any
    high: Any

    def column(self, frame: Frame) -> Column:
        kind = frame.kind(self.name)
        if isinstance(self.low, bool):
            if not self.low and self.high:
                return F.lit(True)
            return frame.prop(self.name).isNotNull() if self.low and self.high and isinstance(kind, T.BooleanType) else Never()
        if kind is None or not comparable(self.low, kind) or not comparable(self.high, kind):
            return Never()
        low, high = F.lit(fold_value(self.low)), F.lit(fold_value(self.high))
        p = fold(frame.prop(self.name), kind)
        return F.exists(p, lambda x: x.between(low, high)) if isinstance(kind, T.ArrayType) else p.between(low, high)


@dataclass(frozen=True)
class StartsWith(Predicate):
    """Property begins with a text, in any case; the empty text finds all."""

    name: str
    prefix: str | None

    def column(self, frame: Frame) -> Column:
        if not self.prefix:
            return F.lit(True)
        return _text(frame, self.name, lambda x: F.startswith(x, F.lit(self.prefix.lower())))


@dataclass(frozen=True)
class Contains(Predicate):
    """Property contains a text.  Stored text is compared in lower case, so without ignore_case a needle with capitals finds nothing.

    The empty needle finds all; with `present`, those that have the property.
    """

    name: str
    needle: str | None
    ignore_case: bool = True
    present: bool = False

    def column(self, frame: Frame) -> Column:
        if not self.needle:
            return Present(self.name).column(frame) if self.present else F.lit(True)
        needle = self.needle.lower() if self.ignore_case else self.needle
        return _text(frame, self.name, lambda x: F.contains(x, F.lit(needle)))


def _text(frame: Frame, name: str, test: Callable[[Column], Column]) -> Column:
    kind = frame.kind(name)
    if isinstance(kind, T.StringType):
        return test(fold(frame.prop(name), kind))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.exists(fold(frame.prop(name), kind), test)
    return Never()


@dataclass(frozen=True)
class Present(Predicate):
    """Property, or a blob of that name, is there."""

    name: str

    def column(self, frame: Frame) -> Column:
        return frame.prop(self.name).isNotNull() if frame.kind(self.name) is not None else HasBlob(self.name).column(frame)


@dataclass(frozen=True)
class HasBlob(Predicate):
    name: str

    def column(self, frame: Frame) -> Column:
        b = frame.blob(self.name)
        return Never() if b is None else b.isNotNull()


@dataclass(frozen=True)
class IdBetween(Predicate):
    low: int
    high: int

    def column(self, frame: Frame) -> Column:
        return F.col("local_id").between(self.low, self.high)


@dataclass(frozen=True)
class LinkIs(Predicate):
    """The link leads to this entity; None: to none."""

    link: str
    target: int | None

    def column(self, frame: Frame) -> Column | None:
        if frame.link(self.link) is None:
            return F.lit(self.target is None)
        fk = frame.fk(self.link)
        return None if fk is None else fk.isNull() if self.target is None else fk == F.lit(self.target)


@dataclass(frozen=True)
class LinkIn(Predicate):
    """The link leads to one of these few entities."""

    link: str
    targets: tuple[int, ...]

    def column(self, frame: Frame) -> Column | None:
        if frame.link(self.link) is None or not self.targets:
            return Never()
        fk = frame.fk(self.link)
        return None if fk is None else fk.isin(*self.targets)


@dataclass(frozen=True)
class HasLink(Predicate):
    link: str

    def column(self, frame: Frame) -> Column | None:
        if frame.link(self.link) is None:
            return Never()
        fk = frame.fk(self.link)
        return None if fk is None else fk.isNotNull()


@dataclass(frozen=True)
class LinkTo(Predicate):
    """The link leads to an entity for which a predicate holds: a semi-join with the targets."""

    link: str
    inner: Predicate

    def column(self, frame: Frame) -> Column | None:
        return Never() if frame.link(self.link) is None else None

    def children(self) -> tuple[Predicate, ...]:
        return (self.inner,)

    def label(self) -> str:
        return f"LinkTo({self.link!r})"


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, frame: Frame) -> Column | None:
        return _fold_columns([p.column(frame) for p in self.parts], lambda a, b: a & b)

    def children(self) -> tuple[Predicate, ...]:
        return self.parts


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, frame: Frame) -> Column | None:
        return _fold_columns([p.column(frame) for p in self.parts], lambda a, b: a | b)

    def children(self) -> tuple[Predicate, ...]:
        return self.parts


@dataclass(frozen=True)
class Not(Predicate):
    """The complement within the type: entities without the property included."""

    inner: Predicate

    def column(self, frame: Frame) -> Column | None:
        c = self.inner.column(frame)
        return None if c is None else ~F.coalesce(c, F.lit(False))

    def children(self) -> tuple[Predicate, ...]:
        return (self.inner,)


def _fold_columns(columns: Sequence[Column | None], how: Callable[[Column, Column], Column]) -> Column | None:
    out = columns[0]
    for c in columns[1:]:
        if out is None or c is None:
            return None
        out = how(out, c)
    return out


def both(a: Predicate, b: Predicate) -> Predicate:
    """AND; all is neutral, and a repeated part counts once."""
    parts = [p for x in (a, b) for p in (x.parts if isinstance(x, And) else (x,)) if not isinstance(p, All)]
    parts = list(dict.fromkeys(parts))
    return All() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


def either(a: Predicate, b: Predicate) -> Predicate:
    """OR; all absorbs, a repeated part counts once, and equalities on one link become one list."""
    parts = [p for x in (a, b) for p in (x.parts if isinstance(x, Or) else (x,))]
    if any(isinstance(p, All) for p in parts):
        return All()
    lists: dict[str, list[int]] = {}
    rest: list[Predicate] = []
    for p in parts:
        if isinstance(p, LinkIs) and p.target is not None:
            lists.setdefault(p.link, []).append(p.target)
        elif isinstance(p, LinkIn):
            lists.setdefault(p.link, []).extend(p.targets)
        else:
            rest.append(p)
    rest += [LinkIs(k, v[0]) if len(set(v)) == 1 else LinkIn(k, tuple(dict.fromkeys(v))) for k, v in lists.items()]
    rest = list(dict.fromkeys(rest))
    return rest[0] if len(rest) == 1 else Or(tuple(rest))
