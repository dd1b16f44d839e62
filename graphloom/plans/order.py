"""Order as data: the keys that an entity set is sorted by, carried until something needs positions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Property sorts that are kept when sorts are nested; older ones go.
MOST_SORTS = 4


@dataclass(frozen=True)
class Key:
    """A column to sort by.  `sort` marks the keys that a sort put there, as against those that make an order total."""

    column: str
    ascending: bool = True
    nulls_last: bool = True
    sort: bool = False

    def expression(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()

    def flipped(self) -> Key:
        return replace(self, ascending=not self.ascending, nulls_last=not self.nulls_last)


BY_ID = (Key("type_id"), Key("local_id"))


def flipped(keys: tuple[Key, ...]) -> tuple[Key, ...]:
    return tuple(k.flipped() for k in keys)


def prepended(key: Key, keys: tuple[Key, ...]) -> tuple[Key, ...]:
    """A new leading key; of the sorts among the keys at most MOST_SORTS stay."""
    out, sorts = [key], 1
    for k in keys:
        sorts += k.sort
        if not k.sort or sorts <= MOST_SORTS:
            out.append(k)
    return tuple(out)


def expressions(keys: tuple[Key, ...]) -> list[Column]:
    return [k.expression() for k in keys]
