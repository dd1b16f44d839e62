"""Keeping a set current while entities arrive: the same predicates, over Structured Streaming."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators.entities import EntityStore
from ..plans.model import EntityType
from ..plans.predicates import Predicate


def matching(stream: DataFrame, kind: EntityType, predicate: Predicate) -> DataFrame:
    """type_id and local_id of a stream's rows for which a predicate over the type's own columns holds."""
    store = EntityStore(stream.sparkSession, [replace(kind, df=stream)])
    frame = store.frame(kind.name)
    condition = predicate.column(frame)
    if condition is None:
        raise ValueError("this predicate takes a join")
    return frame.df.where(condition).select("type_id", "local_id")
