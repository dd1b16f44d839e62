"""Ordered key/value stores and their cursors, as DataFrames of (key, value)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import spool

@dataclass(frozen=True)
class KeyValueStore:
    """A map from keys to values; with duplicates a key may have several values, ordered."""

    df: DataFrame
    duplicates: bool = False

    # --- point reads ---

    def get(self, key: Any) -> DataFrame:
        """The least value of a key, in no or one row."""
        return self.df.where(F.col("key") == F.lit(key)).orderBy("value").limit(1)

    def exists(self, key: Any, value: Any) -> bool:
        return not self.df.where((F.col("key") == F.lit(key)) & F.col("value").eqNullSafe(F.lit(value))).isEmpty()

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    # --- cursors ---

    def scan(self, ascending: bool = True) -> DataFrame:
        """All pairs in key and value order."""
        return self.df.orderBy("key", "value") if ascending else self.df.orderBy(F.desc("key"), F.desc("value"))

    def no_dup(self) -> DataFrame:
        """Each key with its least value: what a cursor sees that skips duplicates."""
        return self.df.groupBy("key").agg(F.min("value").alias("value"))

    def dup_counts(self) -> DataFrame:
        return self.df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def seek(self, key: Any) -> DataFrame:
        """The first pair at or after a key."""
        return self.df.where(F.col("key") >= F.lit(key)).orderBy("key", "value").limit(1)

    def seek_both(self, key: Any, value: Any, nearest: bool = False) -> DataFrame:
        """This pair, or with nearest the key's first value at or after value."""
        same = self.df.where(F.col("key") == F.lit(key))
        return same.where(F.col("value") >= F.lit(value)).orderBy("value").limit(1) if nearest else same.where(F.col("value") == F.lit(value)).limit(1)

    def last(self) -> DataFrame:
        return self.scan(False).limit(1)

    def steps(self) -> DataFrame:
        """Each pair with the pairs that a cursor comes from and goes to: previous and next, as structs, null at the ends.

        Pairs are sorted into ranges, so that no key is in one task as a whole; a range takes the pairs beyond its ends from a table of
        one row a range.
        """
        n = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pair = F.struct("key", "value")
        placed = self.df.select("key", "value").repartitionByRange(n, "key", "value").withColumn("range_", F.spark_partition_id())
        placed = spool(placed, "steps")
        ends = placed.groupBy("range_").agg(F.min(pair).alias("low_"), F.max(pair).alias("high_"))
        w = W.orderBy("range_")
        ends = ends.select(F.col("range_").alias("r_"), F.lag("high_").over(w).alias("before_"), F.lead("low_").over(w).alias("after_"))
        here = W.partitionBy("range_").orderBy("key", "value")
        out = placed.withColumns({"p_": F.lag(pair).over(here), "n_": F.lead(pair).over(here)}).join(ends, F.col("range_") == F.col("r_"))
        return out.select("key", "value", F.coalesce("p_", "before_").alias("previous"), F.coalesce("n_", "after_").alias("next"))

    def neighbours(self) -> DataFrame:
        """Each pair with the previous and next value of its key (next and previous duplicate)."""
        same = lambda x: F.when(F.col(f"{x}.key").eqNullSafe(F.col("key")), F.col(f"{x}.value")).alias(x)
        return self.steps().select("key", "value", same("previous"), same("next"))

    # --- writes: a new store ---

    def put(self, pairs: DataFrame) -> KeyValueStore:
        """Add pairs; without duplicates a key's value is replaced (of pairs that share a new key, by the greatest)."""
        new = pairs.select("key", "value")
        if self.duplicates:
            return KeyValueStore(self.df.unionByName(new).distinct(), True)
        new = new.groupBy("key").agg(F.max("value").alias("value"))
        return KeyValueStore(self.df.join(new.select("key"), "key", "left_anti").unionByName(new), False)

    def add(self, pairs: DataFrame) -> tuple[KeyValueStore, DataFrame]:
        """Add pairs whose key is new; also the pairs refused."""
        refused = pairs.join(self.df.select("key"), "key", "left_semi")
        return self.put(pairs.join(self.df.select("key").distinct(), "key", "left_anti")), refused

    def put_right(self, pairs: DataFrame) -> KeyValueStore:
        """Append pairs whose keys are all greater than the store's."""
        low, high = pairs.agg(F.min("key")).first()[0], self.df.agg(F.max("key")).first()[0]
        if low is not None and high is not None and low <= high:
            raise ValueError("put_right takes keys greater than all others")
        return KeyValueStore(self.df.unionByName(pairs.select("key", "value")), self.duplicates)

    def delete(self, keys: DataFrame) -> KeyValueStore:
        return KeyValueStore(self.df.join(keys.select("key"), "key", "left_anti"), self.duplicates)
