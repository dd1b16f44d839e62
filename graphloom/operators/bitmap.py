"""Sparse sets of non-negative longs, as a DataFrame of distinct bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bitmap:
    df: DataFrame  # bit bigint, distinct

    @staticmethod
    def of(df: DataFrame, column: str) -> Bitmap:
        bits = df.select(F.col(column).cast("bigint").alias("bit")).where("bit >= 0").distinct()
        return Bitmap(bits)

    def get(self, bit: int) -> bool:
        return not self.df.where(F.col("bit") == bit).isEmpty()

    def iterator(self) -> DataFrame:
        return self.df.orderBy("bit")

    def reverse_iterator(self) -> DataFrame:
        return self.df.orderBy(F.desc("bit"))

    def ends(self) -> DataFrame:
        """first and last bit, -1 if there is none, and how many there are."""
        return self.df.agg(F.coalesce(F.min("bit"), F.lit(-1)).alias("first"), F.coalesce(F.max("bit"), F.lit(-1)).alias("last"), F.count("bit").alias("n"))

    def count(self, low: int, high: int) -> DataFrame:
        """Bits from low to high, both included."""
        if low > high:
            raise ValueError("low is greater than high")
        return self.df.where(F.col("bit").between(low, high)).agg(F.count("bit").alias("n"))

    def set(self, bits: DataFrame) -> tuple[Bitmap, DataFrame]:
        """With these bits; also those that weren't set before."""
        new = bits.select("bit").distinct().join(self.df, "bit", "left_anti")
        return Bitmap(self.df.unionByName(new)), new

    def clear(self, bits: DataFrame) -> tuple[Bitmap, DataFrame]:
        """Without these bits; also those that were set before."""
        old = self.df.join(bits.select("bit").distinct(), "bit", "left_semi")
        return Bitmap(self.df.join(bits.select("bit").distinct(), "bit", "left_anti")), old
