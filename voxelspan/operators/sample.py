"""Sampling and pruning of points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(pos: Column) -> Column:
    """A number from 0 to 999,999 from pos, by arithmetic that any engine has."""
    return F.pmod(F.pmod(pos, F.lit(1_000_003)) * F.lit(7_919) + F.lit(104_729), F.lit(1_000_000))


def hashed_numbers(pos: np.ndarray) -> np.ndarray:
    """hashed() of numbers."""
    return (pos % 1_000_003 * 7_919 + 104_729) % 1_000_000


def subsample(points: DataFrame, rate: float, mode: str = "random", seed: int = 0) -> DataFrame:
    """Keeps each point with the given probability; mode "hash" decides by pos and repeats exactly."""
    if mode == "hash":
        return points.where(hashed(F.col("pos")) <= F.lit(int(rate * 1_000_000)))
    return points.where(F.rand(seed) <= F.lit(rate))


def stride(points: DataFrame, skip: int, batch: int) -> DataFrame:
    """Every skip-th point, with the number of the batch of ``batch`` records it came in."""
    return points.where(F.pmod(F.col("pos"), F.lit(skip)) == 0).withColumn("batch_no", F.floor(F.col("pos") / F.lit(batch)))
