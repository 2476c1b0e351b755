"""Stable selection by a predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.plans.running import positions


def select_if(x: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """(pos, v): selected values at their place among the selected, in index order."""
    return positions(x.filter(keep(F.col("v"))).select("i", "v")).select("pos", "v")


def select_if_with_index(x: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """(pos, v, i): as :func:`select_if` for a predicate of value and index."""
    return positions(x.filter(keep(F.col("v"), F.col("i"))).select("i", "v")).select("pos", "v", "i")


def count_selected(x: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    return x.agg(F.count_if(keep(F.col("v"))).alias("n"))
