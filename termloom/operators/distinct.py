"""What depends on a few columns alone is found once for each of their distinct values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal(keys: list[str]) -> Column:
    """Whether `_l` and `_r` agree on all keys; nulls are values like others."""
    return reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])


def joined(df: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`df` with the other columns of the rows of `found` that have its keys; with `how` "left", rows without one stay.

    Both sides are dealt by key. A file of many rows that compresses well is taken for small, and would be broadcast to the one task that holds all names.
    """
    more = [F.col(f"_r.{c}") for c in found.columns if c not in keys]
    return df.alias("_l").join(found.alias("_r").hint("merge"), equal(keys), how).select(*[F.col(f"_l.{c}") for c in df.columns], *more)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """The columns `keys` of `df`, a few rows with much work on each, dealt to all cores, however small it is.

    What is found from them stays above: the optimizer carries filters on it (such as that a join key isn't null) down to the scan and would
    find it for every row of the input there, in a task for each file. It carries none through a generator.
    """
    dealt = df.select(*keys).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
    return dealt.select(F.explode(F.array(F.struct(*keys))).alias("_k")).select("_k.*")


def once_each(df: DataFrame, keys: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with the columns that `made` adds to a table of `keys`, which are found once for each distinct value and joined back.

    Names repeat far more often than rows grow, and a name costs dozens of patterns, a joined row next to nothing.
    """
    return joined(df, made(spread(df.select(*keys).distinct(), keys)), keys)
