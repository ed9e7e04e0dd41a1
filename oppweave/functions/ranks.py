"""Ranks and first-per-key picks that stay bounded when one key is hot."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int | None, out: str = "rn") -> DataFrame:
    """First ``n`` rows per key; all, numbered, without an ``n`` (for keys of bounded size, such as a page's links).

    The literal bound lets Spark trim each key to ``n`` rows before the shuffle
    (WindowGroupLimit), so a hot key costs tasks x n rows, not its whole group.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(w))
    return numbered if n is None else numbered.filter(F.col(out) <= n)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "__rn").drop("__rn")


#: Rows of a key that one task may hold: up to it, rows are numbered where a key's rows are.
HELD = 500_000


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def full_rank(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Exact row number over every row of each key, without one task per hot key.

    The rows are written once. If no key has more than ``HELD`` of them, they move once, by key. Else
    they are cut into ranges of (keys, order) of about equal size and written again, so one key with most
    rows is spread like many small ones. A row's number is its place within its key's part of the range plus the
    rows of the key in the ranges before, from a table with a row per key and range. Keys may be NULL: joins
    are null-safe and keep every row. NULLs in the order stand where their column's order puts them.
    """
    df = cut(df)
    if largest(df, keys) <= HELD:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    by = [*map(F.col, keys), *order]
    # The number of a range holds only for this one exchange, so the rows are written before it is used twice.
    ranged = cut(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    parts = [*keys, "__range"]
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"__k{i}" for i, k in enumerate(parts)}
    starts = ranged.groupBy(*parts).count().select(
        *[F.col(k).alias(n) for k, n in names.items()], F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    inner = W.partitionBy(*parts).orderBy(*order)
    return (
        ranged.join(starts, same)
        .withColumn(out, (F.col("__start") + F.row_number().over(inner)).cast("int"))
        .drop(*names.values(), "__start", "__range")
    )


def running_max(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with the largest of each of ``values`` (nulls aside) in the key's earlier rows, null where there is none.

    With a struct that begins with the order, this is the last value before a row. No key is one task: the rows are cut
    into even ranges as in :func:`full_rank`, and a range starts from the largest value of the key's ranges before it.
    """
    by = [*map(F.col, keys), *order]
    own = {f"__v{i}": value for i, value in enumerate(values.values())}
    ranged = cut(df.withColumns(own).repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    parts = [*keys, "__range"]
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"__k{i}" for i, k in enumerate(parts)}
    starts = ranged.groupBy(*parts).agg(*[F.max(c).alias(c) for c in own]).select(
        *[F.col(k).alias(n) for k, n in names.items()], *[F.max(c).over(before).alias(f"{c}_start") for c in own]
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    inner = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = {out: F.greatest(f"{c}_start", F.max(c).over(inner)) for out, c in zip(values, own)}
    return ranged.join(starts, same).withColumns(found).drop(*names.values(), *own, *[f"{c}_start" for c in own], "__range")
