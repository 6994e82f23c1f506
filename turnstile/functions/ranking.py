"""Top-k, paging and exact ranks that survive a key holding a large share of the rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.session import cut_lineage

#: Rows of a slice.
SLICE_ROWS = 200_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "position") -> DataFrame:
    """First ``k`` rows per key. The rank filter lets Spark cut each map partition to ``k``
    rows per key before the shuffle (WindowGroupLimit), so a hot key moves few rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def page_per_key(
    df: DataFrame, keys: list[str], order: list[Column], page: int | None, limit: int, rank: str = "position"
) -> DataFrame:
    """One page per key; the whole listing when ``page`` is None (no rank is computed then)."""
    if page is None:
        return df
    ranked = top_k(df, keys, order, page * limit, rank)
    return ranked.filter(F.col(rank) > (page - 1) * limit)


def page_of(df: DataFrame, order: list[Column], page: int | None, limit: int) -> DataFrame:
    """One global page: a distributed top-k, not a full sort."""
    if page is None:
        return df
    out = df.orderBy(*order)
    skip = (page - 1) * limit
    return (out.offset(skip) if skip else out).limit(limit)


def sliced(df: DataFrame, order: list[str], rows_per_slice: int, rows: int, name: str = "_slice") -> DataFrame:
    """Fix an order-preserving slice number on every row; a slice is a partition, in order.

    Range partitioning on the whole order splits a hot key over many slices. The slice number is
    the partition number, so the result is checkpointed: later reads must see the same numbers.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_slice))
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id())
    return cut_lineage(spread)


def slice_counts(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column], slice_col: str = "_slice"
) -> DataFrame:
    """For every row and measure: how much of it precedes the row within its key.

    Sum per (key, slice) with map-side combine, prefix-sum those few rows per key, then count
    inside each slice. No task sees more of a key than one slice.
    """
    part = [*keys, slice_col]
    totals = df.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{m}") for m, c in measures.items()])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{m}") for m, c in measures.items()])
    joined = local.join(offsets, part, "left")
    return joined.select(
        *[joined[c] for c in df.columns], *[(F.col(f"_o_{m}") + F.col(f"_l_{m}")).alias(m) for m in measures]
    )


def oversized(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """The keys with more than ``rows`` rows and how many they have (``_n``), or None if there is none. Counted
    with map-side combine; there is at most one such key for every ``rows`` rows of ``df``."""
    large = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows))
    return None if large.isEmpty() else large


def parted(df: DataFrame, keys: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all other keys, and rows of the keys in ``large``."""
    marks = large.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_large"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    marked = df.join(marks, same, "left")
    return tuple(marked.filter(cond).select(*df.columns) for cond in (F.col("_large").isNull(), F.col("_large")))


def running_rank(df: DataFrame, keys: list[str], order: list[str], name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact ``row_number`` over (keys, order). Keys of more than ``slice_rows`` rows are counted in slices of about
    so many, so no task ranks more than a slice of any key. ``order`` must be total within a key."""

    def in_slices(rows: DataFrame, n: int) -> DataFrame:
        ranked = slice_counts(sliced(rows, [*keys, *order], slice_rows, n), keys, order, {name: F.lit(1)}).drop("_slice")
        return ranked.withColumn(name, F.col(name) + 1)

    if not keys:
        return in_slices(df, df.count())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    large = oversized(df.select(*keys), keys, slice_rows)
    if large is None:
        return df.withColumn(name, place)
    rest, hot = parted(df, keys, large)
    return rest.withColumn(name, place).unionByName(in_slices(hot, large.agg(F.sum("_n")).first()[0]))
