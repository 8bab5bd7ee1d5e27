"""Row numbers and running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import stored

#: Tables of up to this many rows are numbered by one window; larger ones by ranges of about as many.
ONE_TASK = 50_000
#: Ranges at most, so that their counts stay a small table.
MOST_RANGES = 10_000
#: Offsets of so many ranges are a literal; more are joined.
FEW_RANGES = 64
_AT = "range_at"  # the range's number in the upper bits, the row's number there in the lower 33


def _dealt(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df in order by ranges, with _AT. It is written, so that a lost task can't deal rows out otherwise."""
    parts = min(MOST_RANGES, max(2, -(-n // ONE_TASK)))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn(_AT, F.monotonically_increasing_id()), "ranks")


def _range() -> Column:
    return F.shiftright(_AT, 33)


def _inside() -> Column:
    return F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))


def global_row_number(df: DataFrame, order: list[str], name: str, rows: int | None = None) -> DataFrame:
    """df with a number from 0 in order (unique at its last column). Large tables are dealt out by range and sorted
    there; the ranges' counts give the offsets."""
    n = df.count() if rows is None else rows
    if n <= ONE_TASK:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    dealt = _dealt(df, order, n)
    counts = dealt.groupBy(_range().alias("range_no")).count()
    if n <= FEW_RANGES * ONE_TASK:  # a short list, as a literal
        own = dict(counts.collect())
        before, upto = [], 0
        for k in range(max(own, default=-1) + 1):
            before.append(upto)
            upto += own.get(k, 0)
        if not before:
            return df.withColumn(name, F.lit(0).cast("long"))
        offset = F.get(F.array(*[F.lit(b).cast("long") for b in before]), _range().cast("int"))
        return dealt.withColumn(name, offset + _inside()).drop(_AT)
    upto = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range_no", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    # offsets has MOST_RANGES rows at most
    return dealt.join(F.broadcast(offsets), _range() == offsets["range_no"]).withColumn(name, (F.col("before") + _inside()).cast("long")).drop("before", "range_no", _AT)


def global_sums_before(df: DataFrame, order: list[str], sums: dict[str, Column], rows: int | None = None) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before in order (unique)."""
    n = df.count() if rows is None else rows
    if n <= ONE_TASK:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(k) for k, c in sums.items()])
    dealt = _dealt(df, order, n).withColumn("range_no", _range())
    upto = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_no").agg(*[F.sum(c).alias(f"all_{k}") for k, c in sums.items()])
    offsets = totals.select("range_no", *[F.coalesce(F.sum(f"all_{k}").over(upto), F.lit(0)).alias(f"off_{k}") for k in sums])
    own = Window.partitionBy("range_no").orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"in_{k}") for k, c in sums.items()])
    both = inside.join(F.broadcast(offsets), "range_no")
    return both.select(*df.columns, *[(F.col(f"off_{k}") + F.col(f"in_{k}")).cast("long").alias(k) for k in sums])
