"""Places and running sums over a whole table, without one task that sees all of it.

Rows are sorted over ranges; each range counts and sums on its own, a small table of ranges gives every range what comes
before it, and a join brings both together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.sources.tables import Tables

#: Rows of the table of ranges (ranges times keys) up to which it is broadcast; beyond, the engine decides by its size.
BROADCAST_ROWS = 100_000


def in_ranges(rows: DataFrame, order: Sequence[Column | str], tables: Tables, sums: Sequence[str] = (), keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with range_ and at_, ranges: keys, range_, first_, n_, ahead_, and <sum>_ahead per column of ``sums``).

    ``at_`` grows with the order; ``ahead_`` and ``<sum>_ahead`` count and sum the ranges before, within the keys.
    """
    sorted_ = rows.orderBy(*keys, *order).withColumn("at_", F.monotonically_increasing_id())
    sorted_ = tables.save(sorted_.withColumn("range_", F.shiftright("at_", 33)), "ranges")
    per = sorted_.groupBy(*keys, "range_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"), *(F.sum(c).alias(f"{c}_sum") for c in sums))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ahead = {"ahead_": F.coalesce(F.sum("n_").over(before), F.lit(0))} | {f"{c}_ahead": F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0)) for c in sums}
    return sorted_, tables.save(per.withColumns(ahead), "ahead")


def met(sorted_: DataFrame, ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows beside their range; null keys meet too."""
    few = ranges.select(*(F.col(k).alias(f"{k}_key") for k in keys), F.col("range_").alias("of_"), *(c for c in ranges.columns if c not in (*keys, "range_")))
    same = F.col("range_") == F.col("of_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_key"))
    return sorted_.join(F.broadcast(few) if ranges.count() <= BROADCAST_ROWS else few, same)


def placed(rows: DataFrame, order: Sequence[Column | str], name: str = "place", keys: Sequence[str] = (), start: int = 1) -> DataFrame:
    """rows with their place in the order (within each value of the keys), from ``start``."""
    sorted_, ranges = in_ranges(rows, order, Tables(rows.sparkSession), keys=keys)
    place = F.col("at_") - F.col("first_") + F.col("ahead_") + start
    return met(sorted_, ranges, keys).select(*rows.columns, place.alias(name))


def drawn(rows: DataFrame, order: Sequence[Column | str], weight: str, draws: DataFrame, u: str) -> DataFrame:
    """columns of ``draws`` and of ``rows``: each draw meets the row whose band of cumulated weights holds u * total.

    A row's band begins at the weight before it. A draw finds its range by the ranges' sums, then the last band in it
    that begins at the draw or before it, by a window over one range's bands and draws. Weights are positive; no row
    without draws comes back, and without rows there is nothing.
    """
    tables = Tables(rows.sparkSession)
    sorted_, ranges = in_ranges(rows, order, tables, sums=[weight])
    inside = Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    bands = met(sorted_, ranges).withColumn("begin_", F.sum(weight).over(inside) - F.col(weight) + F.col(f"{weight}_ahead"))
    bands = bands.select("range_", "begin_", F.lit(0).alias("kind_"), F.struct(*rows.columns).alias("row_"), F.lit(None).cast(draws.schema.simpleString()).alias("draw_"))
    total = ranges.agg(F.max(F.col(f"{weight}_ahead") + F.col(f"{weight}_sum")).alias("total_"))
    asked = draws.join(F.broadcast(total), F.lit(True)).where("total_ is not null").withColumn("begin_", F.col(u) * F.col("total_"))
    edges = ranges.select(F.col("range_"), F.col(f"{weight}_ahead").alias("low_"), F.lead(f"{weight}_ahead").over(Window.orderBy("range_")).alias("high_"))
    asked = asked.join(F.broadcast(edges), (F.col("begin_") >= F.col("low_")) & (F.col("high_").isNull() | (F.col("begin_") < F.col("high_"))))
    asked = asked.select("range_", "begin_", F.lit(1).alias("kind_"), F.lit(None).cast(rows.schema.simpleString()).alias("row_"), F.struct(*draws.columns).alias("draw_"))
    last = F.last("row_", ignorenulls=True).over(Window.partitionBy("range_").orderBy("begin_", "kind_").rowsBetween(Window.unboundedPreceding, 0))
    return bands.unionByName(asked).withColumn("row_", last).where("kind_ = 1").select("draw_.*", "row_.*")
