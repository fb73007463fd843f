"""Joins Spark has no keyword for: as-of, nearest, interval anti, point in box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its group at or before it: one sort of the
    union, no pairs. A right row of equal time counts as before."""
    names = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("_side"), *names, *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in take])
    b = right.select(*by, at, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], *[F.col(c).alias(f"_{c}") for c in take])
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b)
    for c in take:
        out = out.withColumn(c, F.last(f"_{c}", ignorenulls=True).over(w))
    return out.where("_side = 1").select(*left.columns, *take)


def interval_anti(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, other_start: str, other_end: str, width: int) -> DataFrame:
    """Left rows whose [start, end) overlaps no right interval of their group. Both sides are met on the cells of
    ``width`` that they touch, an equi-join, so a long group is spread over tasks."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width)))
    r = right.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(other_start).alias("_s"), F.col(other_end).alias("_e"))
    r = r.withColumn("_cell", cells(F.col("_s"), F.col("_e")))
    left_cells = left.withColumn("_cell", cells(F.col(start), F.col(end)))
    on: Column = (F.col("_cell") == r["_cell"]) & (F.col(start) < F.col("_e")) & (F.col("_s") < F.col(end))
    on = (left_cells["_cell"] == r["_cell"]) & (left_cells[start] < r["_e"]) & (r["_s"] < left_cells[end])
    for c in by:
        on = on & (left_cells[c] == r[f"_{c}"])
    hit = left_cells.join(r, on, "left_semi").drop("_cell").distinct()
    return left.join(hit, left.columns, "left_anti")


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, ident: str) -> DataFrame:
    """Each left row with the id of the right row of its group nearest to it, the earlier one of a tie: the last
    before and the first after, from one sort of the union."""
    names = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("_side"), *names, F.lit(None).cast(right.schema[ident].dataType).alias("_id"), F.lit(None).cast(right.schema[at].dataType).alias("_at"))
    b = right.select(*by, at, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(ident).alias("_id"), F.col(at).alias("_at"))
    w = Window.partitionBy(*by).orderBy(at, "_side", "_id")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("_id").isNotNull(), F.struct("_at", "_id"))
    both = a.unionByName(b).withColumn("_before", F.last(seen, ignorenulls=True).over(back)).withColumn("_after", F.first(seen, ignorenulls=True).over(ahead))
    later = F.col("_before").isNull() | (F.abs(F.col("_after._at") - F.col(at)) < F.abs(F.col(at) - F.col("_before._at")))
    return both.where("_side = 1").withColumn(ident, F.when(later & F.col("_after").isNotNull(), F.col("_after._id")).otherwise(F.col("_before._id"))).select(*left.columns, ident)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key: an aggregation, so nothing is sorted."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def islands(rows: DataFrame, by: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Rows numbered by the run they are in; ``new`` says where one begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
