"""Reading vector tables: which rows take part, and different vectors instead of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and all its components are finite numbers."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def smallest_ids(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """For each key the ``most`` smallest values of ``vec_id``, as an array in order.

    The ranking is cut off before the shuffle too, so a key that holds a third of all rows
    sends a few from every task.
    """
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id")))
    return ranked.where(F.col("_place") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
