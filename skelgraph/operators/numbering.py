"""Places in an order, for groups of any size."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written


def numbered(df: DataFrame, name: str, by, order) -> DataFrame:
    """`df` with the column `name`: the 0-based place of each row in its group `by`, in `order` (columns that tell its rows apart).

    Rows are dealt by ranges and written; the places in front of each range come from the
    counts of the ranges, so a group, even one that is the whole table, is numbered by many tasks.
    Only a range's first group can have rows in front of it: that table has at most a row for each range
    and is the only one that is broadcast. Nulls are a group like any other.
    """
    part, start = f"_part_{name}", f"_start_{name}"
    dealt = written(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*by, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn(start, F.sum("_n").over(before)).where(F.col(start) > 0)
    ahead = ahead.select(F.col(part).alias("_p"), F.col(start), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)])
    own = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)) - 1
    met = F.col(part) == F.col("_p")
    for k, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    got = dealt.withColumn(name, own).join(F.broadcast(ahead), met, "left")
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(name) + F.coalesce(start, F.lit(0))).alias(name))
