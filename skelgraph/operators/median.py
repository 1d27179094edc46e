"""Exact medians of groups of any size."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

FEW = 100_000  # values of a group that an aggregate holds at once
BINS = 1024


def exact_median(rows: DataFrame, by, value: str, name: str, few=FEW, bins=BINS) -> DataFrame:
    """(by, name): the median of `value` in each group, the mean of the middle two of an even number; nulls do not count.

    Groups of at most `few` values go to the built-in aggregate. In larger ones the two middle places are sought by counting:
    a pass counts the values of the range in question in BINS equal parts, and the part that holds
    the middle places becomes the next range, until it holds at most `few` values or only one; if two parts hold them, they are the greatest value
    of one and the least of the other. So a group's state is BINS counts, however large it is.
    """
    by = list(by)
    rows = rows.where(F.col(value).isNotNull()).select(*by, value)
    large = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).where(F.col("_n") > few)
    large = written(large.withColumns({"_skip": F.lit(0).cast("long"), "_size": F.col("_n"), "_two": F.lit(False)}), "ranges")
    small = rows.groupBy(*by).agg(F.median(value).alias(name))
    if large.isEmpty():
        return small
    met = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    small = rows.join(large, met(rows, large), "left_anti").groupBy(*by).agg(F.median(value).alias(name))
    found = []
    while True:
        over = F.col("_two") | (F.col("_size") <= few) | (F.col("_lo") == F.col("_hi"))
        found.append(large.where(over))
        large = large.where(~over)
        if large.isEmpty():
            break
        state = large.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[c for c in large.columns if c not in by])
        here = rows.join(state, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
        part = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        counts = here.groupBy(*by, "_n", "_skip", part.alias("_part")).agg(F.count("*").alias("_c"), F.min(value).alias("_a"), F.max(value).alias("_z"))
        counts = counts.withColumn("_to", F.col("_skip") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_part")))
        first, last = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
        held = counts.where((F.col("_to") > first) & (F.col("_to") - F.col("_c") <= last))
        two = F.count("*") > 1
        large = written(held.groupBy(*by, "_n").agg(F.when(two, F.min("_z")).otherwise(F.min("_a")).alias("_lo"), F.when(two, F.max("_a")).otherwise(F.max("_z")).alias("_hi"),
                                                    F.min(F.col("_to") - F.col("_c")).alias("_skip"), F.sum("_c").alias("_size"), two.alias("_two")), "ranges")
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    one = ends.where("_two OR _lo = _hi").select(*by, (F.col("_lo") / 2 + F.col("_hi") / 2).alias(name))
    state = ends.where("NOT _two AND _lo < _hi").select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_n", "_lo", "_hi", "_skip")
    rest = rows.join(state, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    rest = rest.groupBy(*by, "_n", "_skip").agg(F.sort_array(F.collect_list(value)).alias("_v"))
    at = lambda k: F.col("_v")[(F.floor(k) - F.col("_skip")).cast("int")]
    rest = rest.select(*by, ((at((F.col("_n") - 1) / 2) + at(F.col("_n") / 2)) / 2).alias(name))
    return small.unionByName(one).unionByName(rest)
