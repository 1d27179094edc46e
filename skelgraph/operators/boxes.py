"""Pairs of overlapping boxes, of any mixture of sizes."""
from pyspark.sql import functions as F


def boxed(df, xs, ys, by, reach):
    """Adds the box (lx, ly, hx, hy) of coordinates, wider by `by` on each side, and the least level whose cells, reach * 2 ** level wide, are at least as wide."""
    box = df.withColumns({"lx": F.array_min(xs) - by, "hx": F.array_max(xs) + by, "ly": F.array_min(ys) - by, "hy": F.array_max(ys) + by})
    wide = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))
    return box.withColumn("level", F.when(wide > reach, F.ceil(F.log2(wide / reach))).otherwise(0).cast("int"))


def _in_cells(df, reach, level):
    """A row for each cell of that level under the box: at most two by two."""
    size = reach * F.pow(F.lit(2.0), F.col(level))
    steps = [F.sequence(F.floor(F.col(f"l{c}") / size), F.floor(F.col(f"h{c}") / size)) for c in "xy"]
    return df.withColumn("gx", F.explode(steps[0])).withColumn("gy", F.explode(steps[1]))


def meet(a, b, reach):
    """Pairs of rows of a sample whose boxes overlap, each once.

    Every box lies in the cells of its own level, so it has at most four copies however long it is; the smaller box of a pair asks at the
    larger one's level, of the levels that its sample has. The pair counts in the cell of the lower corner of what both share.
    """
    def side(mine, other, least):
        levels = other.select("sample_id", F.col("level").alias("at")).distinct()
        asks = _in_cells(mine.join(levels, "sample_id").where(F.col("at") >= F.col("level") + least), reach, "at")
        kept = _in_cells(other, reach, "level").withColumnRenamed("level", "at")
        named = kept.withColumnsRenamed({c: f"o_{c}" for c in ("lx", "ly", "hx", "hy")})
        met = asks.drop("level").join(named, ["sample_id", "at", "gx", "gy"])
        size = reach * F.pow(F.lit(2.0), F.col("at"))
        corner = [F.floor(F.greatest(F.col(f"l{c}"), F.col(f"o_l{c}")) / size) == F.col(f"g{c}") for c in "xy"]
        over = [(F.col(f"l{c}") <= F.col(f"o_h{c}")) & (F.col(f"o_l{c}") <= F.col(f"h{c}")) for c in "xy"]
        return met.where(corner[0] & corner[1] & over[0] & over[1]).drop("at", "gx", "gy", *(f"{p}{e}{c}" for p in ("", "o_") for e in "lh" for c in "xy"))

    first = side(a, b, 0)
    return first.unionByName(side(b, a, 1).select(*first.columns))
