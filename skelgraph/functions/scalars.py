"""Column expressions on types, angles and distances."""
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EDGE_TAGS, TYPES


def type_onehot(kind: Column) -> Column:
    """Five slots; an unknown or null type gives zeros."""
    return F.array(*[F.coalesce((kind == t).cast("double"), F.lit(0.0)) for t in TYPES])


def edge_type_onehot(tag: Column, weight=1.0) -> Column:
    """Eleven slots; an unknown or null tag falls in slot 0."""
    other = [F.coalesce((tag == t).cast("double") * weight, F.lit(0.0)) for t in EDGE_TAGS[1:]]
    known = F.coalesce(tag.isin(EDGE_TAGS[1:]), F.lit(False))
    return F.array(F.when(known, 0.0).otherwise(float(weight)), *other)


def broad_class(kind: Column) -> Column:
    return F.when(kind.isin("Landmark", "Node"), "pt").when(kind.isin("Path", "Edge"), "ln").otherwise("pg")


def relative_angle(dx: Column, dy: Column, zero: Column) -> Column:
    """From 0 to two pi; an angle below zero by less than can be told from two pi becomes two pi and not 0, which `pmod` makes of it."""
    rest = (F.atan2(dy, dx) - zero) % (2 * math.pi)
    return rest + F.when(rest < 0, 2 * math.pi).otherwise(0.0)


def sector(rel: Column, sectors=8, edge="wrap") -> Column:
    s = F.floor(rel / (2 * math.pi) * sectors).cast("int")
    return F.pmod(s, F.lit(sectors)) if edge == "wrap" else F.least(F.greatest(s, F.lit(0)), F.lit(sectors - 1))


def relative_sector(dx: Column, dy: Column, zero: Column, sectors=8, edge="wrap") -> Column:
    rel = relative_angle(dx, dy, zero)
    return F.struct(rel.alias("rel"), F.cos(rel).alias("cos"), F.sin(rel).alias("sin"), sector(rel, sectors, edge).alias("sector"))


def radial_gate(d: Column, radius) -> Column:
    return F.exp(-0.5 * F.pow((d / (F.lit(radius) + 1e-8) - 1) / 0.5, 2)) / (d + 1e-3)


def soft_weight(d: Column, tau=0.5) -> Column:
    return F.exp(-d / max(1e-6, tau))


def pair_features(ga: Column, gb: Column) -> Column:
    """[ga, gb, |ga - gb|, ga * gb]."""
    return F.concat(ga, gb, F.zip_with(ga, gb, lambda a, b: F.abs(a - b)), F.zip_with(ga, gb, lambda a, b: a * b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
