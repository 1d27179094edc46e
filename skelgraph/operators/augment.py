"""Random augmentation from hashes: the same for any partitioning."""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import rotate


def uniform(seed, *keys) -> Column:
    """In (0, 1), by a hash of the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normals(seed, *keys):
    """Two independent standard normal values."""
    r, t = F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit(1)))), 2 * math.pi * uniform(seed, *keys, F.lit(2))
    return r * F.cos(t), r * F.sin(t)


def _view(nodes):
    return [F.col("view")] if "view" in nodes.columns else [F.lit(0)]


def jitter(nodes: DataFrame, sigma=0.02, seed=42) -> DataFrame:
    """Normal noise of deviation `sigma` on both coordinates of every node."""
    a, b = normals(seed, "sample_id", "node_id", *_view(nodes))
    return nodes.withColumns({"x": F.col("x") + sigma * a, "y": F.col("y") + sigma * b})


def elastic_deform(nodes: DataFrame, sigma=0.01, alpha=0.02, seed=42, waves=None) -> DataFrame:
    """Two sine waves of random direction and phase in each sample, and noise.

    `waves` gives the waves instead: (x, y, phase) columns of each, x and y being its direction.
    """
    x, y = F.col("x"), F.col("y")
    dx, dy = F.lit(0.0), F.lit(0.0)
    if waves is None:
        waves = [(*normals(seed, "sample_id", F.lit(wave), *_view(nodes)), uniform(seed, "sample_id", F.lit(wave + 10), *_view(nodes))) for wave in (11, 12)]
    for a, b, phase in waves:
        size = F.hypot(a, b) + 1e-6
        push = alpha * F.sin(2 * math.pi * (x * a / size + y * b / size + phase))
        dx, dy = dx + push * a / size, dy + push * b / size
    a, b = normals(seed + 1, "sample_id", "node_id", *_view(nodes))
    return nodes.withColumns({"x": x + dx + sigma * a, "y": y + dy + sigma * b})


def contrastive_views(nodes: DataFrame, sigma=0.02, seed=42, theta: Column | None = None) -> DataFrame:
    """Two views of every sample, each turned by an angle of its own (`theta`, if given) and jittered."""
    both = nodes.withColumn("view", F.explode(F.array(F.lit(1), F.lit(2))))
    turned = rotate(both, 2 * math.pi * uniform(seed, "sample_id", "view", F.lit(3)) if theta is None else theta)
    return jitter(turned, sigma, seed)
