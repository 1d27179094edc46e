"""URL filter: a blocked Bloom filter before an exact hash join, in SQL functions only.

A url asks for every suffix of its host with every path prefix of a length that
some rule has. Keys that the filter passes are joined with the rules. The longest
rule wins (ties: by name); urls without a rule are allowed. Null urls, or such
without `://`, have empty host and path. Repeated rows are judged each; an empty table gives no rows; urls are read whole.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS_PER_KEY = 16
PROBES = 4
MAX_BLOCKS = 1 << 20  # 16 MB of filter, the most that is broadcast


def parsed(pages: DataFrame, url_col="url") -> DataFrame:
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def _mask(key):
    """`PROBES` bits of one 64-bit block."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.expr("1L") for _ in range(PROBES)]
    out = None
    for k in range(PROBES):
        b = F.call_function("shiftleft", bits[k], F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        out = b if out is None else out.bitwiseOR(b)
    return out


def bloom(keys: DataFrame, n_keys: int):
    """((block, bits) of the filter, number of blocks) over column `key`."""
    blocks = min(MAX_BLOCKS, max(1, n_keys * BITS_PER_KEY // 64))
    rows = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), _mask(F.col("key")).alias("m"))
    return rows.groupBy("block").agg(F.bit_or("m").alias("bits")), blocks


def judge(pages: DataFrame, rules: DataFrame, default="allow") -> DataFrame:
    """All columns of `pages`, with host, path, rule and verdict, which replace columns of these names. `rules`: (verdict, host, path)."""
    pages = pages.drop(*{"host", "path", "rule", "verdict"} - {"url"})
    listed = rules.select(F.concat("host", "path").alias("rule"), F.concat_ws("\n", "host", "path").alias("key"), "verdict")
    shape = rules.agg(F.count("*"), F.collect_set(F.length("path"))).first()  # path lengths: as many as the longest path at most
    n, lengths = shape[0], sorted(shape[1])
    rows = parsed(pages)
    if not n:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    bits, blocks = bloom(listed, n)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = rows.select("host", "path").distinct()
    asked = places.select("host", "path", F.explode(suffixes).alias("s"))
    heads = F.array_distinct(F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])))
    asked = asked.select("host", "path", F.explode(F.transform(heads, lambda p: F.concat_ws("\n", F.col("s"), p))).alias("key"))
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(blocks)), "m": _mask(F.col("key"))})
    passed = asked.join(F.broadcast(bits), "block").where(F.col("bits").bitwiseAND(F.col("m")) == F.col("m")).select("host", "path", "key")
    won = passed.join(listed, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("r"))
    won = materialize(won, "won")  # an aggregate by the join's own key would keep the pages of a hot (host, path) in one task
    out = rows.join(won, ["host", "path"], "left")
    return out.select(*[rows[c] for c in pages.columns], "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
