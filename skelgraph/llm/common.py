"""Shared helpers of the training-data operators."""
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, codec="snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder, let go of the shuffle files behind it, and read it back."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "skelgraph", uuid.uuid4().hex, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def remove(spark: SparkSession, *folders: str):
    """Delete folders below the shared one that nothing reads any more."""
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def batches_of(batches, column, size):
    """Arrow batches cut so that each holds about `size` bytes of a string column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for rec in batches:
        if not len(rec):
            continue
        ends = np.cumsum(pc.binary_length(rec[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(rec):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield rec.slice(at, to - at)
            at = to


def word_table(kept: bytes) -> bytes:
    """For `bytes.translate`: A-Z in lower case, the ASCII bytes `kept` and all of 128 up as they are, the rest blank."""
    low = kept.lower()
    return bytes(b + 32 if 65 <= b <= 90 and b + 32 in low else b if b >= 128 or b in low else 32 for b in range(256))


def words_of(text, table, size=1 << 20):
    """Lists of the words (bytes) of a text, in order, each from about `size` bytes of it."""
    raw, at = (text or "").encode().translate(table), 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def attach(rows: DataFrame, result, names) -> DataFrame:
    """`rows` with the fields `names` of a struct column; they replace columns of the same name."""
    keep, own = [c for c in rows.columns if c not in names], f"result_{uuid.uuid4().hex}"
    out = rows.select(*[F.col(f"`{c}`") for c in keep], result.alias(own))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(own)[n].alias(n) for n in names])


def text_id(col="text"):
    """128 bits of the SHA-256 of a text: the same for equal texts."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(col), F.lit("")).cast("binary"), 256), 1, 32))
