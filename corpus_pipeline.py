"""The corpus pipeline: language ID, near-dedup, repeated strings, decontamination, packing.

The stages share their executors' Python workers, which keep the memory of their largest batch. So each
stage sets the session's bound on the bytes of an Arrow batch; it goes for results that are read later too.
"""
import functools

from pyspark.sql import functions as F

from skelgraph.llm import decontam, langid, nearcopies, packing, suffix
from skelgraph.llm.common import materialize, table, text_id
from skelgraph.llm.queries import vocabulary

BATCH = "8MB"


def _bounded(stage):
    """The stage, in a session whose Arrow batches hold about BATCH."""
    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)
    return run_stage


def _rows(docs, *more):
    """(row, ...): the columns of `docs` in one struct, so that no name clashes."""
    return docs.select(F.struct("*").alias("row"), *more)


@_bounded
def language(spark, docs, sf_dir):
    """Documents with a language, their columns as they were: null or letterless texts go."""
    return langid.identify(_rows(docs, "text"), langid.fit(docs)).where("lang_pred <> 'und'").select("row.*")


@_bounded
def near_dedup(spark, docs, sf_dir):
    """Of each group of near copies (linked by five-word Jaccard 0.8 or more) the document of the smallest doc_id; rows without doc_id stay."""
    return nearcopies.distinct(docs).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


@_bounded
def repeats(spark, docs, sf_dir):
    """Documents without passages of over 50 words that also stand elsewhere; n_chars, where there is one, counts what stays."""
    out = suffix.strip_passages(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


@_bounded
def decontaminate(spark, docs, sf_dir):
    """Documents that contain the text of no benchmark row, whatever the ids of both."""
    items = table(spark, sf_dir, "benchmark").select(text_id().alias("item_id"), "text").distinct()
    bad = decontam.contained(docs.select(text_id().alias("tid"), "text"), items, doc_col="tid").select(F.col("doc_id").alias("tid")).distinct()
    return _rows(docs, text_id().alias("tid")).join(materialize(bad, "contaminated"), "tid", "left_anti").select("row.*")


@_bounded
def pack(spark, docs, sf_dir):
    """Packed pieces of the documents."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", repeats), ("decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
