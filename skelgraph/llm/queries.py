"""The registered queries, with production parameters over whole tables."""
from pyspark.sql import functions as F

from . import audit, decontam, extract, langid, licenses, media, mixing, packing, ranked, simhash, suffix, tokencount, urlfilter
from .common import table


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))))
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_extract(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_decontam(spark, sf_dir):
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("containment", F.round("containment", 6))


def op5_simhash(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_tokencount(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, vocabulary("piece_bpe_32k.model")).drop("text")


def op7_suffix(spark, sf_dir):
    return suffix.removed(table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    return media.digests(media.store(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)).drop("media")


def op9_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_urlfilter(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + " AS t(verdict, host, path)")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_ranked(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_extract, op3_packing, op4_decontam, op5_simhash, op6_tokencount, op7_suffix, op8_media, op9_licenses, op10_urlfilter, op11_ranked, op12_mixing, op13_audit)}
