"""The corpus pipeline against brute force."""
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skelgraph.llm import nearcopies, queries, suffix, wordbpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "a", "of", "über", "house", "river", "stone", "we", "in", "small", "light", "to", "x"]


def passage(rnd, n):
    return [rnd.choice(WORDS) + str(rnd.randrange(100)) for _ in range(n)]


def planted():
    """Texts that share passages of 45 to 65 words, some with other white space."""
    rnd = random.Random(7)
    texts = []
    for n in list(range(49, 66)) + [200]:
        shared = passage(rnd, n)
        texts += [" ".join(passage(rnd, 90)) + sep + sep.join(shared) + " " + " ".join(passage(rnd, 5)) for sep in (" ", "\n")]
    return texts


def brute_passages(texts, length=51):
    split = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    words = [[t[a:z] for a, z in s] for t, s in zip(texts, split)]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for t, s, w in zip(texts, split, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone |= set(range(s[i][0], s[i + length - 1][1]))
        out.append("".join(c for k, c in enumerate(t) if k not in gone))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(planted())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b1", "five words never found here")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_passages_of_over_50_words_go(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = planted()
    want = brute_passages(texts)
    assert want[0] == texts[0] and want[4] != texts[4]  # 49 words stay, 51 go
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs, corpus).collect()}
    assert [got[i].text for i in range(len(want))] == want and all(r.n_chars == len(r.text) for r in got.values())
    tok = wordbpe.model(queries.vocabulary("word_bpe_49k.json")).tok
    packed = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, corpus).collect()}
    assert packed == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(want)}


def test_python_workers_get_batches_of_bounded_bytes(spark, corpus):
    """4,000 texts of 11 kB in one partition, read in the session of each stage."""
    def sizes(batches):
        for rec in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rec.nbytes])], names=["n"])

    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("some words "), 1000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, before)
            stage(spark, spark.read.parquet(f"{corpus}/documents.parquet").limit(4), corpus)
            got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(got) < 9 << 20 and sum(got) > 40 << 20
    finally:
        spark.conf.set(key, before)


def test_strings_without_words_go_by_bytes(spark):
    rnd = random.Random(3)
    han = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300)) for _ in range(3)]
    rows = [(1, han[0] + han[1], None, None, 0), (2, han[2] + " " + han[1], None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0)]
    got = {r.doc_id: r.text for r in suffix.strip_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: han[0], 2: han[2] + " ", 3: None, 4: ""}
    assert suffix.strip_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(11)
    rows = []
    for base in range(20):
        words = passage(rnd, 200)
        for swaps in (0, 1, 2, 3, 8, 40):
            own = list(words)
            for k in rnd.sample(range(200), swaps):
                own[k] = f"z{rnd.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(own), "en", "a", 0))
    rows += [(500, rows[0][1], "en", "a", 0), (None, rows[0][1], "en", "a", 0)]
    kept = []
    for r in rows[:-1]:
        if not any(brute_jaccard(r[1], k[1]) >= 0.8 for k in kept):
            kept.append(r)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), None).collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert ids == [k[0] for k in kept] and 20 < len(ids) < 100 and len(got) == len(ids) + 1


def test_groups_cut_in_blocks_equal_brute_force(spark):
    """A star of near copies, a chain of small changes and strangers, in blocks of 8 texts."""
    rnd = random.Random(5)
    base = passage(rnd, 150)
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rnd.sample(range(150), rnd.randrange(12)):
            own[k] = f"y{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(own))
    chain = passage(rnd, 150)
    for _ in range(12):
        chain[rnd.randrange(150)] = f"x{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(chain))
    texts += [" ".join(passage(rnd, 150)) for _ in range(5)] + ["", None, " \n", "two words", "two Words"]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i] or "", texts[j] or ""
            if root[i] != root[j] and (brute_jaccard(a, b) >= 0.8 or not (a.split() or b.split())):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, tid int, row string")
    want = sorted(set(root))
    assert 10 < len(want) < 60
    for block in (8, 256):
        got = nearcopies.distinct(docs, block=block)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert nearcopies.distinct(docs.limit(0)).count() == 0
