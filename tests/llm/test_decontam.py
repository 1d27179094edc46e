"""Benchmark rows with repeated, missing and short items."""
import random

import pytest

import corpus_pipeline
from skelgraph.llm import decontam

Q, A = "what is the name of the long river", "it runs to the north sea in the end of all"
FAR = " ".join(f"w{i}" for i in range(3000))
DOCS = [(1, f"{FAR} {Q} {FAR} {A} tail"), (2, f"{FAR} {Q}"), (3, f"head {A} {FAR}"), (None, f"{FAR} null item with six own words {FAR}"), (None, FAR), (4, "null item with six own words")]
ITEMS = [(1, Q), (1, A), (1, None), (None, "Null item with six own words"), (2, "words that never stand in any of these")]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame(DOCS, "doc_id long, text string"), str(tmp_path)


def test_rows_with_one_id_are_one_item(spark, tables, monkeypatch):
    docs, path = tables
    items = spark.read.parquet(f"{path}/benchmark.parquet")
    for bits in (27, 7):  # a full bitmap passes more, and changes nothing
        monkeypatch.setattr(decontam, "MAX_BITS", bits)
        assert [tuple(r) for r in decontam.contained(docs, items).collect()] == [(1, 1, 1.0)]


def test_pipeline_goes_by_rows(spark, tables):
    docs, path = tables
    got = corpus_pipeline.decontaminate(spark, docs, path)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(None, FAR)]


def planted(rnd, n, swaps, per):
    """Documents with one item each, of n words of which `swaps` were changed."""
    vocab = [f"v{i}" for i in range(3000)]
    items = [[rnd.choice(vocab) for _ in range(n)] for _ in range(per)]
    docs = []
    for own in items:
        own = list(own)
        for k in rnd.sample(range(n), swaps):
            own[k] = "changed"
        docs.append(" ".join([*(rnd.choice(vocab) for _ in range(rnd.randint(50, 4000))), *own, *(rnd.choice(vocab) for _ in range(rnd.randint(50, 4000)))]))
    return [" ".join(i) for i in items], docs


def test_recall_by_length_and_containment(spark):
    """All short items and at least 0.9 of the long ones, at containment 0.8 to 1."""
    rnd, items, docs, group = random.Random(5), [], [], []
    for n in (5, 6, 9, 20, 60, 68, 100, 250, 700):
        for swaps in sorted({0, (n - 4) // 50, (n - 4) // 26}):
            a, b = planted(rnd, n, swaps, 12)
            items, docs, group = items + a, docs + b, group + [(n, swaps)] * 12
    want = {}
    for k, (item, doc) in enumerate(zip(items, docs)):
        own, have = set(decontam.shingles(item)), set(decontam.shingles(doc))
        if len(own & have) / len(own) >= 0.8:
            want[k] = len(own & have) / len(own)
    got = decontam.contained(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    found = {r.doc_id: r.containment for r in got.collect() if r.doc_id == r.item_id}
    recall = {g: [0, 0] for g in group}
    for k in want:
        recall[group[k]][0] += k in found
        recall[group[k]][1] += 1
    assert all(abs(found[k] - want[k]) < 1e-9 for k in found) and set(found) <= set(want) and min(want.values()) < 0.9
    assert all(hit == n for (words, _), (hit, n) in recall.items() if words <= 68), recall
    assert all(hit >= 0.9 * n for hit, n in recall.values()), recall
