"""Ranked search, mixing and source audit against plain Python on small tables and awkward rows."""
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from skelgraph.llm import audit, mixing, oracles, queries, ranked

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score long, size long"
RNG = random.Random(4)
WORDS = [f"w{i}" for i in range(60)]


def text(n):
    return " ".join(RNG.choices(WORDS, [1 / (i + 1) for i in range(60)], k=n))


SAME = text(30)
ROWS = [(i, text(RNG.choice([3, 20, 80])), RNG.choice(["en", "fr", None]), RNG.choice(["a", "b", "c", None]), 7, -1) for i in range(240)]
ROWS += [(300, None, "en", "a", 1, 1), (301, "", None, None, 1, 1), (302, " \t\n", "fr", "z", 1, 1), (303, "Éa W1 w1 £w1", "en", "a", 1, 1), (304, "x " * 300_000 + "w1", "en", "b", 1, 1)]
ROWS += [(400, SAME, "en", "hot", 1, 1)] * 70 + [(None, SAME, "en", "hot", 1, 1)] * 5 + [(500 + i, SAME, "de", "hot", 1, 1) for i in range(40)]
ITEMS = [(0, "w1 w2 w3"), (1, "W59 w58 w57 w59 w1 w1"), (2, None), (3, "nothing here"), (0, "w4"), (None, SAME), (5, SAME + " " + text(40))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(value):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))


def ranking(docs, items, k):
    counted = [(r[0], Counter(terms(r[1]))) for r in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    big_n, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(Counter)
    for item, value in items:
        asked[item].update(terms(value))
    out = []
    for item, q in asked.items():
        scored = []
        for d, c, n in counted:
            m = 75 + (25 * n * big_n) // length
            s = sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 17, 4])
def test_ranking_equals_brute_force(spark, rows, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.search(rows, items, k=6, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranking(ROWS, ITEMS, 6)


def test_ranking_of_string_ids_and_empty_tables(spark, rows, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    named = rows.where("doc_id IS NOT NULL").selectExpr("concat('d', doc_id) AS name", "text AS body")
    got = ranked.search(named, items.selectExpr("CAST(item_id AS string) AS q", "text"), k=3, doc_col="name", text_col="body", item_col="q").collect()
    want = ranking([(f"d{r[0]}", r[1]) for r in ROWS if r[0] is not None], [(None if i is None else str(i), t) for i, t in ITEMS], 3)
    assert sorted([(r.item_id, r["rank"], r.score) for r in got], key=repr) == sorted([(i, k, s) for i, k, _, s in want], key=repr)
    assert ranked.search(empty, items).count() == 0
    assert ranked.search(rows, items.limit(0)).count() == 0


def test_accumulators_are_limited_and_scores_exact():
    rng = np.random.default_rng(1)
    docs, vocabulary = 4000, 40
    df = np.geomspace(3, 3500, vocabulary).astype(int)
    doc = np.concatenate([np.sort(rng.choice(docs, n, replace=False)) for n in df])
    term = np.repeat(np.arange(vocabulary), df)
    order = np.lexsort((term, doc))
    size = np.bincount(doc, minlength=docs)
    tfs = rng.integers(1, 5, len(doc))
    part = ranked.Slice(np.full(docs, 50), size, term[order], tfs, vocabulary, docs, 50 * docs)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df])
    whole = np.zeros(docs, np.int64)
    np.add.at(whole, part.doc, weight[np.repeat(np.arange(vocabulary), np.diff(part.start))] * part.share)
    found, score, made = part.search(np.arange(vocabulary), weight, 10)
    assert (score == whole[found]).all()
    assert sorted(-score)[:10] == sorted(-whole)[:10]
    assert made < (whole > 0).sum() * 2 / 3
    least = int(np.sort(whole)[-10])
    found, score, made_again = part.search(np.arange(vocabulary), weight, 10, least)
    assert set(found) >= set(np.flatnonzero(whole >= least)) and made_again <= made


@pytest.mark.parametrize("name", ["op11_ranked", "op13_audit"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(want)


def audited(docs, least):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(r[2] or "", r[3] or "", Counter(word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")))) for r in docs]
    df = Counter((lang, t) for lang, _, c in found for t in c)
    groups, out = defaultdict(Counter), []
    for lang, source, c in found:
        groups[lang, source].update({t: n for t, n in c.items() if df[lang, t] >= least})
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        whole = sum((c for g, c in groups.items() if g[0] == lang), Counter())

        def p(c):
            return {t: 1 + (10 ** 9 * (c[t] + 5)) // (c.total() + 5 * len(kept)) for t in kept}
        q, each = p(whole), {g[1]: p(c) for g, c in groups.items() if g[0] == lang}
        for s, own in each.items():
            pairs = sorted((-sum(abs(own[t] - other[t]) for t in kept), o) for o, other in each.items() if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)]
            best = sorted((q[t] - own[t], t) for t in kept if groups[lang, s][t] and own[t] > q[t])[:50]
            out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, block, cells", [(30, 512, 300_000), (2, 2, 40), (1000, 512, 300_000)])
def test_audit_equals_brute_force(rows, empty, least, block, cells):
    """Also with pairs of blocks, stripes handed on early, and no kept term at all."""
    got = audit.audit(rows, least, block, cells)
    assert sorted(tuple(r) for r in got.collect()) == audited(ROWS, least)
    assert audit.audit(empty).count() == 0


def test_portions_are_exact_for_large_counts():
    counts = np.array([5, 10 ** 12 + 7, 9 * 10 ** 14], np.int64)
    total = 9 * 10 ** 14 + 12345
    assert audit.portions(counts, total).tolist() == [1 + 10 ** 9 * int(c) // total for c in counts]


def words(value):
    return len(re.findall(r"[^\x20\x09-\x0D]+", value or ""))


def levels(sizes, most=3):
    """Targets by giving the excess to the others again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        free = sum(weight[s] for s in rest)
        now = {s: (total - sum(full.values())) * weight[s] / free for s in rest}
        over = [s for s in rest if now[s] > most * sizes[s]]
        if not over:
            return full | now
        full |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets_and_repeats(rows, empty):
    got = mixing.mix(rows)
    out = got.collect()
    assert sorted((r.doc_id or -1, r.source or "", r["size"]) for r in out) == sorted((r[0] or -1, r[3] or "", words(r[1])) for r in ROWS)
    sizes, taken, target = Counter(), Counter(), {}
    for r in ROWS:
        sizes[r[3]] += words(r[1])
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    want = levels(sizes)
    assert target == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    longest = {s: max(words(r[1]) for r in ROWS if r[3] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]
        if s in ("a", "c", None, "hot"):
            assert abs(taken[s] - target[s]) <= 80

    def plain(df):
        return sorted(df.collect(), key=repr)
    assert plain(mixing.mix(rows.repartition(3))) == plain(got)  # the same for another partitioning
    assert plain(mixing.mix(rows, seed=1)) != plain(got)
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(rows.where("doc_id IN (300, 301, 302)")).collect()} == {0}


def test_mix_levels_and_given_weights(spark):
    """Three levels of blocks of four; every document keeps its expected copies over many seeds."""
    rng = random.Random(2)
    docs = [(i, "w " * rng.randrange(1, 40), "x" if i % 3 else "y") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string").coalesce(2)
    weights = spark.createDataFrame([("x", 1), ("y", 9)], "source string, weight long")
    sums, runs = Counter(), 12
    for seed in range(runs):
        out = mixing.mix(df, seed=seed, fan=4, weights=weights).collect()
        for s in "xy":
            own = [r for r in out if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 40
            assert {r.copies for r in own} <= {math.floor(own[0].target / own[0].source_size), math.ceil(own[0].target / own[0].source_size)}
        sums.update({r.source: r.copies for r in out})
        rate = {r.source: r.target / r.source_size for r in out}
        for r in out:
            sums[r.source, r.doc_id % 2] += r.copies
    for s in "xy":
        for half in (0, 1):
            n = sum(1 for i, _, x in docs if x == s and i % 2 == half)
            assert sums[s, half] / runs / n == pytest.approx(rate[s], abs=0.12)
