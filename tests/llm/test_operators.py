"""Brute-force checks of the training-data operators on sf0.001 and awkward rows."""
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from skelgraph.llm import decontam, extract, langid, licenses, media, packing, queries, simhash, suffix, tokencount, urlfilter, wordbpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, "123 !!", "en", None, 6), (5, LONG, "en", "a", 9),
       (6, LONG, "en", "b", 9), (6, LONG, "en", "b", 9), (None, "one two", "fr", "c", 7), (7, "Ünïcode ▁ ﬁ <s> <|endoftext|> 's 東京", None, "a", 9),
       (8, "a" * 2500, "en", "a", 2500), (9, "All rights reserved. all rights reserved CC BY-NC 4.0", "en", "d", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy_and_odd_rows(spark, docs, odd, empty):
    got = queries.op1_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4 and 0 <= out[5].score <= 1
    assert langid.identify(odd, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def _ranked(counts, size=400):
    return sorted(counts, key=lambda g: (-counts[g], [len(g), *map(ord, g)]))[:size]


def _counted(text):
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        found.update([*word, *(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1))])
    return found


def test_language_ranks_and_distances_equal_plain(spark, docs):
    rows = docs.collect()
    learned = defaultdict(Counter)
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learned[r.lang].update(_counted(r.text))
    place = {lang: {g: k for k, g in enumerate(_ranked(c))} for lang, c in learned.items()}
    got = {r.doc_id: r for r in queries.op1_langid(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = _ranked(_counted(r.text or ""))
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        far, lang = min((sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)), lang) for lang, p in place.items())
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(1 - far / (400 * len(own)), abs=1e-12)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_blocks_equal_whole(monkeypatch):
    a = langid.grams(LONG[:50_000])
    monkeypatch.setattr(langid, "_BLOCK", 1000)
    b = langid.grams(LONG[:50_000])
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_extract(spark):
    page = ("<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use the cookies and so on for you</div>"
            "<article><h1>A &amp; B</h1><p>The first   part of the text<br>and more<p>Short<div class=ad>Buy the thing</div><aside>side</aside>"
            "<form>the form</form><section id=comments><p>I like the text of this and that for all it is</p></section></article>"
            "<footer>&copy; me</footer><script>var a='<p>'</script></body></html>")
    assert extract.main_text(page) == "A & B\nThe first part of the text and more\nShort"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, page)], "page_id long, html string")
    assert [r.n_chars for r in extract.extract(rows).orderBy("page_id").collect()] == [0, 0, 47]  # 5 + 1 + 35 + 1 + 5
    got = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract.extract(got).collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        import html
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(x for x in want if x)


GOOD = "The long story of that and this is for it. " * 4


def test_extract_rules_decide_without_article():
    page = ("<html lang=en><body><div>Home</div><h1>Title</h1><p>" + GOOD + "</p><p>Short</p><p>" + GOOD + "</p><p>" + "keyword tag cloud item " * 8 + "</p>"
            "<ul><li><a href=x>One link</a></li><li><a href=y>Two links</a></li></ul><div>Imprint</div></body></html>")
    text = extract.main_text(page)
    assert text == "\n".join(["Home", "Title", GOOD.strip(), "Short", GOOD.strip()])  # what is near a good block stays with it
    assert "keyword" in extract.main_text(page, frozenset()) and "keyword" not in text
    assert extract.first_pass("en", extract.blocks(page)[1]) == [None, None, True, None, True, False, False, False, None]
    foreign = "<body><h1>Привет</h1><p>" + "Длинный рассказ о том и этом для всех людей. " * 4 + "</p><nav>Меню</nav></body>"
    assert extract.main_text(foreign).startswith("Привет\nДлинный") and "Меню" not in extract.main_text(foreign)


def test_extract_articles_are_hints():
    story = "<p>" + GOOD + "</p>"
    assert extract.main_text(f"<body>{story}<article class='comment'>{story}x</article></body>") == GOOD.strip()
    assert extract.main_text(f"<body><article><p>Teaser</p></article>{story}</body>").endswith(GOOD.strip())
    whole = f"<article>{story}<p>See <a>long reference title</a></p><li><a>Reference one</a></li><div class='related-work'>Of the work</div></article><p>{GOOD}</p>"
    assert extract.main_text(whole) == "\n".join([GOOD.strip(), "See long reference title", "Reference one", "Of the work"])


def test_extract_is_linear_in_bad_pages():
    began = time.time()
    for page in ("<a " * 350_000, "<!" * 500_000, '<a "' * 250_000, "<script " * 125_000, "<p>" * 300_000):
        extract.main_text(page)
    assert time.time() - began < 20


def test_extract_clashes_and_repeats(spark):
    rows = spark.createDataFrame([(1, f"<p>{GOOD}", "old", 5)] * 2, "page_id long, html string, text string, n_chars int")
    got = extract.extract(rows)
    assert got.columns == ["page_id", "html", "text", "n_chars"] and [r.text for r in got.collect()] == [GOOD.strip()] * 2


def check_packing(rows, frame):
    tok = wordbpe.model(queries.vocabulary("word_bpe_49k.json")).tok
    byid = defaultdict(list)
    for r in rows:
        byid[r.doc_id].append(r)
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for w, parts in by_seq.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == 2048 or (w == max(by_seq) and at < 2048)
    for r in frame:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        want = Counter()
        for p in byid[r.doc_id]:
            assert p.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            want[p.start] += p.length
        copies = sum(x.doc_id == r.doc_id for x in frame)
        assert sum(want.values()) == copies * len(ids)


def test_packing(docs, odd, empty):
    path = queries.vocabulary("word_bpe_49k.json")
    check_packing(packing.pack(docs, path).collect(), docs.collect())
    check_packing(packing.pack(odd, path).collect(), odd.collect())
    assert packing.pack(empty, path).count() == 0
    one = packing.pack(docs.withColumnsRenamed({"n_chars": "queue"}), path, weights={"a": 3}).collect()
    check_packing(one, docs.collect())


def test_packing_schedule_keeps_targets(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    totals = [100_003, 7, 50_000, 1, 33, 20_000]
    for weights in (None, [1, 1, 1, 1, 1, 1], [5, 1, 0, 2, 0, 90]):
        s = packing.Schedule(totals, weights, 256)
        given = np.concatenate([s.block(b)[0][:-1] for b in range(-(-s.windows // 16))] + [[totals]])
        assert (np.diff(given, axis=0) >= 0).all() and (given.sum(1) == np.minimum(np.arange(s.windows + 1) * 256, s.all)).all()
        if weights is None:  # no deficit ever reaches two tokens
            assert (abs(given - np.outer(given.sum(1), totals) / s.all) <= 2).all()
        elif weights[2]:  # equal shares until the small queues are dry
            assert (abs(given[20] - [(5120 - 41) / 3, 7, (5120 - 41) / 3, 1, 33, (5120 - 41) / 3]) <= 2).all()
        else:  # the queues of weight zero come when the others are dry
            others = sum(totals[k] for k in (0, 1, 3, 5))
            assert (given[:others // 256, [2, 4]] == 0).all() and abs(given[10][5] - (2560 - 8) * 90 / 95) < 2  # two of 8 tokens are dry by then
        for q in range(6):
            pos, window, offset = s.spans(q, totals[q] // 3, totals[q])
            assert pos[0] == totals[q] // 3 and (np.diff(pos) > 0).all() and (given[window, q] <= pos).all() and (pos < given[window + 1, q]).all()


def test_packing_windows_are_counted_together(monkeypatch):
    """Blocks equal the count window by window, and queues of a token a window or more hardly need it."""
    rnd = random.Random(4)
    at_once = packing.Schedule._at_once
    used = []
    for totals in ([rnd.randrange(200_000, 900_000) for _ in range(20)], [400_000, 3, 90_000, 0, 50, 1], [700_000]):
        for weights in (None, [rnd.randrange(8) for _ in totals]):
            monkeypatch.setattr(packing.Schedule, "_at_once", lambda *a: None)
            one = packing.Schedule(totals, weights)
            want = [one.block(b) for b in range(-(-one.windows // packing.BLOCK))]
            monkeypatch.setattr(packing.Schedule, "_at_once", lambda *a: used.append(at_once(*a)) or used[-1])
            s = packing.Schedule(totals, weights)
            used.clear()
            got = [s.block(b) for b in range(len(want))]
            assert all((x == y).all() for w, g in zip(want, got) for x, y in zip(w, g))
            if weights is None and min(totals) > 100_000:
                assert sum(len(u) - 1 for u in used if u is not None) > 0.9 * s.windows


def test_packing_ids_equal_the_library():
    bpe, rnd = wordbpe.model(queries.vocabulary("word_bpe_49k.json")), random.Random(1)
    parts = ["a", "aa", "aaa", "the", "'s", "'S", "'ll", " ", "  ", "\n", "\t", "\u0301", "é", "É", "İ", "ß", "Σ", "ς", "ﬁ", "東京", "0", "½", "٣", "!", "...", "_", "<|endoftext|>", "<|STARTOFTEXT|>",
             "\x1c", "\x85", "\u200b", "\u3000", "😀", "x" * 70, "zq" * 40, "\x00", "ǅ", "Ⅷ", "क्षि"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000 + " x", ""]
    for k in range(0, len(texts), 500):
        ids, offsets = bpe.encode(pa.array(texts[k:k + 500], pa.string()), 1)
        for t, a, z in zip(texts[k:k + 500], offsets[:-1], offsets[1:]):
            assert ids[a:z].tolist() == [*bpe.tok.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_decontamination(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = set()
    sets = {r.item_id: set(decontam.shingles(r.text)) for r in items.collect()}
    for r in docs.collect():
        have = set(decontam.shingles(r.text))
        want |= {(r.doc_id, i) for i, s in sets.items() if s and len(s & have) / len(s) >= 0.8}
    assert {(r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()} == want and want
    assert decontam.contained(odd, items).count() == 0 and decontam.contained(empty, items).count() == 0
    assert decontam.contained(odd, items.limit(0)).count() == 0
    far = spark.createDataFrame([(1, LONG + " alpha beta gamma delta epsilon zeta " + LONG)], "doc_id long, text string")
    tiny = spark.createDataFrame([(1, "Alpha, beta gamma DELTA epsilon zeta"), (2, None), (3, "zeta eta theta iota kappa")], "item_id long, text string")
    assert [r.item_id for r in decontam.contained(far, tiny).collect()] == [1]


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i] ^ ids[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(ids))]


def test_simhash(docs, odd, empty):
    for frame in (docs, odd):
        rows = frame.collect()
        fps = [brute_fp(r.text) for r in rows]
        comp = brute_components(fps)
        least = {c: min((r.doc_id for r, x in zip(rows, comp) if x == c and r.doc_id is not None), default=None) for c in comp}
        want = Counter((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp))
        assert Counter(tuple(r) for r in simhash.classes(frame).collect()) == want
    assert simhash.classes(empty).count() == 0


def test_simhash_links_on_dense_fingerprints(spark, monkeypatch):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    ids = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(40)} | {0, 2 ** 64 - 1, 1, 3, 7})
    signed = [x - 2 ** 64 if x >> 63 else x for x in ids]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame, 2, block=16)).collect()}
    a, b = defaultdict(set), defaultdict(set)
    for x, c in zip(signed, brute_components(ids)):
        a[c].add(x)
        b[got.get(x, x)].add(x)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_components_of_long_chains_and_stars(spark, monkeypatch):
    written = []
    real = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.append(name) or real(df, name))
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, 1001 + k) for k in range(50)] + [(3000, 2000 + k) for k in range(50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long").coalesce(2)).collect()}
    assert {got[k] for k in range(301)} == {0} and {got[1000 + k] for k in range(51)} == {1000} and {got[x] for x in [*range(2000, 2050), 3000]} == {2000}
    assert written.count("edges") - 1 <= 8


def test_token_counts(docs, odd, empty):
    path = queries.vocabulary("piece_bpe_32k.model")
    c = tokencount.counter(path)
    for frame in (docs, odd):
        for r in tokencount.count_tokens(frame, path).collect():
            assert r.n_tokens == len(c.sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    rnd = random.Random(0)
    for _ in range(3000):
        t = "".join(rnd.choice([" ", "  ", "▁", "\n", "the", "a", "é", "x", "ing", "\t", "<s>", "0", "東"]) for _ in range(rnd.randint(0, 12)))
        assert c.count(t) == len(c.sp.encode(t)), repr(t)
    assert tokencount.count_tokens(empty, path).count() == 0


def brute_removed(rows, length):
    seen = Counter()
    data = [(r.text or "").encode() for r in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[hash(d[i:i + length])] += 1
    out = Counter()
    for r, d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out[(r.doc_id, len(d), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest())] += 1
    return out


SMALL = suffix.Search(40, 20, 1)


def brute_passages(rows, length=51):
    """(passages, words in them) of each text."""
    split = [(r.text or "").split() for r in rows]
    seen = Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = True
        out.append((int((gone[1:] & ~gone[:-1]).sum() + gone[0]), int(gone.sum())))
    return out


def test_suffix(docs, odd, empty):
    for frame, search in ((docs, suffix.STRINGS), (odd, suffix.STRINGS), (docs.limit(60), SMALL)):
        frame = frame.cache()
        rows = frame.collect()
        got = suffix.removed(frame, search).collect()
        assert Counter(tuple(r)[:5] for r in got) == brute_removed(rows, search.length)
        assert Counter((r.doc_id, r.n_passages, r.n_passage_words) for r in got) == Counter((r.doc_id, *p) for r, p in zip(rows, brute_passages(rows)))
    assert suffix.removed(empty).count() == 0
    clash = odd.withColumnsRenamed({"lang": "tid", "source": "spans", "n_chars": "row"})
    assert suffix.strip_repeats(clash).columns == clash.columns and suffix.strip_repeats(clash).count() == odd.count()


def test_suffix_large_groups(docs, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 2)
    frame = docs.limit(80)
    assert Counter(tuple(r)[:5] for r in suffix.removed(frame, SMALL).collect()) == brute_removed(frame.collect(), 40)


def test_suffix_family(docs, spark, tmp_path):
    frame = docs.limit(80)
    spans = [{bytes(r.tid): sorted(map(tuple, r.spans)) for r in suffix.repeats(frame, suffix.F.lit(3), SMALL, batches=n).collect()} for n in (1, 3, 5)]
    assert spans[0] and spans[0] == spans[1] == spans[2]
    family = suffix.Family(spark, f"file://{tmp_path}", 4)
    rows, seen = [(0, 1), (1, 1), (2, 2)], []
    for batch in (rows, [], [(2, 1), (3, 1)], [(9, 3)], [(1, 1)]):
        seen.append(sorted(r.key for r in family.add(spark.createDataFrame(batch, "key long, n long")).collect()))
    assert seen == [[2], [], [2], [9], [1]] and [rank for rank, _ in family.levels] == [2, 0]
    family.save()
    later = suffix.Family.open(spark, f"file://{tmp_path}")
    assert later.levels == family.levels and later.buckets == 4
    assert sorted(r.key for r in later.add(spark.createDataFrame([(0, 1), (7, 1)], "key long, n long")).collect()) == [0]
    assert sorted(map(tuple, later.level(later.levels[0][1]).collect())) == [(0, 1), (1, 1), (2, 3), (3, 1), (9, 3)]


def test_suffix_levels_are_scanned_without_a_shuffle(spark, tmp_path):
    family = suffix.Family(spark, f"file://{tmp_path}", 4)
    path = family._write(spark.range(100).select(suffix.F.col("id").alias("key"), suffix.F.lit(1).cast("long").alias("n")))
    plan = family.level(path).hint("merge").join(family.level(path), "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_suffix_blocks(monkeypatch):
    data = (LONG[:9000] * 2).encode()
    whole = set(suffix.regions(data)[0].tolist())
    monkeypatch.setattr(suffix, "_BLOCK", 1 << 12)
    assert whole == set(suffix.regions(data)[0].tolist())


def test_media(docs, odd, empty):
    for frame in (docs, odd):
        for r in media.store_text(frame).collect():
            raw = (r.text or "").encode()
            want = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
            code, channels, rate, block, back = media.read_wav(r.media)
            assert (channels, rate, back) == (1, 8000, want) and code == (7, 6, 17)[zlib.crc32(want) % 3] and block == (576 if code == 17 else 1)
            assert (r.payload_sha256, r.tail_crc32, r.media_bytes) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]), len(r.media))
            assert (r.pcm_bytes, r.pcm_sha256) == (len(r.pcm), hashlib.sha256(r.pcm).hexdigest()) and len(r.pcm) == 4 * (len(want) if code != 17 else len(want) // 576 * 1145)
    assert media.store_text(empty).count() == 0
    clash = odd.withColumnsRenamed({"lang": "media", "source": "feature"})
    assert sorted(media.store_text(clash).columns) == sorted(["doc_id", "text", "n_chars", *media.store_text(odd).drop(*odd.columns).columns])
    held = media.store(odd, keep_text=False)
    assert held.columns == ["doc_id", "lang", "source", "n_chars", "n_bytes", "media"] and "FileScan" in held._jdf.queryExecution().toString() and "mapInArrow" not in held._jdf.queryExecution().toString()
    same = lambda df: sorted(map(repr, df.select("doc_id", "payload_sha256", "feature", "pcm_sha256").collect()))
    assert same(media.digests(held)) == same(media.store_text(odd))
    mu, al = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (al[0xD5], al[0x55], al[0x2A], al[0xAA]) == (8, -8, -32256, 32256)


def test_decode_media(spark):
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 256, 1200, dtype=np.uint8).tobytes()
    two = b"".join(x for k in range(0, 512, 4) for x in (data[k:k + 4], data[600 + k:604 + k]))
    files = {"mu": media.wav(data), "al": media.wav(data, media.ALAW), "ima": media.wav(data[:600], media.IMA, block=512), "two": media.wav(two, media.IMA, block=1024, channels=2),
             "pcm": media.wav(data, media.PCM, bits=16), "none": None, "text": b"no media", "cut": media.wav(data)[:30], "empty": b""}
    got = {r.k: r for r in media.decode_media(spark.createDataFrame([*files.items(), ("mu", files["mu"])], "k string, media binary"), 8000).collect()}
    ima = np.concatenate([media.ima_decode(data[:512], 512), media.ima_decode(data[512:600], 88)])
    assert got["mu"].pcm == media.mulaw_table()[list(data)].astype("<i2").tobytes() and got["al"].pcm == media.alaw_table()[list(data)].astype("<i2").tobytes()
    assert got["ima"].pcm == ima.astype("<i2").tobytes() and got["pcm"].pcm == data
    left, right = (media.ima_decode(data[a:a + 512], 512) for a in (0, 600))
    assert got["two"].channels == 2 and got["two"].pcm == np.stack([left, right], 1).astype("<i2").tobytes()
    assert [got[k].pcm for k in ("none", "text", "empty")] == [None] * 3 and got["cut"].pcm in (None, b"")


def test_ima_blocks_match_one_by_one():
    rnd = np.random.default_rng(0)
    b = rnd.integers(0, 256, 256 * 3, dtype=np.uint8)
    b[[2, 258, 514]] %= 89
    want = []
    for block in b.reshape(-1, 256):
        pred, index = int(block[:2].copy().view("<i2")[0]), int(block[2])
        want.append(pred)
        for byte in block[4:]:
            for nib in (int(byte) & 15, int(byte) >> 4):
                step = int(media.IMA_STEPS[index])
                d = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
                pred = max(-32768, min(32767, pred - d if nib & 8 else pred + d))
                index = max(0, min(88, index + int(media.IMA_MOVES[nib & 7])))
                want.append(pred)
    assert (media.ima_decode(b.tobytes()) == np.array(want)).all()


def test_licenses(docs, odd, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for frame in (docs, odd):
        for r in licenses.scan(frame).collect():
            w = word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
            at = {lab: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for lab, p in licenses.BASE}
            every = [i for x in at.values() for i in x]
            assert (r.n_words, r.n_base) == (len(w), len(every))
            assert (r.first_word, r.last_word) == (min(every, default=None), max(every, default=None))
            assert r.base_labels == ",".join(sorted(k for k, x in at.items() if x)) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
            assert ("mit" in r.labels.split(",")) == ("Released under the MIT License" in (r.text or "")) and 0 <= r.score <= 1
    assert licenses.scan(empty).count() == 0
    twice = licenses.scan(licenses.scan(odd))
    assert len(twice.columns) == len(set(twice.columns)) == len(odd.columns) + 7


def test_urls(spark):
    urls = ["http://example.org/es/x", "HTTP://A.Example.ORG/en/12?x=1#y", "x.org", None, "https://example.com", "https://b.com/de/", "ftp://org/#/a", "a://b://c.org/"]
    rules = spark.createDataFrame(queries.RULES, "verdict string, host string, path string")
    got = urlfilter.judge(spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)], "page_id long, url string, verdict0 string"), rules)
    rows = [(r.host, r.path, r.rule, r.verdict) for r in got.orderBy("page_id").collect()]
    assert rows == [("example.org", "/es/x", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
                    ("example.com", "", None, "allow"), ("b.com", "/de/", "com/de/", "block"), ("org", "/", "org/", "allow"), ("b:", "//c.org/", None, "allow")]
    again = urlfilter.judge(got, rules)
    assert sorted(again.columns) == sorted(got.columns) and again.orderBy("page_id").select("host", "path", "rule", "verdict").collect() == got.orderBy("page_id").select("host", "path", "rule", "verdict").collect()
    assert urlfilter.judge(got.limit(0).select("page_id", "url"), rules).count() == 0
    assert urlfilter.judge(got.select("page_id", "url"), rules.limit(0)).where("rule IS NOT NULL").count() == 0
