"""Licence scan by a positional rare-token index, in SQL functions only.

Each template looks up its own `TOP` words of highest inverse document frequency
among those the document holds. Every hit names a place of the template; places named by
too few hits go (the words not looked up could not bring them to SHARE), and at the others
all words are checked. A place counts if SHARE of the template's words stand there and
its mandatory phrase stands inside the place's span. So no label and no score depends on the other
templates' words or on the corpus. The base phrases are found at every place. `score` is
the largest share of a place that counts, 1 with a base phrase, else 0. Null text is
empty: no words, no labels, score 0. Words tied in frequency go by name. Repeated rows give a row each;
all columns are kept, but for those of the names added.
"""
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases, and opening or grant sentences of public licences with their mandatory phrases.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
]
TOP = 8
SHARE = 0.6
_VOCAB = sorted({w for _, p in BASE for w in p.split()} | {w for _, t, _ in TEMPLATES for w in t.split()})


def words(col="text"):
    lower = F.translate(F.coalesce(F.col(col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _strings(values):
    return F.array(*[F.lit(x) for x in values])


def hits(docs: DataFrame) -> DataFrame:
    """`docs` with _w, n_words and _h: (w, i) of every word of the vocabulary."""
    vocab = ", ".join(f"'{w}'" for w in _VOCAB)
    out = docs.withColumn("_w", words())
    return (out.withColumn("n_words", F.size("_w").cast("long"))
            .withColumn("_h", F.expr(f"filter(transform(_w, (w, i) -> named_struct('w', w, 'i', i)), h -> h.w IN ({vocab}))")))


def _places(phrase):
    """Start positions of a phrase, from the hits; neighbours in the text are neighbours among the hits."""
    p = phrase.split()
    rest = " AND ".join(f"get(_h, k + {j}).w = '{w}' AND get(_h, k + {j}).i = h.i + {j}" for j, w in enumerate(p) if j)
    return F.expr(f"transform(filter(transform(_h, (h, k) -> named_struct('i', h.i, 'ok', h.w = '{p[0]}' AND {rest})), x -> x.ok), x -> x.i)")


def frequencies(docs: DataFrame) -> dict:
    """Documents with each vocabulary word: at most one row per word comes back."""
    rows = hits(docs.select("text")).select(F.explode(F.array_distinct(F.col("_h.w"))).alias("w"))
    return {r[0]: r[1] for r in rows.groupBy("w").count().collect()}


def _score(own, need, df, top, share):
    """The largest share of a place of the template `own` that counts, else 0; from _w, _h and _p."""
    order = sorted(set(own), key=lambda w: (df.get(w, 0), w))  # rarest first
    least = math.ceil(share * len(own) - 1e-9)
    votes = least - sum(own.count(w) for w in order[top:])
    if votes < 1:
        raise ValueError("too few words looked up for this template")
    rare = F.slice(F.filter(_strings(order), lambda w: F.array_contains("_p", w)), 1, top)
    posts = F.create_map(*[x for w in order for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(own) if v == w]))])
    named = F.array_sort(F.flatten(F.transform(rare, lambda w: F.flatten(F.transform(F.filter("_h", lambda h: h["w"] == w), lambda h: F.transform(posts[w], lambda i: h["i"] - i))))))
    # in order, a place is named often enough if it comes again votes - 1 entries later; its first entry stands for it
    runs = F.transform(F.array(named), lambda a: F.filter(a, lambda x, k: (F.get(a, k + (votes - 1)) == x) & ((k == 0) | (F.get(a, k - 1) != x))))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(own)])
    # the starts whose span holds the phrase, from its places: work grows with the hits, not with places times phrases
    around = F.array_distinct(F.flatten(F.transform(_places(" ".join(need)), lambda p: F.sequence(p - (len(own) - len(need)), p))))
    spans = F.array_intersect(F.flatten(runs), around)
    stand = F.transform(spans, lambda a: F.size(F.filter(pairs, lambda p: (a + p["i"] >= 0) & (F.get("_w", a + p["i"]) == p["w"]))))
    best = F.array_max(F.filter(stand, lambda n: n >= least)) / F.lit(len(own))
    there = F.size(F.array_intersect(F.col("_p"), _strings(sorted(set(need))))) == len(set(need))
    return F.when(there, F.coalesce(best, F.lit(0.0))).otherwise(0.0)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan(docs: DataFrame, top=TOP, share=SHARE) -> DataFrame:
    """All columns of `docs`, with n_words, n_base, first_word, last_word, base_labels, labels and score, which replace columns of these names."""
    keep = [c for c in docs.columns if c not in NAMES]
    df = frequencies(docs)
    out = hits(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "text"))
    out = out.withColumns({f"_b{k}": _places(p) for k, (_, p) in enumerate(BASE)} | {"_p": F.array_distinct(F.col("_h.w"))})
    out = out.withColumn("_s", F.array(*[_score(line.split(), need.split(), df, top, share) for _, line, need in TEMPLATES]))
    base = F.array_compact(F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(x)) for k, (x, _) in enumerate(BASE)]))
    own = F.array_compact(F.array(*[F.when(F.col("_s")[t] > 0, F.lit(x)) for t, (x, _, _) in enumerate(TEMPLATES)]))
    places = F.concat(*[F.col(f"_b{k}") for k in range(len(BASE))])
    out = out.withColumns({
        "n_base": F.size(places).cast("long"), "first_word": F.array_min(places).cast("long"), "last_word": F.array_max(places).cast("long"),
        "base_labels": F.array_join(F.array_sort(base), ","), "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ","),
        "score": F.greatest(F.array_max("_s"), F.when(F.size(places) > 0, 1.0).otherwise(0.0)).cast("double")})
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *NAMES)
