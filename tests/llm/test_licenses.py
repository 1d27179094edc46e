"""Files with several licences, against brute force."""
import re

from skelgraph.llm import licenses

FILLER = "the software of the person in source forms and any copy to the public as published by this code "
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted. "
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License. "
LGPL = "GNU Lesser General Public License as published by the Free Software Foundation. "
SHORT = ["Released under the MIT License. ", "Licensed under the Apache License, Version 2.0. ", "Licensed under CC BY-NC 4.0. "]
TEXTS = ([a + FILLER * 3 + b for a in (BSD, GRANT, MPL, LGPL) for b in SHORT] + [a + b + c for a in (BSD, MPL) for b in (GRANT, LGPL) for c in SHORT]
         + [b + FILLER + BSD[12:] for b in SHORT] + [FILLER * 5, "mit license", "License version 3 of the GNU General Public License"])


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())

    def stands(p):
        return any(w[i:i + len(p)] == p for i in range(len(w)))

    out = {k for k, p in licenses.BASE if stands(p.split())}
    for label, line, need in licenses.TEMPLATES:
        own = line.split()
        best = max(sum(0 <= a + i < len(w) and w[a + i] == v for i, v in enumerate(own)) for a in range(-len(own), len(w) + 1))
        if stands(need.split()) and best / len(own) >= licenses.SHARE:
            out.add(label)
    return ",".join(sorted(out))


def test_files_with_several_licences(spark):
    want = [brute(t) for t in TEXTS]
    assert want[:3] == ["bsd,mit", "apache-2.0,bsd", "bsd,cc-by,cc-by-nc"]
    every = [(i, t) for i, t in enumerate(TEXTS)]
    for corpus in (every, every + [(100 + i, "mit apache licensed released version nc by cc under") for i in range(50)], every[:1]):
        got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
        assert [got[i] for i, _ in corpus if i < 100] == want[:len([0 for i, _ in corpus if i < 100])]


def test_scan_equals_sql_and_spans_bind(spark):
    """Every label in full, key phrases outside the span, spans cut by the text's ends, clashing columns; against DuckDB."""
    import duckdb
    import pandas as pd

    from skelgraph.llm.oracles import ORACLES

    full = [line for _, line, _ in licenses.TEMPLATES]
    texts = TEXTS + full + [" ".join(full), None, "", "é über", "apache license " + FILLER + "licensed under the version 2 0", "license version 2 0", "under the apache license version"]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    with duckdb.connect() as db:
        db.register("documents", rows)
        want = {r[0]: r for r in db.execute(ORACLES["op9_licenses"]).fetchall()}
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, _w string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {i: tuple(r[c] for c in ["doc_id"] + licenses.NAMES) for i, r in got.items()} == want
    assert all(r["_w"] == "x" for r in got.values())
    whole = got[len(TEXTS) + len(full)].labels.split(",")
    assert {x for x, _, _ in licenses.TEMPLATES} <= set(whole)
    assert got[len(texts) - 3].labels == "" and got[len(texts) - 1].labels == "apache-2.0"
    assert licenses.scan(docs.limit(0)).count() == 0
