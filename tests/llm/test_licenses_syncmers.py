import hashlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lodestone.llm import licenses, queries, syncmers


def test_license_scan_agrees_with_brute_force(odd, odd_rows, empty, spark):
    unique = list(dict((i, t) for i, t in odd_rows if i is not None).items())
    documents = pd.DataFrame(unique, columns=["doc_id", "text"])
    docs = spark.createDataFrame(unique, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in licenses.license_scan(docs).collect())
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.sql(queries.ORACLE_SQL["op2_license_scan"]).fetchall())
    assert [tuple(None if x is None else x for x in r) for r in got] == want
    assert licenses.license_scan(odd).count() == len(odd_rows)
    by_text = {r.labels for r in licenses.license_scan(odd.filter("doc_id is null and text is not null")).collect()}
    assert by_text == {"apache-2,cc-by-nc"}
    assert licenses.license_scan(empty).count() == 0


def test_places_of_phrases(spark):
    docs = spark.sql("select 1L doc_id, 'x Under the-MIT license; under the mit licenses. CC BY-NC cc by nc' text")
    r = licenses.license_scan(docs).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (15, 3, 1, 12, "cc-by-nc,mit", 1.0)


def test_wrapped_and_scattered_notices(spark):
    mit = "# Permission is hereby granted, free of\n# charge, to any person obtaining a copy of\n# this software and associated\n# documentation files"
    filler = " ".join(f"f{k}" for k in range(40))
    rows = [
        (1, f"{filler}\n{mit}\n{filler}"),
        (2, "This program is free software: you can redistribute\nit and/or modify it under the terms of\nthe GNU General Public License"),
        (3, "x\n".join(["Redistribution and use in source and binary forms,", " with or without modification, are permitted", " provided that the following conditions\nare met"])),
        (4, filler.join([" released ", " under ", " the ", " mit ", " license "])),
        (5, licenses.NOTICES[2][1].replace(", ", ",\n")),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: r.labels for k, r in got.items()} == {1: "mit", 2: "gpl", 3: "bsd", 4: "", 5: "mit"}
    assert got[1].score == got[2].score == got[5].score == 1.0 and got[4].score == 0.0


def test_edited_texts_and_order(odd, odd_rows, empty):
    got = syncmers.fingerprints(odd).collect()
    rows = [(i, t or "") for i, t in odd_rows]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i or -1, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.fingerprints(empty).count() == 0


def test_fingerprints_tell_edits_from_strangers(small):
    rows = syncmers.fingerprints(small).select("n_chars", "fingerprint", "near_edited", "near_next", "doc_id").toPandas()
    assert (rows.near_edited[rows.n_chars > 200] > 0.25).mean() > 0.97
    assert (rows.near_next < 0.15).mean() > 0.95
    texts = {r.doc_id: r.text for r in small.collect()}
    first = {}
    for doc, mark in zip(rows.doc_id, rows.fingerprint, strict=True):
        assert first.setdefault(texts[doc], mark) == mark


def test_anchors_are_closed_syncmers_and_context_free(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    k, s = syncmers.K, syncmers.S
    frame = spark.createDataFrame([(text,), ("before it " + text + " after",)], "t string")
    plain, inside = (r.a for r in frame.select(syncmers.anchors(frame.t).alias("a")).collect())
    assert {a.hash for a in plain} <= {a.hash for a in inside}
    assert {a.pos + 2 for a in plain} <= {a.pos for a in inside}
    words = text.split()
    hashes = {w: spark.sql(f"select xxhash64('{w}')").first()[0] for w in words}
    inner = spark.createDataFrame([(i, *[hashes[w] for w in words[i : i + s]]) for i in range(len(words) - s + 1)], "i int, x bigint, y bigint").selectExpr("i", "xxhash64(x, y) h").collect()
    h = [r.h for r in sorted(inner)]
    want = [i for i in range(len(words) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]
    assert [a.pos for a in plain] == want


def test_every_anchor_counts_and_places_matter(spark):
    words = [f"w{k}" for k in range(6000)]
    changed = [*words[:3000], *[f"x{k}" for k in range(100)], *words[3100:]]
    moved = [*words[3000:], *words[:3000]]
    shifted = ["new", "words", *words]
    texts = [" ".join(w) for w in (words, changed, moved, shifted)]
    frame = spark.createDataFrame([tuple(texts)], "a string, b string, c string, d string")
    near = lambda x: syncmers.likeness(syncmers.marks(frame.a), syncmers.marks(frame[x]))
    r = frame.select(near("a"), near("b"), near("c"), near("d"), F.size(syncmers.marks(frame.a)), F.length(syncmers.as_string(syncmers.marks(frame.a)))).first()
    assert r[0] == 1.0 and 0.96 < r[1] < 0.995 and r[2] < 0.01 and 0.99 < r[3] < 1
    assert r[4] > 3000 and r[5] == 11 * r[4]


def test_fingerprints_of_far_ids(spark):
    rows = [(k, f"text number {k} of some") for k in range(3000)] + [(10**15, "a far one"), (-(10**15), None)]
    got = {r.doc_id: r.edited_sha256 for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
