"""License scans: phrases in order, and an exact set-similarity join with license notices.

Only DataFrame functions run on the main path.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store

#: Characters that part words, once A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices: label and text.  A block that holds enough of a notice's words gets its label.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Share of a notice's distinct words that a block must hold.
THRESHOLD = 0.85


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; the plain function does the same for ASCII texts."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAKS), "")


def notice_block(text: str) -> int:
    """Half the length of the blocks that a notice is looked for in: a power of two, no less than its words."""
    n = len("".join(c if c.isalnum() else " " for c in text).split())
    return max(8, 1 << (n - 1).bit_length())


def notice_words(text: str) -> list[str]:
    """Distinct words of a notice; notices are ASCII."""
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w})


def _places(ws: Column, phrase: str) -> Column:
    """Starts of a phrase's words in the array ``ws``."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(ws, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(ws, i + k) == part)
        return test

    last = F.size(ws) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _read(docs: DataFrame, notices, threshold: float) -> DataFrame:
    """Phrase places and notice words of each text, from its words, which are cut once.

    Texts that hold enough words of some notice are kept as candidates.
    """
    none = F.array().cast("array<int>")
    out = docs.withColumn("words", words(F.col("text")))
    for k, (phrase, _) in enumerate(PHRASES):
        gap = BREAKS.join(phrase.split())
        likely = F.col("text").rlike("(?i)" + gap)
        out = out.withColumn(f"p{k}", F.when(likely, _places(F.col("words"), phrase)).otherwise(none))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    sets = [notice_words(text) for _, text in notices]
    vocabulary = F.array(*map(F.lit, sorted({w for ws in sets for w in ws})))
    out = out.withColumn("held", F.array_intersect(vocabulary, "words"))
    enough = F.lit(False)
    for ws in sets:
        enough = enough | (F.size(F.array_intersect("held", F.array(*map(F.lit, ws)))) >= _need(ws, threshold))
    return out.select(
        "doc_id",
        "mark",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.sort_array(F.array_distinct(labels)).alias("base"),
        "held",
        F.when(enough, F.col("text")).alias("candidate"),
    )


def _need(ws: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(ws) - 1e-9)


def notice_matches(read: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, mark, half, block, label, containment``: every text block that holds enough of a notice.

    Blocks run across lines.  A notice of at most ``half`` words is looked for
    in blocks of twice as many, each beginning ``half`` words behind the last,
    so a notice that stands in the text is whole in one of them.

    An exact join: words of the notices are ordered by the number of
    documents that hold them, rarest first (one row per such word comes to the
    driver, so the bound is the notices' size).  Words in no notice never
    count, so a block is its notice words in that order.  A block and a notice
    that share ``need`` words share one among the first ``size - need + 1`` of
    each (prefix filter); the block must have ``need`` words (length filter)
    and enough words must follow the shared one on both sides (positional
    filter).  Candidates are verified on all words.
    """
    spark = read.sparkSession
    sets = [(label, notice_block(text), notice_words(text)) for label, text in notices]
    every = sorted({w for _, _, ws in sets for w in ws})
    seen = read.select(F.explode("held").alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in seen.collect()}  # at most len(every) rows
    order = sorted(every, key=lambda w: (count.get(w, 0), w))
    rows, least = [], {}
    for k, (label, half, ws) in enumerate(sets):
        need = _need(ws, threshold)
        least[half] = min(least.get(half, need), need)
        ws = sorted(ws, key=order.index)
        rows += [(k, label, half, w, at, need, ws) for at, w in enumerate(ws[: len(ws) - need + 1])]
    table = spark.createDataFrame(rows, "notice int, label string, half int, word string, at int, need int, notice_words array<string>")
    halves = F.array(*[F.struct(F.lit(h).alias("half"), F.lit(n).alias("least")) for h, n in sorted(least.items())])
    ordered = F.array(*map(F.lit, order))

    def blocks(ws: Column, h: Column) -> Column:
        """Blocks of one length that hold enough notice words for some notice; all others are dropped where they are."""
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), h["half"])
        every = F.transform(starts, lambda i, k: F.struct(h["half"], h["least"], k.alias("block"), F.array_intersect(ordered, F.slice(ws, i + 1, 2 * h["half"])).alias("held")))
        return F.filter(every, lambda x: F.size(x["held"]) >= h["least"])

    cut = F.get(F.transform(F.array(words(F.col("candidate"))), lambda ws: F.flatten(F.transform(halves, lambda h: blocks(ws, h)))), F.lit(0))
    held = read.filter("candidate is not null").select("doc_id", "mark", F.explode(cut).alias("x")).select("doc_id", "mark", "x.*")
    prefix = held.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)).alias("place", "word"))
    after_block = F.size("held") - F.col("place") - 1
    after_notice = F.size("notice_words") - F.col("at") - 1
    near = prefix.join(F.broadcast(table), ["half", "word"]).filter(
        (F.size("held") >= F.col("need")) & (F.col("place") <= F.size("held") - F.col("need")) & (F.least(after_block, after_notice) + 1 >= F.col("need"))
    )
    common = F.size(F.array_intersect("notice_words", "held"))
    return near.filter(common >= F.col("need")).select("doc_id", "mark", "half", "block", "label", (common / F.size("notice_words")).alias("containment"))


def license_scan(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: words, phrase places, labels and a score.

    ``score`` is 1 where a phrase stands, else the largest share of a notice
    that a block holds, else 0.  Labels are those of phrases and of notices.
    Null texts are empty; a null id is kept; repeated rows give repeated
    results; extra columns are not read; an empty table gives no rows.
    What is read from the texts is written to the shared folder, so they are
    cut into words once.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    read = store.written(_read(narrow, notices, threshold), "licenses")
    hits = notice_matches(read, notices, threshold).groupBy("doc_id", "mark").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "more", "best")
    joined = read.drop("held", "candidate").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
