import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bytescan, decontamination, toxicity


@pytest.fixture(scope="module")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_words_of_many_texts():
    texts = ["One TWO", None, "", "two", "x" * 10, "é1-b", "\x00", "one two"]
    raw, offsets = bytescan.buffer(pa.array(texts).slice(0))
    found = bytescan.words(raw, offsets)
    assert [len(found.of(k)) for k in range(len(texts))] == [2, 0, 0, 1, 1, 2, 0, 2]
    assert (found.of(0) == found.of(7)).all() and found.of(0)[1] == found.of(3)[0]
    raw, offsets = bytescan.buffer(pa.array(texts).slice(3, 2))
    assert bytes(raw) == b"two" + b"x" * 10


def test_contamination_finds_every_whole_item(small, items):
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(small, items).collect()}
    norm = lambda t: " ".join(["", *__import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()), ""])
    docs = [(r.doc_id, norm(r.text)) for r in small.collect()]
    want = {(d, r.item_id) for r in items.collect() for d, t in docs if norm(r.text) in t}
    assert want and want <= got
    kept = {r.doc_id for r in decontamination.clean(small, items).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    blocks = {(r.doc_id, r.item_id) for r in decontamination.contamination(small, items, items=7).collect()}
    assert blocks == got


def test_edited_items_are_found(items):
    rows = [(r.item_id, r.text) for r in items.collect()]
    index = decontamination.Index(rows)
    rng = np.random.default_rng(1)
    hits = tries = 0
    for i, text in rows:
        w = text.split()
        for p in rng.choice(len(w), max(1, len(w) // 10), replace=False):
            w[p] = f"zz{p}"
        raw, offsets = bytescan.buffer(pa.array(["some words before it " + " ".join(w) + " and after"]))
        tries += 1
        hits += any(x[1] == i for x in index.search(raw, offsets))
    assert hits / tries >= 0.9


def test_infix_distance():
    a = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert decontamination.infix_distance(a("abcd"), a("xxabcdyy")) == 0
    assert decontamination.infix_distance(a("abcd"), a("xxabdyy")) == 1
    assert decontamination.infix_distance(a("abcd"), a("")) == 4


def test_contamination_of_odd_rows(odd, odd_rows, empty, items, spark):
    mine = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, dict(odd_rows)[3]), (3, dict(odd_rows)[6])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(odd, mine).collect()}
    assert {(3, 3), (4, 3), (5, 3), (6, 3)} <= got
    assert decontamination.contamination(empty, mine).count() == 0
    assert decontamination.contamination(odd, mine.filter("item_id < 0")).count() == 0
    assert decontamination.clean(odd, mine).columns == odd.columns


def test_toxicity_learns_from_labels_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    y, p = rows.toxic.to_numpy(), rows.predicted.to_numpy()
    assert (y & p).sum() / y.sum() > 0.8 and (y & p).sum() / p.sum() > 0.85
    assert ((rows.score - y) ** 2).mean() < 0.03


def test_toxicity_of_odd_rows(odd, odd_rows, empty, spark):
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == len(odd_rows) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.filter("doc_id < 0")).filter("score <> 0").count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    knots, values = toxicity.isotonic(raw, (raw + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and 0 <= values[0] <= values[-1] <= 1


def edited(words, n, kind, rng):
    """``words`` with ``n`` edits of a kind at places drawn anew."""
    w = list(words)
    for p in sorted(rng.choice(len(w), n, replace=False), reverse=True):
        if kind == "delete":
            del w[p]
        else:
            w[p : p + (kind == "replace")] = [f"zz{p}x"]
    return w


@pytest.mark.parametrize("kind", ["replace", "delete", "insert"])
def test_every_item_is_found_at_the_most_edits_of_its_length(kind, spark):
    rows = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rows += [(-n, " ".join(f"own{n}w{k}" for k in range(n))) for n in range(1, 60)]
    index = decontamination.Index(rows)
    rng = np.random.default_rng(4)
    lost = []
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
        for _ in range(3):
            near = edited(w, int(0.2 * len(w)), kind, rng)
            raw, offsets = bytescan.buffer(pa.array(["some words before it " + " ".join(near) + " and after"]))
            if not any(x[1] == k and x[2] <= int(0.2 * len(w)) for x in index.search(raw, offsets)):
                lost.append(len(w))
    assert sorted(lost) == []


def test_the_stage_drops_what_the_operator_predicts_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
