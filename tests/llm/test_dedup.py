import hashlib
import os
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bytescan, components, induced, near_dedup, store, suffix_dedup


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text))


def bag(text):
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else Counter()


def true_classes(rows):
    texts = [t or "" for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for t in texts]
    for a in range(len(rows)):
        for b in range(a):
            both, every = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if texts[a] == texts[b] or (every and both / every >= 0.8):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = find(k)
        have = least.get(root)
        least[root] = i if have is None else have if i is None else min(i, have)
    return Counter((i, least[find(k)]) for k, (i, _) in enumerate(rows))


def test_classes_agree_with_brute_force(odd, odd_rows, empty, small):
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.classes(odd).collect()) == true_classes(odd_rows)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.classes(small).collect()) == true_classes(rows)
    assert near_dedup.classes(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(200, int(rng.integers(0, 12)), replace=False):
            w[p] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = true_classes(rows)
    assert got == want


def test_one_document_of_each_class_is_kept(odd, odd_rows):
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # 6 and 7 differ in a few words only; both texts with id 10 stay, as they are not alike
    assert ids == [1, 3, 6, 8, 9, 10, 10, 11, 12, 13]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(40):
        e = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = (np.repeat(x, rng.integers(1, 9, len(x))) for x in (e[:45], e[10:]))
        s = near_dedup.bag_minhash([a, b, np.zeros(0, np.uint64)], 256)
        pairs.append(((s[0] == s[1]).mean(), near_dedup.similarity(near_dedup.tagged(a), near_dedup.tagged(b))))
    est, true = np.array(pairs).T
    assert abs((est - true).mean()) < 0.01 and np.abs(est - true).max() < 0.15


def test_components(spark):
    chain = [(f"{k:04}", f"{k + 1:04}") for k in range(60)] + [("x", "y"), ("x", "x"), (None, "z"), ("y", "x")]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"{k:04}": "0000" for k in range(61)} | {"x": "x", "y": "x"}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_induced_order_puts_equal_matches_together(seed):
    rng = np.random.default_rng(seed)
    parts = [np.append(rng.integers(1, 1 + rng.integers(1, 4), rng.integers(0, 150)), 0) for _ in range(4)]
    text = np.concatenate(parts)
    order = induced.suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    ok = np.zeros(len(text), bool)
    at = 0
    for p in parts:
        ok[at : at + max(0, len(p) - induced.DEPTH)] = True
        at += len(p)
    order = order[ok[order]]
    of = induced.equal_runs(text, order)
    raw = bytes(text.tolist())
    keys = [raw[i : i + induced.DEPTH] for i in order]
    assert keys == sorted(keys) and len(set(keys)) == (of[-1] + 1 if len(of) else 0)


def test_queues_go_to_disk_and_come_back_in_order():
    queue = induced.Queue(held=10)
    for k in range(0, 100, 5):
        queue.push(np.arange(k, k + 5))
    assert queue.file is not None and queue.take().tolist() == list(range(100)) and queue.take().tolist() == []


def removed(rows):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, order(i)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i if i is not None else -1, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removal_agrees_with_brute_force(odd, odd_rows, empty, small, monkeypatch):
    got = lambda d: sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect())
    assert got(odd) == removed(odd_rows)
    assert got(small) == removed([(r.doc_id, r.text) for r in small.collect()])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    monkeypatch.setattr(bytescan, "STEP", 200)
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 101, 2500).astype(np.uint8)
    offsets = np.array([0, 2000, 2500])
    want = suffix_dedup._anchor_runs(raw, offsets, 4)
    whole = {(int(t), int(f - offsets[t]) + k) for _, t, f, n in zip(*want, strict=True) for k in range(n)}
    seen = []
    for part, cut, nums, base in suffix_dedup._pieces(raw, offsets):
        for _, t, f, n in zip(*suffix_dedup._anchor_runs(part, cut, 4), strict=True):
            seen += [(int(nums[t]), int(f - cut[t] + base[t]) + k) for k in range(n)]
    assert len(seen) == len(set(seen)) and set(seen) == whole == {(0, k) for k in range(1951)} | {(1, k) for k in range(451)}


def test_blocks_of_a_shard_are_worked_on_together(monkeypatch):
    """A shard's work does not grow with the number of blocks that its rows come from, and gives the same as one block."""
    texts = [f"{k:04} before {'the passage that all of these texts have in common, word by word ' * 2}{k % 7} after {k:04}" for k in range(300)]
    raw, offsets = bytescan.buffer(pa.array(texts))
    anchor, text, _, _ = suffix_dedup._anchor_runs(raw, offsets, 4)
    lists = [np.unique(anchor[text == k]).tobytes() for k in range(300)]
    batch = pa.record_batch([pa.array(np.arange(300) * 16), pa.array(np.arange(300)), pa.array(texts), pa.array(lists)], ["key", "low", "text", "anchors"])
    sums, calls = bytescan.prefix, []
    got = []
    for size in (1, 6 << 20):
        monkeypatch.setattr(suffix_dedup, "BLOCK", size)
        held = list(suffix_dedup._segments(4, 1)(iter([batch])))
        assert len(held) == (300 if size == 1 else 1)
        monkeypatch.setattr(bytescan, "prefix", lambda x: calls.append(len(x)) or sums(x))
        calls.clear()
        rows = [r for out in suffix_dedup._repeats(4)(iter(held)) for r in out.to_pylist()]
        assert len(calls) < 5
        got.append(Counter(x for r in rows for x in zip(*(np.frombuffer(r[c], k).tolist() for c, k in (("keys", "<i8"), ("docs", "<i8"), ("at", "<i8"), ("n", "<u2"))), strict=True)))
        monkeypatch.setattr(bytescan, "prefix", sums)
    assert got[0] == got[1] and len({d for _, d, _, _ in got[0]}) == 299


def test_disk_holds_one_step_of_suffix_dedup(spark, small, monkeypatch):
    """Shuffle files of a step are gone before the next one starts, texts stay in their buckets when cut, and tables of steps are deleted."""
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    write, seen = store.written, {}

    def written(df, name):
        until = time.time() + 10
        while shuffles() and time.time() < until:  # Spark deletes in the background
            time.sleep(0.1)
        seen[name] = [shuffles(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")]
        out = write(df, name)
        seen[name].append(out.lodestone_path.removeprefix("file://"))
        return out

    monkeypatch.setattr(store, "written", written)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        suffix_dedup.repeats(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert {name: left for name, (left, _, _) in seen.items()} == {"anchors": 0, "spans": 0, "repeats": 0}
    assert seen["repeats"][1] == 1  # the places to cut, not the texts
    assert [name for name, (_, _, path) in seen.items() if os.path.exists(path)] == ["repeats"]


def test_cut_texts_keep_their_columns(odd):
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    rows = {r.doc_id: r for r in out.filter("doc_id in (3, 5, 6, 7)").collect()}
    assert rows[5].text == "" and rows[3].n_chars == len(rows[3].text) > 0 and len(rows[7].text) < 60 < len(rows[6].text)


def versions(n, edits, seed):
    """Texts of 200 words of which each edits a few words of an earlier one, and their classes by all pairs."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 200)]]
    for _ in range(n - 1):
        w = list(texts[rng.integers(len(texts))])
        for p in rng.choice(200, int(rng.integers(edits[0], edits[1] + 1)), replace=False):
            w[p] = f"e{rng.integers(10**9)}"
        texts.append(w)
    number = {}
    sets = [{number.setdefault(tuple(w[a : a + 5]), len(number)) for a in range(196)} for w in texts]
    held = np.zeros((n, len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, list(s)] = 1
    both, size = held @ held.T, held.sum(1)
    alike = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    label = np.arange(n)
    while True:
        low = np.where(alike, label[None, :], n).min(1)
        if (low == label).all():
            return [" ".join(w) for w in texts], label.tolist()
        label = low


@pytest.mark.parametrize("edits", [(2, 4), (3, 4)])
def test_families_of_many_versions_have_their_true_classes(spark, edits):
    texts, want = versions(1500, edits, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert sum(got[k] != c for k, c in enumerate(want)) == 0


def test_rounds_of_near_dedup_are_small_plans(spark, monkeypatch):
    """The driver holds plans, stages and shuffle places: no plan is large, and those of a round are gone before the next one starts."""
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    write, seen = store.written, []

    def written(df, name):
        until = time.time() + 10
        while name == "open" and shuffles() > 8 and time.time() < until:  # Spark deletes in the background
            time.sleep(0.1)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString().count(" Exchange "), shuffles()))
        return write(df, name)

    monkeypatch.setattr(store, "written", written)
    monkeypatch.setattr(components.store, "written", written)
    texts, want = versions(300, (3, 4), 7)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert [got[k] for k in range(300)] == want
    assert max(n for _, n, _ in seen) <= 8
    left = [n for name, _, n in seen if name == "open"]
    assert len(left) > 1 and max(left[1:]) <= 8


def test_kept_texts_with_null_and_repeated_ids(odd, odd_rows):
    kept = Counter((r.doc_id, r.text or "") for r in near_dedup.one_of_each(odd).collect())
    gone = {(2, ""), (4, odd_rows[3][1]), (5, odd_rows[4][1]), (7, odd_rows[6][1]), (None, "")}
    want = {(i, t or "") for i, t in odd_rows} - gone
    assert kept == Counter(want)


def test_templated_texts_lose_no_link(spark):
    """Texts of which most words are one template: pairs of them are links, others are just not."""
    rng = np.random.default_rng(3)
    template = [f"t{k}" for k in range(176)]
    rows = []
    for k in range(200):
        own = [f"p{k}x{j}" for j in range(24)]
        cut = int(rng.integers(10, 150))
        for extra in range(2):
            w = [*template[:cut], *own, *template[cut:]]
            w[int(rng.integers(200))] = f"e{k}x{extra}"
            rows.append((2 * k + extra, " ".join(w)))
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == true_classes(rows)
