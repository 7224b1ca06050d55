"""Removal of bytes that repeat earlier documents, by suffix orders of shards.

A match is a string of ``induced.DEPTH`` bytes.  The least hash of the short
strings inside it, its anchor, is the same wherever the match stands.  So
anchors deal the text to shards: runs of matches with one anchor are segments,
and equal matches meet in one shard.  Anchors that only one text has are left
out first.  A shard keeps each distinct segment once; those whose anchor has
several segments are put in suffix order by induced sorting, where equal
matches stand together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan, induced, store

#: Bytes of the short strings whose hashes are compared.
GRAM = 20
#: Bytes of text that one block of anchors or segments comes from.
BLOCK = 6 << 20
#: Matches of a segment at most.
SEGMENT = 4096
#: Shards for each shuffle partition.
SHARDS = 3
_LOW = np.uint64((1 << 40) - 1)


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in steps: bytes, offsets, number of each text, and where in the text it starts.

    Parts of a text longer than a step overlap so that each match is in one.
    """
    over = induced.DEPTH - 1
    for a, b in bytescan.steps(offsets):
        size = int(offsets[b] - offsets[a])
        if b - a == 1 and size > 2 * bytescan.STEP:
            for at in range(0, size - over, bytescan.STEP):
                end = min(size, at + bytescan.STEP + over)
                part = raw[offsets[a] + at : offsets[a] + end]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at])
        else:
            yield raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(a, b), np.zeros(b - a, np.int64)


def _anchor_runs(raw: np.ndarray, offsets: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of matches with one anchor: anchor, text, first byte, number of matches.

    Anchors are 40 bits of their hash below its part of ``parts``.
    """
    depth, none = induced.DEPTH, np.zeros(0, np.int64)
    n = len(raw) - depth + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    sums = bytescan.prefix(raw)
    grams = bytescan.mix((sums[GRAM:] - sums[:-GRAM]) * bytescan._power(len(raw), "down", bytescan._INVERSE)[: len(raw) - GRAM + 1])
    least, span, width = grams, 1, depth - GRAM + 1
    while span < width:
        more = min(span, width - span)
        least = np.minimum(least[: len(least) - more], least[more:])
        span += more
    edge = np.zeros(n + 1, np.int32)
    starts, ends = np.minimum(offsets[:-1], n), np.minimum(np.maximum(offsets[1:] - depth + 1, offsets[:-1]), n)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[starts[(starts < n) & (ends > starts)]] = True
    first = np.flatnonzero(new)
    # a run ends before the next one, and where its text's matches end
    text = np.searchsorted(offsets, first, "right") - 1
    count = np.minimum(np.append(first[1:], n), ends[text]) - first
    long = count > SEGMENT
    if long.any():
        times = -(-count // SEGMENT)
        back = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, text, count = np.repeat(first, times) + back * SEGMENT, np.repeat(text, times), np.repeat(count, times) - back * SEGMENT
        count = np.minimum(count, SEGMENT)
    value = least[first]
    return ((value >> np.uint64(40)) % np.uint64(parts)) << np.uint64(40) | value & _LOW, text, first, count


def _split(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of 0..n-1 in sorted keys."""
    return np.searchsorted(keys, np.arange(n + 1))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of all places in runs."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = bytescan.buffer(batch.column(text))
        for a, b in bytescan.steps(offsets, BLOCK):
            yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _rows(names: list[str], kinds: list, cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of values, one behind the other, as binary cells without copying them."""
    width = values.nbytes // len(values) if len(values) else 1
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbered(runs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values in order within runs: each one's number among the distinct ones of its run, where those stand first, and their runs."""
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1 - np.searchsorted(runs[first], runs), first, runs[first]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of each batch with the least document that has them, so copies are merged before they move."""
    for batch in batches:
        seen: dict[bytes, list] = {}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = seen.setdefault(hashlib.md5(text.encode(), usedforsecurity=False).digest(), [doc, text])
            row[0] = min(row[0], doc)
        keys = [int.from_bytes(m[:8], "big") >> 4 for m in seen]
        yield _rows(["key", "mark", "low", "text"], [pa.int64(), pa.binary(), pa.int64(), pa.string()], [keys, list(seen), [d for d, _ in seen.values()], [t for _, t in seen.values()]])


def _anchors(parts: int):
    """Distinct anchors of blocks of texts, by part: anchors, text numbers, keys of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, offsets in _blocks(batches, 1):
            keys = np.asarray(block.column(0))
            got = [(a, docs[t]) for part, cut, docs, _ in _pieces(raw, offsets) for a, t, _, _ in [_anchor_runs(part, cut, parts)]]
            anchor, text = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((text, anchor))
            anchor, text = anchor[order], text[order]
            keep = np.ones(len(anchor), bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            anchor, text = anchor[keep], text[keep]
            part = (anchor >> np.uint64(40)).astype(np.int64)
            order = np.argsort(part << 32 | text)
            nums = np.empty(len(part), np.int64)
            nums[order], first, owners = _numbered(part[order], text[order])
            held = np.unique(part)
            cuts, low = np.append(np.searchsorted(part, held), len(part)), np.ascontiguousarray(anchor).view(np.uint8).reshape(-1, 8)[:, :5]
            kind = "<u2" if len(keys) < 65536 else "<u4"
            some = np.append(np.searchsorted(owners, held), len(owners))
            cols = [pa.array(held, pa.int32()), _cells(low, cuts), _cells(nums.astype(kind), cuts), _cells(keys[text[order][first]].astype("<i8"), some)]
            yield pa.RecordBatch.from_arrays(cols, ["part", "low", "nums", "keys"])

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each part; rows come sorted by their first column."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part:
                if rows:
                    yield part, rows
                    bytescan.release()
                part, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield part, rows
        bytescan.release()


def _shared(parts: int):
    """Anchors that at least two texts have, by part of the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            five = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            low = wide.view("<u8").ravel()
            owner = np.concatenate([np.frombuffer(keys, "<i8")[np.frombuffer(nums, "<u2" if 5 * len(nums) == 2 * len(some) else "<u4")] for some, nums, keys in rows])
            order = np.lexsort((owner, low))
            low, owner = low[order], owner[order]
            new = np.ones(len(low), bool)
            new[1:] = low[1:] != low[:-1]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(low)) - 1
            many = (owner[first] != owner[last])[group]
            low, owner = low[many] | np.uint64(part << 40), owner[many]
            order = np.argsort(owner % parts, kind="stable")
            low, owner = low[order], owner[order]
            held = np.unique(owner % parts)
            cuts = np.append(np.searchsorted(owner % parts, held), len(owner))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), _cells(owner, cuts), _cells(low, cuts)], ["part", "keys", "anchors"])

    return run


def _per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted shared anchors of each text."""
    for _, rows in _by_part(batches):
        key = np.concatenate([np.frombuffer(k, "<i8") for k, _ in rows])
        anchor = np.concatenate([np.frombuffer(a, "<u8") for _, a in rows])
        order = np.lexsort((anchor, key))
        key, anchor = key[order], anchor[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cuts = np.append(first, len(key))
        for at in range(0, len(first), 2000):
            some = range(at, min(at + 2000, len(first)))
            yield _rows(["owner", "anchors"], [pa.int64(), pa.binary()], [[int(key[cuts[k]]) for k in some], [anchor[cuts[k] : cuts[k + 1]].tobytes() for k in some]])


def _segments(parts: int, shards: int):
    """Segments with shared anchors, by shard: bytes, and for each its length, text number, place and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, offsets in _blocks(batches, 2):
            keys, docs = np.asarray(block.column(0)), np.asarray(block.column(1))
            lists = [np.frombuffer(x, "<u8") for x in block.column(3).to_pylist()]
            got = []
            for part, cut, nums, base in _pieces(raw, offsets):
                anchor, text, first, count = _anchor_runs(part, cut, parts)
                keep = np.zeros(len(anchor), bool)
                bounds = _split(text, len(nums))
                for k in range(len(nums)):
                    mine, known = anchor[bounds[k] : bounds[k + 1]], lists[nums[k]]
                    keep[bounds[k] : bounds[k + 1]] = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                anchor, text, first, count = anchor[keep], text[keep], first[keep], count[keep]
                at = first - cut[text] + base[text]
                got.append((anchor, nums[text], at, count, offsets[nums[text]] + at))
            anchor, text, at, count, place = (np.concatenate(x) for x in zip(*got, strict=True))
            shard = ((anchor ^ anchor >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")  # texts stay in order within a shard
            shard, anchor, text, at, count, place = (x[order] for x in (shard, anchor, text, at, count, place))
            held = np.unique(shard)
            cuts = np.append(np.searchsorted(shard, held), len(shard))
            nums, first, owners = _numbered(shard, text)
            some = np.append(np.searchsorted(owners, held), len(owners))
            lengths = count + induced.DEPTH - 1
            ends = np.append(0, np.cumsum(lengths))
            data = np.empty(int(ends[-1]), np.uint8)
            for a, b in bytescan.steps(ends):
                data[ends[a] : ends[b]] = raw[_gather(place[a:b], lengths[a:b])]
            cols = [pa.array(held, pa.int32()), _cells(data, ends[cuts]), _cells(count.astype("<u2"), cuts), _cells(nums.astype("<u4"), cuts), _cells(at.astype("<u8"), cuts), _cells(anchor, cuts)]
            cols += [_cells(x[text[first]].astype("<i8"), some) for x in (keys, docs)]
            yield pa.RecordBatch.from_arrays(cols, ["part", "bytes", "counts", "nums", "at", "anchors", "keys", "docs"])

    return run


def _least_docs(data: np.ndarray, counts: np.ndarray, anchors: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Least document of each match of distinct segments, whose own least documents are ``low``."""
    span = induced.DEPTH - 1
    least = np.repeat(low, counts)
    _, group, sizes = np.unique(anchors, return_inverse=True, return_counts=True)
    several = np.flatnonzero(sizes[group] > 1)
    if not len(several):
        return least
    lengths = counts + span
    starts = np.cumsum(lengths) - lengths
    wide = lengths[several]
    text = np.zeros(int(wide.sum()) + len(several), np.int16)
    places = np.cumsum(wide + 1) - (wide + 1)
    text[_gather(places, wide)] = data[_gather(starts[several], wide)].astype(np.int16) + 1
    match = np.full(len(text), -1, np.int64)
    match[_gather(places, counts[several])] = _gather((np.cumsum(counts) - counts)[several], counts[several])
    order = induced.suffix_order(text)
    order = order[match[order] >= 0]
    of = induced.equal_runs(text, order)
    best = np.full(int(of[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, of, least[match[order]])
    least[match[order]] = best[of]
    return least


def _joined_rows(rows: list[tuple], size: int = bytescan.STEP) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Cells of a shard's rows put together until their texts have ``size`` bytes, and how many texts stand before each segment's row.

    There is a row for each block of the input, so work on each by itself would grow with the square of the input.
    """
    some, n = [], 0
    for k, row in enumerate(rows):
        some.append(row)
        n += len(row[0])
        if n >= size or k == len(rows) - 1:
            texts = np.array([len(r[5]) // 8 for r in some])
            yield [b"".join(c) for c in zip(*some, strict=True)], np.repeat(np.cumsum(texts) - texts, [len(r[1]) // 2 for r in some])
            some, n = [], 0


def _repeats(parts: int):
    """Matches of each shard that also stand in a document with a smaller id, by part of the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = induced.DEPTH - 1
        for _, rows in _by_part(batches):
            names, count, where, own, key = [], [], [], [], []
            kept: dict[str, list] = {"data": [], "count": [], "anchor": [], "name": []}
            seen = np.zeros(0, np.uint64)
            for (data, counts, nums, at, anchors, keys, docs), before in _joined_rows(rows):
                raw, n = np.frombuffer(data, np.uint8), np.frombuffer(counts, "<u2").astype(np.int64)
                ends = np.cumsum(n + span)
                sums = bytescan.prefix(raw)
                starts = ends - n - span
                name = bytescan.mix((sums[ends] - sums[starts]) * bytescan._power(len(raw) + 1, "down", bytescan._INVERSE)[starts]) ^ n.astype(np.uint64)
                nums = np.frombuffer(nums, "<u4") + before
                names.append(name)
                count.append(n)
                where.append(np.frombuffer(at, "<u8").astype(np.int64))
                own.append(np.frombuffer(docs, "<i8")[nums])
                key.append(np.frombuffer(keys, "<i8")[nums])
                _, first = np.unique(name, return_index=True)
                first = first[~np.isin(name[first], seen)]
                seen = np.union1d(seen, name[first])
                kept["data"].append(raw[_gather(starts[first], n[first] + span)])
                kept["count"].append(n[first])
                kept["anchor"].append(np.frombuffer(anchors, "<u8")[first])
                kept["name"].append(name[first])
            name, n, at, doc, owner = map(np.concatenate, (names, count, where, own, key))
            distinct = {k: np.concatenate(v) for k, v in kept.items()}
            order = np.argsort(distinct["name"])
            segment = order[np.searchsorted(distinct["name"][order], name)]
            low = np.full(len(order), np.iinfo(np.int64).max)
            np.minimum.at(low, segment, doc)
            least = _least_docs(distinct["data"], distinct["count"], distinct["anchor"], low)
            base = np.cumsum(distinct["count"]) - distinct["count"]
            out = []
            for a in range(0, len(name), 1 << 16):
                s = slice(a, a + (1 << 16))
                hit = least[_gather(base[segment[s]], n[s])] < np.repeat(doc[s], n[s])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                # runs do not cross segments
                bounds = np.cumsum(n[s])
                lo, hi = edge[::2], edge[1::2]
                first, last = np.searchsorted(bounds, lo, "right"), np.searchsorted(bounds, hi - 1, "right")
                times = last - first + 1
                which = np.repeat(first, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                begin = np.maximum(np.repeat(lo, times), (bounds - n[s])[which])
                end = np.minimum(np.repeat(hi, times), bounds[which])
                out.append((owner[s][which], doc[s][which], at[s][which] + begin - (bounds - n[s])[which], end - begin))
            owner, doc, at, n = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(owner % parts, kind="stable")
            owner, doc, at, n = (x[order] for x in (owner, doc, at, n.astype("<u2")))
            held = np.unique(owner % parts)
            cuts = np.append(np.searchsorted(owner % parts, held), len(owner))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *[_cells(x, cuts) for x in (owner, doc, at, n)]], ["part", "keys", "docs", "at", "n"])

    return run


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges to remove from each text: disjoint, in order, as pairs."""
    for _, rows in _by_part(batches):
        key, doc, at, n = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(("<i8", "<i8", "<i8", "<u2")))
        end = at + n + induced.DEPTH - 1
        order = np.lexsort((at, doc, key))
        key, doc, at, end = key[order], doc[order], at[order], end[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])), len(key))
        cols: list[list] = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            top = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate([[True], at[a + 1 : b] > top[:-1]]))
            spans = np.stack([at[a:b][new], top[np.append(new[1:], b - a) - 1]], 1)
            for col, x in zip(cols, (int(key[a]), int(doc[a]), spans.astype("<i8").tobytes()), strict=True):
                col.append(x)
            if len(cols[0]) == 2000:
                yield _rows(["owner", "own_doc", "spans"], [pa.int64(), pa.int64(), pa.binary()], cols)
                cols = [[], [], []]
        yield _rows(["owner", "own_doc", "spans"], [pa.int64(), pa.int64(), pa.binary()], cols)


RESULT = "mark binary, low bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")] + ["kept_text"] * with_text
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
        for block, raw, offsets in _blocks(batches, 2):
            view, rows = raw.tobytes(), []
            for k, (mark, low, spans) in enumerate(zip(*(block.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                data = view[offsets[k] : offsets[k + 1]]
                pairs = np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist()
                kept, last = [], 0
                for a, b in pairs:
                    kept.append(data[last:a])
                    last = b
                left = b"".join([*kept, data[last:]])
                row = (mark, low, len(data), len(data) - len(left), len(pairs), hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode("utf-8", "ignore")) if with_text else row)
            yield _rows(names, kinds, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names])

    return run


def repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``mark, low, n_bytes, n_removed, n_spans, kept_sha256`` of each distinct text, as its first document has it.

    ``mark`` is the text's digest and ``low`` the least id that has it.  Equal
    texts are brought to one row before texts move, so copies cost a row of
    identifiers.  The distinct texts are a bucketed table in the shared
    warehouse: what is found out about a text comes to it without moving it.
    """
    spark = docs.sparkSession
    store.sweep(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = SHARDS * parts
    # null ids count as greater than all
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    once = docs.select(doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_once, "key bigint, mark binary, low bigint, text string")
    # dealt by the table's own key, so each task writes one bucket
    firsts = once.repartition(parts, "key").groupBy("key", "mark").agg(F.min("low").alias("low"), F.first("text").alias("text"))
    table = f"lodestone_{uuid.uuid4().hex}"
    firsts.select("key", "low", "mark", "text").write.bucketBy(parts, "key").format("parquet").saveAsTable(table)
    try:
        # each step starts without the shuffle files of the one before, so that disk holds one step's
        store.sweep(spark)
        texts = spark.table(table)
        long = texts.filter(F.octet_length("text") >= induced.DEPTH)
        some = long.select("key", "text").mapInArrow(_anchors(parts), "part int, low binary, nums binary, keys binary")
        some = _dealt(some, parts).mapInArrow(_shared(parts), "part int, keys binary, anchors binary")
        lists = store.written(_dealt(some, parts).mapInArrow(_per_text, "owner bigint, anchors binary"), "anchors")
        store.sweep(spark)
        found = long.join(lists, F.col("key") == F.col("owner")).select("key", "low", "text", "anchors")
        held = found.mapInArrow(_segments(parts, shards), "part int, bytes binary, counts binary, nums binary, at binary, anchors binary, keys binary, docs binary")
        hits = _dealt(held, shards).mapInArrow(_repeats(parts), "part int, keys binary, docs binary, at binary, n binary")
        spans = store.written(_dealt(hits, parts).mapInArrow(_covers, "owner bigint, own_doc bigint, spans binary"), "spans")
        store.forget(lists)
        store.sweep(spark)
        # the second condition is no equality, as the table's buckets would not serve a join by two columns and all texts would move
        ranged = texts.join(spans, (F.col("key") == F.col("owner")) & F.col("low").between(F.col("own_doc"), F.col("own_doc")), "left")
        schema = RESULT + (", kept_text string" if with_text else "")
        out = store.written(ranged.select("mark", "low", "text", "spans").mapInArrow(_cut(with_text), schema), "repeats")
        store.forget(spans)
        return out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document.

    A byte is removed if it is covered by a string of 50 bytes that also starts
    in a document with a smaller id; matches stay inside documents and are
    judged on the input.  Null texts are empty; documents with null ids come
    after all others and not after each other; of rows with the same id none
    comes after another; repeated rows get the same result; extra columns are
    not read; an empty table gives no rows.
    """
    out = _joined(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), repeats(docs))
    return out.select("doc_id", *[F.col(f"lodestone_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Results of the texts for all documents: later copies lose every byte that a match covers, so all or none."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    own = "lodestone_"  # keeps the texts' columns apart from any that documents have
    theirs = found.select(*[F.col(c).alias(own + c) for c in found.columns])
    keyed = docs.withColumn(own + "key", F.unhex(F.md5("text"))).drop("text")
    rows = keyed.join(theirs, F.col(own + "key") == F.col(own + "mark"))
    copy = (doc > F.col(own + "low")) & (F.col(own + "n_bytes") >= induced.DEPTH)
    of = lambda name, if_copy: F.when(copy, if_copy).otherwise(F.col(own + name)).alias(own + name)
    return rows.select(
        *[c for c in docs.columns if c != "text"],
        own + "n_bytes",
        of("n_removed", F.col(own + "n_bytes")),
        of("n_spans", F.lit(1).cast("bigint")),
        of("kept_sha256", F.sha2(F.lit(""), 256)),
        *([F.when(copy, F.lit("")).otherwise(F.col(own + "kept_text")).alias("text")] if "kept_text" in found.columns else []),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out of ``text``; other columns stay, ``n_chars`` is counted anew.

    Bytes of a character that is cut through are dropped.
    """
    found = repeats(docs, with_text=True)
    out = _joined(docs.withColumn("text", F.coalesce("text", F.lit(""))), found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
