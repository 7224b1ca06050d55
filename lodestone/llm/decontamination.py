"""Benchmark decontamination: CGK walks, bit sampling over item-sized windows, exact edit verification.

The CGK embedding reads a string by a walk: at each step it puts out the word
it stands on and, as a random bit of step and word says, stays or goes on.
Walks over two texts that differ by an edit fall into step again, so a small
edit distance becomes a small Hamming distance of what is put out.  A table
samples some steps of a walk; windows of documents begin at every word, and
those that agree with an item's window in all steps of one table are
candidates.  Each candidate is verified by its exact edit distance in words.

An item has windows of its own from each of its words that leaves one whole,
and each walk of each window is a try of its own, so few tables reach the
target recall: see ``RECALL``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan

#: Most edits of a match, as a share of the item's words, and the share of such matches that must be found.
DISTANCE, RECALL = 0.2, 0.98
#: Items, and bytes of them, that one pass takes; a larger benchmark is taken in blocks.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Steps of the windows, longest first; an item takes the longest that its words allow (``steps_of``).
STEPS = (16, 8, 4, 3, 2, 1)
#: Random walks, and tables of sampled steps of each.
WALKS, TABLES = 6, 3
#: Bits of a key that a table's filter looks at.
BITS = 18
#: Word places that are looked at at once.
PLACES = 1 << 15


def steps_of(n: int) -> int:
    """Steps of the windows of an item of ``n`` words: at most three fifths of it, all of it where no edit is allowed."""
    most = n if int(DISTANCE * n) == 0 else int(0.6 * n)
    return next(s for s in STEPS if s <= max(1, most))


def plan() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Multipliers that decide each step of each walk, and the steps that each table of each length samples."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, (WALKS, STEPS[0]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sampled = {s: np.array([[np.sort(rng.choice(s, min(s, 4 + s // 8), replace=False)) for _ in range(TABLES)] for _ in range(WALKS)]) for s in STEPS}
    return odd, sampled


def walk(words: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """What the walk with multipliers ``odd`` puts out at each step, for windows from ``starts``; one row a step.

    A walk that comes to the last word stays there.
    """
    out = np.empty((len(odd), len(starts)), np.uint64)
    at, bit = starts.copy(), np.empty(len(starts), np.uint64)
    for j, factor in enumerate(odd):
        np.take(words, at, out=out[j], mode="clip")
        np.multiply(out[j], factor, out=bit)
        np.right_shift(bit, np.uint64(63), out=bit)
        np.add(at, bit.view(np.int64), out=at)
    return out


def keys_of(out: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """One key for each window from the steps that a table samples."""
    key = out[sampled[0]] * np.uint64(0x9E3779B97F4A7C15)
    for j in sampled[1:]:
        np.multiply(key, np.uint64(0xD6E8FEB86659FD93), out=key)
        np.add(key, out[j], out=key)
    return key


def infix_distance(item: np.ndarray, doc: np.ndarray) -> int:
    """Least edits that turn ``item`` into some run of ``doc``."""
    row = np.zeros(len(doc) + 1, np.int32)
    steps = np.arange(len(doc) + 1, dtype=np.int32)
    for word in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        np.minimum(row[:-1] + (doc != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


class Index:
    """Windows of the items by their sampled steps; looks for items in documents."""

    def __init__(self, items: list[tuple[int, str]]):
        assert len(items) < 1 << 15
        raw, offsets = bytescan.buffer(pa.array([t or "" for _, t in items], pa.string()))
        found = bytescan.words(raw, offsets)
        self.ids = [i for i, _ in items]
        self.words = [found.of(k) for k in range(len(items))]
        self.spelled = [_spelled(raw, found, found.first[k], found.first[k + 1]) for k in range(len(items))]
        self.odd, sampled = plan()
        by_steps: dict[int, list[tuple[int, int, int]]] = {}
        for k, ws in enumerate(self.words):
            if len(ws):
                n = steps_of(len(ws))
                by_steps.setdefault(n, []).extend((int(found.first[k]) + at, k, at) for at in range(len(ws) - n + 1))
        #: per walk: its most steps, and of each table its sampled steps, sorted keys, (item, word) of each, and filter
        self.walks: list[tuple[int, list]] = []
        for w in range(WALKS):
            tables = []
            for n, rows in sorted(by_steps.items()):
                of = np.array(rows)
                out = walk(found.hashes, of[:, 0], self.odd[w, :n])
                for steps in sampled[n][w]:
                    keys = keys_of(out, steps)
                    order = np.argsort(keys, kind="stable")
                    bits = np.zeros(1 << BITS, bool)
                    bits[(keys >> np.uint64(64 - BITS)).view(np.int64)] = True
                    tables.append((steps, keys[order], of[order, 1:], bits))
            self.walks.append((max(by_steps, default=0), tables))

    def _candidates(self, ws: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct ``(item, text, begin)``, in order, of windows that agree with an item's: where in which text it would begin.

        Each is one number while they are gathered: 15 bits, 20 and 28.
        """
        high = np.uint64(64 - BITS)
        got = [np.zeros(0, np.int64)]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 28
        for a in range(0, len(ws), PLACES):
            starts = np.arange(a, min(a + PLACES, len(ws)))
            for w, (n, tables) in enumerate(self.walks):
                out = walk(ws, starts, self.odd[w, :n])
                for steps, keys, of, bits in tables:
                    mine = keys_of(out, steps)
                    likely = np.flatnonzero(bits[(mine >> high).view(np.int64)])
                    lo, hi = np.searchsorted(keys, mine[likely], "left"), np.searchsorted(keys, mine[likely], "right")
                    n_hits = hi - lo
                    if n_hits.any():
                        which = np.repeat(lo - (np.cumsum(n_hits) - n_hits), n_hits) + np.arange(n_hits.sum())
                        # where the window begins, less the word of the item at which the item's window begins
                        window = np.repeat(likely + a, n_hits)
                        got.append((of[which, 0] << 48) + text[window] + (window - of[which, 1] + (1 << 20)))
        key = np.unique(np.concatenate(got))
        return np.stack([key >> 48, key >> 28 & (1 << 20) - 1, (key & (1 << 28) - 1) - (1 << 20)], 1)

    def _stretches(self, ws: np.ndarray, first: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, begin, a, b)``: words ``a`` to ``b`` of a text that hold enough of an item's words.

        Each word of the item that a stretch lacks is an edit.  Words are told
        apart by a few bits here, so a stretch may seem to hold more than it
        does, never less.
        """
        few = (ws & np.uint64(4095)).astype(np.int16)
        cuts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1, append=-1))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            item = int(rows[x, 0])
            words = self.words[item]
            n, most = len(words), int(DISTANCE * len(words))
            text, begin = rows[x:y, 1], rows[x:y, 2]
            held = np.zeros(4097, bool)
            held[(words & np.uint64(4095)).view(np.int64)] = True
            lo, hi = np.maximum(first[text], begin - most), np.minimum(first[text + 1], begin + n + most)
            for at in range(0, y - x, 4096):
                s = slice(at, at + 4096)
                place = lo[s, None] + np.arange(n + 2 * most)
                inside = place < hi[s, None]
                seen = held[few[np.minimum(place, len(ws) - 1)]] & inside
                good = np.flatnonzero(seen.sum(1) >= n - most) + at
                # stretches of one text that overlap are looked at together
                k = 0
                while k < len(good):
                    j = k
                    while j + 1 < len(good) and text[good[j + 1]] == text[good[k]] and begin[good[j + 1]] - begin[good[j]] <= most:
                        j += 1
                    yield int(text[good[k]]), item, int(begin[good[k]]), int(lo[good[k]]), int(hi[good[j]])
                    k = j + 1

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, distance, word)`` of the best match of each text and item."""
        found = bytescan.words(raw, offsets)
        ws = found.hashes
        if not len(ws):
            return
        rows = self._candidates(ws, found.first)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for k, item, begin, a, b in self._stretches(ws, found.first, rows):
            have = best.get((k, item))
            if have and have[0] == 0:
                continue
            d = infix_distance(self.words[item], ws[a:b])
            if d <= int(DISTANCE * len(self.words[item])) and (have is None or d < have[0]):
                best[(k, item)] = (d, max(0, begin - int(found.first[k])), a, b)
        for (k, item), (_, word, a, b) in best.items():
            # hashes have said where to look; the words themselves decide
            d = _spelled_distance(self.spelled[item], _spelled(raw, found, a, b))
            if d <= int(DISTANCE * len(self.words[item])):
                yield k, item, d, word


def _spelled(raw: np.ndarray, found: bytescan.Words, a: int, b: int) -> list[bytes]:
    """Words ``a`` to ``b`` in lower-case ASCII letters and the bytes of all others."""
    return [raw[x:y].tobytes().lower() for x, y in zip(found.starts[a:b].tolist(), found.ends[a:b].tolist(), strict=True)]


def _spelled_distance(item: list[bytes], doc: list[bytes]) -> int:
    number: dict[bytes, int] = {}
    as_numbers = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.uint64)
    return infix_distance(as_numbers(item), as_numbers(doc))


HIT = "doc_id bigint, item_id bigint, distance int, n_item_words int, word bigint"


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``size`` items and about ``ITEM_BYTES`` bytes, one block on the driver at a time."""
    some, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna().dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        some.append((r["item_id"], r["text"]))
        held += len(r["text"])
        if len(some) == size or held >= ITEM_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def contamination(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, distance, n_item_words, word``: every item found in every document.

    ``distance`` is the least number of word edits found between the item and
    a run of the document's words, at most ``DISTANCE`` of the item's words;
    ``word`` is about where the run begins.  No shuffle: each pass over the
    documents holds one block of items, and there is one pass while the
    benchmark has at most ``items`` items.

    Items with a null id or text, or without words, match nothing; null texts
    are empty.  Null document ids are kept.  Items with the same id are looked
    for each.  Repeated documents give repeated rows.  Extra columns are not
    read; empty tables give no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for block in _blocks(benchmark, items):
        found = narrow.mapInArrow(_searcher(block), HIT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], HIT)


def _searcher(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = ["doc_id", "item_id", "distance", "n_item_words", "word"]
        for batch in batches:
            index = index or Index(items)
            raw, offsets = bytescan.buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows = []
            for a, b in bytescan.steps(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                for k, item, d, word in index.search(raw[offsets[a] : offsets[b]], cut):
                    rows.append((ids[a + k], index.ids[item], d, len(index.words[item]), word))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """Documents in which no item is found, with all their columns, in one pass per block of items.

    Null texts, null ids, repeated rows and odd items are as in ``contamination``;
    extra columns stay as they are, whatever their names; an empty table gives
    no rows, and without items every document stays.
    """
    out = docs
    for block in _blocks(benchmark, items):
        out = out.mapInArrow(_cleaner(block, docs.columns.index("text")), docs.schema)
    return out


def _cleaner(items: list[tuple[int, str]], text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(items)
            raw, offsets = bytescan.buffer(batch.column(text))
            keep = np.ones(batch.num_rows, bool)
            for a, b in bytescan.steps(offsets):
                for k, _, _, _ in index.search(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    keep[a + k] = False
            yield batch.filter(pa.array(keep))

    return run
