"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store, tokens

WINDOW = 4096
#: Windows that stay open in a partition.
OPEN_WINDOWS = 64
#: A gap of at least so many tokens is filled by cutting a piece; smaller gaps are padded.
MIN_CUT = 64
#: Leftover windows that one task of a merge round takes.
MERGE_ROWS = 20_000

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
FULL = PIECE + ", sequence_id bigint, offset bigint, open boolean"


class Packer:
    """A fixed number of open windows; pieces go where they fit best.

    ``put`` returns windows that are closed.  A piece as long as the window
    closes at once.  Where a piece fits in no open window and none may be
    added, the fullest is emitted: its gap is filled with the head of the
    piece if ``cut`` gives one, else padded.
    """

    def __init__(self, window: int, slots: int, min_cut: int):
        self.window, self.slots, self.min_cut = window, slots, min_cut
        self.open: list[tuple[int, list]] = []

    def put(self, piece, length: int, cut=None) -> Iterator[list]:
        while True:
            if length == self.window:
                yield [(piece, length)]
                return
            best = -1
            for k, (used, _) in enumerate(self.open):
                if used + length <= self.window and (best < 0 or used > self.open[best][0]):
                    best = k
            if best >= 0:
                used, pieces = self.open[best]
                pieces.append((piece, length))
                if used + length == self.window:
                    del self.open[best]
                    yield pieces
                else:
                    self.open[best] = (used + length, pieces)
                return
            if len(self.open) < self.slots:
                self.open.append((length, [(piece, length)]))
                return
            fullest = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open.pop(fullest)
            gap = self.window - used
            if cut is not None and gap >= self.min_cut and length - gap >= self.min_cut:
                head, piece = cut(piece, gap)
                pieces.append((head, gap))
                length -= gap
            yield pieces

    def rest(self) -> list[list]:
        out = [pieces for _, pieces in self.open]
        self.open = []
        return out


def _rows(windows: Iterator[tuple[list, bool]], base: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset", "open"]
    cols: list[list] = [[] for _ in names]
    size = 0
    for seq, (pieces, is_open) in enumerate(windows):
        offset = 0
        for (doc_id, start, ids, crc, doc_tokens), length in pieces:
            if crc is None:
                crc = zlib.crc32(ids)
            row = (doc_id, start, length, crc, doc_tokens, ids if with_ids else None, base + seq, offset, is_open)
            for col, x in zip(cols, row, strict=True):
                col.append(x)
            offset += length
            size += len(ids) if with_ids and ids else 64
        if size > 4_000_000:
            yield _batch(names, cols)
            cols, size = [[] for _ in names], 0
    if cols[0]:
        yield _batch(names, cols)


def _batch(names: list[str], cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    window: int = WINDOW,
    slots: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    with_ids: bool = True,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; one row per piece.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, unless ``with_ids`` is false, ``ids`` (little-endian
    unsigned 32-bit).  Each partition packs its documents in the order it
    reads them with a fixed number of open windows, so its memory does not
    grow with its rows; long documents first give whole windows.  Windows
    left open are merged in rounds, each a good deal smaller than the one
    before, until one task takes what is left.  The first round's rows are
    written to the shared folder, so nothing is tokenized twice.

    Null texts are empty documents of one token (the end id); null ids stay
    null and repeated rows are packed each.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        packer = Packer(window, slots, min_cut)

        def cut(piece, gap):
            doc_id, start, ids, _, n = piece
            return (doc_id, start, ids[: 4 * gap], None, n), (doc_id, start + gap, ids[4 * gap :], None, n)

        def windows():
            encode = tokens.encoder(path)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    texts = part.column(1).to_pylist()
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode.batch(texts), strict=True):
                        ids += end
                        n = len(ids) // 4
                        for start in range(0, n, window):
                            some = ids[4 * start : 4 * (start + window)]
                            for closed in packer.put((doc_id, start, some, None, n), len(some) // 4, cut):
                                yield closed, False
            for pieces in packer.rest():
                yield pieces, True

        yield from _rows(windows(), base, with_ids)

    packed = store.written(narrow.mapInArrow(first, FULL), "packed")
    done = [packed.filter(~F.col("open"))]
    left = packed.filter("open")
    level = 1
    while True:
        n = left.select("sequence_id").distinct().count()
        parts = -(-n // MERGE_ROWS) if n else 1
        left = store.written(_merge(left, window, slots, parts, level, with_ids), "packed-left")
        if parts == 1:
            done.append(left)
            break
        done.append(left.filter(~F.col("open")))
        left = left.filter("open")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open") if with_ids else out.drop("open", "ids")


def _merge(left: DataFrame, window: int, slots: int, parts: int, level: int, with_ids: bool) -> DataFrame:
    """Place the pieces of open windows anew, longest windows first; the last round closes all."""
    spread = left.repartition(parts, "sequence_id").sortWithinPartitions(F.desc("length"), "doc_id", "start")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        packer = Packer(window, slots, window)

        def windows():
            for batch in batches:
                for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    doc_id, start, length, crc, n, ids = r
                    for closed in packer.put((doc_id, start, ids, crc, n), length):
                        yield closed, False
            for pieces in packer.rest():
                yield pieces, parts > 1

        yield from _rows(windows(), base, with_ids)

    return spread.mapInArrow(place, FULL)
