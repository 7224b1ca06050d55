"""Document fingerprints from closed syncmers over words.

A k-mer of words is an anchor if the least of its inner s-mers (by hash)
stands first or last in it.  The choice looks at nothing outside the k-mer,
so equal passages have equal anchors wherever they stand.  A fingerprint is
all anchors of the whole text in order, each with its distance from the one
before; likeness matches anchors by hash and place.  Only DataFrame functions
run on the main path.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 4, 2
#: Bits of a mark that hold the place of its anchor; the 40 above them hold its hash.
PLACE_BITS = 23
#: Words (as a power of two) by which the places of equal anchors may always differ; twice as many are too far.
NEAR_BITS = 8
#: Documents of one stretch of identifiers, and the most stretches: their bounds go to the driver and back.
STRETCH, MAX_STRETCHES = 1000, 40_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mark(hash64: Column, pos: Column) -> Column:
    """40 bits of a hash above the place."""
    place = F.least(pos, F.lit((1 << PLACE_BITS) - 1)).cast("bigint")
    return F.shiftleft(F.shiftrightunsigned(hash64, 24), PLACE_BITS).bitwiseOR(place)


def marks(text: Column, k: int = K, s: int = S) -> Column:
    """All anchors in text order as marks (see ``anchors``)."""
    inner = k - s + 1
    hashes = F.transform(F.array_remove(F.split(F.lower(text), BREAKS), ""), lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        small = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda j: F.xxhash64(*[F.get(h, j + x) for x in range(s)]))

        def of(g: Column) -> Column:
            def edge(i: Column) -> Column:
                ends = F.least(F.get(g, i), F.get(g, i + (inner - 1)))
                out = F.lit(True)
                for x in range(1, inner - 1):
                    out = out & (ends <= F.get(g, i + x))
                return out

            whole = lambda i: _mark(F.xxhash64(*[F.get(h, i + x) for x in range(k)]), i)
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - k), edge), whole)

        return _let(small, of)

    whole = F.array(_mark(F.xxhash64(text), F.lit(0)))
    none = F.array().cast("array<bigint>")
    return _let(hashes, lambda h: F.when(F.size(h) >= k, chosen(h)).when(F.size(h) > 0, F.transform(h, _mark)).when(F.length(text) > 0, whole).otherwise(none))


def _place(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of ``(hash, pos)`` in text order.

    A text of fewer than ``k`` words has an anchor for each word; one without
    words, unless it is empty, a single anchor for the whole text.
    """
    return F.transform(marks(text, k, s), lambda m: F.struct(F.shiftrightunsigned(m, PLACE_BITS).alias("hash"), _place(m).alias("pos")))


def as_string(of: Column) -> Column:
    """For each mark ten hex digits of its hash and its distance from the one before, a digit where that is below 16."""

    def one(m: Column, i: Column) -> Column:
        before = F.coalesce(_place(F.get(of, i - 1)), F.lit(0).cast("bigint"))
        return F.concat(F.lpad(F.hex(F.shiftrightunsigned(m, PLACE_BITS)), 10, "0"), F.hex(_place(m) - before))

    return F.lower(F.array_join(F.transform(of, one), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice likeness of two arrays of marks, matched by hash and place; 1 for two empty ones.

    Places are cut into cells; an anchor is matched if the other text has it
    in the same cell or the one before or behind, so words put in or left out
    shift what follows without harm, and passages moved farther don't match.
    """
    cells = lambda m: F.transform(m, lambda x: F.shiftright(x, NEAR_BITS))
    around = lambda c: F.concat(c, F.transform(c, lambda x: x + 1), F.transform(c, lambda x: x - 1))

    def matched(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, around(y)))

    def share(x: Column, y: Column) -> Column:
        size = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))
        return F.when(size == 0, F.lit(1.0)).otherwise((matched(x, y) + matched(y, x)) / size)

    return _let(cells(a), lambda x: _let(cells(b), lambda y: share(x, y)))


def _stretch(bounds: list[int]) -> Column:
    """How many of the rising ``bounds`` are at most ``doc_id``: searched in two levels, as arrays have no binary search."""
    width = max(1, int(len(bounds) ** 0.5))
    fine = F.lit(np.array([*bounds], np.int64))
    coarse = F.lit(np.array(bounds[::width], np.int64))
    at_most = lambda some: F.size(F.filter(some, lambda x: x <= F.col("doc_id")))
    return _let(F.greatest(F.lit(1), at_most(coarse)), lambda c: (c - 1) * width + at_most(F.slice(fine, (c - 1) * width + 1, F.lit(width))))


def with_next(docs: DataFrame, derived: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, text`` with ``marks``, ``next_text`` and ``next_marks`` of the one that follows in descending ``doc_id``.

    The last is followed by the first.  Identifiers are cut into stretches of
    about equal numbers of rows by quantiles, however they are spread; each is
    ordered by itself, and the first rows of a stretch are also dealt to the
    stretch before whose last row they follow, so no task sees all rows.
    Null ids come last; rows with the same id follow in order of their texts.
    ``marks`` are derived from texts where they have been dealt to.
    """
    spark = docs.sparkSession
    n = docs.count()
    cuts = max(1, min(n // STRETCH, MAX_STRETCHES))
    found = docs.stat.approxQuantile("doc_id", [k / cuts for k in range(1, cuts)], 1 / (4 * cuts)) if cuts > 1 else []
    bounds = sorted({int(x) for x in found})
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_stretch(bounds) if bounds else F.lit(0))
    tops = sorted((r["place"], r["top"]) for r in docs.groupBy(place.alias("place")).agg(F.max("doc_id").alias("top")).collect())  # at most MAX_STRETCHES + 2 rows
    rows = [(p, top, tops[(k + 1) % len(tops)][0]) for k, (p, top) in enumerate(tops)]
    table = F.broadcast(spark.createDataFrame(rows, "place int, top bigint, lender int"))
    placed = docs.withColumn("place", place).join(table, "place")
    own = F.struct(F.col("place").alias("place"), F.lit(0).alias("lent"))
    lent = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.struct(F.col("lender").alias("place"), F.lit(1).alias("lent")))
    dealt = placed.withColumn("seat", F.explode(F.array_compact(F.array(own, lent)))).select("doc_id", "text", "seat.place", "seat.lent")
    order = ["lent", F.desc_nulls_last("doc_id"), "text"]
    marked = dealt.repartition("place").sortWithinPartitions("place", *order).withColumn("marks", derived(F.col("text")))
    after = F.lead(F.struct("text", "marks")).over(Window.partitionBy("place").orderBy(*order))
    return marked.withColumn("after", after).filter("lent = 0").select("doc_id", "text", "marks", F.col("after.text").alias("next_text"), F.col("after.marks").alias("next_marks"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has the last third of the code points (rounded down)
    replaced by the first as many of the next document.  Null texts are empty;
    null ids, ties and repeated rows are ordered as ``with_next`` says; extra
    columns are not read; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if narrow.isEmpty():
        none = F.lit(None).cast("array<bigint>")
        rows = narrow.select("doc_id", "text", none.alias("marks"), F.lit("").alias("next_text"), none.alias("next_marks"))
    else:
        rows = with_next(narrow, marks)
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = rows.withColumn("n", n).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail)))
    marked = edited.select("doc_id", "n", "marks", "next_marks", F.sha2("edited", 256).alias("edited_sha256"), marks(F.col("edited")).alias("edited_marks"))
    return marked.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_string(F.col("marks")).alias("fingerprint"),
        as_string(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
