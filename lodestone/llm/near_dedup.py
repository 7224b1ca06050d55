"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

Texts are multisets of runs of five words.  A run that occurs ``w`` times
covers the levels 0 to ``w`` of a hierarchy of dyadic intervals; each interval
of each run has a Poisson process of its own whose points fall on a signature
component and a level.  The first point of each component whose level the
text reaches is its signature value, so two texts agree on a component with
the probability of their weighted Jaccard similarity (Ertl 2018).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lodestone.llm import bytescan, store
from lodestone.llm.components import components

#: Words of a run, and the least similarity of a link.
RUN, SIMILARITY = 5, 0.8
#: A pair with that similarity misses all bands with probability 3e-6.
BANDS, ROWS = 24, 4
#: Members of a pivot that one task compares.
MEMBERS = 2000
#: Members of a group that the first round offers to those outside its main class, and the growth a round.
OFFERED, GROWTH = 1, 16
#: Counters by which elements are put in order; many elements share one.
SLOTS = 1 << 18
_STEP = np.uint64(0xA0761D6478BD642F)
_SIDE = np.uint64(0xE7037ED1A0B428DB)


def _times(n: int, odd: np.uint64) -> np.uint64:
    return np.uint64(n * int(odd) & (1 << 64) - 1)


def bag_minhash(runs: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of multisets given as arrays of hashes that may repeat; one row each."""
    n = len(runs)
    out = np.full((n, m), np.inf)
    keys, owner, weight, base = [], [], [], []
    for k, run in enumerate(runs):
        if not len(run):
            continue
        elements, counts = np.unique(run, return_counts=True)
        top, low = int(counts.max()), 0
        while low < top:  # intervals [0,1), [1,2), [2,4), ...
            mine = counts > low
            keys.append(bytescan.mix(elements[mine] + _times(low, _SIDE)))
            owner.append(np.full(int(mine.sum()), k))
            weight.append(counts[mine])
            base.append(np.full(int(mine.sum()), low))
            low = max(1, 2 * low)
    if not keys:
        return out
    key, doc, w, lo = map(np.concatenate, (keys, owner, weight, base))
    size = np.maximum(lo, 1).astype(float)
    time = np.zeros(len(key))
    flat, limit = out.reshape(-1), np.full(n, np.inf)
    step = 0
    while len(key):
        step += 1
        x = bytescan.mix(key + _times(step, _STEP))
        time = time - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / size
        y = bytescan.mix(x)
        part = ((y >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        level = lo + ((y & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * size).astype(np.int64)
        ok = level < w
        np.minimum.at(flat, doc[ok] * m + part[ok], time[ok])
        touched = np.unique(doc)
        limit[touched] = out[touched].max(1)
        live = time < limit[doc]
        key, doc, w, lo, size, time = key[live], doc[live], w[live], lo[live], size[live], time[live]
    return out


def tagged(run: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the i-th occurrence of a hash is an element of its own."""
    run = np.sort(run)
    if not len(run):
        return run
    new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    nth = np.arange(len(run)) - np.repeat(new, np.diff(np.append(new, len(run))))
    return np.sort(np.where(nth == 0, run, bytescan.mix(run + nth.astype(np.uint64) * _SIDE)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two tagged multisets."""
    if not len(a) or not len(b):
        return 0.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def _node(hashes: np.ndarray, raw: np.ndarray) -> bytes:
    """128 bits that equal word sequences share; texts without words share them if equal."""
    seq, salt = (hashes, 1) if len(hashes) else (raw.astype(np.uint64), 2)
    place = np.arange(len(seq), dtype=np.uint64)
    one = bytescan.mix(seq + (place + np.uint64(1)) * _STEP).sum(dtype=np.uint64)
    two = bytescan.mix((seq ^ _SIDE) + (place + np.uint64(3)) * _SIDE).sum(dtype=np.uint64)
    head = np.array([one ^ np.uint64(len(seq) * 4 + salt), two ^ np.uint64(len(seq))], np.uint64)
    return bytescan.mix(head).tobytes()


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, node, bands`` of each document: its text's digest, which word sequence it is, and its band keys (none without words)."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(5).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            raw, offsets = bytescan.buffer(batch.column(1))
            for a, b in bytescan.steps(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                part = raw[offsets[a] : offsets[b]]
                found = bytescan.words(part, cut)
                nodes = [_node(found.of(k), part[cut[k] : cut[k + 1]]) for k in range(b - a)]
                runs = [bytescan.shingles(found.of(k), RUN) for k in range(b - a)]
                sig = bag_minhash(runs).view(np.uint64).reshape(b - a, BANDS, ROWS)
                keys = bytescan.mix((sig * odd).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)
                bands = [list(keys[k]) if len(runs[k]) else [] for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "node", "bands"])

    return narrow.mapInArrow(run, "doc_id bigint, digest string, node binary, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(pivot, member)`` with their similarity.

    Members come to a task with the pivot's text before them; a pivot with
    many members is dealt to several tasks, each with a copy of its text.
    """
    n = pairs.groupBy("pivot").agg(F.count("*").alias("n"))
    cuts = F.ceil(F.col("n") / MEMBERS).cast("int")
    heads = n.select("pivot", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("salt")).join(texts, F.col("pivot") == F.col("node")).select("pivot", "salt", F.lit(None).cast("binary").alias("member"), "text")
    members = pairs.join(n, "pivot").withColumn("salt", F.pmod(F.xxhash64("member"), cuts).cast("int")).join(texts, F.col("member") == F.col("node")).select("pivot", "salt", "member", "text")
    together = heads.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.asc_nulls_first("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, mine = None, None
        for batch in batches:
            raw, offsets = bytescan.buffer(batch.column(3))
            pivots, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for a, b in bytescan.steps(offsets):
                found = bytescan.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(a, b):
                    bag = tagged(bytescan.shingles(found.of(k - a), RUN))
                    if members[k] is None:
                        have, mine = pivots[k], bag
                    else:
                        assert pivots[k] == have
                        rows.append((pivots[k], members[k], similarity(mine, bag)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["pivot", "member", "similarity"])

    return together.mapInArrow(run, "pivot binary, member binary, similarity double")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` for every document; the class is named by its least id.

    Equal word sequences are one node.  Nodes that share a band key are a
    bucket; each bucket names one pivot, the member that most others share
    buckets with, and every member is compared with it exactly.  Members of
    buckets that are not in one class then are joined exactly (``_rest``), so
    classes are the components of all links within buckets.  Buckets have no
    limit of size.  ``n_links`` counts the verified links of the document's
    node.

    Null texts are empty; texts without words are alike only if equal; null
    ids get the class of their text; repeated rows give repeated results;
    extra columns are not read; an empty table gives no rows.
    """
    signed, labels, links = _labelled(docs)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = signed.select("doc_id", "node").join(labels.join(degree, "node"), "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "label").select("doc_id", "class_id", "n_links")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed documents, ``(node, label)`` of the nodes that have links, and the links."""
    signed = store.written(sign(docs), "signed")
    rows = signed.filter(F.size("bands") > 0).dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = store.written(rows.join(shared, "bucket"), "buckets")
    central = buckets.groupBy("node").agg(F.sum(F.log("n")).alias("central"))
    pivots = buckets.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("central", "node")).alias("pivot"))
    rows = store.written(buckets.join(pivots, "bucket"), "pivoted")
    store.forget(buckets)
    wanted = rows.select("node").distinct()
    holders = signed.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("holder"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = store.written(_node_texts(texts.join(holders, texts["doc_id"].eqNullSafe(holders["holder"])).select("text")).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
    pairs = store.written(rows.filter("node <> pivot").select("pivot", F.col("node").alias("member")).distinct(), "pairs")
    first = store.written(_verified(pairs, texts), "verified")
    store.forget(pairs)
    links, labels = _rest(rows, first, texts)
    store.forget(rows)
    store.forget(texts)
    return signed, labels, links


def _counted(texts: DataFrame) -> np.ndarray:
    """How many texts hold the elements of each of ``SLOTS`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, bag in _bags(batch):
                held += np.bincount((bag % np.uint64(SLOTS)).view(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held[slot])], ["slot", "n"])

    got = texts.select("node", "text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _bags(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Number and tagged multiset of each row's text, the second column."""
    raw, offsets = bytescan.buffer(batch.column(1))
    for a, b in bytescan.steps(offsets):
        found = bytescan.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(a, b):
            yield k, tagged(bytescan.shingles(found.of(k - a), RUN))


def _prefixes(texts: DataFrame) -> DataFrame:
    """``node, size, group, place``: the rarest elements of each text, enough of them that texts of a link share one.

    Of two sets that are alike by ``SIMILARITY``, each lacks at most the rest
    of the other; so in any common order of elements their first ``size -
    ceil(SIMILARITY * size) + 1`` have one in common.  The order is by rarity,
    so that groups are small; it need not be exact.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(_counted(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, cols, size = batch.column(0).to_pylist(), ([], [], [], []), 0
            for k, bag in _bags(batch):
                n = len(bag)
                if not n:
                    continue
                keep = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1
                rank = np.lexsort((bag, shipped.value[(bag % np.uint64(SLOTS)).view(np.int64)]))[:keep]
                for col, x in zip(cols, ([nodes[k]] * keep, np.full(keep, n), bag[rank].view(np.int64), np.arange(keep)), strict=True):
                    col.append(x)
                size += keep
                if size > 100_000:
                    yield _prefix_rows(cols)
                    cols, size = ([], [], [], []), 0
            if size:
                yield _prefix_rows(cols)

    return texts.select("node", "text").mapInArrow(run, "node binary, size bigint, group bigint, place bigint")


def _prefix_rows(cols: tuple[list, ...]) -> pa.RecordBatch:
    nodes = pa.array([x for part in cols[0] for x in part], pa.binary())
    return pa.RecordBatch.from_arrays([nodes, *[pa.array(np.concatenate(c)) for c in cols[1:]]], ["node", "size", "group", "place"])


def _rest(rows: DataFrame, first: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links ``(a, b)`` and the components' ``(node, label)``, from the comparisons with pivots on.

    A bucket whose members have more than one label is open, and an exact
    set-similarity join of the members of open buckets finds what the pivots
    missed.  Texts meet in groups of those that hold one rare element
    (``_prefixes``).  Each round offers some of a group's members, always
    those with the least hash and many times more of them each round, to the
    members outside its most frequent label; pairs of one label, and pairs
    whose sizes or places rule out a link, are left out.  Once all members
    have been offered, every pair of the group is compared or in one
    component, and the group is closed.
    """
    order = [F.greatest("pivot", "member").alias("pivot"), F.least("pivot", "member").alias("member")]
    close = F.col("similarity") >= SIMILARITY
    done = first.select(*order, "similarity")
    labels = store.written(components(done.filter(close).select(F.col("pivot").alias("a"), F.col("member").alias("b"))), "labels")

    def several(held: DataFrame, by: str) -> DataFrame:
        """Rows of groups with more than one label: with each row's label, the group's ``n`` rows and ``main``, its most frequent label."""
        named = held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = named.withColumn("held", F.count("*").over(Window.partitionBy(by, "label")))
        group = Window.partitionBy(by)
        named = named.withColumn("n", F.count("*").over(group)).withColumn("main", F.max(F.struct("held", "label")).over(group)["label"])
        return named.filter("held < n").drop("held")

    # a bucket of two has no pair but the one that its pivot made
    in_open = store.written(several(rows.filter("n > 2").select("bucket", "node"), "bucket").select("node").distinct(), "open-nodes")
    open_rows = store.written(_prefixes(texts.join(in_open, "node", "left_semi")), "prefixes")
    by_hash = Window.partitionBy("group").orderBy(F.xxhash64("node"), "node")
    offered, last, compared = OFFERED, open_rows, [first]
    while True:
        named = store.written(several(open_rows, "group").withColumn("nth", F.row_number().over(by_hash)), "open")
        store.forget(last)
        last = named
        if named.isEmpty():
            break
        theirs = named.filter(F.col("nth") <= offered)
        theirs = theirs.select("group", *[F.col(c).alias("its_" + c) for c in ("node", "size", "place", "label")])
        mine = named.filter("label <> main")
        least = SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("its_size")) - 1e-6
        enough = F.least(F.col("size") - F.col("place"), F.col("its_size") - F.col("its_place")) >= least
        sized = F.least("size", "its_size") >= (SIMILARITY - 1e-9) * F.greatest("size", "its_size")
        pairs = mine.join(theirs, "group").filter((F.col("label") != F.col("its_label")) & sized & enough)
        pairs = pairs.select(F.greatest("node", "its_node").alias("pivot"), F.least("node", "its_node").alias("member")).distinct()
        pairs = store.written(pairs.join(done, ["pivot", "member"], "left_anti"), "pairs")
        again = store.written(_verified(pairs, texts), "verified")
        store.forget(pairs)
        compared.append(again)
        done = done.unionByName(again)
        of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        found = again.filter(close).join(of("pivot"), "pivot", "left").join(of("member"), "member", "left")
        found = found.select(F.coalesce("pivot_label", "pivot").alias("a"), F.coalesce("member_label", "member").alias("b"))
        merged = store.written(components(found), "merged")
        if not merged.isEmpty():
            # nodes new to all links come in under their own name
            every = labels.unionByName(merged.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti"))
            joined = every.join(merged.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
            joined = store.written(joined.select("node", F.coalesce("least", "label").alias("label")), "labels")
            store.forget(labels)
            labels = joined
        store.forget(merged)
        open_rows = named.filter(F.col("n") > offered).select("node", "size", "group", "place")
        offered *= GROWTH
        store.sweep(rows.sparkSession)  # else shuffle files and plans of all rounds stay
    links = store.written(done.filter(close).select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct(), "verified-links")
    for table in (last, in_open, *compared):
        store.forget(table)
    store.sweep(rows.sparkSession)
    return links, labels


def _node_texts(texts: DataFrame) -> DataFrame:
    """``node`` before the columns of each row, of which the first is its text; a node's name depends on its words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytescan.buffer(batch.column(0))
            for a, b in bytescan.steps(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                part = raw[offsets[a] : offsets[b]]
                found = bytescan.words(part, cut)
                nodes = [_node(found.of(k), part[cut[k] : cut[k + 1]]) for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), *[c.slice(a, b - a) for c in batch.columns]], ["node", *batch.schema.names])

    return texts.mapInArrow(run, StructType([StructField("node", BinaryType()), *texts.schema.fields]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class with all its columns: the least id's (null ids last), of its texts that of the least digest.

    Rows are told apart by id and text, so null and repeated ids are no
    reason to drop a row.  Of rows with one id and one text one is kept, any
    of them.  Null texts are empty; an empty table gives no rows; extra
    columns stay, whatever their names.
    """
    signed, labels, links = _labelled(docs)
    named = signed.select("doc_id", "digest", "node").join(labels, "node", "left").select("doc_id", "digest", F.coalesce("label", "node").alias("label"))
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    kept = named.groupBy("label").agg(F.min(least).alias("least")).select(F.col("least.doc_id").alias("kept_id"), F.col("least.digest").alias("kept_digest"))
    kept = store.written(kept, "kept")
    own = "_near_dedup_digest"
    mine = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    out = mine.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(own) == F.col("kept_digest")), "left_semi")
    again = signed.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty()
    for table in (signed, labels, links):
        store.forget(table)
    return (out if again else out.dropDuplicates(["doc_id", own])).drop(own)
