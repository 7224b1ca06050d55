"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

A lexicon of words and word beginnings, the trees and the calibration are
learned on a bounded sample of labelled rows by cross-fitting: a row's
features come from a lexicon that its own fold had no part in, and the
calibration sees scores of trees that were not fitted on the row.  The model
is a few thousand numbers, trained on the driver; documents are scored where
they are, whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lodestone.llm import store

#: Labelled rows that are learned from at most, those with the least hash of their id.
SAMPLE = 24_000
#: Parts of the sample that take turns in being left out.
FOLDS = 3
#: Entries of the lexicon at most, and documents that must hold one.
LEXICON, LEAST_DOCS = 4000, 4
#: Word beginnings that the lexicon may hold.
BEGINNINGS = (6, 5, 4)
#: Log odds from which a form is in the lexicon.
LEAST_ODDS = 2.0
#: Name of the score among columns that an input may have.
SCORE = "lodestone_toxic_score"
#: A document with at least this score is predicted toxic.
CUT = 0.3
#: The second person in four languages.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes su vosotros".split())
#: Words at either side in which a second person counts as near.
NEAR = 5
#: Characters that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"\w+")
_MASK = re.compile(r"(?<=[^\W\d_])[0-9@$*#!]+(?=[^\W\d_])")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$*#!]+[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_][^\W\d_]){3,}(?!\w)")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_SHOUT = re.compile(r"[!?]{2,}")
FEATURES = (
    "words", "word_hits", "word_rate", "begin_hits", "begin_rate", "distinct", "sum_odds", "max_odds", "mean_odds",
    "near_second", "second_rate", "near_share", "upper", "all_caps", "exclaim", "question", "shout", "punct",
    "masked", "spaced", "runs", "leet_hits",
)


def forms(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


def features(text: str, lexicon: dict[str, float], begins: list[tuple[int, dict[str, float]]]) -> list[float]:
    """Dense features of a whole text; rates are per word or per character."""
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = len(words), max(1, len(text))
    hits: list[tuple[int, str, float, bool]] = []
    for k, w in enumerate(words):
        odds = lexicon.get(w)
        if odds is not None:
            hits.append((k, w, odds, True))
            continue
        for size, table in begins:
            odds = table.get(w[:size]) if len(w) >= size else None
            if odds is not None:
                hits.append((k, w[:size], odds, False))
                break
    second = [k for k, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    places = np.array(second)
    near = 0
    if second:
        for k, *_ in hits:
            at = int(np.searchsorted(places, k))
            near += min([abs(int(places[x]) - k) for x in (at - 1, at) if 0 <= x < len(second)]) <= NEAR
    exact = sum(1 for h in hits if h[3])
    begun = len(hits) - exact
    odds = [h[2] for h in hits]
    masked = _MASKED.findall(low) if _MASK.search(low) else []
    spaced = _SPACED.findall(low)
    leet = sum(1 for w in masked if w.translate(LEET) in lexicon) + sum(1 for w in spaced if re.sub(r"[ .\-_]", "", w) in lexicon)
    per = max(1, n)
    runs = _UPPER.findall(text)
    upper = sum(map(len, runs))
    caps = sum(1 for w in runs if len(w) > 2)
    return [
        math.log1p(n), exact, exact / per, begun, begun / per, len({h[1] for h in hits}), sum(odds), max(odds, default=0.0), sum(odds) / max(1, len(odds)),
        near, len(second) / per, near / max(1, len(hits)), upper / chars, caps / per, text.count("!") / chars, text.count("?") / chars,
        len(_SHOUT.findall(text)) / per, sum(map(text.count, ".,;:!?")) / chars, len(masked) / per, len(spaced) / per,
        len(_LONG_RUN.findall(low)) / per, leet,
    ]


@dataclass
class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.prior = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        for f in range(width):  # rare values above a bulk of zeros get edges of their own
            top = x[:, f][x[:, f] > 0]
            if len(top) and len(edges[f]) < 4:
                edges[f] = np.unique(np.concatenate([edges[f], [0.0], np.quantile(top, np.linspace(0, 0.9, 10)) - 1e-9]))
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
        score = np.full(n, self.prior)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, int)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            for at in range(inner):
                mine = np.flatnonzero(node == at)
                best = (1e-6, 0, np.inf, None)
                if len(mine) >= 8:
                    g, h = grad[mine], hess[mine]
                    whole = g.sum() ** 2 / (h.sum() + self.ridge)
                    for f in range(width):
                        m = len(edges[f])
                        if not m:
                            continue
                        b = binned[mine, f]
                        gl = np.cumsum(np.bincount(b, g, m + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h, m + 1))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, float(edges[f][k]), b > k)
                feature[at], cut[at] = best[1], best[2]
                right = best[3] if best[3] is not None else np.zeros(len(mine), bool)
                node[mine] = 2 * at + 1 + right
            leaf = node - inner
            value = self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of a rising curve, smoothed by one half of a row each way."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [(b[0] + 0.5 * float(y.mean())) / (b[1] + 0.5) for b in blocks for _ in (0, 1)]
    return np.array(knots), np.maximum.accumulate(np.array(values))


@dataclass
class Model:
    """Lexicon, trees and calibration."""

    lexicon: dict[str, float]
    begins: list[tuple[int, dict[str, float]]]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    constant: float = 0.0

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([features(t, self.lexicon, self.begins) for t in texts], float).reshape(len(texts), len(FEATURES))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        raw = self.trees.raw(self.matrix(texts))
        # the raw score orders rows within one step of the calibration
        tie = 1e-6 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, self.knots, self.values) * (1 - 1e-6) + tie, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lexicon(best: list) -> Model:
    """A model with nothing but the lexicon of ``(form, odds)`` rows."""
    table = {r["form"]: float(r["odds"]) for r in best}
    begins = [(k, {f[:-1]: o for f, o in table.items() if f.endswith("*") and len(f) == k + 1}) for k in BEGINNINGS]
    return Model({f: o for f, o in table.items() if not f.endswith("*")}, [b for b in begins if b[1]], None, np.zeros(0), np.zeros(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out.

    The sample, one text for each labelled id (of several the least), is
    written to the shared folder once.  The driver gets at most ``LEXICON``
    entries of each of ``FOLDS + 1`` lexicons and a row of numbers for each
    row of the sample.  Labels that are null are not used; of several for one
    id the largest counts.  Without labels of both kinds the score is the
    share of toxic ones.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    rows = texts.groupBy("label_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = store.written(rows.select("label_id", "toxic", fold, "text"), "toxic-sample")
    sizes = {r[0]: (r[1], int(r[2])) for r in rows.groupBy("fold").agg(F.count("*"), F.sum("toxic")).collect()}
    total, bad = sum(a for a, _ in sizes.values()), sum(b for _, b in sizes.values())
    if not bad or bad == total:
        return Model({}, [], None, np.zeros(0), np.zeros(0), bad / total if total else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for y, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = {(f, k) for w in set(_WORD.findall(text.lower())) for f in forms(w)}
                every.update(seen)
                if y:
                    toxic.update(seen)
            keep = list(every)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keep]), pa.array([k for _, k in keep], pa.int32()), pa.array([toxic[k] for k in keep], pa.int64()), pa.array([every[k] for k in keep], pa.int64())], ["form", "fold", "toxic", "n"])

    counts = rows.select("toxic", "fold", "text").mapInArrow(count, "form string, fold int, toxic bigint, n bigint").groupBy("form")
    left_out = range(FOLDS + 1)  # the last leaves out none
    part = lambda c, k: F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counts = store.written(counts.agg(*[part(c, k) for k in left_out for c in ("toxic", "n")]).filter(F.col(f"n{FOLDS}") >= LEAST_DOCS), "toxic-counts")
    lexicons = []
    for k in left_out:
        n_bad = bad - sizes.get(k, (0, 0))[1]
        n_clean = total - sizes.get(k, (0, 0))[0] - n_bad
        toxic, n = F.col(f"toxic{k}"), F.col(f"n{k}")
        odds = F.log((toxic + 0.5) / (n_bad + 1)) - F.log((n - toxic + 0.5) / (n_clean + 1))
        best = counts.filter(n >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
        lexicons.append(_lexicon(best.select("form", "odds").orderBy(F.desc("odds"), "form").limit(LEXICON).collect()))
    model = lexicons[FOLDS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicons[k].lexicon, lexicons[k].begins) for k, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(x, pa.list_(pa.float64()))], ["label_id", "toxic", "fold", "x"])

    got = rows.mapInArrow(measure, StructType([*rows.schema.fields[:3], StructField("x", ArrayType(DoubleType()))])).toArrow()
    got = got.take(np.argsort(got["label_id"].to_numpy(), kind="stable"))
    x = np.array(got["x"].to_pylist(), float).reshape(len(got), -1)
    y, fold_of = (got["toxic"].to_numpy() > 0).astype(float), got["fold"].to_numpy()
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold_of == k
        if own.any() and not own.all():
            raw[own] = Trees().fit(x[~own], y[~own]).raw(x[own])
    for table in (rows, counts):
        store.forget(table)
    model.trees = Trees().fit(x, y)
    model.knots, model.values = isotonic(raw, y)
    return model


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``SCORE`` of each whole text."""
    names = [*docs.columns, SCORE]
    text = names.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([shipped.value.scores([t or "" for t in batch.column(text).slice(a, 500).to_pylist()]) for a in range(0, batch.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(SCORE, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null texts count as empty, null ids are never held out, repeated rows get
    the same score, extra columns are not read, and empty tables give no rows;
    without labels of both kinds the score is the share of toxic ones (0 if
    there are none).
    """
    scored = _scored(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Documents that ``toxicity`` doesn't predict toxic, with all their columns.

    Null texts, null ids, repeated rows and empty tables are as in
    ``toxicity``; extra columns stay, whatever their names.
    """
    return _scored(docs, train(docs, labels)).filter(F.col(SCORE) < cut).drop(SCORE)
