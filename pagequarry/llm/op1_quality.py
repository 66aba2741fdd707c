"""Quality classifier: ridge regression on random Fourier features of document statistics.

1. One pass over the texts gives ``STATISTICS`` numbers a document (vectorised on Arrow buffers); the
   table of numbers, not the texts, is checkpointed and joined with the labels.
2. Means and deviations over all documents standardise them; ``FEATURES`` random Fourier features
   approximate a Gaussian kernel of width ``WIDTH``.
3. Each partition sums its normal equations, partial sums are added in two levels, and the driver solves
   one system of FEATURES + 1 unknowns.  Four fifths of the labelled documents (by a hash of the id) fit
   the ridge scores; the other fifth calibrates them.
4. Isotonic calibration: counts of the calibration scores in ``BINS`` fixed bins, pooled by adjacent
   violators.  A document is kept if its calibrated probability of good quality is at least ``CUTOFF``.

The model is of fixed size, so it travels in the closure whatever the input.

Defined results: a null text is read as an empty one; null ids are scored but not trained on; several
labels of a document are averaged, null labels ignored; documents that repeat count repeatedly; without
labelled documents there is no model: scores are null and everything is kept; with labels of one kind
only, that kind is every document's probability; an empty table gives an empty result.  Other columns
are ignored here and pass through ``keep_quality``, whatever their names.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._shared import checkpointed, release, small_batches, spread, trimmed
from pagequarry.llm._text import as_string_array, buffers, chunks, mix64, word_hashes

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-2
BINS = 2000
CUTOFF = 0.5
SEED = 1

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _WIDE, _TAIL, _LINE = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[0x80:0xC0] = _TAIL  # continuation bytes: not characters of their own
_CLASS[0xC0:] = _WIDE
NAMES = ("log_chars", "letters", "capitals", "digits", "stops", "symbols", "spaces", "word_length", "types", "top_word", "twice_2", "twice_5", "line_length", "words_a_line", "log_types")
STATISTICS = len(NAMES)


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: keys, distinct keys, and the largest count of one key."""
    _, first, count = np.unique(keys ^ mix64(doc.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    own = doc[first]
    top = np.zeros(n)
    np.maximum.at(top, own, count)
    return np.bincount(doc, minlength=n).astype(float), np.bincount(own, minlength=n).astype(float), top


def _grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(words) < k:
        return words[:0], doc[:0]
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = mix64(h) + words[i : len(words) - k + 1 + i]
    same = doc[: len(doc) - k + 1] == doc[k - 1 :]
    return h[same], doc[: len(doc) - k + 1][same]


def document_statistics(arr: pa.Array) -> np.ndarray:
    """(texts, STATISTICS) numbers, all finite, of whole texts."""
    out = np.zeros((len(arr), STATISTICS), np.float32)
    for at, to, part in chunks(arr):
        n = to - at
        data, offs = buffers(part)
        kinds = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * 9 + _CLASS[data], minlength=n * 9).reshape(n, 9).astype(float)
        chars = kinds.sum(1) - kinds[:, _TAIL]
        some = np.maximum(chars, 1)
        letters = kinds[:, _LOWER] + kinds[:, _UPPER] + kinds[:, _WIDE]
        words, woffs = word_hashes(part)
        doc = np.repeat(np.arange(n), np.diff(woffs))
        n_words, types, top = _repeats(words, doc, n)
        held = np.maximum(n_words, 1)
        twos, two_types, _ = _repeats(*_grams(words, doc, 2), n)
        fives, five_types, _ = _repeats(*_grams(words, doc, 5), n)
        lines = kinds[:, _LINE] + 1
        out[at:to] = np.column_stack([
            np.log1p(chars), letters / some, kinds[:, _UPPER] / np.maximum(letters, 1), kinds[:, _DIGIT] / some, kinds[:, _STOP] / some, np.sqrt(kinds[:, _SYMBOL] / some),
            kinds[:, _SPACE] / some, np.minimum((letters + kinds[:, _DIGIT]) / held, 40), types / held, top / held, 1 - two_types / np.maximum(twos, 1), 1 - five_types / np.maximum(fives, 1),
            np.log1p(chars / lines), np.log1p(n_words / lines), np.log1p(types) / np.log1p(held),
        ])
        empty = chars == 0
        out[at:to][empty] = 0
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, then the intercept
    edges: np.ndarray  # lower ends of the calibration's steps, rising
    levels: np.ndarray  # probabilities of the steps, not falling

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return (self.features(stats) @ self.weights).astype(np.float64) if len(stats) else np.zeros(0)

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        return self.levels[np.clip(np.searchsorted(self.edges, scores, side="right") - 1, 0, len(self.levels) - 1)]


def fourier(x: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """sqrt(2 / D) cos(W x + b), W normal with deviation 1 / width, and a constant: its inner products
    approximate exp(-|x - y|^2 / (2 width^2)) (+ 1)."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((x.shape[1], features)) / width
    b = rng.uniform(0, 2 * math.pi, features)
    z = np.cos(np.clip(x, -12, 12) @ w + b) * math.sqrt(2 / features)
    return np.column_stack([z, np.ones(len(x))])


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the not falling means, for bins with n > 0, in order."""
    blocks: list[list[float]] = []
    for weight, total in zip(n.tolist(), good.tolist()):
        blocks.append([weight, total, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, blocks[-1][2] + k]
    return np.concatenate([np.full(k, t / w) for w, t, k in blocks]) if blocks else np.zeros(0)


_COLUMNS = [f"s{i}" for i in range(STATISTICS)]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, s0 ...) of every document."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = document_statistics(as_string_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in stats.T)], names=["doc_id", *_COLUMNS])

    return slim.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} float" for c in _COLUMNS)]))


def _summed(parts: DataFrame, size: int) -> np.ndarray | None:
    """The sum of binary vectors of ``size`` doubles, in two levels."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for blob in table["v"]:
            total += np.frombuffer(blob.as_py())
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    groups = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    rows = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups))).applyInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in rows), np.zeros(size)) if rows else None


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model from a statistics table and (doc_id, quality) labels; None without labelled documents."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.avg("quality").alias("__y"))
    known = stats.join(named, F.col("doc_id") == F.col("__id"))
    known = checkpointed(spread(known.select(*_COLUMNS, "__y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("__cal")), F.xxhash64(*_COLUMNS)))
    moments = stats.agg(*(f(c).alias(f"{n}_{c}") for c in _COLUMNS for n, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    if known.isEmpty():
        return None
    mean = np.array([moments[f"m_{c}"] or 0.0 for c in _COLUMNS])
    scale = np.array([max(moments[f"d_{c}"] or 0.0, 1e-6) for c in _COLUMNS])
    d = FEATURES + 1
    size = d * d + d

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in _COLUMNS]).astype(float)
            y = batch.column("__y").to_numpy()
            for at in range(0, len(y), 4096):
                z = fourier((x[at : at + 4096] - mean) / scale)
                total[: d * d] += (z.T @ z).ravel()
                total[d * d :] += z.T @ y[at : at + 4096]
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    for train, calibrate in ((known.where("NOT __cal"), known.where("__cal")), (known, known)):
        total = _summed(train.mapInArrow(equations, "v binary"), size)
        if total is None:
            continue  # too few labels for a split: all of them do both
        gram = total[: d * d].reshape(d, d) + RIDGE * np.eye(d)
        model = Model(mean, scale, np.linalg.solve(gram, total[d * d :]), np.zeros(1), np.zeros(1))

        def scored(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = model.scores(np.column_stack([batch.column(c).to_numpy() for c in _COLUMNS]).astype(float))
                cell = np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("__y")], names=["bin", "y"])

        bins = sorted(calibrate.mapInArrow(scored, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect())
        if bins:
            levels = isotonic(np.array([r["n"] for r in bins], float), np.array([r["good"] for r in bins], float))
            return Model(mean, scale, model.weights, np.array([r["bin"] / BINS * 2 - 0.5 for r in bins]), levels)
    return None


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, score, quality, keep): ridge score, calibrated probability of good quality, decision."""
    stats = checkpointed(statistics_table(docs))
    model = fit(stats, labels)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                cells = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
            else:
                s = model.scores(np.column_stack([batch.column(c).to_numpy() for c in _COLUMNS]).astype(float))
                p = model.calibrated(s)
                cells = [pa.array(s), pa.array(p), pa.array(p >= cutoff)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], names=["doc_id", "score", "quality", "keep"])

    return stats.mapInArrow(decide, f"doc_id {kind}, score double, quality double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.  Rows are decided by
    their own text, so ids may be null or repeat."""
    small_batches(docs.sparkSession)
    model = fit(checkpointed(statistics_table(docs)), labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            stats = document_statistics(as_string_array(pa.array(text, pa.string(), from_pandas=True)))
            yield pd.Series(model.calibrated(model.scores(stats)) >= cutoff)
        release()

    return docs.where(good(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None
