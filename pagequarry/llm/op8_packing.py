"""Packing along a space-filling curve.

Each document's words are hashed into a signed feature vector, the vector is normalised and
projected by a fixed random matrix to ``DIMS`` dimensions, and the quantised point becomes a Hilbert
key.  Documents are range-sorted by that key and packed into sequences of ``capacity`` tokens, so
that neighbours on the curve share sequences.

Only (key, doc_id, n_tokens) is shuffled, never a text.  The order along the curve is total, token
offsets come from sums by range partition (one row a partition reaches the driver), and the curve
is cut every ``segment`` tokens; segments are packed independently.  A document begins in the segment
of its first token, so results do not depend on the number of partitions.  The sorted rows are
checkpointed, which keeps both passes on the same partitions when executors are lost.

Rules inside a segment: a document is put whole into the open sequence if it fits there; otherwise
the open sequence is closed.  One longer than ``capacity`` is cut into full sequences and its rest
opens the next one.

Defined results: a null text has no row; an empty one (0 tokens) has no row either, as it fills
nothing; null ids keep their rows with a null ``doc_id`` (first on ties); repeated rows are packed
repeatedly; ties of the key go by ``doc_id``, then by length; an empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._shared import checkpointed, trimmed
from pagequarry.llm._text import as_string_array, chunks, word_hashes
from pagequarry.llm._tokens import DEFAULT_VOCABULARY, token_counter

FEATURES = 256
DIMS = 3
BITS = 16
CAPACITY = 4096
SEGMENT = 1 << 20


def projection(features: int = FEATURES, dims: int = DIMS, seed: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((features, dims)).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dims) below 2**bits (Skilling's transform)."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def hashed_vectors(arr: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Normalised vectors of signed word counts; a text without words has the zero vector."""
    out = np.zeros((len(arr), features), np.float32)
    for at, to, part in chunks(arr):
        words, offs = word_hashes(part)
        doc = np.repeat(np.arange(to - at), np.diff(offs))
        sign = 1.0 - 2.0 * ((words >> np.uint64(62)) & np.uint64(1)).astype(np.float64)
        cell = doc * features + (words % np.uint64(features)).astype(np.int64)
        out[at:to] = np.bincount(cell, sign, (to - at) * features).reshape(to - at, features)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def curve_keys(arr: pa.Array, matrix: np.ndarray, bits: int = BITS) -> np.ndarray:
    low = hashed_vectors(arr, len(matrix)) @ matrix
    # a unit vector's projections are about standard normal: tanh spreads them over the cube
    cells = np.clip((np.tanh(low.astype(np.float64)) + 1) * 0.5 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_key(cells, bits)


def pack_segment(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next-fit in the given order: (row, sequence, place in it, first token, token after the last)."""
    rows, seqs, places, starts, ends = [], [], [], [], []
    seq, used = 0, 0
    for r, n in enumerate(tokens.tolist()):
        if used and used + n > capacity:
            seq, used = seq + 1, 0
        at = 0
        while at < n:
            take = min(n - at, capacity - used)
            rows.append(r), seqs.append(seq), places.append(used), starts.append(at), ends.append(at + take)
            at, used = at + take, used + take
            if used == capacity:
                seq, used = seq + 1, 0
    return tuple(np.array(x, np.int64) for x in (rows, seqs, places, starts, ends))


def measured(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(key, doc_id, n_tokens) of every document with a token."""
    matrix = projection()

    @trimmed
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for batch in batches:
            arr = as_string_array(batch.column(1))
            keys, n = curve_keys(arr, matrix), count(arr)
            out = pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), pa.array(n)], names=["key", "doc_id", "n_tokens"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "key long, doc_id long, n_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, segment: int = SEGMENT, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(pack_id, offset, doc_id, start_token, end_token, curve_key): tokens [start, end) of a document
    stand at ``offset`` of sequence ``pack_id``; sequences are numbered along the curve."""
    order = ["key", "doc_id", "n_tokens"]
    # range bounds come from a sample of the rows: the texts are measured once, not once for the sample and once to sort
    slim = checkpointed(measured(docs, vocabulary))
    ranged = checkpointed(slim.repartitionByRange(*order).sortWithinPartitions(*order))
    sums = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n_tokens").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sums):
        base[r["p"]], total = total, total + r["n"]

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = base.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = at + np.cumsum(n)
            starts = ends - n
            at = int(ends[-1]) if len(n) else at
            yield pa.RecordBatch.from_arrays([pa.array(starts // segment), pa.array(starts), *batch.columns], names=["segment", "start", *order])

    def pack_one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), *((c, "ascending") for c in order)])
        rows, seqs, places, starts, ends = pack_segment(table["n_tokens"].to_numpy(), capacity)
        rows = pa.array(rows)
        cells = [table["segment"].take(rows), pa.array(seqs), pa.array(places), table["doc_id"].take(rows), pa.array(starts), pa.array(ends), table["key"].take(rows)]
        return pa.table(cells, names=["segment", "seq", "offset", "doc_id", "start_token", "end_token", "curve_key"])

    placed = ranged.mapInArrow(offsets, "segment long, start long, key long, doc_id long, n_tokens long")
    out = placed.groupBy("segment").applyInArrow(pack_one, "segment long, seq long, offset long, doc_id long, start_token long, end_token long, curve_key long")
    return out.select((F.shiftleft("segment", 32) + F.col("seq")).alias("pack_id"), "offset", "doc_id", "start_token", "end_token", "curve_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
