"""N-gram Jaccard self-join by a token-group matrix; exact.

A document's tokens are the hashes of its distinct word ``N``-grams (all its words, if there are fewer).
Documents with equal token sets form one class and are compared once.

1. Survivors.  A class of n tokens can only be similar to another if at least ``ceil(t * n)`` of its tokens
   are shared.  Tokens are met in buckets by their leading bits: a task sorts the tokens of ``FLUSH`` entries
   at once; one held twice there is known to be shared, is counted on the spot and told to its bucket once,
   whatever the number of its holders; all others ask their bucket.  So a token, and a text, that a third
   of all documents hold sends one entry a flush.  Buckets compare 32 further bits, which can only make
   more tokens look shared, so no class that has a partner is lost.
2. Groups.  A survivor joins the group of that of its tokens which is most frequent by a table of
   ``CELLS`` counts; groups of one family are joined, and cut into parts of about ``PART`` tokens.  How classes
   are grouped decides the cost, not the result.  A set's prefix are the first
   ``n - ceil(t * n) + ceil(LEAD * n)`` tokens in the order of that table, rare ones first, then of the hashes:
   an order that is the same for all.
3. The matrix holds the token union of each group's prefixes.  Of two similar classes, the first
   ``min(ceil(LEAD * n), ceil(LEAD * m))`` common tokens are in both prefixes, and ``m >= ceil(t * n)``.  So a query
   must meet ``ceil(LEAD * ceil(t * n))`` tokens of a group's union, else the group stays closed.
4. An opened group first bounds the overlap with the union of its members' whole sets (at least
   ``ceil(t * n)``), then computes the exact Jaccard similarities, in blocks of about ``PART`` tokens of queries.

Every bound is one that all similar pairs meet, so none is lost, and whether a pair is found does not depend
on other rows.  Each class is in one group and asks it in one block, so each link is counted once from either
side.  Links leave a block as counts, and as a spanning forest for the connected components: never as all
pairs.  In a family of k mutually similar, different texts the comparisons grow as k * k, as its links do.
Similarities are of sets of 48-bit hashes.

Result: one row for each document: ``doc_id``; ``class_id``, the least id among the documents that are
connected with it by links; ``n_copies``, other documents of equal token set; ``n_links``, different token sets
that are at least ``threshold`` similar.

Defined results: null, empty and wordless texts match nothing, their class is their own id; null ids are
compared, and the least id is taken among those that are not null (null if none is); repeated rows are copies
of each other, each has its row; a similarity that equals the threshold is a link; very long texts are taken
whole; an empty table gives an empty result.  Other columns are ignored by the join and pass through
``keep_one``, whatever their names.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm._shared import checkpointed, release, trimmed
from pagequarry.llm._text import WORD_RE, as_string_array, chunks, mix64, word_hashes

N = 3
THRESHOLD = 0.6
LEAD = 0.1
FLUSH = 1 << 20  # entries that a task sorts at once
BUCKET = 1 << 21  # entries of a bucket, about
CELLS = 1 << 18
PART = 1 << 20
BROADCAST_ROWS = 1_000_000
_ROWS = 1 << 15  # documents at once: their numbers must fit in 16 bits beside 48 bits of hash
_LOW = np.uint64((1 << 48) - 1)


def least_shared(n, threshold: float):
    """Tokens that a set of n must share with one that is similar to it."""
    return np.ceil(threshold * np.asarray(n) - 1e-9).astype(np.int64)


def prefix_size(n, threshold: float):
    return np.asarray(n) - least_shared(n, threshold) + least_shared(n, min(LEAD, threshold))


def least_met(n, threshold: float):
    """Tokens of a set of n that its prefix must share with that of a similar one."""
    return least_shared(least_shared(n, threshold), min(LEAD, threshold))


def token_sets(arr: pa.Array, n: int = N) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts, in order: sorted distinct tokens (48 bits) and each text's offsets."""
    for at, to, part in chunks(arr):
        for lo in range(0, to - at, _ROWS):
            own = part.slice(lo, min(_ROWS, to - at - lo))
            words, offs = word_hashes(own)
            counts = np.diff(offs)
            doc = np.repeat(np.arange(len(own), dtype=np.uint64), counts)
            grams, of = words[:0], doc[:0]
            if len(words) >= n:
                h = words[: len(words) - n + 1].copy()
                for i in range(1, n):
                    h = mix64(h) + words[i : len(words) - n + 1 + i]
                same = doc[: len(doc) - n + 1] == doc[n - 1 :]
                grams, of = mix64(h[same]), doc[: len(doc) - n + 1][same]
            short = np.flatnonzero((counts > 0) & (counts < n))
            if len(short):
                whole = []
                for k in short:
                    h = np.array([counts[k]], np.uint64)
                    for w in words[offs[k] : offs[k + 1]]:
                        h = mix64(h + w)
                    whole.append(h)
                grams, of = np.concatenate([grams, *whole]), np.concatenate([of, short.astype(np.uint64)])
            keys = np.sort((of << np.uint64(48)) | (grams >> np.uint64(16)))
            if len(keys):
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            yield keys & _LOW, np.searchsorted(keys >> np.uint64(48), np.arange(len(own) + 1, dtype=np.uint64))


def fingerprints(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(sets, 2) numbers that stand for each token set; those of an empty one mean nothing."""
    out = np.zeros((len(offs) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        out[some, 0] = mix64(np.add.reduceat(mix64(tokens), offs[some]))
        out[some, 1] = mix64(np.add.reduceat(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), offs[some]))
    return out


def _binary(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of numbers as binary values."""
    return pa.array([x.tobytes() if valid is None or valid[k] else None for k, x in enumerate(rows)], pa.binary())


def _blobs(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Slices of one array as binary values."""
    size = flat.dtype.itemsize
    if int(offs[-1]) * size < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * size).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
    return pa.array([flat[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary())


def _unblob(col, kind) -> tuple[np.ndarray, np.ndarray]:
    """One array and offsets of a column of binary values."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    if not len(arr):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    data = arr.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind) if data is not None and offs[-1] > offs[0] else np.zeros(0, kind)
    return flat, (offs - offs[0]) // np.dtype(kind).itemsize


def _packed(tokens: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Token sets as binary values of six bytes a token."""
    six = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6])
    return _blobs(six.ravel(), offs * 6)


def _unpacked(col) -> tuple[np.ndarray, np.ndarray]:
    flat, offs = _unblob(col, np.uint8)
    eight = np.zeros((len(flat) // 6, 8), np.uint8)
    eight[:, :6] = flat.reshape(-1, 6)
    return eight.view(np.uint64).ravel(), offs // 6


def _gathered(flat: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of some rows, one after another, and their offsets."""
    lens = offs[rows + 1] - offs[rows]
    ends = np.concatenate([[0], np.cumsum(lens)])
    return flat[np.repeat(offs[rows] - ends[:-1], lens) + np.arange(ends[-1])], ends


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is null without words."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for tokens, offs in token_sets(as_string_array(batch.column(1))):
                fps = fingerprints(tokens, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(fps)), _binary(fps, np.diff(offs) > 0)], names=["doc_id", "fp"])
                at += len(fps)

    return slim.mapInArrow(run, f"doc_id {kind}, fp binary")


def survivors(texts: DataFrame, threshold: float) -> DataFrame:
    """(cls) of the classes of which enough tokens are shared; cls is the first half of a fingerprint."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(0, math.ceil(math.log2(max(1, size / 6 / BUCKET)))))
    to_low = np.uint64(64 - bits - 32)

    def sent(parts: list[np.ndarray], classes: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, cls, size = np.concatenate(parts), np.concatenate(classes), np.concatenate(sizes)
        keys.sort()  # token, then the class's number in the last 16 bits
        new = np.concatenate([[True], (keys[1:] ^ keys[:-1]) > np.uint64(0xFFFF)])
        again = np.concatenate([~new[1:], [False]])
        single = new & ~again
        known = np.bincount((keys[~single] & np.uint64(0xFFFF)).astype(np.int64), minlength=len(cls)) - least_shared(size, threshold)
        cells = [pa.array([-1 - int(cls[0] % np.uint64(1 << bits))], pa.int32()), _binary([known]), pa.array([b""], pa.binary()), _binary([cls]), pa.array([b""], pa.binary())]
        names = ["bucket", "asked", "counts", "cls", "told"]
        yield pa.RecordBatch.from_arrays(cells, names=names)
        ends = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)), len(keys))
        rows: list[list] = [[], [], [], [], []]
        held = 0
        for b in np.flatnonzero(np.diff(ends)).tolist():
            at = slice(ends[b], ends[b + 1])
            asks = single[at]
            low = ((keys[at] >> to_low) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            number = (keys[at][asks] & np.uint64(0xFFFF)).astype(np.uint16)
            n = np.bincount(number, minlength=len(cls))
            there = np.flatnonzero(n)
            # a class of more than 255 askers is listed again
            times = -(-n[there] // 255)
            counts = np.full(int(times.sum()), 255, np.uint8)
            counts[np.cumsum(times) - 1] = n[there] - 255 * (times - 1)
            told = low[new[at] & again[at]]
            for cell, x in zip(rows, (b, low[asks][np.argsort(number, kind="stable")].tobytes(), counts.tobytes(), np.repeat(cls[there], times).tobytes(), told.tobytes())):
                cell.append(x)
            held += ends[b + 1] - ends[b]
            if held > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int32(), *[pa.binary()] * 4))], names=names)
                rows, held = [[], [], [], [], []], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int32(), *[pa.binary()] * 4))], names=names)

    @trimmed
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, classes, sizes, done, n = [], [], [], set(), 0
        for batch in batches:
            for tokens, offs in token_sets(as_string_array(batch.column(0))):
                cls = fingerprints(tokens, offs)[:, 0]
                lens = np.diff(offs)
                fresh = []
                for k in np.flatnonzero(lens).tolist():
                    c = int(cls[k])
                    if c not in done:
                        done.add(c)
                        fresh.append(k)
                if not fresh:
                    continue
                if len(done) >= 1 << 16:
                    if parts:
                        yield from sent(parts, classes, sizes)
                    parts, classes, sizes, done, n = [], [], [], {int(cls[k]) for k in fresh}, 0
                fresh = np.array(fresh)
                flat, ends = _gathered(tokens, offs, fresh)
                first = sum(map(len, classes))
                parts.append((flat << np.uint64(16)) | np.repeat(np.arange(first, first + len(fresh), dtype=np.uint64), np.diff(ends)))
                classes.append(cls[fresh]), sizes.append(lens[fresh])
                n += len(flat)
                if n >= FLUSH:
                    yield from sent(parts, classes, sizes)
                    parts, classes, sizes, done, n = [], [], [], set(), 0
        if parts:
            yield from sent(parts, classes, sizes)

    @trimmed
    def answer(table: pa.Table) -> pa.Table:
        """(cls, balance): the shared tokens of a bucket, or those known before, less what is needed."""
        classes, _ = _unblob(table["cls"], np.uint64)
        if table["bucket"][0].as_py() < 0:
            return pa.table({"cls": pa.array(classes.view(np.int64)), "balance": pa.array(_unblob(table["asked"], np.int64)[0])})
        asked, _ = _unblob(table["asked"], np.uint32)
        told, _ = _unblob(table["told"], np.uint32)
        cls = np.repeat(classes, _unblob(table["counts"], np.uint8)[0])
        order = np.argsort(asked, kind="stable")
        token, cls = asked[order], cls[order]
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        if not len(new):
            return pa.table({"cls": pa.array([], pa.int64()), "balance": pa.array([], pa.int64())})
        shared = np.minimum.reduceat(cls, new) != np.maximum.reduceat(cls, new)
        shared |= np.isin(token[new], told)
        own, n = np.unique(cls[np.repeat(shared, np.diff(new, append=len(token)))], return_counts=True)
        return pa.table({"cls": pa.array(own.view(np.int64)), "balance": pa.array(n.astype(np.int64))})

    rows = texts.mapInArrow(ask, "bucket int, asked binary, counts binary, cls binary, told binary")
    return rows.groupBy("bucket").applyInArrow(answer, "cls long, balance long").groupBy("cls").agg(F.sum("balance").alias("balance")).where("balance >= 0").select("cls")


def token_table(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, fp, size, tokens) of the wanted classes, once each; tokens are sorted and packed."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    listed = None
    if few:  # else all token sets are shuffled and joined
        keys = np.sort(wanted.toArrow()["cls"].to_numpy())
        listed = texts.sparkSession.sparkContext.broadcast(keys)

    @trimmed
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for tokens, offs in token_sets(as_string_array(batch.column(0))):
                fps = fingerprints(tokens, offs)
                cls, lens = fps[:, 0].view(np.int64), np.diff(offs)
                ok = lens > 0
                if listed is not None:
                    at = np.searchsorted(listed.value, cls)
                    ok &= listed.value[np.minimum(at, len(listed.value) - 1)] == cls if len(listed.value) else False
                rows = [k for k in np.flatnonzero(ok).tolist() if fps[k].tobytes() not in done]
                if len(done) < 1 << 17:
                    done.update(fps[k].tobytes() for k in rows)
                if rows:
                    rows = np.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), _binary(fps[rows]), pa.array(lens[rows]), _packed(*_gathered(tokens, offs, rows))], names=["cls", "fp", "size", "tokens"])

    sets = texts.mapInArrow(whole, "cls long, fp binary, size long, tokens binary")
    if listed is None:
        sets = sets.join(wanted, "cls", "left_semi")
    return sets.groupBy("fp").agg(F.first("cls").alias("cls"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))


def _ordered(batch: pa.RecordBatch, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sets, each set's rarest by the table of counts first, and their offsets."""
    flat, offs = _unpacked(batch.column(batch.schema.get_field_index("tokens")))
    row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
    return flat[np.lexsort((cells[(flat % np.uint64(CELLS)).astype(np.int64)], row))], offs  # stable: then by hash


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How many tokens fall into each of CELLS cells; one vector a task, added in two levels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            flat, _ = _unpacked(batch.column(0))
            total += np.bincount((flat % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        if total.any():
            yield pa.RecordBatch.from_arrays([_binary([total])], names=["v"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for blob in table["v"]:
            total += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table({"v": _binary([total])})

    parts = sets.select("tokens").mapInArrow(trimmed(count), "v binary")
    groups = max(1, math.isqrt(sets.rdd.getNumPartitions()))
    rows = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups))).applyInArrow(add, "v binary").toLocalIterator()
    return sum((np.frombuffer(r["v"], np.int64) for r in rows), np.zeros(CELLS, np.int64))


def grouped(sets: DataFrame, threshold: float, cells) -> DataFrame:
    """The sets with their group; a group is in one partition.  ``cells`` is the broadcast table of counts."""

    @trimmed
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offs = _ordered(batch, cells.value)
            best = flat[offs[1:] - 1].view(np.int64)
            second = flat[np.maximum(offs[1:] - 2, 0)].view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(second, mask=np.diff(offs) < 2)], names=[*batch.schema.names, "top", "second"])

    kinds = "fp binary, cls long, size long, tokens binary, top long, second long"
    tops = sets.select("fp", "cls", "size", "tokens").mapInArrow(top, kinds)
    slim = checkpointed(tops.select("size", "top", "second"))
    own = slim.groupBy("top").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # a top whose classes are no more than those that have it second joins the group of their top: these are
    # members of one family, some of which lack its most frequent token; tops rise in frequency, so there are no rings
    both = slim.where("second IS NOT NULL").groupBy(F.col("top").alias("root"), F.col("second").alias("top")).agg(F.count("*").alias("both"))
    up = checkpointed(both.join(own, "top").where("both >= n").groupBy("top").agg(F.max_by("root", F.struct("both", "root")).alias("root")))
    for _ in range(2):  # four steps up
        higher = up.select(F.col("top").alias("root"), F.col("root").alias("higher"))
        up = up.join(higher, "root", "left").select("top", F.coalesce("higher", "root").alias("root"))
    rooted = checkpointed(own.join(up, "top", "left").select("top", F.coalesce("root", "top").alias("root"), "size"))
    parts = rooted.groupBy("root").agg(F.ceil(F.sum("size") / PART).cast("long").alias("parts"))
    moved = checkpointed(rooted.join(parts, "root").where("root <> top OR parts > 1").select("top", "root", "parts"))
    known = F.broadcast(moved) if moved.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else moved
    part = F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1).cast("long")))
    group = F.xxhash64(F.coalesce("root", "top"), part)
    return tops.join(known, "top", "left").select("fp", "cls", "size", "tokens", group.alias("group")).repartition("group")


def opened(sets: DataFrame, threshold: float, cells) -> DataFrame:
    """(group, cls) of the queries that meet enough tokens of a group's union, and of all members of a group
    that has several."""

    @trimmed
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = _ordered(batch, cells.value)
            lens = prefix_size(np.diff(offs), threshold)
            ends = np.concatenate([[0], np.cumsum(lens)])
            flat = flat[np.repeat(offs[:-1] - ends[:-1], lens) + np.arange(ends[-1])]
            row = pa.array(np.repeat(np.arange(batch.num_rows), lens))
            need = np.repeat(least_met(batch.column(2).to_numpy(), threshold), lens)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(need.astype(np.int32)), pa.array(flat.view(np.int64))], names=["cls", "home", "need", "token"])

    @trimmed
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            one = np.concatenate(held)
            held.clear()
            one = one[np.lexsort((one[:, 1], one[:, 0]))]
            one = one[np.concatenate([[True], (one[1:] != one[:-1]).any(1)])]
            return pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1])], names=["group", "token"])

        for batch in batches:
            held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if sum(map(len, held)) >= FLUSH:
                yield rows()
        if held:
            yield rows()

    asks = sets.select("cls", "group", "size", "tokens").mapInArrow(prefix, "cls long, home long, need int, token long")
    # a group's members are in one partition: what is distinct there is distinct but for what was flushed in
    # between, which can only open more groups
    matrix = asks.select("home", "token").mapInArrow(distinct, "group long, token long")
    met = asks.join(matrix, "token").where(F.col("group") != F.col("home"))
    met = met.groupBy("cls", "group").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("group", "cls")
    many = sets.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    return met.unionByName(sets.select("group", "cls").join(many, "group").select("group", "cls"))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the given ones connect, without cycles."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n): a spanning forest of the similar classes by edges (a, b), n null; and of every class a
    with links their number in a block, b null."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    wanted = checkpointed(survivors(texts, threshold))
    sets = checkpointed(token_table(texts, wanted))
    cells = docs.sparkSession.sparkContext.broadcast(cell_counts(sets))
    sets = checkpointed(grouped(sets, threshold, cells))
    asking = checkpointed(opened(sets, threshold, cells))
    sizes = sets.select("cls", "size")
    n = asking.join(sizes, "cls").groupBy("group").agg(F.ceil(F.sum("size") / PART).cast("long").alias("n"))
    q = asking.join(n, "group").select("group", F.pmod(F.xxhash64("cls"), F.col("n")).alias("block"), "cls", F.lit(True).alias("query"), F.lit(False).alias("member"))
    m = sets.select("group", "cls").join(n, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"), "cls", F.lit(False).alias("query"), F.lit(True).alias("member"))

    def verify(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy()
        names = table["fp"].to_pylist()
        flat, offs = _unpacked(table["tokens"])
        sizes = np.diff(offs)
        members = np.flatnonzero(table["member"].to_numpy())
        mine, ends = _gathered(flat, offs, members)
        order = np.argsort(mine, kind="stable")
        mine, owner = mine[order], np.repeat(np.arange(len(members)), np.diff(ends))[order]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        union, stop = mine[first], np.append(first[1:], len(mine))
        a, b, found = [], [], []
        for k in np.flatnonzero(query).tolist():
            tokens = flat[offs[k] : offs[k + 1]]
            at = np.searchsorted(union, tokens)
            at[at == len(union)] = 0
            at = at[union[at] == tokens] if len(union) else at[:0]
            if len(at) < least_shared(sizes[k], threshold):
                continue
            lens = stop[at] - first[at]
            hits = owner[np.repeat(first[at] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
            both = np.bincount(hits, minlength=len(members))
            near = np.flatnonzero(both / (sizes[members] + sizes[k] - both) >= threshold)
            near = members[near]
            near = near[near != k]
            if len(near):
                found.append((names[k], len(near)))
                a.append(np.full(len(near), k)), b.append(near)
        edges = _forest(np.concatenate(a), np.concatenate(b), len(names)) if a else []
        x = [min(names[i], names[j]) for i, j in edges] + [f for f, _ in found]
        y = [max(names[i], names[j]) for i, j in edges] + [None] * len(found)
        return pa.table({"a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary()), "n": pa.array([None] * len(edges) + [c for _, c in found], pa.int64())})

    # a class that asks the group of which it is a member travels there once
    met = q.unionByName(m).groupBy("group", "block", "cls").agg(F.max("query").alias("query"), F.max("member").alias("member"))
    met = met.join(sets.select("cls", "fp", "tokens"), "cls")
    return met.groupBy("group", "block").applyInArrow(trimmed(verify), "a binary, b binary, n long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b) edges, by alternating large and small stars;
    a root is its component's least node and is not listed itself."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("b", "a"))
            low = e.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
            out = e.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")
        else:  # a < b in every edge: each node's smaller neighbours are joined to the least of them
            low = e.groupBy("b").agg(F.min("a").alias("m"))
            met = e.join(low, "b")
            out = met.where("a > m").select(F.col("m").alias("x"), F.col("a").alias("y")).union(met.select("m", "b")).toDF("a", "b")
        return out.where("a < b").distinct()

    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = checkpointed(edges.select("a", "b").distinct())
    before = state(edges)
    while True:
        edges = checkpointed(star(star(edges, True), False))
        after = state(edges)
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links), see above."""
    signed = checkpointed(signatures(docs))
    found = checkpointed(links(docs, threshold))
    roots = checkpointed(components(found.where("b IS NOT NULL")))
    classes = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("least"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_links"))
    members = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    best = members.join(classes, "fp").groupBy("root").agg(F.min("least").alias("class_id"))
    info = classes.join(counts, "fp", "left").join(members, "fp", "left").join(best, "root", "left")
    info = info.select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), (F.col("n_docs") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    info = info.where("n_copies > 0 OR n_links > 0")  # the rest are alone
    alone = F.lit(0).cast("long")
    out = signed.join(info.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left")
    return out.select("doc_id", F.when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", alone).alias("n_copies"), F.coalesce("n_links", alone).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those that are copies: of each connected group of similar documents the
    one of least id (null ids last, then by content) stays."""
    columns = docs.columns
    signed = checkpointed(signatures(docs).where("fp IS NOT NULL"))
    roots = checkpointed(components(links(docs, threshold).where("b IS NOT NULL")))
    members = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    repeated = signed.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    # classes in groups, and classes of several documents that are groups of their own
    grouped = repeated.join(members, "fp", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp"))
    best = grouped.groupBy("root").agg(F.min_by(F.struct("fp", "first"), F.struct(F.col("first").isNull(), "first", "fp")).alias("w"))
    listed = checkpointed(grouped.join(best, "root").select(F.col("fp").alias("__fp"), (F.col("fp") == F.col("w.fp")).alias("__wins"), F.col("w.first").alias("__first")))

    @F.pandas_udf("binary")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            out: list[bytes | None] = []
            for tokens, offs in token_sets(as_string_array(pa.array(text, pa.string(), from_pandas=True))):
                out += _binary(fingerprints(tokens, offs), np.diff(offs) > 0).to_pylist()
            yield pd.Series(out, dtype=object)
        release()

    # the row travels as one struct, so that its columns may have any names
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), fp(F.col("text").cast("string")).alias("own"))
    known = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
    d = d.join(known, d["own"] == known["__fp"], "left")
    d = d.where(F.col("__fp").isNull() | (F.col("__wins") & F.col("id").eqNullSafe(F.col("__first"))))
    # a winner whose row repeats, id and all
    twice = signed.groupBy("fp", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.join(listed.where("__wins"), (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    twice = checkpointed(twice.select(F.col("fp").alias("__twice")))
    if twice.isEmpty():
        return d.select("row.*")
    d = d.join(twice, F.col("own") == F.col("__twice"), "left")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.xxhash64(*[F.col(f"row.`{c}`") for c in columns])))
    once = d.where("__twice IS NULL").select("row.*")
    return once.union(d.where("__twice IS NOT NULL").withColumn("__rank", rank).where("__rank = 1").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TOKENS = f"""
    words AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS w FROM documents),
    grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i : i + {N} - 1], ' '))) END AS g FROM words),
    signed AS (SELECT doc_id, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), '|')) END AS fp, g FROM grams),
    classes AS (SELECT fp, min(doc_id) AS least, count(*) - 1 AS n_copies, any_value(g) AS g FROM signed WHERE fp IS NOT NULL GROUP BY fp),
    tokens AS (SELECT fp, len(g) AS size, unnest(g) AS token FROM classes)"""
SQL = f"""
WITH RECURSIVE {_TOKENS},
    pairs AS (SELECT x.fp AS a, y.fp AS b FROM tokens x JOIN tokens y ON x.token = y.token AND x.fp <> y.fp
        GROUP BY x.fp, y.fp, x.size, y.size HAVING count(*) / (x.size + y.size - count(*)) >= {THRESHOLD}),
    reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    best AS (SELECT reach.a AS fp, min(least) AS class_id FROM reach JOIN classes ON reach.b = classes.fp GROUP BY reach.a),
    counts AS (SELECT a AS fp, count(*) AS n_links FROM pairs GROUP BY a)
SELECT doc_id, coalesce(best.class_id, classes.least, doc_id) AS class_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links
FROM signed LEFT JOIN classes USING (fp) LEFT JOIN best USING (fp) LEFT JOIN counts USING (fp)
"""
