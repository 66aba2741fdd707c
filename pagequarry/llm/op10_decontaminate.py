"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of ``2 * BLOCK`` words, one beginning every ``BLOCK`` words, over whole documents.
   Terms are words; only those of the benchmark are columns of the matrix, as no other can bring a passage
   nearer to an item.  A term's document frequency counts all passages of the corpus.
2. A distributed randomised SVD of the TF-IDF matrix A, whose rows are all passages of the corpus, and the
   items, weighted so that they hold as much of the matrix as the corpus does: every task adds its passages'
   share of ``A'(A W)`` for a random W of ``RANK + OVERSAMPLE`` columns, in one pass.  From this sum and W the
   Nystrom formula gives the leading right singular vectors; ``RANK`` of them are the latent space.
3. Passages and items are projected.  The cosine of a passage a and an item b is estimated by ``<Pa, Pb> |b| /
   (|Pb|^2 |a|)`` with whole norms of both, so an item of which the space holds little is compared by what it
   does hold; pairs of at least ``COSINE`` are candidates (every passage meets every item in one matrix product,
   in blocks).  Items of which less than ``FLOOR`` is held are searched again in a space fitted to them.
4. A candidate is confirmed by its longest common subsequence with the item, over the passage and ``BLOCK``
   words on either side, without common words (an item with fewer than ``FEW`` others keeps them): at least
   ``LCS`` of the item; or, for a paraphrase, at least ``LCS_LOOSE`` of it with ``ANSWER`` of its answer (its
   last sentence, or its last words if that is shorter than ``FEW``).

The basis (terms of the benchmark x RANK) is what is sent to every task: the benchmark is fixed while the
corpus grows.  Its size is checked: one of over ``MAX_TERMS`` different words is refused, not cut.

Defined results: null and empty texts match nothing; very long texts are searched whole; items without words are ignored; null ids are matched
and reported as null; repeated documents and items are each reported; an item or document in several
places is reported once a pair, with its best place; ties go to the earliest; empty tables give an empty
result.  Other columns are ignored, whatever their names.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._shared import release, small_batches, trimmed
from pagequarry.llm._text import as_string_array, chunks, word_hashes

BLOCK = 32
RANK = 96
COSINE = 0.3
LCS = 0.5
LCS_LOOSE = 0.35
ANSWER = 0.6
MAX_DF = 0.05
PRIOR = 1000  # passages without any term, added to those of the corpus
FEW = 4
OVERSAMPLE = 16
FLOOR = 0.2
ITEM_BLOCK = 4096
MAX_TERMS = 500_000


@dataclass
class Benchmark:
    ids: list
    words: list[np.ndarray]  # term numbers of each item, in order
    answers: list[np.ndarray]  # the part of them that is the answer
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None  # (terms, RANK) times idf, then the squares of idf
    latent: np.ndarray | None = None  # (items, RANK): Pb |b| / |Pb|^2

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 where a word is no term."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1)


def _answer_start(text: str) -> int:
    """Where an item's answer, its last sentence, begins; 0 if it has one sentence only."""
    body = text.rstrip().rstrip(".?!")
    return max(body.rfind(x) + len(x) for x in (". ", "? ", "! ", ".\n", "?\n", "!\n", "\n")) if any(x in body for x in (". ", "? ", "! ", "\n")) else 0


def read_benchmark(rows: list[tuple]) -> Benchmark:
    """From (id, text) rows."""
    rows = [(i, t) for i, t in rows if t]
    hashes, offs = word_hashes(pa.array([t for _, t in rows], pa.string()))
    heads, hoffs = word_hashes(pa.array([t[: _answer_start(t)] for _, t in rows], pa.string()))
    terms = np.unique(hashes)
    out = Benchmark([], [], [], terms)
    for k, (item, _) in enumerate(rows):
        own = out.numbers(hashes[offs[k] : offs[k + 1]])
        if len(own):
            out.ids.append(item)
            out.words.append(own)
            out.answers.append(own[hoffs[k + 1] - hoffs[k] :])
    return out


def _blocks(part: pa.Array, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: term numbers of all words, first word of each text, each word's block, and
    the first block of each text."""
    words, offs = word_hashes(part)
    counts = np.diff(offs)
    blocks = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(len(words)) - np.repeat(offs[:-1], counts)
    return bench.numbers(words), offs, np.repeat(first[:-1], counts) + place // BLOCK, first


def _windows(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Window sums from block sums: each block with the next one of its text."""
    out = sums.copy()
    if len(sums) > 1:
        last = np.zeros(len(sums), bool)
        ends = first[1:][np.diff(first) > 0]
        last[ends - 1] = True
        out[:-1] += np.where(last[:-1].reshape(-1, *[1] * (sums.ndim - 1)), 0, sums[1:])
    return out


def _project(terms: np.ndarray, block: np.ndarray, n_blocks: int, first: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """(windows, dims): sums of the weighted rows of each window's terms."""
    out = np.zeros((n_blocks, weighted.shape[1]), np.float32)
    if len(terms):
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        out[block[starts]] = np.add.reduceat(weighted[terms], starts, axis=0)
    return _windows(out, first)


def frequencies(texts: DataFrame, bench: Benchmark) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""
    n_terms = len(bench.terms)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for _, _, part in chunks(as_string_array(batch.column(0))):
                terms, _, block, first = _blocks(part, bench)
                passages += int(first[-1])
                hit = terms >= 0
                # a window is a block and its next: a term counts in its block and the one before, once each
                pairs = np.unique(block[hit].astype(np.int64) * n_terms + terms[hit])
                b, t = pairs // n_terms, pairs % n_terms
                starts = np.zeros(int(first[-1]) + 1, bool)
                starts[first[:-1][np.diff(first) > 0]] = True
                back = pairs[~starts[b]] - n_terms
                both = np.isin(back, pairs, assume_unique=True)
                total += np.bincount(t, minlength=n_terms) + np.bincount(back[~both] % n_terms, minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], passages))], names=["term", "n"])

    rows = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, passages = np.zeros(n_terms, np.int64), 0
    for t, n in zip(rows["term"].to_pylist(), rows["n"].to_pylist()):
        if t < 0:
            passages = n
        else:
            df[t] = n
    return df, passages


def range_sketch(texts: DataFrame, bench: Benchmark, weights: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'(A W) over all passages; ``weights`` are the terms' IDF, W is ``test``, (terms, columns)."""
    rank = test.shape[1]
    weighted = (weights[:, None] * test).astype(np.float32)
    used = weights > 0

    @trimmed
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros_like(weighted, dtype=np.float64), False
        for batch in batches:
            for _, _, part in chunks(as_string_array(batch.column(0))):
                terms, _, block, first = _blocks(part, bench)
                hit = (terms >= 0) & used[terms]  # -1 reads the last term, which the first half undoes
                terms, block = terms[hit], block[hit]
                if not len(terms):
                    continue
                seen = True
                y = _project(terms, block, int(first[-1]), first, weighted)
                # a term belongs to the window of its block and to the one before
                before = np.zeros(len(y), bool)
                before[first[:-1][np.diff(first) > 0]] = True
                both = y.copy()
                both[1:] += np.where(before[1:, None], 0, y[:-1])
                order = np.argsort(terms, kind="stable")
                t = terms[order]
                starts = np.flatnonzero(np.diff(t, prepend=-1))
                total[t[starts]] += np.add.reduceat(both[block[order]], starts, axis=0)
        if seen:
            rows = np.flatnonzero(np.any(total != 0, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(total[rows]), pa.list_(pa.float64()))], names=["term", "v"])

    def add(table: pa.Table) -> pa.Table:
        terms, back = np.unique(table["term"].to_numpy(), return_inverse=True)
        total = np.zeros((len(terms), rank))
        np.add.at(total, back, np.array(table["v"].combine_chunks().flatten()).reshape(-1, rank))
        return pa.table({"term": pa.array(terms), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = texts.mapInArrow(sketch, "term long, v array<double>")
    out = np.zeros((len(weights), rank))
    rows = parts.groupBy(F.pmod("term", F.lit(32))).applyInArrow(add, "term long, v array<double>").toArrow()
    if rows.num_rows:
        out[rows["term"].to_numpy()] = np.array(rows["v"].combine_chunks().flatten()).reshape(-1, rank)
    return out * weights[:, None]


def _item_weights(bench: Benchmark, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The items' TF-IDF rows of unit length: item, term, value of each entry; and the whole norms."""
    pairs = [np.unique(w, return_counts=True) for w in bench.words]
    item = np.repeat(np.arange(len(pairs)), [len(t) for t, _ in pairs])
    term = np.concatenate([t for t, _ in pairs])
    value = np.concatenate([n for _, n in pairs]) * idf[term]
    norm = np.sqrt(np.bincount(item, value**2, len(pairs)))
    return item, term, value / np.maximum(norm, 1e-12)[item], norm


def _times(item: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, right: np.ndarray) -> np.ndarray:
    """The items' rows times (terms, columns)."""
    out = np.zeros((n, right.shape[1]))
    for at in range(0, len(item), 1 << 14):
        np.add.at(out, item[at : at + (1 << 14)], value[at : at + (1 << 14), None] * right[term[at : at + (1 << 14)]])
    return out


def singular_vectors(sketch: np.ndarray, test: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and values of A, from ``A'(A test)``: Nystrom's formula for A'A, shifted
    for stability, then the SVD of its factor."""
    shift = 1e-7 * max(1e-12, float(np.linalg.norm(sketch)))
    moved = sketch + shift * test
    core = test.T @ moved
    d, v = np.linalg.eigh((core + core.T) / 2)
    ok = d > 1e-6 * max(1e-300, d.max(initial=0))  # the sketch is summed from single precision
    u, s, _ = np.linalg.svd(moved @ (v[:, ok] / np.sqrt(d[ok])), full_matrices=False)
    s = np.sqrt(np.maximum(s**2 - shift, 0))
    held = (s > 1e-3 * max(1e-12, s.max(initial=0)))[:rank]
    return u[:, :rank][:, held], s[:rank][held]


def fit(docs: DataFrame, bench: Benchmark, rank: int = RANK) -> list[Benchmark]:
    """IDF over the whole corpus, latent basis and the items' projections; a further benchmark of items that
    the space does not hold, and so on."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    df, passages = frequencies(texts, bench)
    idf = np.maximum(np.log((passages + 1) / (df + 0.5)), 0.05)
    common = df > MAX_DF * (passages + PRIOR)
    needed = [w for w in bench.words if (~common[w]).sum() < FEW]  # items that have little else keep their common words
    if needed:
        common[np.concatenate(needed)] = False
    idf[common] = 0
    test = np.random.default_rng(10).standard_normal((len(idf), min(rank + OVERSAMPLE, len(idf))))
    corpus = range_sketch(texts, bench, idf, test)
    return _fitted(bench, idf, test, corpus, rank)


def _fitted(bench: Benchmark, idf: np.ndarray, test: np.ndarray, corpus: np.ndarray, rank: int) -> list[Benchmark]:
    n = len(bench.ids)
    item, term, value, norm = _item_weights(bench, idf)
    weight = max(float((test * corpus).sum()) / test.shape[1], 1.0) / n  # the trace of A'A, over the items
    own = np.zeros_like(corpus)
    seen = _times(item, term, value, n, test)
    for at in range(0, len(item), 1 << 14):
        np.add.at(own, term[at : at + (1 << 14)], value[at : at + (1 << 14), None] * seen[item[at : at + (1 << 14)]])
    basis, _ = singular_vectors(corpus + weight * own, test, rank)
    latent = _times(item, term, value, n, basis)  # of the items at unit length
    held = np.linalg.norm(latent, axis=1)
    there = held >= FLOOR
    if not there.any() and n > 1:  # no space of this rank holds so many: halves
        there[: n // 2] = True
        first, second = _part(bench, there), _part(bench, ~there)
        return _fitted(first, idf, test, corpus, rank) + _fitted(second, idf, test, corpus, rank)
    there |= n == 1
    out = _part(bench, there)
    out.idf, out.basis = idf, np.column_stack([basis * idf[:, None], idf**2]).astype(np.float32)
    out.latent = (latent[there] / np.maximum(held[there, None], 1e-6) ** 2).astype(np.float32)
    return [out] + ([] if there.all() else _fitted(_part(bench, ~there), idf, test, corpus, rank))


def _part(bench: Benchmark, rows: np.ndarray) -> Benchmark:
    at = np.flatnonzero(rows).tolist()
    return Benchmark([bench.ids[k] for k in at], [bench.words[k] for k in at], [bench.answers[k] for k in at], bench.terms)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Bit-parallel longest common subsequence."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Searcher:
    """Candidates and confirmations for slices of texts."""

    def __init__(self, bench: Benchmark, cosine: float = COSINE):
        self.bench, self.cosine = bench, cosine
        self.used = bench.idf > 0
        rare = [w[self.used[w]] for w in bench.words]
        self.rare = [len(r) >= FEW for r in rare]
        self.lists = [(r if ok else w).tolist() for r, ok, w in zip(rare, self.rare, bench.words)]
        self.reach = [max(0, len(w) - 2 * BLOCK) for w in bench.words]
        answers = [a[self.used[a]] if ok else a for a, ok in zip(bench.answers, self.rare)]
        self.answers = [(a.tolist() if len(a) >= FEW else own[-2 * FEW :]) for a, own in zip(answers, self.lists)]

    def search(self, part: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, first word, cosine, LCS share, answer share) of every confirmed pair."""
        b = self.bench
        terms, offs, block, first = _blocks(part, b)
        held = terms >= 0
        hit = held & self.used[terms]
        if not len(b.ids) or not hit.any():
            return []
        n = int(first[-1])
        y = _project(terms[hit], block[hit], n, first, b.basis)
        # the norm is that of the whole passage, not only of its latent part
        live = np.flatnonzero(y[:, -1] > 0)
        if not len(live):
            return []
        scaled = y[live, :-1] / np.sqrt(y[live, -1:])
        w, item, cos = [], [], []
        for at in range(0, len(b.ids), ITEM_BLOCK):
            part = scaled @ b.latent[at : at + ITEM_BLOCK].T
            r, c = np.nonzero(part >= self.cosine)
            w.append(r), item.append(c + at), cos.append(np.minimum(part[r, c], 1.0))
        w, item, cos = np.concatenate(w), np.concatenate(item), np.concatenate(cos)
        text_of = np.searchsorted(first, live[w], side="right") - 1
        best: dict[tuple[int, int], tuple[float, float, int, float]] = {}
        for k, (p, i, t) in enumerate(zip(live[w].tolist(), item.tolist(), text_of.tolist())):
            start = int(offs[t]) + (p - int(first[t])) * BLOCK
            lo, hi = max(int(offs[t]), start - BLOCK), min(int(offs[t + 1]), start + 3 * BLOCK)
            # longer items reach further
            lo, hi = max(int(offs[t]), lo - self.reach[i]), min(int(offs[t + 1]), hi + self.reach[i])
            seen = terms[lo:hi]
            seen = seen[(hit if self.rare[i] else held)[lo:hi]].tolist()
            share = lcs_length(self.lists[i], seen) / len(self.lists[i])
            if share < LCS_LOOSE:
                continue
            answer = self.answers[i]
            found = lcs_length(answer, seen) / len(answer) if answer else 0.0
            if share >= LCS or found >= ANSWER:
                old = best.get((t, i))
                if old is None or share > old[0]:
                    best[(t, i)] = (share, found, start - int(offs[t]), float(cos[k]))
        return [(t, i, place, c, share, found) for (t, i), (share, found, place, c) in best.items()]


def _benchmark(items: DataFrame) -> Benchmark:
    """The whole benchmark, which must fit on the driver."""
    rows = _item_rows(items).where("text IS NOT NULL")
    n = rows.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).agg(F.approx_count_distinct("w")).first()[0]
    if n > MAX_TERMS:
        raise ValueError(f"the benchmark has about {n} different words, more than {MAX_TERMS}: search it in parts")
    return read_benchmark([(r[0], r[1]) for r in rows.collect()])


def _item_rows(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text")


def find_contamination(docs: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, first_word, cosine, lcs, answer) of every document and item of which it holds a
    passage or a paraphrase."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = slim.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, cosine double, lcs double, answer double"
    out = None
    whole = _benchmark(items)
    for bench in fit(docs, whole) if whole.ids else []:

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(bench, cosine)
            for batch in batches:
                found = [(at + t, *rest) for at, _, part in chunks(as_string_array(batch.column(1))) for t, *rest in searcher.search(part)]
                t, i, place, cos, share, answer = zip(*found) if found else [()] * 6
                cells = [batch.column(0).take(pa.array(t, pa.int64())), pa.array([bench.ids[k] for k in i], pa.int64() if kinds[1] == "bigint" else None)]
                cells += [pa.array(place, pa.int64()), *(pa.array(x, pa.float64()) for x in (cos, share, answer))]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "item_id", "first_word", "cosine", "lcs", "answer"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` without a confirmed passage, with all their columns; decided row by row."""
    whole = _benchmark(items)
    out = docs
    for bench in fit(docs, whole) if whole.ids else []:
        out = out.where(_clean(bench, cosine)(F.col("text").cast("string")))
    return out


def _clean(bench: Benchmark, cosine: float):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(bench, cosine)
        for text in texts:
            ok = np.ones(len(text), bool)
            for at, _, part in chunks(as_string_array(pa.array(text, pa.string(), from_pandas=True))):
                for t, *_ in searcher.search(part):
                    ok[at + t] = False
            yield pd.Series(ok)
        release()

    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = None
