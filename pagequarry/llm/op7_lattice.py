"""Language-model scoring by subword lattices.

The vocabulary is that of an existing public tokenizer; its pieces are never changed.  Its file holds
merge ranks in place of probabilities, so the unigram scores are counted here: all words of all
documents are counted, each distinct word is cut by the tokenizer once, and a piece's score is the log
of its smoothed share of all pieces.  A document's score is the log of the sum, over every segmentation
of every word into pieces, of the product of the pieces' probabilities: the forward recursion runs over
each word's lattice in log space, and the words' marginals are added.

Words are what white space separates, with the tokenizer's word mark in front.  Characters that are no
piece are spelled by byte pieces; that arc is always there, so every word has a segmentation.

At scale: the only things shuffled are (word, count) pairs, combined in each task first; the scores are
one number for each piece of the vocabulary, whatever the corpus.  Each task keeps the marginals of the
words that it has met, and drops them when there are too many, so memory is bounded.  The words that a
stretch of texts adds are scored together: words of about one length are the columns of a matrix, through
which the pieces' trie and the recursion go a character at a time in numpy.

Defined results: a null text has null scores; a text without words has 0 words, score 0 and null
``bits_per_char``; one very long word is scored whole; repeated rows count and are scored repeatedly;
an empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._shared import checkpointed, spread
from pagequarry.llm._tokens import DEFAULT_PIECES, pieces

SMOOTHING = 0.5
FLUSH_WORDS = 300_000
STRETCH = 1 << 20  # characters of texts whose new words are scored together
CELLS = 1 << 14  # characters of a matrix of words
MIN_COLUMNS = 12  # fewer words, or longer ones, are scored one by one
MAX_ROWS = 256
MARK = "▁"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(text.as_py().split())
                    if len(held) > FLUSH_WORDS:
                        yield rows()
        yield rows()

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, model: str = DEFAULT_PIECES) -> DataFrame:
    """(piece, n): how often the tokenizer's own segmentation of the counted words uses each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in range(0, len(names), 20_000):
                ids = sp.encode(names[at : at + 20_000], num_threads=1)
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for own in ids for i in own), np.int64, int(lens.sum()))
                np.add.at(total, flat, np.repeat(n[at : at + 20_000], lens))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    return words.mapInArrow(cut, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log-space forward recursion over all segmentations of a word."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float]):
        self.scores = scores
        self.byte_scores = byte_scores
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        # the trie of the pieces for numpy: (node, character) -> node in an open hash table; node 0 is the root
        nodes = {p: k for k, p in enumerate(sorted(self.prefixes, key=len), 1)} | {"": 0}
        chars = sorted({p[-1] for p in self.prefixes})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece, or beyond a word's end
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = np.int64(len(chars) + 1)
        self.score = np.array([-np.inf, *(scores.get(p, -np.inf) for p in nodes if p)])
        self.depth = max(map(len, scores), default=1)
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        last = self.code[np.array([ord(p[-1]) for p in nodes if p], np.int64)]
        keys = np.array([nodes[p[:-1]] for p in nodes if p], np.int64) * self.width + last
        ids, at = np.arange(1, len(nodes)), self._slot(keys)
        while len(ids):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys  # of several for one slot, the last is in it
            self.nodes[at[mine]] = ids[mine]
            keys, ids, at = keys[~mine], ids[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def _step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to; 0 for none."""
        keys = nodes * self.width + codes
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.nodes[at], 0)
        (open_,) = np.nonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def spelled(self, char: str) -> float:
        return sum(self.byte_scores[b] for b in char.encode("utf-8", "surrogatepass"))

    def log_marginal(self, word: str) -> float:
        n = len(word)
        scores, prefixes, exp, log = self.scores, self.prefixes, math.exp, math.log
        arcs: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = 0.0
        for i in range(n):
            if i:
                terms = arcs[i]
                if len(terms) == 1:
                    alpha = terms[0]
                elif not terms:
                    continue
                else:
                    top = max(terms)
                    alpha = top + log(sum([exp(t - top) for t in terms]))
            j = i + 1
            part = word[i:j]
            # bytes spell a character that is no piece of its own
            s = scores.get(part)
            arcs[j].append(alpha + (self.spelled(part) if s is None else s))
            while part in prefixes and j < n:
                j += 1
                part = word[i:j]
                s = scores.get(part)
                if s is not None:
                    arcs[j].append(alpha + s)
        terms = arcs[n]
        top = max(terms)
        return top + log(sum([exp(t - top) for t in terms]))

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """The same for many words, none of them empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.empty(len(words))
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            rows = int(sizes[order[at]])
            own = order[at : at + max(1, CELLS // (rows + 1))]
            if rows > MAX_ROWS or len(own) < MIN_COLUMNS:
                out[own] = [self.log_marginal(words[k]) for k in own]
            else:
                out[own] = self._columns([words[k] for k in own], sizes[own])
            at += len(own)
        return out

    def _columns(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """The same for words of falling length, as columns of a matrix."""
        n, rows = len(words), int(sizes[0])
        points = np.array(words, f"<U{rows}").view(np.uint32).reshape(n, rows).T
        inside = np.arange(rows)[:, None] < sizes
        codes = np.zeros((rows + self.depth, n), np.int64)
        codes[:rows] = np.where(inside, self.code[points], 0)
        flat = codes.ravel()
        # arcs[d - 1]: scores of the arcs of d characters by the row and column of their end
        arcs = np.full((self.depth, rows + 1, n), -np.inf)
        starts = np.flatnonzero(inside)
        nodes = np.zeros(len(starts), np.int64)
        deepest = 1
        for d in range(1, self.depth + 1):
            nodes = self._step(nodes, flat[starts + (d - 1) * n])
            scores = self.score[nodes]
            if d == 1:
                (bare,) = np.nonzero(scores == -np.inf)  # bytes spell a character that is no piece of its own
                each, which = np.unique(points.ravel()[starts[bare]] if len(bare) else np.zeros(0, np.uint32), return_inverse=True)
                scores[bare] = np.array([self.spelled(chr(c)) for c in each])[which] if len(bare) else 0
            some = scores > -np.inf
            if some.any():
                deepest = d
                arcs[d - 1].ravel()[starts[some] + d * n] = scores[some]
            on = nodes > 0
            starts, nodes = starts[on], nodes[on]
            if not len(starts):
                break
        alpha = np.zeros((rows + 1, n))
        for j in range(1, rows + 1):
            here = int(np.searchsorted(-sizes, -j, side="right"))  # words of j characters and more
            d = min(j, deepest)
            terms = alpha[j - d : j, :here][::-1] + arcs[:d, j, :here]
            top = terms.max(0)
            terms -= top
            alpha[j, :here] = top + np.log(np.exp(terms, out=terms).sum(0))
        return alpha[sizes, np.arange(n)]


def lattice_of(counts: dict[int, int], model: str = DEFAULT_PIECES, smoothing: float = SMOOTHING) -> Lattice:
    """The lattice over a model's pieces with scores from their counts."""
    sp = pieces(model)
    size = sp.get_piece_size()
    usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = sum(counts.values()) + smoothing * len(usable)
    score = {i: math.log((counts.get(i, 0) + smoothing) / total) for i in usable}
    byte_scores = [score[sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
    return Lattice({sp.id_to_piece(i): s for i, s in score.items() if not sp.is_byte(i)}, byte_scores)


def stretches(column: pa.Array, least: int = STRETCH) -> Iterator[list[str | None]]:
    """All texts in order, in lists of ``least`` characters and what their last text has beyond."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def score_documents(docs: DataFrame, model: str = DEFAULT_PIECES, smoothing: float = SMOOTHING) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_char): natural log of the marginal probability, and its bits
    by character that is not white space."""
    words = checkpointed(spread(word_counts(docs), "word"))
    counts = {r["piece"]: r["n"] for r in piece_counts(words, model).collect()}  # at most one row a piece
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(counts, model, smoothing)
        known: dict[str, float] = {}
        for batch in batches:
            n_words, logs, bits = [], [], []
            for texts in stretches(batch.column(1)):
                if len(known) > FLUSH_WORDS:
                    known.clear()
                split = [None if text is None else text.split() for text in texts]
                new = list({w for own in split if own for w in own}.difference(known))
                known.update(zip(new, lattice.log_marginals([MARK + w for w in new]).tolist()))
                for own in split:
                    if own is None:
                        n_words.append(None), logs.append(None), bits.append(None)
                        continue
                    total = math.fsum(map(known.__getitem__, own))
                    chars = sum(map(len, own))
                    n_words.append(len(own)), logs.append(total), bits.append(-total / math.log(2) / chars if chars else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(logs, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "n_words", "log_prob", "bits_per_char"])

    return slim.mapInArrow(score, f"doc_id {kind}, n_words long, log_prob double, bits_per_char double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
