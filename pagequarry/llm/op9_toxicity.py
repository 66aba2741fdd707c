"""Toxicity through a noisy channel.

A text may hide its words behind digits and symbols (``l0$er``), spacing (``s t u p i d``) or repetition
(``stuuupid``), also combined (``l 0 $ e r``), without any letter (``$#!7``), or in two pieces (``stu pid``).  Suspicious tokens and runs of single letters, digits and
symbols, with any white space and separators between them, become a lattice: every observed
character emits itself, the letters that it can stand for, or nothing (a separator, or the repetition of
the character before it), each at a cost.  Viterbi decoding under a character trigram model finds the
likeliest string, and the restored words are scored with all other words of the text.  Neighbouring tokens
that join to a lexicon word of ``MIN_SPLIT`` letters count as it, unless clean labelled documents hold both of
them as words.

* The character model counts every text of the corpus; its alphabet is fixed (``ALPHABET`` letters), so
  the counts that are collected are bounded whatever the input.
* Weights of words and of word beginnings (``STEMS`` letters, for inflected words) are log odds from
  labelled documents: at most ``MAX_LABELS`` of them, those of lowest hash, so that labels and lexicon stay
  small enough to send to every task.  The evidence is the number of different neighbourhoods in which
  toxic documents hold the word, so that copies of one document do not turn its words toxic; it must have
  ``MIN_CONTEXTS`` of them and be ``PURITY`` toxic (``STEM_PURITY`` for a beginning).  A word weighs what the heaviest of its entries does.
* The decoder's character model mixes the corpus with the lexicon, as who hides a word has one to hide.
* A document's score adds the prior and the weights of its distinct lexicon words; it is toxic where the
  probability reaches ``CUTOFF``.  Each task remembers the tokens that it has judged.

Defined results: very long texts are judged whole; of equally likely decodings the first met counts; a null text scores as an empty one (the prior); null ids are scored, not trained on;
several labels of a document: toxic if any says so; repeated rows are scored repeatedly; without
labelled toxic documents nothing is toxic; an empty table gives an empty result.  Other columns are
ignored, whatever their names.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._shared import trimmed
from pagequarry.llm._text import as_string_array

MAX_LABELS = 200_000
MIN_CONTEXTS = 6
STEMS = (4, 5, 6)
LEXICON_SHARE = 0.3
PURITY = 0.9
STEM_PURITY = 0.98
MIN_WEIGHT = 2.5
CUTOFF = 0.5
REMEMBERED = 400_000
REMEMBERED_RUNS = 20_000
REMEMBERED_RUN = 200  # characters; a longer run is read anew
PART = 1 << 18
ROW = 16
MIN_SPELLED = 3  # characters of a token without letters that may be a word
MIN_SPLIT = 5  # letters of a word that may be cut in two pieces

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
ALPHABET = len(LETTERS) + 1  # 0: everything else, a word's edge
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_LUT = np.zeros(0x180, np.int64)
_LUT[[ord(c) for c in LETTERS]] = np.arange(1, ALPHABET)

LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": LETTERS[:26], "#": "h",
}
SEPARATORS = " .-_*,/\\~^'`​­•·"
LEET_COST = math.log(0.7)
SKIP_COST = math.log(0.3)
AGAIN_COST = math.log(0.4)
KEPT_COST = math.log(0.005)

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_EDGE = frozenset(" \t\n\r\v\f" + SEPARATORS)
_TWICE = re.compile(r"([^\W\d_])\1+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][ .\-_*/~]{1,2}){2,}[^\W_](?!\w)")
_SYMBOLS = re.escape("".join(c for c in LEET if not c.isalnum() and c not in SEPARATORS))
_GAP = re.compile(rf"[\s{re.escape(SEPARATORS)}]*")
_ELEMENT = re.compile(rf"[^\W_]|[{_SYMBOLS}]|\*")
# single letters, digits and symbols with any white space and separators between them; possessive, so linear
_RUNS = re.compile(rf"(?:(?<![^\W_])[^\W_](?![^\W_])|[{_SYMBOLS}])(?:[\s{re.escape(SEPARATORS)}]*+(?:(?<![^\W_])[^\W_](?![^\W_])|[{_SYMBOLS}]))++")
_ALL_LEET = re.compile("[" + re.escape("".join(LEET)) + "]+")
_STOPS = ".,;:?!)]}\"'"
_ENDS = "\"'.,;:?!)]}>-_"
_LEETED = re.compile(r"[0-9@$!|+(€£*#]")


def _squeezed(gap: str) -> str:
    """What of a gap the decoder must see: its asterisks, which may be letters, else one blank.  A row of over
    ``ROW`` asterisks is a rule, not spelling, and costs too much to decode."""
    n = gap.count("*")
    return "*" * n if 0 < n <= ROW else gap and " "


def single_runs(text: str) -> Iterator[str]:
    """The runs of single characters, with the white space and separators around them."""
    for m in _RUNS.finditer(text):
        at, to = m.span()
        while at and text[at - 1] in _EDGE:
            at -= 1
        while to < len(text) and text[to] in _EDGE:
            to += 1
        yield text[at:to]


def readings(found: str) -> tuple[str, ...]:
    """What a run of three or more single characters may spell: all of it, its parts between
    unusual gaps (a gap between words is often wider than those between letters), and these without a
    first or last character, which may be a word or a mark of its own; each of three characters at least."""
    run = found.lower()
    if len(_ELEMENT.findall(run)) < 3:
        return ()
    chars, gaps = [], []
    k = _GAP.match(run).end()
    lead = _squeezed(run[:k]).strip()
    while k < len(run):
        chars.append(run[k])
        end = _GAP.match(run, k + 1).end()
        gaps.append(run[k + 1 : end])
        k = end
    tail = _squeezed(gaps.pop()).strip()
    usual = Counter(gaps).most_common(1)[0][0]
    cuts = [0, *(i for i, g in enumerate(gaps, 1) if g != usual), len(chars)]
    spans = {(0, len(chars)), *(x for x in zip(cuts, cuts[1:]) if x[1] - x[0] > 2)}
    spans |= {(a + i, b - j) for a, b in spans for i in (0, 1) for j in (0, 1) if b - a - i - j > 2}
    joins = [_squeezed(g) for g in gaps]
    out = {m.group().lower() for m in _SPACED.finditer(found)}
    for a, b in spans:
        seen = "".join(c + g for c, g in zip(chars[a:b], [*joins[a : b - 1], ""]))
        out.add((lead if a == 0 else "") + seen + (tail if b == len(chars) else ""))
    return tuple(sorted(out))


def trigrams(word: str) -> np.ndarray:
    codes = np.array([0, 0, *(CODE.get(c, 0) for c in word), 0])
    return (codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:]


class CharModel:
    """Interpolated trigram log probabilities over LETTERS and the edge."""

    def __init__(self, counts: np.ndarray, words: list[str] | None = None, share: float = LEXICON_SHARE):
        p = self._smoothed(counts)
        if words:
            own = np.zeros(ALPHABET**3, np.int64)
            np.add.at(own, np.concatenate([trigrams(w) for w in words]), 1)
            p = (1 - share) * p + share * self._smoothed(own)
        self.logp = np.log(p).ravel().tolist()

    @staticmethod
    def _smoothed(counts: np.ndarray) -> np.ndarray:
        a = ALPHABET
        tri = counts.reshape(a, a, a).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + a)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        return (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)

    def decode(self, seen: str) -> str:
        """The likeliest letters behind an observed string, by Viterbi over (last two letters)."""
        logp, a = self.logp, ALPHABET
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in seen:
            out: list[tuple[int, str, float]] = []  # (letter's code, letter, cost)
            skip = None
            if c in CODE:
                out.append((CODE[c], c, 0.0))
                if c == before:
                    skip = AGAIN_COST
            elif c in LEET:
                cost = LEET_COST - math.log(len(LEET[c]))
                out += [(CODE[x], x, cost) for x in LEET[c]]
                out.append((0, c, KEPT_COST))
                if c == before:
                    skip = AGAIN_COST
                elif c in SEPARATORS:
                    skip = SKIP_COST
            elif c in SEPARATORS:
                skip = SKIP_COST
                out.append((0, " ", KEPT_COST))
            else:
                out.append((0, c, 0.0))
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (u, v), (score, path) in best.items():
                if skip is not None:
                    old = step.get((u, v))
                    if old is None or score + skip > old[0]:
                        step[(u, v)] = (score + skip, path)
                base = (u * a + v) * a
                for w, x, cost in out:
                    s = score + cost + logp[base + w]
                    old = step.get((v, w))
                    if old is None or s > old[0]:
                        step[(v, w)] = (s, (path, x))
            best, before = step, c
        (u, v), (score, path) = max(best.items(), key=lambda kv: kv[1][0] + logp[(kv[0][0] * a + kv[0][1]) * a])
        letters = []
        while path is not None:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters))


def add_trigrams(texts: list[str], total: np.ndarray) -> None:
    """Add the trigrams of texts in small letters, none of them empty; two edges are before each, one is after it."""
    a = ALPHABET
    whole = "\0\0" + "\0\0".join(texts) + "\0"
    for at in range(0, len(whole) - 2, PART):  # two characters of overlap: no trigram is lost
        points = np.frombuffer(whole[at : at + PART + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _LUT[np.minimum(points, 0x17F)]
        total += np.bincount((codes[:-2] * a + codes[1:-1]) * a + codes[2:], minlength=a**3)
    # what is read from a text's last character over the two edges before the next is no trigram of either
    np.subtract.at(total, [CODE.get(t[-1], 0) * a * a for t in texts[:-1]], 1)


def stretches(texts: pa.Array) -> Iterator[list[str]]:
    """All texts but empty ones, in small letters, in lists of ``PART`` characters and what their last text has beyond."""
    held, size = [], 0
    for text in texts:
        if not text.as_py():
            continue
        held.append(text.as_py().lower())
        size += len(held[-1])
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of all texts, as ALPHABET**3 numbers."""
    a = ALPHABET

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(a**3, np.int64)
        for batch in batches:
            for texts in stretches(as_string_array(batch.column(0))):
                add_trigrams(texts, total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["gram", "n"])

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram int, n long")
    out = np.zeros(a**3, np.int64)
    for r in each.groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def entries(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked by a dash."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


class Entries:
    """Which entries of a word are among given ones; for words without a dash."""

    def __init__(self, held):
        self.held = held
        self.begins = [(k, {w[:-1]: w for w in held if w.endswith("-") and len(w) == k + 1}) for k in STEMS]

    def of(self, word: str) -> tuple[str, ...]:
        found = [word] if word in self.held else []
        for k, begins in self.begins:
            if word[:k] in begins and len(word) > k:
                found.append(begins[word[:k]])
        return tuple(found)

    def any(self, word: str) -> bool:
        if word in self.held:
            return True
        for k, begins in self.begins:
            if word[:k] in begins and len(word) > k:
                return True
        return False


def labelled(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """(text, toxic) of the labelled documents that fit the lexicon."""
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.xxhash64("__id"), "__id").limit(max_labels)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("text", "toxic").where("text IS NOT NULL")


def pieces_of(word: str) -> list[tuple[str, str]]:
    """The ways to cut a lexicon word in two."""
    return [(word[:k], word[k:]) for k in range(2, len(word) - 1)] if len(word) >= MIN_SPLIT and not word.endswith("-") else []


def plain_pieces(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_labels: int = MAX_LABELS) -> frozenset[str]:
    """Pieces of lexicon words that clean documents hold as words of their own."""
    wanted = frozenset(x for w in weights for pair in pieces_of(w) for x in pair)
    if not wanted:
        return wanted

    @trimmed
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["piece"])

    rows = labelled(docs, labels, max_labels).where("toxic = 0").select("text").mapInArrow(held, "piece string").distinct()
    return frozenset(r["piece"] for r in rows.collect())  # at most the wanted ones


def lexicon(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[dict[str, float], float]:
    """Weights of the toxic words, and the prior's log odds."""
    known = labelled(docs, labels, max_labels)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic = sum(n for k, n in sizes.items() if k)
    n_clean = sum(n for k, n in sizes.items() if not k)
    if not n_toxic:
        return {}, math.log(0.5 / (n_clean + 1))

    @trimmed
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for text in batch.column(0).to_pylist():
                own = words_of(text)
                for before, w, after in zip(["", *own], own, [*own[1:], ""]):
                    ctx = zlib.crc32(f"{before} {after}".encode())
                    pairs.update((e, ctx) for e in entries(w))
            words, ctx = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ctx, pa.int64())], names=["word", "ctx"])

    held = known.where("toxic <> 0").select("text").mapInArrow(contexts, "word string, ctx long").distinct()
    seen = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS).toLocalIterator()}

    @trimmed
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        counted = Entries(seen)
        held: dict[str, tuple[str, ...]] = {}  # of words met before
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(held) > REMEMBERED:
                    held.clear()
                own = set(words_of(text))
                for w in own.difference(held):
                    held[w] = counted.of(w)
                total.update(set().union(*map(held.__getitem__, own)))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    against = {r["word"]: r["n"] for r in known.where("toxic = 0").select("text").mapInArrow(clean, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()}
    weights = {}
    for word, n in seen.items():
        m = against.get(word, 0)
        weight = math.log((n + 0.5) / (n_toxic + 1)) - math.log((m + 0.5) / (n_clean + 1))
        if n >= (STEM_PURITY if word.endswith("-") else PURITY) * (n + m) and weight >= MIN_WEIGHT:
            weights[word] = weight
    return weights, math.log((n_toxic + 0.5) / (n_clean + 0.5))


class Judge:
    """Scores texts; remembers tokens, of which a corpus repeats most."""

    def __init__(self, model: CharModel, weights: dict[str, float], prior: float, plain: frozenset[str] = frozenset()):
        self.model, self.weights, self.prior = model, weights, prior
        self.collapsed = {_TWICE.sub(r"\1", w): w for w in weights}
        self.harmless: set[str] = set()
        self.found: dict[str, tuple[tuple[str, ...], bool]] = {}
        self.runs: dict[str, tuple[str, ...]] = {}
        self.read: dict[str, frozenset[str]] = {}  # of short runs as they stand in texts
        self.openers: set[str] = set()  # tokens met that are a first piece
        self.listed, self.listed_once = Entries(weights), Entries(self.collapsed)
        self.halves: dict[str, dict[str, str]] = {}  # of words in two pieces: the first, the second, the word
        for w in weights:
            for first, second in pieces_of(w):
                if first not in plain or second not in plain:  # else two words, as clean documents have them
                    self.halves.setdefault(first, {})[second] = w

    def weight(self, word: str) -> float:
        return max([self.weights.get(e, 0.0) for e in entries(word)])

    def _restored(self, seen: str) -> list[str]:
        out = []
        for w in words_of(self.model.decode(seen)):
            if not self.weight(w):
                w = self.collapsed.get(_TWICE.sub(r"\1", w), w)  # the model can't tell one letter from two
            if self.weight(w):
                out.append(w)
        return out

    def token(self, token: str) -> tuple[tuple[str, ...], bool]:
        """Lexicon words in a token without white space, and whether decoding was what showed one."""
        low = token.lower()
        core = low.strip(_ENDS)
        if core.isalpha():  # one word
            if self.listed.any(core):
                return (core,), False
            if _TWICE.search(core) and (_RUN.search(core) or self.listed_once.any(_TWICE.sub(r"\1", core))):
                return tuple(self._restored(core)), True
            return (), False
        parts = _WORD.findall(low)
        hits = [w for w in parts if self.listed.any(w)]
        if hits:
            return tuple(hits), False
        while core and core[-1] in "*#$%&@+|" and core[-3:] == core[-1] * 3:
            core = core.rstrip(core[-1])  # a tail of symbols is ornament, not spelling
        if core.isalpha():
            if _RUN.search(core) or _TWICE.search(core) and any(e in self.collapsed for e in entries(_TWICE.sub(r"\1", core))):
                return tuple(self._restored(core)), True
        elif parts and (_LEETED.search(core) or len(parts) > 1):
            return tuple(self._restored(core)), True
        elif not parts and len(core) >= MIN_SPELLED and core == low and _ALL_LEET.fullmatch(core):
            # symbols and digits only: what is read must be a whole word of the lexicon, not a beginning
            return tuple(w for w in self._restored(core) if w in self.weights), True
        return (), False

    def run(self, found: str) -> frozenset[str]:
        """Lexicon words in a run as it stands in a text."""
        got = self.read.get(found)
        if got is None:
            got = frozenset(w for seen in readings(found) for w in self.spelled(seen))
            if len(found) <= REMEMBERED_RUN:
                if len(self.read) >= REMEMBERED_RUNS:
                    self.read.clear()
                self.read[found] = got
        return got

    def spelled(self, seen: str) -> tuple[str, ...]:
        """Lexicon words in a run of single characters."""
        got = self.runs.get(seen)
        if got is None:
            if len(self.runs) > REMEMBERED:
                self.runs.clear()
            got = self.runs[seen] = tuple(self._restored(seen))
        return got

    def text(self, text: str | None) -> tuple[float, list[str], int]:
        """(log odds, distinct lexicon words, how many of them only decoding showed)."""
        held: set[str] = set()
        hidden: set[str] = set()
        if text:
            if len(self.harmless) > REMEMBERED:
                self.harmless.clear()
                self.openers.clear()  # met again, as no token is harmless now
            if len(self.found) > REMEMBERED:
                self.found.clear()
            tokens = text.split()
            distinct = set(tokens)
            for token in distinct.difference(self.harmless):
                if token.lower() in self.halves:
                    self.openers.add(token)
                got = self.found.get(token) or self.token(token)
                if got[0]:
                    self.found[token] = got
                    (hidden if got[1] else held).update(got[0])
                else:
                    self.harmless.add(token)
            if not self.openers.isdisjoint(distinct):
                openers = self.openers
                for k in [k for k, t in enumerate(tokens) if t in openers and k + 1 < len(tokens)]:
                    word = self.halves[tokens[k].lower()].get(tokens[k + 1].lower().rstrip(_STOPS))
                    if word:
                        hidden.add(word)
            for found in single_runs(text):
                hidden.update(self.run(found))
        words = held | hidden
        return self.prior + sum(self.weight(w) for w in sorted(words)), sorted(words), len(hidden - held)


def score_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, toxicity, toxic, words, n_restored): the probability, the decision, the lexicon words found
    and how many of them were hidden."""
    weights, prior = lexicon(docs, labels, max_labels)
    plain = plain_pieces(docs, labels, weights, max_labels)
    counts = char_counts(docs)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "toxicity", "toxic", "words", "n_restored"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(CharModel(counts, [w.rstrip("-") for w in weights]), weights, prior, plain)
        for batch in batches:
            odds, words, restored = [], [], []
            for text in batch.column(1).to_pylist():
                o, w, r = judge.text(text)
                odds.append(o), words.append(w), restored.append(r)
            p = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -50, 50)))
            cells = [pa.array(p), pa.array(p >= cutoff), pa.array(words, pa.list_(pa.string())), pa.array(restored, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], names=names)

    return slim.mapInArrow(run, f"doc_id {kind}, toxicity double, toxic boolean, words array<string>, n_restored int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None
