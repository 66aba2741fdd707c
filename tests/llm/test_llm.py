import math
import random
import struct
import time
from collections import Counter, defaultdict
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import op1_quality, op2_ogg, op3_dac, op4_urlfilter, op5_lines, op6_jaccard, op7_lattice, op8_packing, op9_toxicity, op10_decontaminate
from pagequarry.llm._tokens import encoder, pieces
from pagequarry.llm.registry import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, own string, h string, bad string, fp string, toxic int, quality int, key long, line string, id string, __fp string, __id string"
WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


WIDE = [x + y for x in WORDS[:40] for y in WORDS]


def prose(seed, n=120, words=WORDS):
    return " ".join(random.Random(seed).choices(words, k=n))


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), "r", "o", "h", "b", "f", 7, 8, 9, "l", "i", "x", "y")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 60_000)
    same = prose(2)
    rows = [row(1, None), row(2, ""), row(3, " \n "), row(4, long), row(5, same), row(5, same), row(6, same), row(None, prose(3)), row(None, same), row(7, "one"), row(8, "é \udbff".encode("utf-8", "ignore").decode()), row(9, "x" * 100_000)]
    rows += [tuple([10, *[None] * (len(SCHEMA.split(",")) - 1)]), tuple([None] * len(SCHEMA.split(",")))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, None, None), (6, 1, 0), (None, 1, 1), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(50, 40)), (2, None), (3, ""), (4, "one"), (5, prose(50, 40)), (None, prose(51, 30))], "item_id long, text string")


@pytest.mark.parametrize("name", list(QUERIES))
def test_sql(spark, sf, same, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name])
    else:
        assert df.count() > 0


# 1
def test_quality(spark, odd, labels):
    got = op1_quality.classify(odd, labels).collect()
    assert len(got) == 14 and all(0 <= r.quality <= 1 for r in got)
    assert op1_quality.classify(odd.limit(0), labels).count() == 0
    free = op1_quality.classify(odd, labels.limit(0)).collect()
    assert all(r.score is None and r.keep for r in free)
    only = op1_quality.classify(odd, labels.where("quality = 1")).collect()
    assert {r.quality for r in only} == {1.0}
    kept = op1_quality.keep_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in got)


def test_quality_held_out(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    lab = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    part = F.pmod(F.hash("doc_id"), F.lit(2)) == 0
    got = op1_quality.classify(docs, lab.where(part)).join(lab.where(~part).select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert sum(r.keep == bool(r.y) for r in got) / len(got) > 0.95


def test_quality_parts():
    assert op1_quality.isotonic(np.array([1, 1, 2, 1.0]), np.array([0, 1, 1, 1.0])).tolist() == [0, 2 / 3, 2 / 3, 1]
    x = np.random.default_rng(0).standard_normal((40, 5))
    z = op1_quality.fourier(x, 20_000, 2.0)
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 8) + 1
    assert np.abs(z @ z.T - want).max() < 0.05
    s = op1_quality.document_statistics(pa.array(["", "a b a b", "A1."]))
    assert np.isfinite(s).all() and not s[0].any()


# 2
def test_ogg():
    packets = [(b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 0, 48000, 0, 0), 0), (b"T", 0), (b"a" * 255, 960), (b"b" * 70_000, 1920), (b"", 2880)]
    blob = op2_ogg.mux_ogg([(7, packets), (8, [(b"zz", 5)])])
    streams, bad = op2_ogg.parse_ogg(blob)
    assert bad == 0 and {s.serial: s.packets for s in streams} == {7: [p for p, _ in packets], 8: [b"zz"]}
    s = streams[0]
    assert (s.codec, s.seconds(s.last_granule), s.lost) == ("opus", 0.06, 0)
    broken = bytearray(blob)
    broken[len(blob) // 2] ^= 1
    streams, bad = op2_ogg.parse_ogg(bytes(broken))
    assert bad == 1 and streams[0].lost == 1 and b"b" * 70_000 not in streams[0].packets
    assert op2_ogg.parse_ogg(blob[:-1])[1] == 1 and op2_ogg.parse_ogg(b"")[0] == [] and op2_ogg.parse_ogg(b"OggS")[1] == 1
    # the checksum against the plain bitwise definition
    page, c = b"OggS" + bytes(range(60)), 0
    for x in page:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    assert op2_ogg.page_crc(page) == c


def test_ogg_edges(spark, odd):
    got = op2_ogg.demux_ogg(op2_ogg.with_media(odd), "doc_id", "media").collect()
    assert Counter(r.id for r in got)[5] == 4 and all(r.bad_pages == 0 for r in got)
    media = spark.createDataFrame([(1, None), (2, b""), (3, b"junk")], "id long, media binary")
    assert op2_ogg.demux_ogg(media, "id", "media").count() == 0 and op2_ogg.with_media(odd.limit(0)).count() == 0


# 3
def test_codes(spark, odd):
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (2 ** rng.uniform(0, 31.9, n)).astype(np.uint64) * rng.integers(0, 2, n).astype(np.uint64)
        r = op3_dac.Reader(op3_dac.encode(ids))
        assert len(r) == n and r.decode().tolist() == ids.tolist() and all(r[i] == ids[i] for i in range(0, n, 7))
    assert op3_dac.Reader(op3_dac.encode([5, 300, 70_000], (3, 5, 16))).decode().tolist() == [5, 300, 70_000]
    with pytest.raises(ValueError):
        op3_dac.encode([2**32])
    got = op3_dac.encode_tokens(odd).withColumn("third", op3_dac.token_at(F.col("codes"), F.lit(2))).collect()
    encode, texts = encoder(), [r.text for r in odd.collect()]
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        if t is None:
            assert r.codes is None and r.n_tokens is None and r.third is None
        else:
            ids = encode(t)
            assert op3_dac.Reader(bytes(r.codes)).decode().tolist() == ids and r.n_tokens == len(ids) and r.third == (ids[2] if len(ids) > 2 else None)
    assert op3_dac.encode_tokens(odd.limit(0)).count() == 0


# 4
def test_globs(spark):
    rng = random.Random(4)
    globs = ["", "*", "?", "a*b", "*a?b*", "**", "abc"] + ["".join(rng.choices("ab?*", k=rng.randrange(30))) for _ in range(60)]
    texts = ["", "a", "ab", "abc"] + ["".join(rng.choices("abcé", k=rng.randrange(20))) for _ in range(200)]
    got = op4_urlfilter.GlobAutomaton(globs).match(texts)
    assert (got == np.array([[fnmatchcase(t, g) for g in globs] for t in texts])).all()
    rows = [(1, None), (2, ""), (3, "HTTP://A.b:80/x?utm_a=1&y=2#f"), (4, "HTTP://A.b:80/x?utm_a=1&y=2#f"), (5, "x" * 50_000), (6, " mailto:Me ")]
    df = spark.createDataFrame([(*r, "c", True) for r in rows], "id long, url string, canonical string, blocked boolean")
    got = {r.id: r for r in op4_urlfilter.filter_urls(df, "id", "url", [("block_a", "http://a.b/*"), ("allow_y", "*y=3*")]).collect()}
    assert got[1].canonical is None and not got[1].blocked and got[3].canonical == "http://a.b/x?y=2" and got[4].blocked and got[6].canonical == "mailto:me"
    assert op4_urlfilter.filter_urls(df.limit(0), "id", "url", []).count() == 0 and not op4_urlfilter.filter_urls(df, "id", "url", []).where("blocked").count()


# 5
@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_lines(spark, odd, broadcast):
    texts = [f"Menu \n{prose(i, 9)}\nmenu" for i in range(6)]
    docs = spark.createDataFrame([row(i, t, None) for i, t in enumerate(texts)] + [row(10, texts[0], None), row(11, "menu", None), row(12, "menu", "t"), row(13, None, None), row(14, "", None)], SCHEMA)
    got = {r.doc_id: r for r in op5_lines.drop_boilerplate(docs, 0.5, 5, with_counts=True, broadcast_rows=broadcast).collect()}
    assert got[0].text == prose(0, 9) == got[10].text and got[0].dropped_lines == 2 and got[0].n_chars == len(got[0].text)
    assert got[11].text == "" and got[12].text == "menu" and got[13].text is None and got[14].text == ""
    assert 11 not in {r.doc_id for r in op5_lines.drop_boilerplate(docs, 0.5, 5, drop_empty=True, broadcast_rows=broadcast).collect()}
    out = op5_lines.drop_boilerplate(odd, broadcast_rows=broadcast)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert op5_lines.drop_boilerplate(odd.limit(0)).count() == 0


# 6
def _edited(seed, base, share):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split())


def _links(texts):
    """{row: (class_id, n_copies, n_links)} and the similarities, by comparing all pairs."""
    sets, classes, near = {}, defaultdict(list), defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        if w:
            sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2)))
            classes[sets[i]].append(i)
    own = list(classes)
    for a in range(len(own)):
        for b in range(a):
            if len(own[a] & own[b]) / len(own[a] | own[b]) >= op6_jaccard.THRESHOLD:
                near[a].add(b), near[b].add(a)
    root = {}
    for a in range(len(own)):
        if a not in root:
            todo, seen = [a], {a}
            while todo:
                todo += (new := near[todo.pop()] - seen)
                seen |= new
            root |= dict.fromkeys(seen, min(i for k in seen for i in classes[own[k]]))
    number = {s: k for k, s in enumerate(own)}
    return {i: (root[number[sets[i]]], len(classes[sets[i]]) - 1, len(near[number[sets[i]]])) if i in sets else (i, 0, 0) for i in range(len(texts))}


def _mixed():
    texts = [prose(i) for i in range(30)] + [_edited(k, prose(k % 10, 300 if k % 3 else 40), 0.03 * (k % 5)) for k in range(150)]
    texts += [prose(i, 60) + " " + prose(777, 60) for i in range(120)]  # a passage that many share
    return texts + [_edited(i, prose(999, 200), 0.02) for i in range(130)] + ["a b", "a b", "b a", None, "", "x", "x y x y x y", "y x y x y x"]


@pytest.mark.parametrize("part, bucket, broadcast", [(1 << 19, 1 << 22, 10**6), (3000, 500, 0)])
def test_jaccard_brute_force(spark, monkeypatch, part, bucket, broadcast):
    """Small parts, buckets and joins in place of broadcasts give the same."""
    monkeypatch.setattr(op6_jaccard, "PART", part), monkeypatch.setattr(op6_jaccard, "BUCKET", bucket), monkeypatch.setattr(op6_jaccard, "BROADCAST_ROWS", broadcast)
    texts = _mixed()
    want = _links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in op6_jaccard.jaccard_join(docs).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in op6_jaccard.keep_one(docs).collect())
    assert kept == [i for i in range(len(texts)) if want[i][0] == i]


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.9, 1.0])
def test_jaccard_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(op6_jaccard, "THRESHOLD", threshold)
    texts = _mixed()[::3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in op6_jaccard.jaccard_join(docs, threshold).collect()}
    assert got == _links(texts)


def test_jaccard_large_family(spark):
    """A passage that 800 documents share, each with own text, all pairs at a similarity just above the
    threshold; then the same beside other documents, among them holders of a part of the passage."""
    core = prose(787, 302, WIDE)
    family = [core + " " + prose(10_000 + i, 80, WIDE) for i in range(800)]
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in map(str.split, family[:40])]
    assert all(0.6 <= len(x & y) / len(x | y) < 0.67 for x in sets for y in sets if x is not y)
    others = [core[:600] + " " + prose(30_000 + i, 150, WIDE) for i in range(300)] + [core] * 50 + [prose(50_000 + i, 90, WIDE) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    assert {(r.class_id, r.n_copies, r.n_links) for r in op6_jaccard.jaccard_join(docs).collect()} == {(0, 0, 799)}
    assert [r.doc_id for r in op6_jaccard.keep_one(docs).collect()] == [0]
    more = docs.union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(others)], docs.schema))
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in op6_jaccard.jaccard_join(more).collect()}
    assert {got[i] for i in range(800)} == {(0, 0, 800)} and {got[1300 + i] for i in range(50)} == {(0, 49, 800)}
    assert all(got[1000 + i] == (1000 + i, 0, 0) for i in [*range(300), *range(350, 550)])


def test_jaccard_edges(spark, odd):
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in op6_jaccard.jaccard_join(odd).collect())
    alone = {(i, i, 0, 0): 1 for i in (1, 2, 3, 4, 7, 8, 9, 10)}
    assert got == {**alone, (5, 5, 3, 0): 2, (6, 5, 3, 0): 1, (None, 5, 3, 0): 1, (None, None, 0, 0): 2}
    kept = op6_jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, 10, None, None])
    assert op6_jaccard.jaccard_join(odd.limit(0)).count() == 0 and op6_jaccard.keep_one(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(f"{a:03}", f"{b:03}") for a, b in (sorted(rng.sample(range(200), 2)) for _ in range(120))] + [(f"{i:03}", f"{i + 1:03}") for i in range(300, 360)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {(r.node, r.root) for r in op6_jaccard.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {(x, find(x)) for x in parent if find(x) != x}


# 7
def _segmentations(lattice, word):
    if not word:
        return [0.0]
    out = []
    for k in range(1, len(word) + 1):
        s = lattice.scores.get(word[:k])
        if s is None and k == 1:
            s = lattice.spelled(word[:1])
        if s is not None:
            out += [s + rest for rest in _segmentations(lattice, word[k:])]
    return out


def test_lattice(spark, odd):
    texts = ["the hat", "the the 猫 ab", None, "", " \n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)], "doc_id long, text string, n_words int")
    counts = Counter(i for t in [*texts, texts[0]] if t for w in t.split() for i in pieces().encode(w))
    lattice = op7_lattice.lattice_of(dict(counts))
    got = op7_lattice.score_documents(docs).collect()
    for r in got:
        t = texts[r.doc_id]
        if t is None:
            assert r.log_prob is None
        else:
            want = sum(math.log(sum(map(math.exp, _segmentations(lattice, op7_lattice.MARK + w)))) for w in t.split())
            assert r.n_words == len(t.split()) and r.log_prob == pytest.approx(want, rel=1e-9) and (r.bits_per_char is None) == (not t.split())
    assert op7_lattice.score_documents(odd).count() == 14 and op7_lattice.score_documents(odd.limit(0)).count() == 0


def test_lattice_columns():
    """Words scored together score as each on its own, at well under its cost."""
    rng = random.Random(7)
    pool = ["the", "ing", "hat", "é", "e\u0301", "猫", "ß", "😀", "\0", "\u200b", "<0x00>", "7", "$", op7_lattice.MARK, "\U0010ffff"]
    few = [op7_lattice.MARK + "".join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(400)]
    long = [op7_lattice.MARK + "".join(rng.choices(pool, k=k)) for k in [60] * 40 + [2000] * 2]
    lattice = op7_lattice.lattice_of(dict(Counter(i for own in pieces().encode(few) for i in own)))
    got = lattice.log_marginals(few + long)
    assert got[:400] == pytest.approx([math.log(sum(map(math.exp, _segmentations(lattice, w)))) for w in few], rel=1e-9)
    assert got[400:] == pytest.approx([lattice.log_marginal(w) for w in long], rel=1e-9)
    assert len(lattice.log_marginals([])) == 0 and lattice.log_marginals(few[:1]) == pytest.approx(got[:1])
    words = [op7_lattice.MARK + "".join(rng.choices("etaoinshr", k=rng.randint(4, 12))) for _ in range(20_000)]
    start = time.process_time()
    each = [lattice.log_marginal(w) for w in words]
    middle = time.process_time()
    assert lattice.log_marginals(words) == pytest.approx(each, rel=1e-12)
    assert time.process_time() - middle < 0.6 * (middle - start)


def test_lattice_stretches(spark):
    """All texts are in stretches, in order, and each row has its own text's words."""
    texts = [None, "", "the hat", "x" * 40 + " a hat", None, "hat the", "猫 " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = op7_lattice.score_documents(docs).orderBy("doc_id").collect()
    for size in (1, 10, 45):
        held = list(op7_lattice.stretches(pa.array(texts, pa.string()), size))
        assert [t for h in held for t in h] == texts and all(sum(len(t or "") for t in h[:-1]) < size for h in held)
    assert [r.n_words for r in got] == [None if t is None else len(t.split()) for t in texts]


# 8
def test_hilbert():
    n = 8
    points = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = op8_packing.hilbert_key(points, 3)
    path = points[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(n**3)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("capacity, segment", [(64, 1 << 20), (100, 1000)])
def test_packing(spark, odd, capacity, segment):
    got = op8_packing.pack(odd, capacity, segment).collect()
    encode = encoder()
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += len(encode(r.text or ""))
    have, seqs = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.end_token - r.start_token
        seqs[r.pack_id].append((r.offset, r.offset + r.end_token - r.start_token, r.curve_key))
    assert have == +want
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    keys = [k for p in sorted(seqs) for _, _, k in seqs[p]]
    assert keys == sorted(keys)
    assert sorted(map(str, got)) == sorted(map(str, op8_packing.pack(odd.repartition(3), capacity, segment).collect()))
    assert op8_packing.pack(odd.limit(0)).count() == 0


# 9
def _brute_decode(model, seen):
    """Every path through the lattice, without pruning."""
    a, best = op9_toxicity.ALPHABET, [(-1e9, "")]

    def go(i, u, v, score, path, before):
        if i == len(seen):
            best[0] = max(best[0], (score + model.logp[(u * a + v) * a], path))
            return
        c, out, skip = seen[i], [], None
        if c in op9_toxicity.CODE:
            out, skip = [(op9_toxicity.CODE[c], c, 0.0)], op9_toxicity.AGAIN_COST if c == before else None
        elif c in op9_toxicity.LEET:
            alts = op9_toxicity.LEET[c]
            out = [(op9_toxicity.CODE[x], x, op9_toxicity.LEET_COST - math.log(len(alts))) for x in alts] + [(0, c, op9_toxicity.KEPT_COST)]
            skip = op9_toxicity.AGAIN_COST if c == before else op9_toxicity.SKIP_COST if c in op9_toxicity.SEPARATORS else None
        else:
            out, skip = [(0, " ", op9_toxicity.KEPT_COST)], op9_toxicity.SKIP_COST
        if skip is not None:
            go(i + 1, u, v, score + skip, path, c)
        for w, x, cost in out:
            go(i + 1, v, w, score + cost + model.logp[(u * a + v) * a + w], path + x, c)

    go(0, 0, 0, 0.0, "", "")
    return best[0]


def test_viterbi():
    counts = np.zeros(op9_toxicity.ALPHABET**3, np.int64)
    for w in ("loser", "hello", "seat", "idiot", "stupid"):
        np.add.at(counts, op9_toxicity.trigrams(w), 5)
    model = op9_toxicity.CharModel(counts, ["loser", "idiot", "stupid"])
    for seen in ("l0$er", "1d10t", "s.t.u.p.i.d", "stuuupid", "hell0", "se@t", "1o53r"):
        assert model.decode(seen) == _brute_decode(model, seen)[1]
    assert model.decode("l0$er") == "loser" and model.decode("s t u p i d") == "stupid" and model.decode("stuuupid") == "stupid"


def test_toxicity(spark, odd, labels):
    bad = ["loser", "idiot", "moron"]
    clean = [(i, prose(i, 40)) for i in range(60)]
    toxic = [(100 + i, f"{prose(i + 500, 15)} {bad[i % 3]} {prose(i + 600, 15)} {bad[(i + 1) % 3]} {prose(i, 5)}") for i in range(40)]
    hidden = [(200, prose(900, 20) + " l0$er " + prose(901, 20)), (201, prose(902, 20) + " m o r o n " + prose(903, 20)), (202, prose(904, 20) + " iiidiooot " + prose(905, 20)), (203, prose(906, 40)), (204, None), (205, "")]
    docs = spark.createDataFrame([row(i, t) for i, t in clean + toxic + hidden], SCHEMA)
    known = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op9_toxicity.score_toxicity(docs, known).collect()}
    assert all(got[i].toxic for i, _ in toxic) and not any(got[i].toxic for i, _ in clean)
    assert [got[i].words for i in (200, 201, 202)] == [["loser"], ["moron"], ["idiot"]] and all(got[i].toxic and got[i].n_restored == 1 for i in (200, 201, 202))
    assert not any(got[i].toxic for i in (203, 204, 205))
    assert op9_toxicity.score_toxicity(odd, labels).count() == 14 and op9_toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    assert not op9_toxicity.score_toxicity(docs, known.limit(0)).where("toxic").count()


def test_combined_disguises():
    words = ["loser", "stupid", "idiot", "moron", "ass"]
    counts = np.zeros(op9_toxicity.ALPHABET**3, np.int64)
    for w in [*WORDS, *words, "hello", "yes", "some", "text", "and", "more"]:
        np.add.at(counts, op9_toxicity.trigrams(w), 5)
    judge = op9_toxicity.Judge(op9_toxicity.CharModel(counts, words), dict.fromkeys(words, 5.0), -3.0)
    hidden = {
        "l 0 $ e r": "loser", "x l 0 $ e r y": "loser", "$ t u p i d": "stupid", "s t u p ! d": "stupid", "@ $ $": "ass", "l   o   s   e   r": "loser", "m\to\tr\to\tn": "moron",
        "m\no\nr\r\no\nn": "moron", "s, t, u, p, i, d": "stupid", "1 - d - 1 - 0 - t": "idiot", "(s t u p i d)": "stupid", "l o s e r !": "loser", "l 0 \u200b $ _ e . r": "loser", "s * u p i d": "stupid", "s_t_u_p_!_d": "stupid",
        "S T U P I D": "stupid", "m o r o n": "moron",
    }
    for seen, word in hidden.items():
        assert word in judge.text(f"{WORDS[3]} {seen} {WORDS[9]}")[1], seen
    more = op9_toxicity.Judge(op9_toxicity.CharModel(np.bincount(np.concatenate([op9_toxicity.trigrams(w) for w in [*WORDS, "ass", "shit", "stupid"]]), minlength=op9_toxicity.ALPHABET**3), ["ass", "shit", "stupid"]), dict.fromkeys(["ass", "shit", "stupid"], 5.0), -3.0)
    for seen, word in {"@$$": "ass", "455": "ass", "$#!7": "shit", "5#17": "shit", "stu pid": "stupid", "st upid.": "stupid", "s   t   u   p   i   d": "stupid"}.items():
        assert more.text(f"{WORDS[3]} {seen} {WORDS[9]}")[1] == [word], seen
    assert op9_toxicity.Judge(judge.model, {"stupid": 5.0}, -3.0, frozenset({"stu", "pid"})).text("stu pid or st upid")[1] == ["stupid"]
    assert op9_toxicity.Judge(judge.model, {"stupid": 5.0}, -3.0, frozenset({"stu", "pid"})).text("stu pid")[1] == []
    assert more.text("in 1999 and 2024, 3.14 or 12:30, 100% of $5")[1] == []
    assert judge.text("l 0 $ e r   1 d 1 0 t\nm 0 r 0 n")[1] == ["idiot", "loser", "moron"]
    for clean in ("a b c d e f", "2 7 2\n7 2 2", "( a ) ( b ) ( c )", "| | |\n+---+---+", "x + y = z!", "5 $ 3", "- - -", "", "*" * 100_000, "* " * 50_000 + "a", "a " + "* " * 50_000 + "b"):
        assert judge.text(clean)[1] == [], clean[:20]


def test_scores_by_hand(spark):
    """Lexicon weights and document scores against a plain count of contexts and documents."""
    rng = random.Random(9)
    bad = ["loser", "moron"]
    texts = [(i, prose(i, 12), 0) for i in range(30)] + [(100 + i, f"{prose(i, 4)} {rng.choice(bad)} {prose(700 + i, 4)}", 1) for i in range(20)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    known = spark.createDataFrame([(i, x) for i, _, x in texts], "doc_id long, toxic int")
    weights, prior = op9_toxicity.lexicon(docs, known)
    around, clean = defaultdict(set), Counter()
    for _, t, x in texts:
        w = t.split()
        if x:
            for k in range(len(w)):
                for e in op9_toxicity.entries(w[k]):
                    around[e].add((w[k - 1] if k else "", w[k + 1] if k + 1 < len(w) else ""))
        else:
            clean.update({e for v in w for e in op9_toxicity.entries(v)})
    want = {}
    for e, c in around.items():
        n, m = len(c), clean[e]
        weight = math.log((n + 0.5) / 21) - math.log((m + 0.5) / 31)
        if n >= op9_toxicity.MIN_CONTEXTS and n >= (op9_toxicity.STEM_PURITY if e.endswith("-") else op9_toxicity.PURITY) * (n + m) and weight >= op9_toxicity.MIN_WEIGHT:
            want[e] = weight
    assert weights == pytest.approx(want) and set(bad) <= set(want) and prior == pytest.approx(math.log(20.5 / 30.5))
    for r in op9_toxicity.score_toxicity(docs, known).collect():
        own = dict((i, t) for i, t, _ in texts)[r.doc_id]
        odds = prior + sum(max(want.get(e, 0) for e in op9_toxicity.entries(w)) for w in set(own.split()))
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-odds))) and r.toxic == (odds >= 0)


def test_char_counts(spark):
    texts = ["ab", None, "", "x" * 200_000 + "é"]
    got = op9_toxicity.char_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = sum(np.bincount(op9_toxicity.trigrams(t or ""), minlength=op9_toxicity.ALPHABET**3) for t in texts if t)
    assert (got == want).all()


def test_trigrams_of_joined_texts(monkeypatch):
    """Texts counted together count as alone, also over parts and where small letters are more than capitals."""
    rng = random.Random(99)
    texts = ["".join(rng.choices("abÉß\0 \n猫İ", k=k)) for k in [1, 2, 3, 50, 0, 0, 7, 300, 1]] + ["İ" * 70_000, "", "Z"]
    want = sum(np.bincount(op9_toxicity.trigrams(t.lower()), minlength=op9_toxicity.ALPHABET**3) for t in texts if t)
    for part in (5, 64, 1 << 18):
        monkeypatch.setattr(op9_toxicity, "PART", part)
        got = np.zeros(op9_toxicity.ALPHABET**3, np.int64)
        for held in op9_toxicity.stretches(pa.array(texts if part > 5 else texts[:9])):
            op9_toxicity.add_trigrams(held, got)
        assert (got == (want if part > 5 else sum(np.bincount(op9_toxicity.trigrams(t.lower()), minlength=op9_toxicity.ALPHABET**3) for t in texts[:9] if t))).all()


def test_small_letters_of_long_texts(spark):
    """The parts of a long text share two small letters, whatever their capitals are."""
    text = "İ" * 70_000
    want = np.bincount(op9_toxicity.trigrams(text.lower()), minlength=op9_toxicity.ALPHABET**3)
    assert (op9_toxicity.char_counts(spark.createDataFrame([(text,)], "text string")) == want).all()


def test_entries_listed():
    held = {"ass": 1.0, "stup-": 1.0, "idiot": 1.0, "loser-": 1.0, "full-": 1.0}
    listed = op9_toxicity.Entries(held)
    for w in ("ass", "asses", "stup", "stupid", "idiot", "idiots", "loser", "losers", "full", "fully", "ful", "", "a"):
        assert list(listed.of(w)) == [e for e in op9_toxicity.entries(w) if e in held] and listed.any(w) == bool(listed.of(w)), w


def test_judge_remembers(monkeypatch):
    """A run that many texts hold is read once; what is remembered changes no verdict, however little it is."""
    words = ["loser", "stupid", "idiot"]
    model = op9_toxicity.CharModel(np.bincount(np.concatenate([op9_toxicity.trigrams(w) for w in [*WORDS, *words]]), minlength=op9_toxicity.ALPHABET**3), words)
    texts = [f"{prose(i, 9)} {x} {prose(i + 50, 9)}" for i in range(12) for x in ("l 0 $ e r", "l0$er,", "STU pid!", "stu pid", "a b c d", "Stuuupid", "x * y * z", "idiot", "st\nupid", "STU")]
    alone = [op9_toxicity.Judge(model, dict.fromkeys(words, 5.0), -3.0).text(t) for t in texts]
    assert {tuple(a[1]) for a in alone} >= {("loser",), ("stupid",), ("idiot",), ()}
    read, calls = op9_toxicity.readings, []
    monkeypatch.setattr(op9_toxicity, "readings", lambda found: calls.append(found) or read(found))
    for most in (400_000, 1):
        monkeypatch.setattr(op9_toxicity, "REMEMBERED", most)
        judge = op9_toxicity.Judge(model, dict.fromkeys(words, 5.0), -3.0)
        calls.clear()
        assert [judge.text(t) for t in texts] == alone
        assert len(calls) == len(set(calls)) > 1
    monkeypatch.setattr(op9_toxicity, "REMEMBERED_RUNS", 1)
    assert [op9_toxicity.Judge.text(judge, t) for t in texts] == alone


# 10
def test_lcs():
    rng = random.Random(10)
    for _ in range(200):
        a, b = [rng.choices(range(5), k=rng.randrange(30)) for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert op10_decontaminate.lcs_length(a, b) == t[-1][-1]


@pytest.mark.parametrize("words", [WIDE, WORDS])  # with the few of the second, every word is common
def test_decontamination(spark, odd, items, words):
    rng = random.Random(11)
    bench = [(i, prose(2000 + i, 30, words) + ". " + prose(3000 + i, 10, words)) for i in range(25)]
    docs = [(i, prose(i, 200, words)) for i in range(80)]
    planted = {}
    for k in range(20):
        own = bench[k][1].split()
        if k % 4 == 1:
            own = [rng.choice(words) if rng.random() < 0.15 else w for w in own]  # a paraphrase
        if k % 4 == 2:
            own = [w.upper() + "!" for w in own]
        docs.append((100 + k, " ".join([prose(5000 + k, 37 * k, words), *own, prose(6000 + k, 90, words)])))
        planted[100 + k] = k
    d = spark.createDataFrame([row(*x) for x in docs], SCHEMA)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate.find_contamination(d, b).collect()}
    if words is WORDS:  # where chance alone makes passages alike
        assert got >= set(planted.items()) and len(got) <= len(planted) + 2
        return
    assert got == set(planted.items())
    left = op10_decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - set(planted)
    assert op10_decontaminate.find_contamination(odd, items).where("doc_id > 100").count() == 0
    assert op10_decontaminate.drop_contaminated(odd.limit(0), items).count() == 0 and op10_decontaminate.find_contamination(odd, items.limit(0)).count() == 0
    assert op10_decontaminate.drop_contaminated(odd, items.limit(0)).count() == 14


def test_singular_space(spark):
    """The latent space is that of the SVD of passages and items; of a low rank, nearly the best one."""
    texts = [prose(i, 70 + 9 * i, WIDE[:300]) for i in range(10)]
    bench = op10_decontaminate.read_benchmark([(i, prose(600 + i, 30, WIDE[:300])) for i in range(12)])
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    (own,) = op10_decontaminate.fit(docs, bench)
    rows = []
    for t in texts:
        w = bench.numbers(op10_decontaminate.word_hashes(pa.array([t]))[0])
        rows += [np.bincount(w[k : k + 64][w[k : k + 64] >= 0], minlength=len(bench.terms)) * own.idf for k in range(0, len(w), 32)]
    a = np.array(rows)
    item, term, value, _ = op10_decontaminate._item_weights(bench, own.idf)
    b = np.zeros((12, len(bench.terms)))
    b[item, term] = value
    test = np.random.default_rng(10).standard_normal((len(bench.terms), min(op10_decontaminate.RANK + op10_decontaminate.OVERSAMPLE, len(bench.terms))))
    trace = (test * (a.T @ (a @ test))).sum() / test.shape[1]
    whole = np.vstack([a, math.sqrt(trace / 12) * b])
    _, s, vt = np.linalg.svd(whole, full_matrices=False)
    v = vt[s > 1e-6 * s[0]].T
    used = own.idf > 0
    got = own.basis[used, :-1] / own.idf[used, None]
    assert len(v[0]) < op10_decontaminate.RANK and np.abs(got @ got.T - (v @ v.T)[np.ix_(used, used)]).max() < 1e-2
    low, values = op10_decontaminate.singular_vectors(whole.T @ (whole @ test[:, :24]), test[:, :24], 8)
    assert ((whole @ low) ** 2).sum() > 0.9 * (s[:8] ** 2).sum() and abs(values[0] / s[0] - 1) < 0.05
    assert low.shape[1] == 8 and np.abs(low.T @ low - np.eye(8)).max() < 1e-6
    # estimated cosines of passages without repeated words are the true ones
    words = random.Random(5).sample(WIDE[:300], 40)
    part = [(0, " ".join(words[:30]))]
    one = op10_decontaminate.find_contamination(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame(part, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in one] == [(1, 0)] and one[0].lcs == 1


@pytest.mark.parametrize("rank", [96, 24])
def test_candidates_brute_force(spark, sf, monkeypatch, rank):
    """What the latent search finds is what the check of all passages against all items finds."""
    monkeypatch.setattr(op10_decontaminate, "RANK", rank)
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    fit = op10_decontaminate.fit
    monkeypatch.setattr(op10_decontaminate, "fit", lambda d, b: fit(d, b, rank))
    found = {(r.doc_id, r.item_id) for r in op10_decontaminate.find_contamination(docs, items).collect()}
    every = {(r.doc_id, r.item_id) for r in op10_decontaminate.find_contamination(docs, items, -1e9).collect()}
    assert found == every and len(every) >= 3


def test_rank_matters(spark):
    bench = [(i, prose(600 + i, 30, WIDE)) for i in range(12)]
    docs = spark.createDataFrame([(prose(i, 100, WIDE),) for i in range(10)], "text string")
    held = [sum(len(p.ids) for p in op10_decontaminate.fit(docs, op10_decontaminate.read_benchmark(bench), rank)[:1]) for rank in (1, 96)]
    assert held[0] < held[1] == 12


def test_document_frequencies(spark):
    texts = [prose(i, 10 + 17 * i) for i in range(12)] + ["", None]
    bench = op10_decontaminate.read_benchmark([(0, prose(0, 40))])
    df, n = op10_decontaminate.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), bench)
    windows = [set(w[k : k + 64]) for t in texts if t for w in [t.split()] for k in range(0, len(w), 32)]
    from pagequarry.llm._text import hash_words

    assert n == len(windows)
    for w in set(prose(0, 40).split()):
        at = np.searchsorted(bench.terms, hash_words([w])[0])
        assert df[at] == sum(w in x for x in windows)


# the pipeline
def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = out
    packed = corpus_pipeline.run(spark, sf).collect()
    encode = encoder()
    want = Counter({r.doc_id: n for r in kept.collect() if (n := len(encode(r.text or "")))})
    have = Counter()
    for r in packed:
        have[r.doc_id] += r.end_token - r.start_token
    assert have == want and 0 < len(have) < docs.count()
