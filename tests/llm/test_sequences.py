"""Packing, periodic runs and collocations against brute force, and on odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lernwerk.llm import collocations, packing, periodic
from lernwerk.llm.bpe import word_file
from lernwerk.llm.common import Shared, documents, slices

from .conftest import SF, prose, rows

SPACE = " \t\n\x0b\x0c\r"


# ---- 11 packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_file())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_packed(packed, texts, library, size):
    """Every id lies in one piece, sequences have no gaps, and only sizes that are powers of two fall short of ``size``."""
    sequences, documents_ = defaultdict(list), defaultdict(list)
    for r in packed:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        documents_[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    for doc, text in texts.items():
        want = [*library(text), 1]
        got = sorted(documents_.pop(doc), key=lambda r: r.start)
        assert [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]]
        assert {r.doc_tokens for r in got} == {len(want)}
    assert not documents_


def test_hilbert_curve_takes_single_steps():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_ids_equal_the_library(library):
    letters = [*"aAbBzZ iİ̌.,;:!?'sStTdD019<|>\n\t\x0b\x1céΣ…J́ 中\U0001f642/-", "<|endoftext|>", "<|STARTOFTEXT|>", "'ll", "</w>"]
    draw = random.Random(3)
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 50))) for _ in range(3000)]
    encoder, got = packing.pieces(word_file()), []
    for _, _, data, offsets in slices(pa.array(texts), 1 << 12):
        ids, at = packing.slice_ids(data, offsets, encoder, 1)
        got += [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)]
    assert got == [[*library(t), 1] for t in texts]


def test_known_pieces_are_forgotten_and_learnt_again(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    encoder = packing.Pieces(word_file())
    for text in (b"one two three", b"four five six one", b"one, seven eight nine ten eleven"):
        ids, _ = packing.slice_ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]), encoder, 1)
        assert ids.tolist() == [*library(text.decode()), 1]


@pytest.mark.parametrize("size", [2048, 64])
def test_packed_whole_table(spark, library, size):
    docs = documents(spark, SF)
    got = packing.pack(docs.repartition(3), Shared(spark), word_file(), size).collect()
    check_packed(got, {r.doc_id: r.text for r in docs.collect()}, library, size)


def test_packed_neighbours_are_alike(spark, table):
    """Documents of two kinds hardly share sequences, though their rows alternate."""
    kinds = ["alpha beta gamma delta epsilon zeta eta theta", "uno dos tres cuatro cinco seis siete ocho"]
    docs = table(*[(i, " ".join(random.Random(i).choices(kinds[i % 2].split(), k=40))) for i in range(200)])
    by = defaultdict(set)
    for r in packing.pack(docs, Shared(spark), word_file(), 128).collect():
        by[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(x) > 1 for x in by.values()) <= 0.1 * len(by)


def test_packed_odd_rows(spark, odd, table, library):
    one = odd.where("doc_id is not null and doc_id <> 9")
    check_packed(packing.pack(one, Shared(spark), word_file()).collect(), {r.doc_id: r.text for r in one.collect()}, library, 2048)
    everything = packing.pack(odd, Shared(spark), word_file())
    assert everything.agg(F.sum("length")).first()[0] == sum(len(library(r.text)) + 1 for r in odd.collect())
    assert packing.pack(table(), Shared(spark), word_file()).isEmpty()


def test_packing_query(spark, library):
    got = packing.op11_packing(spark, SF)
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    for r in got.collect():
        part = [*library(texts[r.doc_id]), 1][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


# ---- 12 periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(draw):
    letters = "abcde"[:draw.choice([1, 2, 2, 3, 5])]
    n, out = draw.randint(0, 100), []
    if draw.random() < 0.4:
        return draw.choices(letters, k=n)
    while len(out) < n:
        root = draw.choices(letters, k=draw.randint(1, 12))
        if draw.random() < 0.5:
            root = root * draw.randint(1, 4) + draw.choices("abcde", k=draw.randint(0, 2))
        out += root * draw.randint(1, 7)
    return out


def test_runs_against_brute_force(spark, table):
    draw = random.Random(12)
    texts = [repetitive(draw) for _ in range(1500)]
    docs = table(*[(i, draw.choice(SPACE).join(t)) for i, t in enumerate(texts)])
    for r in periodic.periodic_runs(docs).collect():
        want = brute_runs(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == brute_collapsed(texts[r.doc_id], want)


def test_wavelet_tree():
    draw = np.random.default_rng(4)
    values = draw.permutation(1000)
    tree = periodic.WaveletTree(values, 10)
    low = draw.integers(0, 1000, 500)
    high = np.minimum(1000, low + draw.integers(0, 60, 500))
    x = draw.integers(0, 1001, 500)
    got = tree.successor(low, high, x)
    for a, z, least, y in zip(low, high, x, got, strict=True):
        assert y == min((v for v in values[a:z] if v >= least), default=1024)


def test_long_periods_in_a_long_text(spark, table):
    root = prose(5, 4000)
    text = prose(6, 777) + " " + " ".join([root] * 4) + " " + " ".join(root.split()[:123]) + " end " + "x " * 50_000
    r = periodic.periodic_runs(table((1, text))).first()
    assert [tuple(x) for x in r.runs] == [(777, 16_123, 4000), (16_901, 50_000, 1)]


def test_runs_odd_rows(spark, odd, table):
    got = periodic.periodic_runs(odd)
    assert got.count() == odd.count()
    assert rows(got.where("doc_id in (1, 2, 3)"), F.size("runs"), "collapsed") == [(0, "")] * 3
    assert rows(got.where("doc_id = 6"), "runs", "collapsed") == [([(0, 60_000, 1)], "word")]
    assert periodic.periodic_runs(table()).isEmpty()


def contract12(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_query(spark):
    seen = 0
    got = {r.doc_id: r for r in periodic.op12_periodic_runs(spark, SF).collect()}
    docs = documents(spark, SF).collect()
    assert len(got) == len(docs)
    for d in docs:
        words = contract12(d.doc_id, d.text)
        if len(words) > 1500:
            continue
        r, want = got[d.doc_id], brute_runs(words)
        seen += len(want)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = max(want, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = None if not want else 1000 * best[1] // best[2]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(want), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        assert r.collapsed_sha256 == sha(brute_collapsed(words, want))
    assert seen > 5


# ---- 13 collocations


def brute_collocations(docs, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und" if lang is None else lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, count in f.items():
        cand = {p for p, a in count.items() if len(p) > 1 and a >= least}
        gone = set()
        for q in cand:
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    if 100 * count[q] >= 80 * count[q[i:i + m]]:
                        gone.add(q[i:i + m])
        scored = []
        for p in cand - gone:
            cuts = [(2_000_000 * count[p] // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least", [2, 5])
def test_collocations_against_brute_force(spark, least):
    draw = random.Random(13)
    parts = "New york City of the big é apple a b c".split()
    docs = []
    for i in range(300):
        words = draw.choices(parts, weights=range(1, len(parts) + 1), k=draw.randint(0, 60))
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", "\x1f"]) for w in words)
        docs.append((text, draw.choice(["en", "de", None])))
    df = spark.createDataFrame([*docs, *docs[:20], (None, "en"), ("", None)], "text string, lang string").repartition(5)
    got = collocations.top(collocations.collocations(df, Shared(spark), least))
    want = brute_collocations([*docs, *docs[:20], (None, "en"), ("", None)], least)
    assert len(want) > 50 and sorted(map(tuple, got.select(*COLUMNS).collect())) == want


def test_counts_add_up_over_shards(spark, monkeypatch):
    """Small shards, crowded maps and no broadcast of common parts give the same result."""
    docs = documents(spark, SF)
    want = sorted(map(tuple, collocations.top(collocations.collocations(docs, Shared(spark), 10)).select(*COLUMNS).collect()))
    monkeypatch.setattr(collocations, "SHARD_BYTES", 5_000)
    monkeypatch.setattr(collocations, "MAP_BITS", 1 << 16)
    monkeypatch.setattr(collocations, "HOT", 1)
    assert sorted(map(tuple, collocations.top(collocations.collocations(docs, Shared(spark), 10)).select(*COLUMNS).collect())) == want
    assert want == brute_collocations([(r.text, r.lang) for r in docs.collect()], 10)


def test_phrases_of_an_index():
    draw = np.random.default_rng(8)
    seq = draw.integers(0, 5, 400)
    seq[0] = seq[-1] = 0
    want = Counter(tuple(seq[i:i + m].tolist()) for m in (2, 3, 4) for i in range(len(seq) - m + 1) if (seq[i:i + m] > 0).all())
    got = Counter()
    for words, count in collocations.phrases(seq):
        for phrase, c in zip(zip(*[(w + 1).tolist() for w in words], strict=True), count.tolist(), strict=True):
            assert phrase not in got
            got[phrase] = c
    assert got == want


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a", 1, 9 * 10**12), ("en", "b", 1, 10**13), ("en", "a b", 2, 8 * 10**12 + 1)], "lang string, phrase string, words int, f long")
    n = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    old = collocations._counted
    try:
        collocations._counted = lambda *_: (found, n, 10**14)
        r = collocations.collocations(found, None).first()
    finally:
        collocations._counted = old
    assert r.score == 2_000_000 * (8 * 10**12 + 1) // (19 * 10**12)


def test_collocations_odd_rows(spark, odd, table):
    got = collocations.collocations(odd, Shared(spark), 2)
    texts = [(r.text, r.lang) for r in odd.where("doc_id is null or doc_id <> 5").collect()]
    assert sorted(map(tuple, collocations.top(got).select(*COLUMNS[:-2], "score").collect())) == [x[:6] + x[7:] for x in brute_collocations(texts, 2)]
    assert collocations.collocations(table(), Shared(spark)).isEmpty()
