"""Phrase collocations from FM-indexes of shards (operator 13).

A phrase is 2 to 4 words inside a piece of a text (punctuation and line ends part pieces); it is a candidate of its
language if it stands there often enough.  A shard is a run of whole texts (about 4 MB) in a task: its pieces, as word
numbers with separators, get an FM-index forwards and backwards.  Intervals of single words are extended by the word
before (forward index) and the word after (backward index); each extension carries its interval in both indexes and its
count.  Counts are summed across shards.

Three passes keep rare phrases out without changing a result, as no part of a phrase is rarer than the phrase: words are
counted; words that are too rare part pieces, and neighbouring pairs are counted; pairs that are too rare part pieces,
and phrases are counted.  Between passes the frequent words (pairs) go to the tasks as one bit each in a map of at most
``MAP_BITS`` bits: a bit shared by chance only lets more through, which the exact counts drop.

Everything after that joins tables of phrases.  A part of phrases that holds at least a thousandth of all words can be
the part of very many phrases; there are at most 1,000 such of a length, so they are broadcast and the rest is joined
by shuffle.

Defined results: null, empty or blank texts have no words; a null language is ``und``; repeated rows count each; null
ids count like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .common import _LOWER, Shared, dictionary, documents, mix, slices, span_hashes

DEPTH = 4
#: A phrase needs so many occurrences in its language.
LEAST = 30
#: A phrase inside a longer candidate with at least so many percent of its occurrences goes.
COVERED_PERCENT = 80
TOP = 2_000
SCALE = 2_000_000
#: A map of frequent words or pairs has at most so many bits (16 MB), and 16 for each entry below that.
MAP_BITS = 1 << 27
SHARD_BYTES = 1 << 22
#: A part with a share of 1 / HOT of all words or more is joined by broadcast: at most HOT of a length.
HOT = 1_000

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_STOP
_WORD[[32, 9]] = False


class Words:
    """The words of a shard in order: symbols (word and language), where pieces begin, and a hash of each symbol."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: pa.Array):
        data = _LOWER[data]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _WORD[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:n]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
        text = np.searchsorted(offsets, start, "right") - 1
        self.begins = np.ones(len(start), bool)
        self.begins[1:] = (text[1:] != text[:-1]) | (stops[start[1:]] != stops[end[:-1]])
        code, self.values = dictionary(data, start, end)
        named = languages.cast(pa.large_string()).fill_null("und").dictionary_encode()
        self.languages = named.dictionary
        self.n_languages = max(1, len(named.dictionary))
        self.symbol = code.astype(np.int64) * self.n_languages + named.indices.to_numpy()[text] if len(start) else np.zeros(0, np.int64)
        raw = lambda x: np.frombuffer(x.buffers()[2] or b"", np.uint8)
        at = lambda x: np.frombuffer(x.buffers()[1], np.int64)[:len(x) + 1]
        of = lambda x: span_hashes(raw(x), at(x)[:-1], at(x)[1:], False) if len(x) else np.zeros(0, np.uint64)
        self.hash = mix(of(self.values)[:, None] + of(self.languages)[None, :] * np.uint64(0x9E3779B97F4A7C15)).reshape(-1)

    def pair_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.hash[a] * np.uint64(0xC2B2AE3D27D4EB4F) + self.hash[b])

    def names(self, symbols: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Language and word of each symbol."""
        language = self.languages.take(pa.array(symbols % self.n_languages)).cast(pa.string())
        return language, self.values.take(pa.array(symbols // self.n_languages)).cast(pa.binary()).cast(pa.string())

    def pieces(self, words: np.ndarray | None = None, pairs: np.ndarray | None = None) -> np.ndarray:
        """The symbols + 1 with a 0 between pieces and at both ends; words and pairs that are not in the maps part pieces."""
        symbol, begins = self.symbol, self.begins
        if words is not None:
            kept = np.flatnonzero(within(words, self.hash)[symbol])
            parted = np.cumsum(begins, dtype=np.int32)
            symbol, begins = symbol[kept], np.ones(len(kept), bool)
            begins[1:] = (np.diff(kept) != 1) | (np.diff(parted[kept]) != 0)
        if pairs is not None and len(symbol):
            begins = begins.copy()
            begins[1:] |= ~within(pairs, self.pair_hash(symbol[:-1], symbol[1:]))
            # a word alone in its piece is in no phrase
            alone = begins & np.append(begins[1:], True)
            symbol, begins = symbol[~alone], begins[~alone]
        at = np.arange(len(symbol)) + np.cumsum(begins)
        out = np.zeros(len(symbol) + int(begins.sum()) + 1, np.int64)
        out[at] = symbol + 1
        return out


def within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a map."""
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class FmIndex:
    """The words before the suffixes of a sequence, suffixes in the order of their first ``depth`` words."""

    def __init__(self, seq: np.ndarray, kinds: int, depth: int):
        n = len(seq)
        order, span, size = seq, kinds, 1
        while size < depth:
            key = order * np.int64(span)
            key[:-size] += order[size:]
            by = np.argsort(key)
            key = key[by]
            order = np.empty(n, np.int32)
            order[by] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)])
            span, size = n, 2 * size
        self.kinds = kinds
        self.before = seq[by - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=kinds))])
        # where each row's word before it stands in the order: words that are equal keep their rows' order
        self.step = np.empty(n, np.int32)
        self.step[np.argsort(self.before.astype(np.int64) * n + np.arange(n))] = np.arange(n, dtype=np.int32)

    def extend(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every extension of the intervals by one word: parent, word, count, its own interval's start in this index,
        and how many rows of the parent have a smaller word, which is its place inside the parent in the other index."""
        total = np.cumsum(size) - size
        row = np.arange(int(size.sum()), dtype=np.int32) + np.repeat((start - total).astype(np.int32), size)
        key = np.repeat(np.arange(len(start)) * self.kinds, size)
        key += self.before[row]
        by = np.argsort(key, kind="stable")
        key = key[by]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(key)))
        parent, word = np.divmod(key[head], self.kinds)
        real = word > 0
        parent, word, count, head = parent[real], word[real], count[real], head[real]
        return parent, word, count, self.step[row[by[head]]], head - total[parent]


def phrases(seq: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The words of every phrase of 2 to ``depth`` words in the pieces of ``seq``, and its count, a length at a time."""
    if len(seq) < 3:
        return
    # numbers without gaps, so that keys stay small
    there = np.zeros(int(seq.max()) + 1, bool)
    there[seq] = True
    symbol = np.flatnonzero(there)
    dense = (np.cumsum(there, dtype=np.int32) - 1)[seq]
    forward, backward = FmIndex(dense, len(symbol), depth), None
    word = np.arange(1, len(symbol))
    size = np.diff(forward.first)[1:]
    ahead, back = forward.first[1:-1], forward.first[1:-1]
    words = [word]
    for length in range(2, depth + 1):
        if length < DEPTH:
            parent, word, size, ahead, inside = forward.extend(ahead, size)
            back = back[parent] + inside
            words = [word, *[w[parent] for w in words]]
        else:
            backward = backward or FmIndex(dense[::-1], len(symbol), depth)
            parent, word, size, back, inside = backward.extend(back, size)
            ahead = ahead[parent] + inside
            words = [*[w[parent] for w in words], word]
        yield [symbol[w] - 1 for w in words], size


def frequent(counts: DataFrame) -> np.ndarray:
    """The map of the hashes ``h`` in a written table: the low bits of a hash name its bit."""
    bits = min(MAP_BITS, max(1 << 16, 1 << (16 * max(1, counts.count()) - 1).bit_length()))
    at = counts.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for row in parts.toLocalIterator():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _shards(batch: pa.RecordBatch) -> Iterator[Words]:
    for a, z, data, offsets in slices(batch.column("text"), SHARD_BYTES):
        yield Words(data, offsets, batch.column("lang")[a:z])


def _counted(docs: DataFrame, shared: Shared, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(lang, phrase, words, f) of frequent words and phrases, (lang, n) of all words, and the count of all words."""
    docs = docs.select("text", "lang")
    context = docs.sparkSession.sparkContext

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _shards(batch):
                count = np.bincount(w.symbol, minlength=len(w.hash))
                there = np.flatnonzero(count)
                lang, word = w.names(there)
                yield pa.RecordBatch.from_arrays([lang, word, pa.array(w.hash[there].view(np.int64)), pa.array(count[there])], names=["lang", "word", "h", "c"])

    counted = docs.mapInArrow(count_words, "lang string, word string, h long, c long")
    # the language's total rides along as the row without a word
    word = F.explode(F.array("word", F.lit(None).cast("string"))).alias("word")
    total = counted.select("lang", word, "h", "c").groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("c").alias("f"))
    words = shared.put(total.where((F.col("f") >= least) | F.col("word").isNull()))
    n = words.where("word is null").select("lang", F.col("f").alias("n"))
    words = words.where("word is not null")
    word_map = context.broadcast(frequent(words))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _shards(batch):
                for (a, b), count in phrases(w.pieces(word_map.value), 2):
                    yield pa.RecordBatch.from_arrays([pa.array(w.pair_hash(a, b).view(np.int64)), pa.array(count)], names=["h", "c"])

    pairs = docs.mapInArrow(count_pairs, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    pairs = shared.put(pairs.select("h"))
    pair_map = context.broadcast(frequent(pairs))

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _shards(batch):
                for parts, count in phrases(w.pieces(word_map.value, pair_map.value)):
                    named = [w.names(p) for p in parts]
                    phrase = pc.binary_join_element_wise(*[x[1] for x in named], " ")
                    yield pa.RecordBatch.from_arrays([named[0][0], phrase, pa.array(np.full(len(count), len(parts), np.int32)), pa.array(count)], names=["lang", "phrase", "words", "c"])

    counted = docs.mapInArrow(count_phrases, "lang string, phrase string, words int, c long")
    found = counted.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    found = shared.put(words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f").union(found))
    word_map.unpersist()
    pair_map.unpersist()
    shared.drop(pairs)
    return found, n, int(n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _with_count(rows: DataFrame, found: DataFrame, part: str, out: str, words: int) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``."""
    found = found.select("lang", F.col("phrase").alias(part), F.col("f").alias(out))
    hot = found.where(F.col(out) * HOT >= words)
    got = rows.join(F.broadcast(hot), ["lang", part], "left")
    rest = got.where(F.col(out).isNull()).drop(out).join(found.where(F.col(out) * HOT < words), ["lang", part])
    return got.where(F.col(out).isNotNull()).unionByName(rest)


def collocations(docs: DataFrame, shared: Shared, least: int = LEAST, covered: int = COVERED_PERCENT) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every candidate that no longer candidate covers.

    A word longer covers as much as any longer one: what stands around a phrase in four words stands around it in three
    at least as often."""
    found, n, words = _counted(docs, shared, least)
    candidates = found.where("words > 1")
    split = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", F.explode(F.array(
        F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " "),
    )).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    open_ = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < covered * F.col("f"), F.lit(True)))
    at = F.sequence(F.lit(1), F.col("words") - 1)
    cuts = open_.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(at).alias("k")).select(
        "*", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
    )
    cuts = _with_count(_with_count(cuts, found, "head", "l", words), found, "tail", "r", words)
    score = F.expr(f"cast(cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    least_cut = F.min(F.struct(F.col("score"), "k", "l", "r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(least_cut.alias("cut"))
    return best.join(n, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def top(rows: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` phrases of each language with their rank; Spark ranks within tasks before it shuffles."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return top(collocations(documents(spark, folder), Shared(spark))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}
SQL = {
    "op13_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, row_number() OVER () AS pid, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, pid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM worded WHERE len(w) > 0
), nexts AS (
  SELECT lang, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z, lead(x, 3) OVER p AS u FROM places WINDOW p AS (PARTITION BY pid ORDER BY i)
), grams AS (
  SELECT lang, x AS phrase, 1 AS m, count(*) AS f FROM nexts GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y AS phrase, 2 AS m, count(*) AS f FROM nexts WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z AS phrase, 3 AS m, count(*) AS f FROM nexts WHERE z IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z || ' ' || u AS phrase, 4 AS m, count(*) AS f FROM nexts WHERE u IS NOT NULL GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), cand AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 30
), inside AS (
  SELECT lang, phrase, max(f) AS around FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE m = 3
    UNION ALL SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' '),
      array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')]) AS phrase FROM cand WHERE m = 4
  ) GROUP BY ALL
), open_ AS (
  SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE i.around IS NULL OR 100 * i.around < 80 * c.f
), common AS (SELECT lang, phrase, f FROM grams WHERE f >= 30
), parted AS (
  SELECT lang, phrase, f AS a, m, w, unnest(range(1, m)) AS k FROM open_
), keyed AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM parted
), cuts AS (
  SELECT o.lang, o.phrase, a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a) // (h.f + t.f) AS score
  FROM keyed o JOIN common h ON h.lang = o.lang AND h.phrase = o.head JOIN common t ON t.lang = o.lang AND t.phrase = o.tail
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM best WHERE nth = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
