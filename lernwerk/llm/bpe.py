"""BPE encoding and decoding with a segment tree over pair ranks (operator 8).

A word is its symbols in a row.  The leaves of a segment tree hold the rank of each adjacent pair, an inner node the
smaller rank of its two children with its place, the left one on ties; so the root is the leftmost pair of the lowest
rank.  A merge changes two leaves (logarithmic point updates) until the root holds no rank.  Words repeat, so every
task keeps what it has encoded, up to a bound, in front of that.

The vocabulary file's path is a parameter; tasks open it where they run.  Defined results: a null or empty text
encodes to no ids and decodes to the empty text; extra columns are ignored.  A vocabulary or a list of merges of more
than 65,536 entries, and a word of more than 2**24 bytes, do not fit a leaf's bits and raise a ValueError.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, releasing

#: A leaf is rank, place and new symbol in one number: 16, 24 and 16 bits, a word has at most 2**24 bytes.
NONE = 1 << 60
RANK, PLACE = 40, 16
MAX_WORD = 1 << 24
#: Encoded words that a task keeps; it starts anew beyond that.
CACHE_WORDS = 400_000
#: The same in the pipeline, whose executors hold what earlier stages left.
STAGE_CACHE = 50_000
#: Rows whose ids are held at once.
STEP_ROWS = 500


class SegmentTree:
    """Smallest value at the root; point updates.  A value ends in its place, so the left one wins ties."""

    def __init__(self, values: list[int]):
        self.width = width = 1 << max(0, (len(values) - 1).bit_length())
        self.node = node = [NONE] * width + values + [NONE] * (width - len(values))
        for at in range(width - 1, 0, -1):
            left, right = node[2 * at], node[2 * at + 1]
            node[at] = left if left < right else right

    def set(self, h: int, at_h: int, i: int, at_i: int, j: int, at_j: int) -> None:
        """Three neighbouring leaves h <= i <= j at once; paths that meet are walked once."""
        node, width = self.node, self.width
        h, i, j = h + width, i + width, j + width
        node[h], node[j], node[i] = at_h, at_j, at_i
        while i > 1:
            h, i, j = h >> 1, i >> 1, j >> 1
            left, right = node[2 * i], node[2 * i + 1]
            node[i] = left if left < right else right
            if h != i:
                left, right = node[2 * h], node[2 * h + 1]
                node[h] = left if left < right else right
            if j != i:
                left, right = node[2 * j], node[2 * j + 1]
                node[j] = left if left < right else right


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoding and decoding with a vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        self.cache = cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.digits = {i: str(i) for i in self.names}
        if max(len(model["merges"]) - 1, *self.ids.values(), *self.special.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids and ranks of merges must be below 65,536")
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]):
            self.merges.setdefault(self.ids[a] << 16 | self.ids[b], rank << RANK | self.ids[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()
        self.symbol = {b: self.ids[c] for b, c in letters.items()}
        self.last = {b: self.ids[c + self.suffix] for b, c in letters.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        # letter by letter: the final sigma has no form of its own here
        return text.replace("Σ", "σ").lower()

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        ids = [self.symbol[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(ids)
        if n == 1:
            return tuple(ids)
        if n > MAX_WORD:
            raise ValueError(f"a word of {n} bytes; at most {MAX_WORD} are possible")
        find = self.merges.get
        tree = SegmentTree([find(ids[i] << 16 | ids[i + 1], NONE) + (i << PLACE) for i in range(n - 1)])
        node, put = tree.node, tree.set
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := node[1]) < NONE:
            i = least >> PLACE & 0xFFFFFF
            j, h = after[i], before[i]
            new = ids[i] = least & 0xFFFF
            k = after[i] = after[j]
            ids[j] = -1
            if k < n:
                before[k] = i
                at_i = find(new << 16 | ids[k], NONE) + (i << PLACE)
            else:
                at_i = NONE
            # the last symbol has no pair, so its leaf is none anyway
            j = j if j < n - 1 else i
            at_j = NONE if j != i else at_i
            if h >= 0:
                put(h, find(ids[h] << 16 | new, NONE) + (h << PLACE), i, at_i, j, at_j)
            else:
                put(i, at_i, i, at_i, j, at_j)
        return tuple([x for x in ids if x >= 0])

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of what stands between two spaces; words never reach over a space."""
        out: list[int] = []
        for word in self.words.findall(piece):
            got = self.known.get(word)
            if got is None:
                got = self.encode_word(word)
                if len(word) < 64:
                    if len(self.known) >= self.cache:
                        self.known.clear()
                    self.known[word] = got
            out += got
        got = tuple(out)
        if len(piece) < 64:
            if len(self.pieces) >= self.cache:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                have = self.pieces
                for piece in self.normalise(part).replace("\n", " ").split(" "):
                    got = have.get(piece)
                    out += self._piece(piece) if got is None else got
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' names with a space between two, as the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def numbers(self, ids: list[int]) -> str:
        digits = self.digits
        return " ".join([digits[i] for i in ids])


@lru_cache(2)
def codec(path: str, cache: int = CACHE_WORDS) -> WordBpe:
    return WordBpe(path, cache)


def encoded(docs: DataFrame, path: str, with_ids: bool = False, cache: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; with ``with_ids`` also ids and decoded.

    ``cache`` bounds the words whose ids a task keeps; it changes the memory and the time, not the result."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, cache)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in (whole.slice(at, STEP_ROWS) for whole in batches for at in range(0, whole.num_rows, STEP_ROWS)):
            n, a, b, ids, decoded = [], [], [], [], []
            for text in batch.column("text"):
                got = bpe.encode(text.as_py() or "")
                back = bpe.decode(got)
                n.append(len(got))
                a.append(sha(bpe.numbers(got)))
                b.append(sha(back))
                if with_ids:
                    ids.append(got)
                    decoded.append(back)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), schema)


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(documents(spark, folder), word_file())


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The kept documents as token ids with the digests of the round trip."""
    return encoded(docs, word_file(), with_ids=True, cache=STAGE_CACHE).drop("decoded")


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
