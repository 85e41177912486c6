"""Byte-pair encoding with a queue of merge ranks over a linked list of symbols, and its decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read_table

#: Words whose encodings a worker remembers in each of two generations, and the longest such word.
REMEMBERED = 200_000
REMEMBERED_LENGTH = 64
#: Room for a symbol id in a pair's number, and for a place in a queue entry.
PAIR_BITS, PLACE_BITS = 20, 32
#: Texts below the first two code points take plain ways; the last is beyond all code points.
ASCII, LATIN, ALL = 0x80, 0x180, 0x110000
_BEYOND_LATIN = re.compile(r"[^\x00-\u017f]")


@cache
def classes(upto: int) -> dict[str, str]:
    """Letters, numbers and white space below a code point, as insides of a bracket expression.

    The library is asked for each code point's class, as its tables of Unicode are its own: neither
    Python's nor those of another engine are of the same age.  All code points take about two seconds,
    once per worker, and only if a text needs them.
    """
    names = (r"\p{L}", r"\p{N}", r"\s")
    split = lambda p, text: [at for _, at in tokenizers.pre_tokenizers.Split(tokenizers.Regex(p), "removed", invert=True).pre_tokenize_str(text)]
    every = "".join(map(chr, (c for c in range(upto) if not 0xD800 <= c < 0xE000)))
    runs = split("|".join(f"{n}+" for n in names), every)
    firsts = "".join(every[a] for a, _ in runs)
    kind = {a: n for n in names for a, _ in split(n, firsts)}
    out = dict.fromkeys(names, "")
    for k, (a, b) in enumerate(runs):
        out[kind[k]] += f"\\U{ord(every[a]):08x}-\\U{ord(every[b - 1]):08x}"
    return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class WordBPE:
    """A tokenizer read from a ``tokenizers`` JSON file: word-level BPE with a word-end suffix.

    Supports what the public files of this kind hold: NFC, white space to one space, lower case, a
    split pattern whose matches are kept, byte-level letters, BPE without an unknown token, and special
    tokens that are found in the text as given.  Beyond ``LATIN`` texts are normalised by the file's own
    normaliser in the library, and the split pattern's classes are the library's (``classes``), so that
    marks and letters of any age are ordered and told apart as there.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.names = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.special_at = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # letters begin no other alternative, so they can be tried first
        self.pattern = "|".join(sorted(pattern.split("|"), key=lambda p: not p.startswith(r"[\p{L}]")))
        self.words = {upto: self.splitter(upto) for upto in (ASCII, LATIN)}
        self.normaliser = tokenizers.Tokenizer.from_file(path).normalizer
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.vocab[left] << PAIR_BITS | self.vocab[right]] = rank
            self.made.append(self.vocab[left + right])
        letters = byte_letters()
        self.inner = [self.vocab.get(c, -1) for c in letters]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in letters]
        self.memory: dict[str, tuple[int, bytes, str]] = {}
        self.older: dict[str, tuple[int, bytes, str]] = {}

    def splitter(self, upto: int) -> re.Pattern:
        """The split pattern with classes spelled out below a code point."""
        pattern = self.pattern
        for name, inside in classes(upto).items():
            pattern = pattern.replace(name, inside)
        return re.compile(pattern)

    def split(self, text: str) -> list[str]:
        """The words of a text in NFC and lower case.  White space need not be made plain: no word has any.

        Nothing below ``LATIN`` changes in NFC, and lower case is the same in all tables there.
        """
        if text.isascii():
            return self.words[ASCII].findall(text.lower())
        if not _BEYOND_LATIN.search(text):
            return self.words[LATIN].findall(text.lower())
        if ALL not in self.words:
            self.words[ALL] = self.splitter(ALL)
        return self.words[ALL].findall(self.normaliser.normalize_str(text))

    def merge(self, word: str) -> list[int]:
        """The ids of one word.

        Symbols form a doubly linked list; a queue holds the rank and the place of every pair that can
        merge, as one number.  An entry whose pair has changed since it was queued is stale and is skipped.
        """
        data = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        symbol = [inner[b] for b in data]
        symbol[-1] = self.final[data[-1]]
        if min(symbol) < 0:
            symbol = [s for s in symbol if s >= 0]
        n = len(symbol)
        if n < 2:
            return symbol
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        rank_of, made = self.ranks.get, self.made
        queue = [r << PLACE_BITS | i for i in range(n - 1) if (r := rank_of(symbol[i] << PAIR_BITS | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push, place = heapq.heappop, heapq.heappush, (1 << PLACE_BITS) - 1
        while queue:
            entry = pop(queue)
            i, rank = entry & place, entry >> PLACE_BITS
            j = after[i]
            if j < 0 or symbol[i] < 0 or rank_of(symbol[i] << PAIR_BITS | symbol[j]) != rank:
                continue
            new = symbol[i] = made[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << PAIR_BITS | symbol[k])) is not None:
                    push(queue, r << PLACE_BITS | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << PAIR_BITS | new)) is not None:
                push(queue, r << PLACE_BITS | h)
        return [s for s in symbol if s >= 0]

    def word(self, word: str) -> tuple[int, bytes, str]:
        """Number of ids, the ids as little-endian 32-bit integers, and their vocabulary strings."""
        got = self.older.get(word)
        if got is None:
            ids, names = self.merge(word), self.names
            got = len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([names[i] for i in ids])
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.memory) >= REMEMBERED:
                self.older, self.memory = self.memory, {}
            self.memory[word] = got
        return got

    def pieces(self, text: str) -> Iterator[tuple[int, bytes, str]]:
        """``word()`` of every word and special token of a text."""
        at, memory, word = 0, self.memory, self.word
        ends = [(m.start(), m.end()) for m in self.special_at.finditer(text)] if self.special_at and "<" in text else []
        for start, end in [*ends, (len(text), len(text))]:
            for w in self.split(text[at:start] if ends else text):
                yield memory.get(w) or word(w)
            if end > start:
                s = text[start:end]
                yield 1, struct.pack("<I", self.special[s]), s
            at = end

    def encode(self, text: str | None) -> list[int]:
        data = b"".join(p[1] for p in self.pieces(text or ""))
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, put together with spaces as a file without decoder has it."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@cache
def load(path: str) -> WordBPE:
    """One tokenizer per Python worker."""
    return WordBPE(path)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` for every row."""
    path = path or public_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            decoded = pa.array([bpe.decode(i) for i in ids], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.list_(pa.int32())), decoded], names=["doc_id", "ids", "decoded"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row.

    One narrow pass, no shuffle.  The tokenizer file is opened by each worker and must lie at the same
    path on every machine (it comes with the installed package by default).

    Defined cases: a null text counts as empty; an empty text, or one without any word, has no ids and
    an empty decoded text; repeated rows and null ids give one row each; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    path = path or public_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            counts, ids, decoded = [], [], []
            for text in b.column(1).to_pylist():
                parts = list(bpe.pieces(text or ""))
                counts.append(sum(p[0] for p in parts))
                ids.append(hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[2] for p in parts if p[0]]).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))
