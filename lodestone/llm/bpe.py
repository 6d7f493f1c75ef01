"""BPE encoding and decoding by dynamic programming over prefixes.

In a byte-pair encoding the tokens of a text's prefix are a prefix of tokens of some text, so each prefix has one possible
last token. For every prefix the automaton of all token strings gives the tokens that end there; the one that stands at
the very start, or whose pair with the last token of the prefix before it survives the merges, is the prefix's last token.
Following these back from the end gives the encoding without ever running the merges.

A pair survives if no merge across its border comes before the merges that build its two tokens. That is tested by undoing
these merges, the later one first, and looking at the pair of pieces that meets at the border each time; results are kept.

The vocabulary file is one of the `tokenizers` library, of the kind: NFC, lower case, words by pattern, bytes as printable
characters, an end-of-word suffix and no decoder (decoding then joins token strings by blanks). Special tokens are found
in the raw text, as the library does. Words between white space are independent of each other, so each is encoded once
for as long as it stays among the last `CACHE` different words of a Python worker.

Null and empty texts have no tokens; their digests are those of no bytes. Null ids are kept as they are, and rows that
repeat an id or a text are encoded each on their own. Very long texts, and words however long, are encoded in whole, in
memory that grows with the text. An empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import common

CACHE = 400_000
_END = 0x10000  # added to the code of a word's last character


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        pattern = next(p["pattern"]["Regex"] for p in content["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.library = Tokenizer.from_file(path)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.ascii = dict(enumerate(byte_characters()[:128]))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = both
            if both not in self.rank:
                self.rank[both], self.parts[both] = rank, (left, right)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.length: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for string, token in vocab.items():
            units = self.units(string)
            if token in self.parts and not self.survives(*self.parts[token], self.rank[token]) or token not in self.parts and len(units) > 1:
                continue  # the merges never arrive at it
            self.length[token] = len(units)
            self.automaton.add_word(units, token)
        self.automaton.make_automaton()

    def units(self, string: str) -> str:
        if not string.endswith(self.suffix) or string == self.suffix:
            return string
        s = string[: -len(self.suffix)]
        return s[:-1] + chr(ord(s[-1]) + _END)

    def survives(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge across the border of left and right comes before their own last merges, or before the given rank."""
        limit = float("inf") if before is None else before
        rank, parts = self.rank, self.parts
        while True:
            across = self.merged.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = parts[left][1], a
            else:  # of equal pairs the left one is merged first: one across the border goes before right's own
                right, limit = parts[right][0], b + 1

    def encode_piece(self, units: str) -> list[int]:
        last = [-1] * (len(units) + 1)
        length, pairs = self.length, self.pairs
        for end, token in self.automaton.iter(units):
            if last[end + 1] < 0:
                begin = end + 1 - length[token]
                if begin:
                    pair = (last[begin], token)
                    good = pairs.get(pair)
                    if good is None:
                        good = pairs[pair] = self.survives(*pair)
                    if not good:
                        continue
                last[end + 1] = token
        ids, at = [], len(units)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def pieces(self, word: str) -> list[str]:
        """The pieces of text without white space and special tokens, as units of the automaton."""
        if word.isascii():
            found = [p.translate(self.ascii) for p in self.split(word.lower())]
        else:  # the library's own tables of characters
            found = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]
        return [p[:-1] + chr(ord(p[-1]) + _END) for p in found]

    def encode_word(self, word: str) -> list[int]:
        return [i for p in self.pieces(word) for i in self.encode_piece(p)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


class _Words(dict):
    """word -> its ids as little-endian bytes, their decoded text. What has not been asked for since `CACHE` other words came is forgotten."""

    def __init__(self, bpe: PrefixBpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.before: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        if len(self) >= CACHE // 2:
            self.before = dict(self)
            self.clear()
        found = self.before.get(word)
        if found is None:
            parts = []
            for piece in self.bpe.pieces(word):
                part = self.pieces.get(piece)
                if part is None:
                    if len(self.pieces) >= CACHE:
                        self.pieces.clear()
                    if len(self.bpe.pairs) >= 4 * CACHE:
                        self.bpe.pairs.clear()
                    ids = self.bpe.encode_piece(piece)
                    part = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids), self.bpe.decode(ids)
                parts.append(part)
            found = parts[0] if len(parts) == 1 else (b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts]))
        self[word] = found
        return found


@cache
def worker(path: str) -> _Words:
    """The tokenizer of this Python process, with the words that it has met."""
    return _Words(PrefixBpe(path))


_WHITE = regex.compile(r"\p{White_Space}+").split


def encode(text: str, words: _Words) -> tuple[bytes, str]:
    """Ids as little-endian 32-bit numbers, and what they decode to."""
    if words.bpe.at_special and "<" in text and len(parts := words.bpe.at_special(text)) > 1:
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append((words.bpe.special[part].to_bytes(4, "little"), part))
            elif part:
                found.append(encode(part, words))
        found = [x for x in found if x[0]]
    elif any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks to Python, but not to the pattern
        found = [words[w] for w in _WHITE(text) if w]
    else:
        found = [words[w] for w in text.split()]
    return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker(path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for x in b.column("text"):
                ids, decoded = encode(x.as_py() or "", words)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker(path)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                found = [encode(x.as_py() or "", words) for x in part.column("text")]
                ids = [[int.from_bytes(i[p : p + 4], "little") for p in range(0, len(i), 4)] for i, _ in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([x for _, x in found], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
