"""Byte-level BPE encoding with a contiguous array of adjacent ranks per word, and decoding.

A word is a list of parts and a list with the rank of each adjacent pair. The smallest rank is looked up by a
scan, its boundary is deleted from both lists, and the two neighbouring ranks are refreshed, until no pair of the
word is in the vocabulary. Words of an ordinary text are short, so a scan of a contiguous list is cheaper than a
heap; a word over ``LONG`` parts takes its minima from a heap instead, with the same result in n log n.

Null and empty texts have no ids. Strings of special tokens inside a text become their single id. A text is cut
between words before it is split, so a very long one needs no list of all its words at once.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Fixed value: the pre-tokenisation pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
CACHE = 1 << 18
SEGMENT = 1 << 18
_NONE = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, tokens and special tokens of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, ids = byte_symbols(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [0] * 256
        for s, b in symbols.items():
            self.byte_ids[b] = ids[s]
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left] << 20 | ids[right]] = (rank, ids[left + right])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.rank = {k: r for k, (r, _) in vocabulary.merges.items()}
        self.made = [0] * len(vocabulary.merges)
        for r, i in vocabulary.merges.values():
            self.made[r] = i
        self.byte_ids = vocabulary.byte_ids
        self.words = regex.compile(WORDS)
        self.gap = regex.compile(r"(?<=\S) (?=\S)")
        self.special = vocabulary.special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len)[::-1])) + ")")
        self.known = _Known(self)

    def parts(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG:
            return self._parts_long(ids)
        rank = self.rank.get
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            new = ids[i] = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], _NONE)
        return ids

    def _parts_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j], _NONE) != r:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := rank(ids[a] << 20 | ids[b], _NONE)) < _NONE:
                    heapq.heappush(heap, (new, a))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        found = []
        for piece in self.split.split(text) if self.special else [text]:
            if piece in self.special:
                found.append(np.int32(self.special[piece]).tobytes())
                continue
            at = 0
            while at < len(piece):
                gap = self.gap.search(piece, at + SEGMENT) if len(piece) - at > SEGMENT else None
                end = gap.start() if gap else len(piece)
                found.append(b"".join(map(self.known.__getitem__, self.words.findall(piece[at:end]))))
                at = end
        return b"".join(found)


class _Known(dict):
    """Words met before, in two generations: when the younger is full it becomes the older, and words that are
    still in use come back from there."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.encoder.parts(word.encode())).tobytes()
        if len(word) <= 64:
            self[word] = ids
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
        return ids


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` plus ``ids``, the token ids of ``text``, and ``decoded``, the text decoded from them, if named.
    ``path`` names the vocabulary file, which every machine has (a file of a bounded size, read once per task)."""

    def make():
        vocabulary = Vocabulary(path)
        encoder = Encoder(vocabulary)

        def work(texts):
            made = [encoder.encode(t) if t else b"" for t in texts]
            ends = np.cumsum([0] + [len(m) // 4 for m in made])
            values = pa.array(np.frombuffer(b"".join(made), np.int32))
            out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            if decoded:
                out.append(pa.array([decode_ids(np.frombuffer(m, np.int32), vocabulary.tokens) for m in made], pa.string()))
            return out

        return work

    adds = [T.StructField(ids, T.ArrayType(T.IntegerType(), True))]
    if decoded:
        adds.append(T.StructField(decoded, T.StringType()))
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    return map_rows(docs, [text], kept, T.StructType(adds), make)


def decode_ids(ids: np.ndarray, tokens: list[bytes]) -> str:
    """The text of token ids; bytes that are no UTF-8 become the replacement character."""
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decoder(path: str):
    """A column function from ids to text; null becomes the empty text."""
    state: list[list[bytes]] = []

    @F.pandas_udf("string")
    def decode(ids):
        import pandas as pd

        if not state:
            state.append(Vocabulary(path).tokens)
        return pd.Series([decode_ids(x, state[0]) if x is not None else "" for x in ids])

    return decode


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens and digests of its ids and of the text decoded from them."""
    coded = encode(docs.select(key, text), path, text, "ids", "decoded")
    return coded.select(
        F.col(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
