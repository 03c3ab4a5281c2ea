"""Byte-level BPE encoding and decoding by a contiguous rank array.

A pre-token is held as an array of parts and an array with the rank of each
pair of neighbours.  The smallest rank is found by scanning; the boundary
between its two parts is deleted, and the ranks of the new part with its left
and right neighbours are refreshed, until no pair has a rank.  Words are
short, so scans over a contiguous array beat any heap; a word of more than
``LONG_WORD`` bytes (a text without spaces) is merged through a heap over
linked neighbours instead, which gives the same merges without quadratic work.

Ids equal those of the tokenizers library for the same file (byte-level
pre-tokenizer without a prefix space, no normaliser, special tokens
recognised in the text, none added).

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows give equal rows; extra columns pass through ``keep``; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import PieceEncoder
from .resident import resident

# Fixed value: the pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_WORD = 256
NO_RANK = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    itself where printable, else the next free code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class RankArrayBPE:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(letters[c] for c in token)
        for token, k in self.specials.items():
            self.bytes_of[k] = token.encode()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.base = len(self.bytes_of)
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] * self.base + vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.words = regex.compile(PATTERN)
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
                                        or r"(?!)")

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        return self._merge_short(parts) if len(parts) <= LONG_WORD else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank_of, base, merged = self.rank.get, self.base, self.merged
        ranks = [rank_of(a * base + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            k = ranks.index(least)
            parts[k] = merged[least]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of(parts[k] * base + parts[k + 1], NO_RANK)
            if k:
                ranks[k - 1] = rank_of(parts[k - 1] * base + parts[k], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        rank_of, base = self.rank.get, self.base
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1)
                if (r := rank_of(parts[k] * base + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if not alive[k] or j >= n or parts[k] != a or parts[j] != b:
                continue  # one of the two has been merged since
            parts[k], alive[j], right[k] = self.merged[r], False, right[j]
            if right[k] < n:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y < n and (s := rank_of(parts[x] * base + parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p, a in zip(parts, alive) if a]

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if text[1:].isalpha() and text[0] == " ":  # letters are one pre-token
            return self._ids(self.merge(text.encode()))
        ids: list[bytes] = []
        at = 0
        for m in self.special_at.finditer(text):
            self._encode_plain(text[at:m.start()], ids)
            ids.append(self._ids([self.specials[m.group()]]))
            at = m.end()
        self._encode_plain(text[at:] if at else text, ids)
        return b"".join(ids)

    def _encode_plain(self, text: str, ids: list[bytes]) -> None:
        ids += (self._ids(self.merge(word.encode())) for word in self.words.findall(text))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def _load(path: str) -> tuple[RankArrayBPE, PieceEncoder]:
    bpe = RankArrayBPE(path)
    return bpe, PieceEncoder(bpe.encode_bytes, list(bpe.specials), "<i4",
                             lambda words: [array("i", bpe.merge(w.encode())).tobytes() for w in words])


def _bpe(path: str) -> RankArrayBPE:
    return resident(("bpe", path), lambda: _load(path))[0]


def _encoder(path: str) -> PieceEncoder:
    return resident(("bpe", path), lambda: _load(path))[1]


def list_column(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list column from all rows' values and where each row ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                     out: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns in `keep` and the ids of each whole text, and in a column
    `decoded`, if named, the text that the ids spell; `path` is the tokenizer
    file on every machine."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            at = 0
            for flat, ends in encoder.encode_many(batch.column(len(keep))):
                own = batch.slice(at, len(ends))
                columns = [*own.columns[:len(keep)], list_column(flat, ends)]
                if decoded:
                    spell, starts = _bpe(path).decode, [0, *ends[:-1].tolist()]
                    columns.append(pa.array([spell(flat[a:b].tolist()) for a, b in zip(starts, ends.tolist())],
                                            pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(ends)

    chosen = docs.select(*keep, text)
    fields = [*chosen.schema.fields[:len(keep)], T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    names, schema = [f.name for f in fields], T.StructType(fields)
    return chosen.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",),
                     out: str = "text") -> DataFrame:
    """The columns in `keep` and the text that the ids spell (null ids: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _bpe(path).decode
        for batch in batches:
            # One document's ids at a time become Python integers.
            texts = pa.array([decode(x.values.to_numpy().tolist() if x.is_valid else ())
                              for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], texts], names)

    chosen = encoded.select(*keep, ids)
    names = [*keep, out]
    schema = T.StructType([*chosen.schema.fields[:len(keep)], T.StructField(out, T.StringType())])
    return chosen.mapInArrow(run, schema)
