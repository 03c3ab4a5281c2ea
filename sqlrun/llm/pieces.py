"""Splitting texts at spaces where byte-level BPE never joins both sides.

The pre-token pattern starts a new pre-token at every space that is followed
by a character that is not white space, so such a text can be encoded piece
by piece.  The pieces of many texts are numbered by Arrow, each distinct piece
is encoded once, and the ids are gathered by number.  Pieces are cut further
at line ends and before a last punctuation mark, and their words cached, so
most words are encoded once per worker instead of once per occurrence.  A text
with another white-space character after a space, or with a special token in
it, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Entries of each of a cache's two generations; longer keys are never kept.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64
# Bytes of text whose pieces are numbered together, if nothing else is asked for:
# the more, the fewer pieces come up again, and the more memory a slice takes.
SLICE_BYTES = 4 << 20
# Marks that are, as a run, a pre-token of their own after a letter and before a space.
PLAIN_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class TwoGenerations(dict):
    """A bounded cache of `make(key)`: when it is full it becomes the old
    generation, from which what is still in use comes back."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.old, self.entries = make, {}, entries

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def put_all(self, found: dict) -> None:
        short = {k: v for k, v in found.items() if len(k) <= CACHE_CHARS}
        if len(self) + len(short) <= self.entries:
            self.update(short)
        else:
            for k, v in short.items():
                self.put(k, v)

    def known(self, keys: set) -> dict:
        """Those of `keys` that are here; those of the old generation come back."""
        found = {k: v for k in keys if (v := self.get(k)) is not None}
        back = {k: v for k in keys.difference(found) if (v := self.old.get(k)) is not None}
        self.put_all(back)
        found |= back
        return found


def _line_atoms(lead: str, line: str) -> tuple[str, ...] | None:
    """A line as pre-tokens, if it is a word with or without marks after it."""
    if line.isalpha():  # letters, with a space before them or not, are one pre-token
        return (lead + line,)
    word = line.rstrip(PLAIN_ENDS)
    return (lead + word, line[len(word):]) if word.isalpha() else None


# What a piece that texts can't be split before starts with; nothing is one, too.
_ODD_STARTS = frozenset(["", *filter(str.isspace, map(chr, range(0x10000)))])


def _atoms(lead: str, piece: str) -> tuple[str, ...] | None:
    """A piece as pre-tokens, or None if it needs the pattern.  A line end
    with other than white space on both sides is a pre-token of its own."""
    if "\n" not in piece:
        return _line_atoms(lead, piece)
    out: tuple[str, ...] = ()
    for k, line in enumerate(piece.split("\n")):
        own = _line_atoms("" if k else lead, line)
        if own is None:
            return None
        out += own if not k else ("\n", *own)
    return out


class PieceEncoder:
    """`encode` turns a text into its ids as bytes of `dtype`; `specials` are
    the strings that it treats apart; `encode_words` encodes many pre-tokens
    (letters, with or without a space before them, or marks) at once."""

    def __init__(self, encode: Callable[[str], bytes], specials: list[str], dtype: str,
                 encode_words: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES,
                 slice_bytes: int = SLICE_BYTES):
        self.whole, self.specials, self.dtype = encode, specials, np.dtype(dtype)
        self.encode_words, self.slice_bytes = encode_words, slice_bytes
        self.pieces = TwoGenerations(encode)  # those that need the pattern
        self.words = TwoGenerations(encode, entries)

    def _encode_pieces(self, lead: str, pieces: list[str]) -> list[bytes]:
        """The ids of pieces after `lead` (a space or nothing)."""
        # A piece of letters is its one word.
        parts = [lead + p if p.isalpha() else _atoms(lead, p) for p in pieces]
        own = {x for x in parts if x.__class__ is str}
        own.update(chain.from_iterable(x for x in parts if x.__class__ is tuple))
        found = self.words.known(own)
        if new := list(own.difference(found)):
            fresh = dict(zip(new, self.encode_words(new)))
            self.words.put_all(fresh)
            found |= fresh
        return [found[x] if x.__class__ is str else self.pieces[lead + p] if x is None
                else b"".join([found[w] for w in x]) for p, x in zip(pieces, parts)]

    def encode(self, text: str) -> bytes:
        flat, _ = self._slice(pa.array([text], pa.string()))
        return flat.tobytes()

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' ids (null: none), by slices: flat, and where each text ends."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            base = sizes[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, base + self.slice_bytes, "right")))
            yield self._slice(texts.slice(a, b - a))
            a = b

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets, numbered = offsets - offsets[0], split.flatten().dictionary_encode()
        number = numbered.indices.to_numpy().astype(np.int64)
        distinct = numbered.dictionary.to_pylist()
        # Nothing, or white space, after a space: the text can't be split there.
        odd = np.array([p[:1] in _ODD_STARTS for p in distinct], bool)
        ids = self._encode_pieces(" ", distinct)

        # Each text's first piece has no space before it and is an entry of its own.
        first = offsets[:-1]
        strange = odd[number]
        strange[first] = False
        apart = np.add.reduceat(strange, first) > 0 if len(first) else np.empty(0, bool)
        for special in self.specials:
            apart |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        ids += self._encode_pieces("", [distinct[k] for k in number[first]])
        for k in np.flatnonzero(apart):
            ids[len(distinct) + k] = self.whole(texts[int(k)].as_py())
        if apart.any():  # these are whole in their first entry
            number[np.repeat(apart, np.diff(offsets))] = len(ids)
            ids.append(b"")
        number[first] = len(distinct) + np.arange(len(texts))

        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize  # in ids
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(ids), self.dtype)
        own = lengths[number]
        ends = np.cumsum(own)
        place = np.repeat(starts[number] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
        return flat[place], ends[offsets[1:] - 1] if len(first) else np.empty(0, np.int64)
