"""Edit-aware token counts.

A document is held as its pre-tokens' lengths and token counts under a segment
tree: leaves of up to ``LEAF`` pre-tokens, inner nodes with the sums of
characters and tokens below.  An edit (characters from ``start`` to ``end``
become another text) descends by characters to the pre-token it touches, steps
back ``CONTEXT`` pre-tokens, whose look-ahead may reach into the edit, and
splits the new text from there on until a boundary behind the edit falls on an
old one.  From that boundary on nothing can differ, as the pre-token pattern
only looks ahead.  Only the pre-tokens in between are encoded; the sums above
the touched leaves are updated.

Trees are a table (``token_trees``, kept by ``write_trees``): lengths and counts
as little-endian 32-bit integers beside the text, so later edits
(``edit_trees``) start from them without encoding the text again.  Each document
is one row and its edits are in it, so there is no shuffle.

Edits are given in the coordinates of the text as it was, in any order; they
must not overlap (two insertions at one place stand in the order given).

Defined results: a null or empty text has no tokens and an empty tree; edits
past the end are cut to it, and null edits are none; repeated rows give equal
rows; an empty table gives an empty result; other columns pass through ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PATTERN
from .common import materialise
from .pieces import TwoGenerations
from .resident import resident

LEAF = 64
ROWS_AT_ONCE = 500
CONTEXT = 2

Edit = tuple[int, int, str]


class Counter:
    """Tokens of a pre-token, by a file of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = encode
        self.count = TwoGenerations(lambda word: len(encode(word)))
        self.words = regex.compile(PATTERN)


def counter(path: str) -> Counter:
    return resident(("counter", path), lambda: Counter(path))


class CountTree:
    """The pre-tokens of one text, with sums."""

    def __init__(self, text: str, tokens: Counter, lengths: list[int] | None = None, counts: list[int] | None = None):
        self.text, self.tokens, self.encoded = text, tokens, 0
        if lengths is None:
            words = tokens.words.findall(text)
            lengths, counts = list(map(len, words)), list(map(tokens.count.__getitem__, words))
            self.encoded = len(words)
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lengths) // LEAF))
        self.first = 1 << (n - 1).bit_length()  # place of the first leaf
        self.lengths = [lengths[k * LEAF:(k + 1) * LEAF] for k in range(n)]
        self.counts = [counts[k * LEAF:(k + 1) * LEAF] for k in range(n)]
        self.chars, self.sums = [0] * (2 * self.first), [0] * (2 * self.first)
        for k in range(n):
            self.chars[self.first + k], self.sums[self.first + k] = sum(self.lengths[k]), sum(self.counts[k])
        for node in range(self.first - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    def state(self) -> tuple[list[int], list[int]]:
        return [x for leaf in self.lengths for x in leaf], [x for leaf in self.counts for x in leaf]

    def _find(self, char: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token that holds a
        character, or of the end."""
        node, before = 1, 0
        while node < self.first:
            node *= 2
            if char >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.first, len(self.lengths) - 1)
        for place, n in enumerate(self.lengths[leaf]):
            if char < before + n:
                return leaf, place, before
            before += n
        return leaf, len(self.lengths[leaf]), before

    def _back(self, leaf: int, place: int, char: int) -> tuple[int, int, int]:
        """The pre-token before, if there is one."""
        while not place:
            if not leaf:
                return leaf, 0, char
            leaf -= 1
            place = len(self.lengths[leaf])
        return leaf, place - 1, char - self.lengths[leaf][place - 1]

    def edit(self, start: int, end: int, new: str) -> None:
        start, end = min(start, len(self.text)), min(max(start, end), len(self.text))
        leaf, place, char = self._find(start)
        for _ in range(CONTEXT):
            leaf, place, char = self._back(leaf, place, char)
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # Walk the new pre-tokens and the old ones side by side.
        last, old_place, old_end = leaf, place, char
        lengths, counts = [], []
        at = char
        for m in self.tokens.words.finditer(self.text, char):
            at = m.end()
            lengths.append(at - m.start())
            counts.append(self.tokens.count[m.group()])
            if at < start + len(new):
                continue
            last, old_place, old_end = self._forward(last, old_place, old_end, max(end, at - shift))
            if old_end == at - shift and old_end >= end:
                break
        else:  # no boundary in common: the rest of the text is new
            last, old_place = len(self.lengths) - 1, len(self.lengths[-1])
        self.encoded += len(lengths)
        self._splice(leaf, place, last, old_place, lengths, counts)

    def _forward(self, leaf: int, place: int, char: int, to: int) -> tuple[int, int, int]:
        """The first old boundary at or behind `to`."""
        while char < to:
            while place == len(self.lengths[leaf]):
                if leaf + 1 == len(self.lengths):
                    return leaf, place, char
                leaf, place = leaf + 1, 0
            char += self.lengths[leaf][place]
            place += 1
        return leaf, place, char

    def _splice(self, leaf: int, place: int, last: int, end: int, lengths: list[int], counts: list[int]) -> None:
        for rows, new in ((self.lengths, lengths), (self.counts, counts)):
            if leaf == last:
                rows[leaf][place:end] = new
            else:
                rows[leaf][place:] = new
                for k in range(leaf + 1, last):
                    rows[k] = []
                del rows[last][:end]
        if len(self.lengths[leaf]) > 16 * LEAF:
            self._build(*self.state())
            return
        nodes = set()
        for k in range(leaf, last + 1):
            self.chars[self.first + k], self.sums[self.first + k] = sum(self.lengths[k]), sum(self.counts[k])
            nodes.add((self.first + k) // 2)
        while nodes and 0 not in nodes:
            for node in nodes:
                self._add_up(node)
            nodes = {node // 2 for node in nodes}

    def edit_all(self, edits: list[Edit]) -> None:
        """Edits in the coordinates of the text as it is now: from the last on."""
        for _, (start, end, new) in sorted(enumerate(edits), key=lambda e: (e[1][0], e[1][1], e[0]), reverse=True):
            self.edit(start, end, new)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def _packed(values: list[int]) -> bytes:
    return np.array(values, "<u4").tobytes()


def token_trees(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, ``text``, ``n_tokens`` and the tree: ``lengths``
    and ``counts`` of the pre-tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in _slices(batches):
            totals, lengths, counts = [], [], []
            for t in batch.column(len(keep)):
                words = tokens.words.findall(t.as_py() or "")
                own = list(map(tokens.count.__getitem__, words))
                totals.append(sum(own))
                lengths.append(_packed(list(map(len, words))))
                counts.append(_packed(own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(totals, pa.int64()), pa.array(lengths, pa.binary()),
                 pa.array(counts, pa.binary())], names)

    chosen = docs.select(*keep, docs[text].cast("string").alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("lengths", T.BinaryType()),
              T.StructField("counts", T.BinaryType())]
    names = [*chosen.columns, *(f.name for f in fields)]
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields, *fields]))


def write_trees(trees: DataFrame) -> DataFrame:
    """Keep trees in the shared folder, and read them back; small integers of
    four bytes are packed by zstd."""
    return materialise(trees, "token-trees", "zstd")


def edit_trees(trees: DataFrame, path: str, edits: Callable[[str], list[Edit]] | str,
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Apply edits to `trees`: those that a function finds in a text, or those
    in a column of (start, end, text) structs.  Gives `keep`, the new ``text``,
    ``n_tokens``, ``lengths`` and ``counts``, with ``n_before``, ``n_edits``
    and ``n_encoded``, the pre-tokens that were encoded anew."""
    given = [edits] if isinstance(edits, str) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in _slices(batches):
            rows = []
            texts, before, lengths, counts = (batch.column(len(keep) + k) for k in range(4))
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                wanted = ([(e["start"], e["end"], e["text"]) for e in batch.column(len(keep) + 4)[k].as_py() or ()]
                          if given else edits(text))
                if not wanted:
                    rows.append((texts[k].as_py(), before[k].as_py(), lengths[k].as_py(), counts[k].as_py(),
                                 before[k].as_py(), 0, 0))
                    continue
                tree = CountTree(text, tokens, *(np.frombuffer(x[k].as_py(), "<u4").tolist() for x in (lengths, counts)))
                tree.edit_all(wanted)
                state = tree.state()
                rows.append((tree.text, tree.n_tokens, _packed(state[0]), _packed(state[1]), before[k].as_py(),
                             len(wanted), tree.encoded))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)],
                                              *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    chosen = trees.select(*keep, "text", "n_tokens", "lengths", "counts", *given)
    fields = [*chosen.schema.fields[:len(keep) + 4], *(T.StructField(n, T.LongType())
                                                      for n in ("n_before", "n_edits", "n_encoded"))]
    names = [f.name for f in fields]
    return chosen.mapInArrow(run, T.StructType(fields))


_MAIL = re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+")
_DIGITS = re.compile(r"\d(?:[ -]?\d){6,}")


def redactions(text: str) -> list[Edit]:
    """The edits that a cleaning step makes: mail addresses and numbers of
    seven digits or more become placeholders, repeated lines go."""
    edits: list[Edit] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((at, min(len(text), at + len(line) + 1), ""))
        else:
            seen.add(line)
            mails = [m.span() for m in _MAIL.finditer(line)] if "@" in line else []
            edits += ((at + a, at + b, "<mail>") for a, b in mails)
            k = 0  # mails before this one end before the number starts
            for m in _DIGITS.finditer(line):
                a, b = m.span()
                while k < len(mails) and mails[k][1] <= a:
                    k += 1
                if k == len(mails) or b <= mails[k][0]:
                    edits.append((at + a, at + b, "<number>"))
        at += len(line) + 1
    return edits
