"""Fuzzy search for short licence notices.

A text is lower-cased (A-Z) and reduced to its words with one space between
them.  A notice of ``n`` characters may differ by ``k = n // EDIT_EVERY``
edits (none for one shorter than ``EDIT_EVERY``: an edit turns "cc by nd", another
licence, into "cc by nc"); cut into ``k + 1`` pieces, at least one piece stands unchanged in
every match (pigeonhole).  One Aho-Corasick pass over the text finds all
pieces of all notices; each hit gives the stretch in which the notice would
lie.  Unchanged notices are read off the same hits, overlapping ones included.
In the stretches a bit-parallel edit distance (Myers) finds all places on word
boundaries within ``k`` edits.  Of places that overlap, the one with the fewest
edits is taken, then the one that starts, then that ends first; a place beside
a better one is not lost.

The work is one pass per document inside its own task; nothing is shuffled.

Defined results: a null or empty text has no words, no spans and score 0; a
text without words likewise; repeated rows give equal rows; words of any
length are compared whole; an empty table gives an empty result; other columns
pass through ``keep``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The phrases whose unchanged places are counted, and their labels.
BASE_NOTICES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Further notices, found with or without edits.
MORE_NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("cc-by", "creative commons attribution"),
    ("reserved", "all rights reserved"),
)
EDIT_EVERY = 10  # characters of a notice for each edit allowed

_NOT_IN_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_SPACED = bytes.maketrans(_NOT_IN_WORD, b" " * len(_NOT_IN_WORD))

SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("edits", T.IntegerType())])


def normalise(text: str) -> bytes:
    """Space, then every word followed by a space."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class NoticeSearch:
    """Finds spans of `notices` ((label, words) pairs) in normalised texts."""

    def __init__(self, notices: tuple[tuple[str, str], ...], edit_every: int = EDIT_EVERY):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        self.fuzzy = []
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, phrase) in enumerate(notices):
            k = len(phrase) // edit_every
            cuts = [len(phrase) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(phrase[a:b], []).append((n, a))
            masks: dict[str, int] = {}
            for at, c in enumerate(phrase):
                masks[c] = masks.get(c, 0) | 1 << at
            self.fuzzy.append((k, masks))
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def _ends(self, n: int, text: str, lo: int, hi: int, anchored: bool) -> list[tuple[int, int]]:
        """(end, edits) of the word ends before `hi` where a place of the
        notice ends that starts at `lo` (anchored), or anywhere from there on."""
        (k, masks), size = self.fuzzy[n], len(self.notices[n][1])
        full, top, first = (1 << size) - 1, 1 << size - 1, int(anchored)
        up, down, score, found = full, 0, size, []
        for j in range(lo, hi):
            c = text[j]
            if c == " " and score <= k:
                found.append((j, score))
            same = masks.get(c, 0)
            zero = ((same & up) + up ^ up) | same | down
            more, less = (down | ~(zero | up)) & full, up & zero
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            more = more << 1 | first
            up, down = (less << 1 | ~(zero | more)) & full, more & zero & full
        return found

    def _edited(self, n: int, text: str, lo: int, hi: int, exact: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the edited places of a notice in a stretch
        whose unchanged places start at `exact`."""
        k, size = self.fuzzy[n][0], len(self.notices[n][1])
        starts = {at for end, _ in self._ends(n, text, lo, hi, False)
                  for at in range(max(lo, 1, end - size - k), end - size + k + 1) if text[at - 1] == " "}
        places = sorted((edits, at, end) for at in starts
                        for end, edits in self._ends(n, text, at, min(hi, at + size + k + 1), True) if edits)
        taken = [(at, at + size) for at in exact]
        for edits, at, end in places:
            place = bisect_left(taken, (at, end))
            if (not place or taken[place - 1][1] <= at) and (place == len(taken) or end <= taken[place][0]):
                taken.insert(place, (at, end))
                yield at, end, edits

    def spans(self, norm: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, first word, last word, edits), by place."""
        text = norm.decode("latin-1")
        exact: dict[int, set[int]] = {}
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for n, a in where:
                phrase, at = self.notices[n][1], end + 1 - size - a
                if at > 0 and text.startswith(f" {phrase} ", at - 1):
                    exact.setdefault(n, set()).add(at)
                if k := self.fuzzy[n][0]:
                    hits.setdefault(n, []).append((max(0, at - k - 1), min(len(text), at + len(phrase) + k + 1)))
        found = [(n, at, at + len(self.notices[n][1]), 0) for n, places in exact.items() for at in places]
        for n, own in hits.items():
            stretches: list[list[int]] = []
            for lo, hi in sorted(own):
                if stretches and lo <= stretches[-1][1]:
                    stretches[-1][1] = max(hi, stretches[-1][1])
                else:
                    stretches.append([lo, hi])
            places = sorted(exact.get(n, ()))
            for lo, hi in stretches:
                inside = places[bisect_left(places, lo):bisect_left(places, hi)]
                found += [(n, *place) for place in self._edited(n, text, lo, hi, inside)]
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(spaces, at)) - 1
        return sorted({(n, word(a), max(word(a), word(b)), e) for n, a, b, e in found},
                      key=lambda s: (s[1], s[2], s[0], s[3]))


@lru_cache(maxsize=4)
def _search(notices: tuple[tuple[str, str], ...], edit_every: int) -> NoticeSearch:
    return NoticeSearch(notices, edit_every)


def scan_notices(docs: DataFrame, notices: tuple[tuple[str, str], ...] = BASE_NOTICES + MORE_NOTICES,
                 edit_every: int = EDIT_EVERY, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, ``n_words``, and ``spans``: each place of a
    notice with its label, words (from 0) and edits; words are cut as above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(notices, edit_every)
        for batch in batches:
            n_words, spans = [], []
            for t in batch.column(len(keep)).to_pylist():
                norm = normalise(t or "")
                n_words.append(norm.count(b" ") - 1)
                spans.append([{"label": notices[n][0], "notice": notices[n][1], "first_word": a,
                               "last_word": b, "edits": e} for n, a, b, e in search.spans(norm)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(n_words, pa.int64()), pa.array(spans, span_type)], names)

    span_type = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()),
                                    ("last_word", pa.int64()), ("edits", pa.int32())]))
    chosen = docs.select(*keep, text)
    names = [*keep, "n_words", "spans"]
    schema = T.StructType([*chosen.schema.fields[:len(keep)], T.StructField("n_words", T.LongType()),
                           T.StructField("spans", T.ArrayType(SPAN))])
    return chosen.mapInArrow(run, schema)
