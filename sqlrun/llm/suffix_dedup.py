"""Repeated windows by a depth-limited radix sort of suffixes.

Every byte string of ``length`` bytes that starts at two places (in two texts
or in one) is repeated; the bytes that repeated windows cover are removed.

Only the first ``length`` bytes of a suffix matter, and most-significant-digit
passes look at them digit by digit: suffixes that are alone with their digits
leave, the others go on, and those that are equal through the full depth are
the repeated windows.  Three things keep the passes small:

- **Runs.**  The suffix at ``s`` belongs to the anchor ``m(s)``: the place of
  the least hash of 16 bytes among the first places from ``s`` on
  (``RUN_SHARE`` of the window).  It depends on the window alone, so equal windows have their anchors at equal distances, and
  the suffixes of one anchor, a run of neighbours, are sorted together: their
  common digit is what all their windows share, the bytes from the anchor on.
- **Whole runs.**  If the string that spans all windows of a run occurs twice,
  the run is done.  If the common digit occurs once, the run is unique.  Only a
  run with a repeated digit and different spans goes on, cut into blocks of
  ``GRAINS[0]`` suffixes, then into single suffixes, whose digit is the window.
- **One of each class.**  Equal runs go on as one representative that counts
  twice, so a passage in a third of all texts is sorted once below the first pass.

Digits are compared by 64-bit polynomial hashes of two bases, one for the
common digit and one for the span, so equal means equal in 128 bits.  A pass
is an aggregation by digit, combined before its shuffle, and a join back that
AQE splits where a digit is hot.  A text's windows lie in rows of its own, a
few per hundred bytes, and texts are cut into blocks of ``BLOCK`` bytes while
they are scanned.  Texts are known by a 128-bit hash: a text that two rows
hold is repeated as a whole if it has ``length`` bytes, and takes part in the
sort only as a representative.

Whole texts are shuffled only where a bit of a table of bounded size
(``SIEVE_SLOTS``) says that they may have a repeated digit or lose bytes.  Two
texts can share a bit, so a join decides; a fuller table costs shuffling, no rows.

A window can also be a number of words (``words``): of more than that many words
in a row, with the bytes between them, and of any length in bytes.  A text is then
the sequence of its words and the white space between them, each known by two
64-bit hashes; bytes give way to these, and only windows that start with a word
count, from the first byte of the first to the last byte of the last word.

Defined results: a null text is empty; texts shorter than ``length`` keep all
bytes; repeated rows are copies of one another; an empty table gives an empty
result; other columns are not read by the sort and are kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, opened, quoted, sealed, word_count

LENGTH = 400
MAX_LENGTH = 8192    # of windows; the tables of powers are that much longer than a block
RUN_SHARE = 16 / 25  # of a window's length: places among which its anchor is the least
GRAM = 16            # bytes that are hashed to choose anchors
GRAINS = (16, 1)     # suffixes sorted together in the passes after the first
BLOCK = 1 << 18      # starts that are scanned at once
SIEVE_SLOTS = 1 << 19  # of 64 bits each, for texts; broadcast as at most so many rows
_PLACE_BITS = 24

_ROWS = "t1 long, t2 long, anchor long, lo long, hi long, digit long, span long, weight long"


@lru_cache(maxsize=1)
def _constants() -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Random byte values, and the powers of two odd bases and of their
    inverses mod 2**64."""
    rng = np.random.default_rng(20240501)
    n = BLOCK + MAX_LENGTH
    values, powers, inverses = [], [], []
    for _ in range(2):
        values.append(rng.integers(0, 1 << 64, 256, np.uint64))
        base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
        for out, r in ((powers, base), (inverses, pow(base, -1, 1 << 64))):
            steps = np.full(n, r, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
    return values, powers, inverses


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def word_edges(data: np.ndarray) -> np.ndarray:
    """Where the first word starts and ends, the second, and so on."""
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _WHITE[data]
    return np.flatnonzero(white[1:] != white[:-1])


def word_symbols(data: np.ndarray) -> np.ndarray:
    """Two hashes of each word and of the white space up to the next one."""
    values, powers, _ = _constants()
    edges = word_edges(data)
    out = np.empty((2, max(0, len(edges) - 1)), np.uint64)
    a, n = 0, out.shape[1]
    while a < n:
        b = int(np.searchsorted(edges, edges[a] + BLOCK, "right")) - 1
        if b <= a:  # longer than the tables
            whole = xxhash.xxh3_128_intdigest(data[edges[a]:edges[a + 1]].tobytes())
            out[:, a] = whole >> 64, whole & ((1 << 64) - 1)
            a += 1
            continue
        b = min(b, n)
        part, first = data[edges[a]:edges[b]], edges[a:b] - edges[a]
        place = np.arange(len(part)) - np.repeat(first, np.diff(edges[a:b + 1]))
        for which in range(2):
            out[which, a:b] = _mix(np.add.reduceat(values[which][part] * powers[which][place], first))
        a = b
    return out


class Slice:
    """Hashes of substrings of a part of a text that starts at `at`: of its
    bytes, or of two rows of symbols."""

    def __init__(self, data: np.ndarray, at: int = 0):
        values, powers, self.inverses = _constants()
        self.at, self.size = at, data.shape[-1]
        self.sums = []
        for v, p, own in zip(values, powers, data if data.ndim == 2 else (data, data)):
            s = np.zeros(self.size + 1, np.uint64)
            np.cumsum((own if data.ndim == 2 else v[own]) * p[:self.size], out=s[1:])
            self.sums.append(s)

    def hash(self, which: int, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        a, b = start - self.at, end - self.at
        h = (self.sums[which][b] - self.sums[which][a]) * self.inverses[which][a]
        return _mix(_mix(h) + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def anchors(self, n_starts: int, run: int) -> np.ndarray:
        """For each of the first starts of the slice, the place of its anchor."""
        n = n_starts + run - 1
        s, inv = self.sums[0], self.inverses[0]
        grams = _mix((s[GRAM:GRAM + n] - s[:n]) * inv[:n])
        keys = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        # Least of each window: from its start to a block's end, and from there on.
        rows = -(-n // run)
        table = np.full(rows * run, np.iinfo(np.uint64).max, np.uint64)
        table[:n] = keys
        table = table.reshape(rows, run)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n_starts], ahead[run - 1:run - 1 + n_starts])
        return (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + self.at


def _first_runs(data: np.ndarray, length: int, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, lo, hi, digit, span) of all runs of a text."""
    last = data.shape[-1] - length
    for a in range(0, last + 1, BLOCK):
        n = min(BLOCK, last + 1 - a)
        part = Slice(data[..., a:a + n + length - 1], a)
        own = part.anchors(n, run)
        cut = np.flatnonzero(own[1:] != own[:-1])
        lo = np.concatenate(([0], cut + 1)) + a
        hi = np.concatenate((cut, [n - 1])) + a
        anchor = own[lo - a]
        yield (anchor, lo, hi, *_digits(part, anchor, np.zeros(len(anchor), np.int64), lo, hi, length, run))


def _digits(part: Slice, anchor, block, lo, hi, length: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """The digit that all windows of block `block` before the anchor share,
    and the span of the windows from lo to hi."""
    digit = part.hash(0, anchor - block * grain, anchor - block * grain - (grain - 1) + length, block)
    span = part.hash(1, lo, hi + length, (anchor - lo) * 65536 + (anchor - hi))
    return digit, span


def _cut_runs(data: np.ndarray, runs: np.ndarray, length: int, grain: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs (anchor, lo, hi, weight) of a text, cut into blocks of `grain`."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    where = runs[:, 1] // BLOCK
    for b in np.unique(where):
        anchor, lo, hi, weight = runs[where == b].T
        first, final = (anchor - hi) // grain, (anchor - lo) // grain
        times = final - first + 1
        of = np.repeat(np.arange(len(anchor)), times)
        block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        own = anchor[of]
        low = np.maximum(own - block * grain - (grain - 1), lo[of])
        high = np.minimum(own - block * grain, hi[of])
        a = max(0, int(lo.min()) - grain)
        part = Slice(data[..., a:int(hi.max()) + length + grain], a)
        yield (own, low, high, *_digits(part, own, block, low, high, length, grain), weight[of])


def _row_batch(chunks: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in zip(*chunks)],
                                      [x.split()[0] for x in _ROWS.split(", ")])


def _emit(batches: Iterator[pa.RecordBatch], of_text) -> Iterator[pa.RecordBatch]:
    """Rows of every text: `of_text` gives (anchor, lo, hi, digit, span, weight) arrays."""
    chunks: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in range(batch.num_rows):
            for found in of_text(batch, k):
                n = len(found[0])
                chunks.append((np.full(n, t1[k]), np.full(n, t2[k]), *found))
                size += n
                if size >= 1 << 17:
                    yield _row_batch(chunks)
                    chunks, size = [], 0
    if chunks:
        yield _row_batch(chunks)


def _bytes(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[k].as_buffer(), np.uint8)


def _units(batch: pa.RecordBatch, column: int, k: int, by_words: bool) -> np.ndarray:
    data = _bytes(batch, column, k)
    return word_symbols(data) if by_words else data


def _scan_texts(texts: DataFrame, length: int, run: int, by_words: bool) -> DataFrame:
    def rows(batches):
        def of_text(batch, k):
            for found in _first_runs(_units(batch, 2, k, by_words), length, run):
                yield (*found, np.ones(len(found[0]), np.int64))
        return _emit(batches, of_text)
    return texts.select("t1", "t2", "bytes").mapInArrow(rows, _ROWS)


def _scan_runs(texts: DataFrame, length: int, grain: int, by_words: bool) -> DataFrame:
    """`texts` has (t1, t2, bytes, runs)."""
    def rows(batches):
        def of_text(batch, k):
            runs = batch.column(3)[k].values
            table = np.stack([runs.field(i).to_numpy() for i in range(4)], axis=1)
            return _cut_runs(_units(batch, 2, k, by_words), table, length, grain)
        return _emit(batches, of_text)
    return texts.select("t1", "t2", "bytes", "runs").mapInArrow(rows, _ROWS)


def _pass(rows: DataFrame, last: bool, name: str) -> tuple[DataFrame, DataFrame | None]:
    """One digit: (done, on).  Done: (t1, t2, lo, hi) of runs that are
    repeated as a whole.  On: one run of each class whose digit is repeated
    with different spans."""
    stats = (rows.groupBy("digit").agg(F.sum("weight").alias("n"), F.min("span").alias("s0"), F.max("span").alias("s1"))
             .filter(F.col("n") >= 2)
             .select(F.col("digit").alias("d"), (F.col("s0") == F.col("s1")).alias("one_class")))
    tied = materialise(rows.join(stats, F.col("digit") == F.col("d")).drop("d"), f"suffix-{name}")
    whole = tied.filter("one_class").select("t1", "t2", "lo", "hi")
    mixed = tied.filter("not one_class")
    classes = materialise(mixed.groupBy("digit", "span").agg(
        F.sum("weight").alias("n"), F.min(F.struct("t1", "t2", "anchor", "lo", "hi")).alias("one")),
        f"suffix-{name}-classes")
    again = classes.filter("n >= 2").select(F.col("digit").alias("d"), F.col("span").alias("s"))
    members = (mixed.join(again, (F.col("digit") == F.col("d")) & (F.col("span") == F.col("s")))
               .select("t1", "t2", "lo", "hi"))
    done = whole.unionByName(members)
    if last:
        return done, None
    return done, classes.select("one.*", F.least("n", F.lit(2)).alias("weight"))


def _by_text(runs: DataFrame, *columns: str, name: str) -> DataFrame:
    return (runs.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2"))
            .agg(F.collect_list(F.struct(*columns)).alias(name)))


def _same(other_1: str = "k1", other_2: str = "k2"):
    return (F.col("t1") == F.col(other_1)) & (F.col("t2") == F.col(other_2))


def text_key(text) -> list:
    """The two hashes by which a text is known."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _sieve(keys: DataFrame) -> DataFrame:
    """A bit for each text of `keys` (t1, t2), in slots: (slot, bits)."""
    return keys.groupBy(_slot().alias("slot")).agg(F.bit_or(_bit()).alias("bits"))


def _slot() -> Column:
    return F.col("t1").bitwiseAND(F.lit(SIEVE_SLOTS - 1))


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(t2 & 63 as int))")


def _sieved(rows: DataFrame, sieve: DataFrame) -> DataFrame:
    """`rows`, with `maybe` false for texts that are surely not in the sieve."""
    return (rows.join(F.broadcast(sieve), _slot() == F.col("slot"), "left")
            .withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(_bit()) != 0, F.lit(False))))


def _length(length: int, words: int | None) -> int:
    """Of windows: bytes, or words and the white space between them."""
    return length if words is None else 2 * words + 1


def repeated_windows(docs: DataFrame, text: str = "text", length: int = LENGTH,
                     words: int | None = None) -> DataFrame:
    """A row for each distinct text that has repeated windows: (t1, t2,
    copied, spans).  `copied` texts are repeated as a whole; for the
    others, each the text of one row, `spans` holds [lo, hi] of the repeated windows' starts, in bytes or,
    with `words`, in words and white space between words."""
    by_words, length = words is not None, _length(length, words)
    if not 2 * GRAM <= length <= MAX_LENGTH // 2:
        raise ValueError(f"length must be from {2 * GRAM} to {MAX_LENGTH // 2}")
    run = min(round(length * RUN_SHARE), length - GRAM)
    own = F.coalesce(F.col(text), F.lit(""))
    # Of the rows of a text that goes on, those of one hash of the plain columns do.
    plain = [quoted(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name != text]
    enough = word_count(own) > words if by_words else F.lit(True)
    texts = (docs.select(own.cast("binary").alias("bytes"), *text_key(own), enough.alias("enough"),
                         (F.xxhash64(*plain) if plain else F.lit(0).cast("long")).alias("row"))
             .filter(F.octet_length("bytes") >= length))
    kinds = materialise(texts.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2"))
                        .agg(((F.count("*") > 1) & F.max("enough")).alias("copied"), F.min("row").alias("one")),
                        "suffix-texts")
    copied = kinds.filter("copied").select("k1", "k2")

    done, on = _pass(_scan_texts(texts, length, run, by_words), False, "digit1")
    # Copies are settled; what is left of the first pass concerns single texts.
    done = done.join(copied, _same(), "left_anti")
    first = _by_text(done, "lo", "hi", name="spans")
    runs = _by_text(on, "anchor", "lo", "hi", "weight", name="runs")
    wanted = (first.join(runs.withColumnsRenamed({"k1": "r1", "k2": "r2"}),
                         (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "full")
              .select(F.coalesce("k1", "r1").alias("w1"), F.coalesce("k2", "r2").alias("w2"), "spans", "runs"))
    wanted = materialise(wanted.join(kinds, (F.col("w1") == F.col("k1")) & (F.col("w2") == F.col("k2")))
                         .select("w1", "w2", "spans", "runs", "one", "copied"), "suffix-wanted", "zstd")
    # The texts that go on are shuffled once and written, one row of each.
    going = wanted.filter(F.col("runs").isNotNull())
    sieve = _sieve(going.select(F.col("w1").alias("t1"), F.col("w2").alias("t2")))
    kept = materialise(_sieved(texts, sieve).filter("maybe")
                       .join(going, _same("w1", "w2") & (F.col("row") == F.col("one")))
                       .select("t1", "t2", "bytes", "runs"), "suffix-kept-texts", "zstd")

    later = []
    for k, grain in enumerate(GRAINS, 2):
        on_rows = _scan_runs(kept, length, grain, by_words)
        done, on = _pass(on_rows, grain == 1, f"digit{k}")
        later.append(done)
        if on is not None:
            runs = _by_text(on, "anchor", "lo", "hi", "weight", name="runs_on")
            kept = (kept.drop("runs").join(runs, _same()).withColumnRenamed("runs_on", "runs").drop("k1", "k2"))
    more = _by_text(later[0].unionByName(later[1]), "lo", "hi", name="more")
    nothing = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    single = (wanted.filter("not copied").select(F.col("w1").alias("t1"), F.col("w2").alias("t2"), "copied", "spans")
              .join(more, _same(), "left")
              .withColumn("spans", F.concat(F.coalesce("spans", nothing), F.coalesce("more", nothing)))
              .filter(F.size("spans") > 0).select("t1", "t2", "copied", "spans"))
    return materialise(single.unionByName(copied.select(
        F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.lit(True).alias("copied"), nothing.alias("spans"))),
        "suffix-spans", "zstd")


def _removed(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal [from, to) runs of bytes (or words and white space) that the
    windows starting in `spans` cover."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1]) + length
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    return np.stack((spans[new, 0], ends[np.concatenate((new[1:], [True]))]), axis=1)


def _from_words(spans: np.ndarray) -> np.ndarray:
    """Of windows of words and white space in turn, those that start with a word."""
    spans = np.stack((spans[:, 0] + (spans[:, 0] & 1), spans[:, 1] - (spans[:, 1] & 1)), axis=1)
    return spans[spans[:, 0] <= spans[:, 1]]


def _cut(data: bytes, spans: np.ndarray, length: int, by_words: bool) -> tuple[bytes, np.ndarray] | None:
    """What stays of a text and the [from, to) that go; None if all of it stays."""
    if by_words:
        spans = _from_words(spans)
        if not len(spans):
            return None
    gone = _removed(spans, length)
    if by_words:
        gone = word_edges(np.frombuffer(data, np.uint8))[gone]
    stay = zip([0, *gone[:, 1]], [*gone[:, 0], len(data)])
    return b"".join(data[a:b] for a, b in stay), gone


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """A row for each distinct text that loses bytes: (t1, t2, kept, n_removed,
    n_spans), `kept` being the bytes that stay.  A copied text loses all."""
    by_words, size = words is not None, _length(length, words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept, removed, runs = [], [], [], []
            for k in range(batch.num_rows):
                if batch.column(2)[k].as_py():
                    rows.append(k), kept.append(b""), removed.append(None), runs.append(1)
                    continue
                own = batch.column(4)[k].values
                spans = np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], axis=1)
                found = _cut(batch.column(3)[k].as_py(), spans, size, by_words)
                if found is None:
                    continue
                stay, gone = found
                rows.append(k)
                kept.append(stay)
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                runs.append(len(gone))
            where = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array(kept, pa.binary()),
                 pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                ["t1", "t2", "kept", "n_removed", "n_spans"])

    found = repeated_windows(docs, text, length, words)
    single = found.filter("not copied").withColumnsRenamed({"t1": "k1", "t2": "k2"})
    own = F.coalesce(F.col(text), F.lit(""))
    texts = _sieved(docs.select(own.cast("binary").alias("bytes"), *text_key(own)),
                    _sieve(found.filter("not copied"))).filter("maybe")
    whole = (texts.join(single, _same()).select("t1", "t2", "copied", "bytes", "spans")
             .unionByName(found.filter("copied").withColumn("bytes", F.lit(None).cast("binary"))))
    return whole.mapInArrow(cut, "t1 long, t2 long, kept binary, n_removed long, n_spans long")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH,
                    words: int | None = None) -> DataFrame:
    """`docs` with the repeated windows of `length` bytes, or of more than
    `words` words, cut out of the texts.  A character that
    is cut in the middle goes with the cut; null texts stay null."""
    by_words, size = words is not None, _length(length, words)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, copied: pd.Series, bounds: pd.Series) -> pd.Series:
        """What stays of the texts that lose bytes; null for the others."""
        out = []
        for own, whole, pairs in zip(texts, copied, bounds):
            found = None if own is None else _cut(bytes(own), np.reshape(pairs, (-1, 2)), size, by_words)
            out.append("" if whole else None if found is None else found[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    found = repeated_windows(docs, text, length, words)
    own = F.coalesce(F.col(text), F.lit(""))
    rows = _sieved(docs.select(sealed(docs).alias("row"), *text_key(own)), _sieve(found))
    bounds = F.flatten(F.transform("spans", lambda s: F.array(s["lo"], s["hi"])))
    joined = (rows.filter("maybe")
              .join(found.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "copied", bounds.alias("bounds")),
                    _same(), "left"))
    kept = cut(F.when(~F.col("copied"), F.col("row").getField(text).cast("binary")),
               F.coalesce("copied", F.lit(False)), F.coalesce("bounds", F.array().cast("array<bigint>")))
    changed = joined.withColumn("kept_text", kept).select(
        *(F.coalesce("kept_text", F.col("row").getField(c)).alias(c)
          if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
    return changed.union(opened(rows.filter("not maybe"), "row", docs.columns))
