"""Language ID by interpolated Kneser-Ney character models.

Letters are lower-cased, runs of other characters become one boundary; a
character with the three before it is one 64-bit code, 16 bits for each
(letters beyond U+FFFF share the 6,400 codes of private use).  Tasks count codes
by language, Spark sums the counts over all training documents, and the sums
are written to the shared folder.  Each worker loads them as sorted arrays,
finds codes in them by binary search, and derives by language:

    p(w|abc) = max(n(abcw) - D, 0) / n(abc.) + D N+(abc.) / n(abc.) p(w|bc)

with D = n1 / (n1 + 2 n2), lower orders counting the distinct characters
before a code instead of occurrences, and under all the uniform distribution
over the characters that any language was seen with, and one more.
A text's language is that of the lowest cross-entropy per character; ``score``
is that language's posterior when at most ``CERTAIN_CHARS`` characters count
as independent evidence.

Rejection is calibrated on a tenth of the labelled documents, chosen by a hash
of the text and left out of the counts: the excess of a document's
cross-entropy over its language's mean, times the root of its length (up to
``LONG_CHARS``), has a standard deviation; a document beyond ``REJECT_SD`` of
them, and ``REJECT_EXCESS`` nats per character or more above the mean, is
rejected.  A language without such documents rejects nothing.

Defined results: a null text, or one without letters, is ``und`` with score 0
and rejected; if no labelled document was given, every text is; ties go to the
smaller language by code point; null labels are not learned; repeated rows
count once each; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_path
from .resident import resident

ORDER = 4
CHAR_BITS = 16
# The code points of private use, which are no letters.
PRIVATE_USE, PRIVATE_USES = 0xE000, 6400
CERTAIN_CHARS = 20
LONG_CHARS = 400
REJECT_SD = 8.0
REJECT_EXCESS = 1.0
CALIBRATE_EVERY = 10  # one labelled document in so many calibrates
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"
BLOCK_CHARS = 1 << 20  # characters that are scored at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point of the basic plane, 0 for no letter."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(1 << CHAR_BITS)], np.uint16)


def text_letters(text: str) -> np.ndarray:
    """The letters of a text; runs of other characters as one 0, one at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = np.zeros(len(points) + 2, np.uint16)
    letters[1:-1] = _letters()[np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF):
        letters[k + 1] = PRIVATE_USE + int(points[k]) % PRIVATE_USES if chr(points[k]).isalpha() else 0
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    return letters[keep]


def text_codes(text: str) -> np.ndarray:
    """The codes of a text, one for each character after the first boundary;
    empty if it has no letters."""
    letters = text_letters(text)
    if not letters.any():
        return np.empty(0, np.uint64)
    padded = np.concatenate((np.zeros(ORDER - 2, np.uint16), letters)).astype(np.uint64)
    n = len(padded) - ORDER + 1
    codes = np.zeros(n, np.uint64)
    for k in range(ORDER):
        codes = (codes << np.uint64(CHAR_BITS)) | padded[k:k + n]
    return codes


def _context(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(CHAR_BITS)


def _last(codes: np.ndarray, order: int) -> np.ndarray:
    """The last characters of each code."""
    return codes & np.uint64((1 << CHAR_BITS * order) - 1)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of equal keys; keys are sorted."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(values, starts)


class KneserNey:
    """One language's model: by order, sorted codes and contexts with what
    the formula needs of them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, characters: int):
        """`characters`: how many there are, for the uniform distribution."""
        self.levels, self.uniform = [], 1.0 / characters
        counts = counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 else 0.5
            contexts, totals = _sums(_context(codes), counts)
            _, types = _sums(_context(codes), np.minimum(counts, 1.0))
            self.levels.append((codes, np.maximum(counts - discount, 0), contexts, totals, discount * types / totals))
            if order > 1:
                shorter = np.sort(_last(codes, order - 1))
                codes, counts = _sums(shorter, np.ones(len(shorter)))

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return k, keys[k] == wanted

    def probability(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), self.uniform)
        for order, (keys, mass, contexts, totals, back) in zip(range(1, ORDER + 1), reversed(self.levels)):
            own = _last(codes, order)
            c, seen = self._at(contexts, _context(own))
            k, known = self._at(keys, own)
            p = np.where(seen, np.where(known, mass[k], 0.0) / totals[c] + back[c] * p, p)
        return p


class LanguageModels:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """`counts`: for each language, sorted codes and their counts."""
        self.langs = sorted(counts, key=lambda x: x.encode())
        self.known = np.unique(np.concatenate([c for c, _ in counts.values()] or [np.empty(0, np.uint64)]))
        characters = len(np.unique(_last(self.known, 1))) + 1
        self.models = [KneserNey(*counts[x], characters) for x in self.langs]
        self.log_p = np.empty((len(self.known), len(self.langs)), np.float32)
        for a in range(0, len(self.known), BLOCK_CHARS):
            self.log_p[a:a + BLOCK_CHARS] = self._log(self.known[a:a + BLOCK_CHARS])

    def _log(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.langs)))
        for k, model in enumerate(self.models):
            out[:, k] = np.log(model.probability(codes))
        return out

    def _sum(self, codes: np.ndarray) -> np.ndarray:
        rows = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        new = self.known[rows] != codes
        total = self.log_p[rows[~new]].sum(axis=0, dtype=np.float64)
        if new.any():  # seen in no language
            values, times = np.unique(codes[new], return_counts=True)
            total = total + (self._log(values) * times[:, None]).sum(axis=0)
        return total

    def entropies(self, text: str) -> tuple[int, np.ndarray]:
        """Characters, and the cross-entropy per character by language."""
        codes = text_codes(text)
        if not len(codes) or not self.langs:
            return 0, np.empty(0)
        total = sum(self._sum(codes[a:a + BLOCK_CHARS]) for a in range(0, len(codes), BLOCK_CHARS))
        return len(codes), -total / len(codes)


def _models(uri: str) -> LanguageModels:
    return resident(("languages", uri), lambda: _load(uri))


def _load(uri: str) -> LanguageModels:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    table = pads.dataset(path, filesystem=store, format="parquet").to_table()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    own, codes = langs.indices.to_numpy(), table.column("code").to_numpy().view(np.uint64)
    counts = table.column("n").to_numpy()
    found = {}
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(own == k)
        mine = mine[np.argsort(codes[mine])]
        found[lang] = (codes[mine], counts[mine])
    return LanguageModels(found)


def train_counts(labelled: DataFrame) -> str:
    """Counts of codes by language over all (text, lang) rows, summed by
    Spark; gives the URI of the table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list[np.ndarray]) -> None:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in totals:
                codes, n = np.concatenate((totals[lang][0], codes)), np.concatenate((totals[lang][1], n))
                order = np.argsort(codes, kind="stable")
                codes, n = _sums(codes[order], n[order])
            totals[lang] = codes, n

        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if len(codes := text_codes(text.as_py())):
                    parts.setdefault(lang, []).append(codes)
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    if sizes[lang] >= BLOCK_CHARS:
                        add(lang, parts.pop(lang))
                        sizes[lang] = 0
            for lang, rest in parts.items():
                add(lang, rest)
        for lang, (codes, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int8))),
                                              pa.array(codes.view(np.int64)), pa.array(n, pa.int64())],
                                             ["lang", "code", "n"])

    uri = shared_path(labelled.sparkSession, "language-counts")
    (labelled.select("text", "lang").mapInArrow(count, "lang string, code long, n long")
     .groupBy("lang", "code").agg(F.sum("n").alias("n")).write.parquet(uri))
    return uri


def predict(docs: DataFrame, uri: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` (the text may be one), ``lang_pred``, ``score``,
    ``entropy`` (nats per character, null if `und`) and ``chars``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(uri)
        for batch in batches:
            rows = []
            for t in batch.column(place):
                n, e = models.entropies(t.as_py() or "")
                if not n:
                    rows.append((UNKNOWN, 0.0, None, 0))
                    continue
                best = int(np.argmin(e))
                rows.append((models.langs[best], float(1 / np.exp((e[best] - e) * min(n, CERTAIN_CHARS)).sum()),
                             float(e[best]), n))
            pred = [pa.array(x, k) for x, k in zip(zip(*rows), types)] if rows else [pa.array([], k) for k in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *pred], names)

    types = (pa.string(), pa.float64(), pa.float64(), pa.int64())
    chosen = docs.select(*keep) if text in keep else docs.select(*keep, text)
    place = chosen.columns.index(text)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("entropy", T.DoubleType()), T.StructField("chars", T.LongType())]
    names = [*keep, *(f.name for f in fields)]
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:len(keep)], *fields]))


def identify(docs: DataFrame, train, text: str = "text", lang: str = "lang",
             keep: tuple[str, ...] = ("doc_id",), reject_sd: float = REJECT_SD) -> DataFrame:
    """Learn from the rows where the column `train` holds, then give every row
    of `docs` its language: the columns in `keep`, and those of ``predict``
    with ``rejected``."""
    learn = train & F.col(lang).isNotNull() & F.col(text).isNotNull()
    calibrate = F.pmod(F.xxhash64(F.col(text)), F.lit(CALIBRATE_EVERY)) == 0
    uri = train_counts(docs.filter(learn & ~calibrate).select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    label = F.when(learn & calibrate, F.col(lang)).alias("__label")
    wanted = keep if text in keep else (*keep, text)
    scored = materialise(predict(docs.select(*wanted, label), uri, text, (*keep, "__label")), "languages", "zstd")
    own = scored.filter(F.col("__label") == F.col("lang_pred"))
    # One aggregation: the mean m of e, and that of r^2 (e - m)^2 from its three parts.
    reach = F.sqrt(F.least(F.col("chars"), F.lit(LONG_CHARS)))
    weight, e = reach * reach, F.col("entropy")
    spread = F.avg(weight * e * e) - 2 * F.avg(e) * F.avg(weight * e) + F.avg(e) * F.avg(e) * F.avg(weight)
    known = materialise(own.groupBy(F.col("lang_pred").alias("of")).agg(
        F.avg(e).alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sd")), "language-calibration")
    few = known.count() <= BROADCAST_LANGUAGES
    known = known.select(F.struct("of", "mean", "sd").alias("__known"))
    k = F.col("__known")
    excess = F.col("entropy") - k["mean"]
    strange = (excess * reach > k["sd"] * reject_sd) & (excess >= REJECT_EXCESS)
    return (scored.join(F.broadcast(known) if few else known, F.col("lang_pred") == k["of"], "left")
            .withColumn("rejected", F.col("entropy").isNull() | F.coalesce(strange, F.lit(False)))
            .drop("__label", "__known"))
