"""Source divergence audit: how far the sources of a language are apart.

Each language keeps the terms that stand in at least ``MIN_DOCUMENTS`` of its
documents; a group (language, source) gives each of these V terms, found there
or not, the smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)).  Two
groups are apart by the sum of f = floor((p - q)^2 / (p + q)) over all V terms.

That is a product of the sparse (group x term) table with its transpose, done
by rows (Gustavson): the table is cut into blocks of terms, each block holds a
term-major index (term -> the groups that have it, with their p), and each group
scatters its terms through that index into a dense accumulator over its
peers.  Per-term pairs of postings are never emitted: a block emits one sum
for each pair of groups.  Terms that a group lacks are not zero here but p0,
its share at count 0.  So with f00 = f(p0, q0) the accumulators hold what differs
from that baseline, and the sum over all V terms is exactly

    V f00 + sum over i's terms of (f(p, q0) - f00) + sum over j's of (f(p0, q) - f00)
          + sum over shared terms of (f(p, q) - f(p, q0) - f(p0, q) + f00).

Tasks count terms in bounded dictionaries, Spark sums them, so a source or a
language with a third of all rows is summed before it is shuffled; blocks are
by (language, hash of the term), as many as the language's rows need.  All
figures are whole numbers: shares by exact decimals, sums in 64 bits.

Defined results:
- null text, lang and source are empty; rows count once each, repeated or not;
- a group without kept terms has p0 everywhere; without any kept term in its
  language all its distances are 0;
- texts are read whole, a MiB at a time; ties go by the item's UTF-8 bytes;
- an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

# Terms and cuts of a text in lower-cased UTF-8; all bytes of characters
# beyond ASCII are over 0x7F.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
SLICE_BYTES = 1 << 20
HELD_TERMS = 200_000       # entries that a counting task holds before it emits them
BLOCK_ROWS = 100_000       # rows of a block, on average
SCATTERED = 1 << 20        # products that are computed at once
PEERS_AT_ONCE = 1000       # groups of a language that one task pairs with all others
# Largest tables of languages and of groups that are broadcast (rows under 200 bytes,
# but for names).
BROADCAST_ROWS = 20_000


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    text = text.lower()  # of bytes: A-Z only
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE_BYTES) if start + SLICE_BYTES < len(text) else None
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, start, end)
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), with one row
    without a term for each group that a batch holds."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.binary()).cast(pa.string()),
                pa.array([source] * len(terms), pa.binary()).cast(pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(docs[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        lang, source, text = (batch.column(c).cast(pa.large_binary()) for c in range(3))
        for k in range(batch.num_rows):
            group = lang[k].as_py() or b"", source[k].as_py() or b""
            n, docs = held.setdefault(group, (Counter(), Counter()))
            before, own = len(n), set()
            for terms in text_terms(text[k].as_py() or b""):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size >= HELD_TERMS:
                yield from emit()
                size = 0
    yield from emit()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) -> n, docs; each group has a row with a null term too."""
    empty = F.lit("")
    read = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text")
    return (read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(SCALE)
    return F.call_function("div", above, (total + 2 * kept).cast("decimal(20,0)")) + 1


def shares(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """`docs` (lang, source, text) -> the groups (lang, source, g, kept, p0),
    g numbering a language's sources from 0, and the rows (lang, source, g,
    term, p, q, blocks) of their kept terms; q is the language's share."""
    counts = materialise(term_counts(docs), "divergence-counts")
    kept = materialise(counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
                       .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("groups"))
                       .filter(F.col("docs") >= min_documents).select("lang", "term", "lang_n", "groups"),
                       "divergence-kept")
    langs = materialise(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"),
                                                 F.ceil(F.sum("groups") / BLOCK_ROWS).cast("int").alias("blocks")),
                        "divergence-langs")
    found = materialise(counts.join(kept.select("lang", "term", "lang_n"), ["lang", "term"]), "divergence-found")

    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.filter(F.col("term").isNull()).select("lang", "source")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.lit(0).cast("long")
    groups = (every.join(totals, ["lang", "source"], "left").join(_small(langs), "lang", "left")
              .withColumn("kept", F.coalesce("kept", zero)).withColumn("total", F.coalesce("total", zero))
              .withColumn("g", number)
              .withColumn("p0", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))))
    groups = materialise(groups, "divergence-groups")
    rows = found.join(_small(groups), ["lang", "source"]).select(
        "lang", "source", "g", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "blocks")
    return groups, materialise(rows, "divergence-shares")


def apart(p, q):
    """f of the shares p and q, of arrays or columns."""
    return (p - q) * (p - q) // (p + q)


def _row_sums(g: int, p: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """Over all peers: the sum over g's terms of f(p, q0) - f00.  Equal shares
    are taken together."""
    values, times = np.unique(p, return_counts=True)
    out = -len(p) * apart(p0[g], p0)
    width = max(1, SCATTERED // len(p0))
    for at in range(0, len(values), width):
        out += times[at:at + width] @ apart(values[at:at + width, None], p0[None, :])
    return out


def _scatter(start: np.ndarray, length: np.ndarray, own: np.ndarray, mine: int,
             peer: np.ndarray, p: np.ndarray, p0: np.ndarray, into: np.ndarray) -> None:
    """Add what a group's terms share with the peers in their postings: slices
    (start, length) of the index, `own` the group's share of each term."""
    ends = np.cumsum(length)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SCATTERED, "right")))
        n = length[at:to]
        places = np.arange(n.sum()) + np.repeat(start[at:to] - (ends[at:to] - n - done), n)
        a, b, j = np.repeat(own[at:to], n), p[places], peer[places]
        np.add.at(into, j, apart(a, b) - apart(a, p0[j]) - apart(b, p0[mine]) + apart(p0[mine], p0[j]))
        at = to


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of a language's terms: rows (g, term, p), and (g, null, p0)
    for every group of the language -> sums (a, b, value), a < b."""
    table = pa.Table.from_batches(list(batches))
    group = table.column("g").to_numpy().astype(np.int64)
    value = table.column("p").to_numpy().astype(np.int64)
    lang = table.column("lang")[0].as_py()
    words = table.column("term").combine_chunks()
    base = words.is_null().to_numpy(zero_copy_only=False)
    p0 = np.zeros(base.sum(), np.int64)
    p0[group[base]] = value[base]
    codes = words.filter(pa.array(~base)).dictionary_encode().indices.to_numpy()
    group, value = group[~base], value[~base]

    by_term = np.lexsort((group, codes))          # the term-major index: peers ascending
    codes, peer, p = codes[by_term], group[by_term], value[by_term]
    end = np.searchsorted(codes, codes, "right")  # of each entry's posting list
    by_group = np.argsort(peer, kind="stable")
    firsts = np.flatnonzero(np.diff(peer[by_group], prepend=-1))
    for entries in np.split(by_group, firsts[1:]) if len(by_group) else ():
        g = int(peer[entries[0]])
        sums = _row_sums(g, p[entries], p0)
        # Pairs are symmetric: only later peers are scattered to.
        _scatter(entries + 1, end[entries] - entries - 1, p[entries], g, peer, p, p0, sums)
        others = np.delete(np.arange(len(p0)), g)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(others), pa.string()), pa.array(np.minimum(others, g), pa.int32()),
            pa.array(np.maximum(others, g), pa.int32()), pa.array(sums[others], pa.int64())],
            ["lang", "a", "b", "value"])


def divergences(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each pair of groups a < b of a language that
    differs from the baseline."""
    place = F.pmod(F.xxhash64("term"), F.col("blocks").cast("long")).cast("int")
    terms = rows.select("lang", place.alias("block"), "g", "term", "p")
    bases = groups.filter("kept > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "g",
        F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block(batches)

    sums = terms.unionByName(bases).groupBy("lang", "block").applyInArrow(block, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group all other
    sources of its language by distance (part `pair`), and the `top` terms that
    it has more of than the language (part `term`)."""
    groups, rows = shares(docs, min_documents)
    own = groups.select("lang", F.col("g").alias("a"), "source", "p0", "kept")
    peers = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    zero = F.lit(0).cast("long")
    sums = materialise(divergences(groups, rows), "divergence-sums")
    both = sums.unionByName(sums.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "value"))
    p, q = F.col("p0"), F.col("q0")
    baseline = F.coalesce(F.col("kept") * F.call_function("div", (p - q) * (p - q), p + q), zero)
    # The result has a row for each two sources of a language: an equi join, a
    # language with many sources cut into as many keys as their number asks for.
    parts = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / PEERS_AT_ONCE).cast("int").alias("parts"))
    own = own.join(_small(parts), "lang").withColumn("part_of", F.pmod("a", "parts"))
    peers = peers.join(_small(parts), "lang").withColumn(
        "part_of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = (own.join(peers, ["lang", "part_of"]).filter("a <> b").join(both, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (baseline + F.coalesce("value", zero)).alias("value")))
    p, q = F.col("p"), F.col("q")
    terms = rows.filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                      F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(ranked)
