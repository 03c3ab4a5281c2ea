"""Quality rules with cross-document line frequency.

Each document's lines are normalised (A-Z lower-cased, white space collapsed)
and hashed.  A line is boilerplate of its host when more than
``max(min_documents, max_share x the host's documents)`` documents of the host
hold it.  Such lines are removed; a document left with fewer than
``min_words`` words, or less than ``min_left`` of its words, is rejected.

Every document gives each of its lines once, so counts are sums of ones that
Spark adds up before the shuffle: a line that a third of all documents hold
is one row per task.  Frequent lines go back to their documents by broadcast
if there are at most ``BROADCAST_LINES`` of them (24 bytes each), else by a
join on (host, line) that AQE splits where a line is hot.

Defined results: a null text has no words, no lines and fails; a null host is
a host of its own; repeated rows count once each; lines of white space count
nowhere; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sealed

MIN_DOCUMENTS = 3  # against chance in small hosts; the share decides
MAX_SHARE = 0.01
MIN_WORDS = 50
MIN_LEFT = 0.3
BROADCAST_LINES = 500_000
# The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) < 1 << 21:
        a = np.array(ids, np.int64)
        windows = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    else:  # windows of more words than fit in 63 bits
        triples: dict[tuple, int] = {}
        windows = np.array([triples.setdefault(t, len(triples)) for t in zip(ids, ids[1:], ids[2:])], np.int64)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    often = times[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= often
    return int(covered.sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def text_stats(text: str) -> dict:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    dups, lines = 0, {}
    for line in data.split(b"\n"):
        if normal := normal_line(line):
            dups += line in seen
            seen.add(line)
            lines[normal] = lines.get(normal, 0) + normal.count(b" ") + 1
    return {"n_words": len(words),
            "word_chars": len(text) - len(data) + len(data.translate(None, _WHITE)),
            "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
            "n_dup_lines": dups, "n_repeat_words": repeat_words(words),
            "lines": [{"h": line_hash(x), "words": w} for x, w in lines.items()]}


_STATS = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                    ("lines", pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())])))])
_STATS_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "lines array<struct<h: long, words: long>>")


def _scan(docs: DataFrame, doc: str, host: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([text_stats(t.as_py() or "") for t in batch.column(2)], _STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *stats.flatten()],
                                             ["doc", "host", *(f.name for f in _STATS)])

    chosen = docs.select(F.col(doc).alias("doc"), F.col(host).alias("host"), F.col(text).alias("text"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:2])
    return chosen.mapInArrow(run, f"{head}, {_STATS_DDL}")


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_documents: int, max_share: float) -> DataFrame:
    """(host, h) of lines above the limit; `lines` holds a row for each
    document and distinct line, `hosts` each host's number of documents."""
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    limits = hosts.select(F.col("host").alias("of"), (F.col("n_docs") * max_share).alias("most"))
    return (counts.join(limits, F.col("host").eqNullSafe(F.col("of")))
            .filter(F.col("n") > F.col("most")).select("host", "h", "n"))


def line_quality(docs: DataFrame, doc: str = "doc_id", host: str = "source", text: str = "text",
                 base_failed: Column | None = None, min_documents: int = MIN_DOCUMENTS,
                 max_share: float = MAX_SHARE, min_words: int = MIN_WORDS,
                 min_left: float = MIN_LEFT) -> tuple[DataFrame, DataFrame]:
    """(verdicts, frequent).  Verdicts: a row per document with its counts,
    ``lines_removed``, ``words_left``, ``base_failed`` and ``kept``.
    Frequent: (host, h, n), the lines to remove."""
    # One scan of the texts; a written row number tells equal rows apart.
    rows = materialise(_scan(docs, doc, host, text).withColumn("row", F.monotonically_increasing_id()), "line-stats")
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select(
        "row", "host", F.col("line.h").alias("h"), F.col("line.words").alias("words"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"))
    frequent = materialise(frequent_lines(lines, hosts, min_documents, max_share), "frequent-lines")
    few = frequent.count() <= BROADCAST_LINES
    known = frequent.select(F.col("host").alias("of"), F.col("h").alias("line_h"))
    removed = (lines.join(F.broadcast(known) if few else known,
                          F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line_h")))
               .groupBy(F.col("row").alias("id")).agg(F.count("*").alias("lines_removed"),
                                                      F.sum("words").alias("words_removed")))
    if base_failed is None:
        base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    left = F.col("words_left")
    verdicts = (rows.drop("lines").join(removed, F.col("row") == F.col("id"), "left")
                .withColumn("lines_removed", F.coalesce("lines_removed", F.lit(0)))
                .withColumn("words_left", F.col("n_words") - F.coalesce("words_removed", F.lit(0)))
                .withColumn("base_failed", base_failed)
                .withColumn("kept", ~F.col("base_failed") & (left >= min_words)
                            & (left >= F.col("n_words") * min_left))
                .drop("row", "id", "words_removed"))
    return verdicts, frequent


def without_lines(docs: DataFrame, frequent: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """`docs` with the frequent lines of each host taken out of the texts.
    Hosts' line lists meet the texts by broadcast under the same bound, else
    each text's own frequent lines are gathered by a hash of the text."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[line_hash(x) for x in {normal_line(y) for y in (t or "").encode().split(b"\n")} if x]
                      for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3),
                                              pa.array(hashes, pa.list_(pa.int64()))], ["host", "k1", "k2", "hs"])

    def drop(texts, hashes):
        import pandas as pd
        out = []
        for t, hs in zip(texts, hashes):
            gone = set() if hs is None else set(hs)
            out.append(None if t is None else t if not gone else "\n".join(
                x for x in t.split("\n") if not (n := normal_line(x.encode())) or line_hash(n) not in gone))
        return pd.Series(out)

    keys = [F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2")]
    host_type = docs.schema[host].dataType.simpleString()
    lines = (docs.select(F.col(host).alias("host"), F.col(text).alias("text"), *keys)
             .mapInArrow(found, f"host {host_type}, k1 long, k2 long, hs array<long>")
             .select("host", "k1", "k2", F.explode("hs").alias("h")))
    known = frequent.select(F.col("host").alias("of"), F.col("h").alias("line_h"))
    gone = (lines.join(known, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line_h")))
            .groupBy("host", "k1", "k2").agg(F.collect_set("h").alias("gone"))
            .select(F.col("host").alias("g0"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), "gone"))
    rewrite = F.pandas_udf(drop, "string")
    joined = (docs.select(sealed(docs).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"), *keys)
              .join(gone, F.col("host").eqNullSafe(F.col("g0")) & (F.col("k1") == F.col("g1"))
                    & (F.col("k2") == F.col("g2")), "left")
              .withColumn("left_text", rewrite("text", "gone")))
    return joined.select(*(F.col("left_text").alias(c) if c == text else F.col("row").getField(c).alias(c)
                           for c in docs.columns))
