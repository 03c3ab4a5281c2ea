"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (lower case; words of fewer than
five make one shingle).  Equal sets are one class from the start; what follows
works on distinct sets, known by 128-bit digests, with a signature of
``COORDINATES`` tokens: by each of as many random orders, the least of the set.

A run walks every set down paths.  A node samples ``BRANCHES`` coordinates by
a hash of its path, and sets with the same token there share a child.  Two
sets of similarity s share a child with probability s for each branch, so a
run finds a pair at the threshold with probability

    phi = 1 - (1 - s phi)^2   (0.94 for 0.8),  whatever the depth,

and runs are repeated until 1 - (1 - phi)^runs reaches the target recall.
Nodes of at most ``SMALL`` sets are leaves.  So is a node that keeps more than
half of its parent's sets, as sampling does not separate near copies.  Others
are split again.

In a leaf all pairs are compared exactly, shingle by shingle, inside tasks; a
large leaf is cut into blocks and each pair of blocks is a task's group.  No
pair is ever written: a pair that several leaves share counts in the least of
them, a group returns a row per set with its number of links and one edge of
the spanning tree.  Classes are the connected components.

Defined results: null texts and texts without words have no shingles, are
linked to nothing and are classes of their own; repeated rows are copies; a
class is known by its least non-null document id; an empty table gives an
empty result; other columns are not read, and are kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, opened, sealed
from .components import components

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
COORDINATES = 64
BRANCHES = 2
SMALL = 256        # sets in a leaf, and in the blocks that a larger leaf is cut into
MAX_DEPTH = 12

_NOT_IN_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
_SPACED = bytes.maketrans(_NOT_IN_WORD, b" " * len(_NOT_IN_WORD))
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * _K + h[k:k + n])
    return np.unique(out)


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    return np.random.default_rng(20240502).integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least token by each order, as 32 bits of its hash."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(tokens), 4096):
        part = tokens[None, a:a + 4096] * _orders()[:, None]
        part ^= part >> np.uint64(29)
        part *= _K
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def runs_for(threshold: float, recall: float) -> int:
    """Runs until the recall of a pair at the threshold."""
    phi = 1.0
    for _ in range(100):
        phi = 1 - (1 - threshold * phi) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - phi)))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc, r1, r2, text) -> (doc, r1, r2, sid, signature); sid is null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, signatures = [], []
            for text in batch.column(3):
                tokens = shingles(text.as_py(), words)
                sids.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                signatures.append(signature(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sids, pa.binary()),
                                              pa.array(signatures, pa.binary())],
                                             ["doc", "r1", "r2", "sid", "signature"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "r1", "r2", "text").mapInArrow(
        run, f"doc {kind}, r1 long, r2 long, sid binary, signature binary")


def _children(path: Column, depth: int) -> Column:
    """The children of a path: for each branch, a hash of the path, the
    coordinate that the path samples there, and the set's token at it."""
    def child(branch: int) -> Column:
        # Branches take different coordinates: the second lies beside the first.
        at = F.pmod(F.xxhash64(path, F.lit(depth)) + branch * (COORDINATES // BRANCHES + 1), F.lit(COORDINATES))
        token = F.substring(F.col("signature"), (at * 4 + 1).cast("int"), F.lit(4))
        return F.xxhash64(path, at, token)
    return F.array(*(child(b) for b in range(BRANCHES)))


def _leaves(sets: DataFrame, runs: int) -> DataFrame:
    """`sets` (sid, signature) -> (leaf, sid, size) of all leaves of two sets or more."""
    rows = sets.select("sid", F.explode(F.array(*(F.lit(r).cast("long") for r in range(runs)))).alias("path"),
                       F.lit(None).cast("long").alias("parent_size"), "signature")
    found = None
    for depth in range(MAX_DEPTH):
        split = materialise(rows.select("sid", "parent_size", F.explode(_children(F.col("path"), depth)).alias("path")),
                            f"paths-{depth}")
        sizes = (split.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
                 .select(F.col("path").alias("p"), "size"))
        shared = materialise(split.join(sizes, F.col("path") == F.col("p")).select("sid", "path", "parent_size", "size"),
                             f"nodes-{depth}")
        leaf = (F.col("size") <= SMALL) | (F.col("size") * 2 > F.col("parent_size"))
        leaf = F.coalesce(leaf, F.lit(False)) if depth + 1 < MAX_DEPTH else F.lit(True)
        own = shared.filter(leaf).select(F.col("path").alias("leaf"), "sid", "size")
        found = own if found is None else found.unionByName(own)
        more = shared.filter(~leaf)
        if depth + 1 == MAX_DEPTH or more.isEmpty():
            return found
        rows = (more.select(F.col("sid").alias("of"), "path", F.col("size").alias("parent_size"))
                .join(sets, F.col("of") == F.col("sid")).select("sid", "path", "parent_size", "signature"))
    return found


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared tokens of each two of the sets."""
    tokens = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[column] > 1
    of, column = of[use], shared[column[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 12
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(sets), width), np.float32)
        part[of[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _links(group: list[dict], leaf: int, crossing: bool, threshold: float, words: int) -> Iterator[dict]:
    """A row for each set of a leaf's group that has links counted here: their
    number, and the least set that they lead to inside the group."""
    group = list({g["sid"]: g for g in group}.values())
    sets = [shingles(g["text"], words) for g in group]
    sizes = np.array([len(s) for s in sets], np.float32)
    common = _common(sets)
    linked = np.triu(common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4, 1)
    root = list(range(len(group)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = [0] * len(group)
    leaves = [set(g["leaves"]) for g in group]
    for i, j in zip(*np.nonzero(linked)):
        if crossing and group[i]["block"] == group[j]["block"]:
            continue  # counted where their own block is compared with itself
        if min(leaves[i] & leaves[j]) != leaf:
            continue
        links[i] += 1
        links[j] += 1
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b, key=lambda x: group[x]["sid"])] = min(a, b, key=lambda x: group[x]["sid"])
    for k, n in enumerate(links):
        if n:
            yield {"sid": group[k]["sid"], "links": n, "root": group[find(k)]["sid"]}


def _compare(rows: DataFrame, threshold: float, words: int) -> DataFrame:
    """Sorted groups (leaf, i, j) of (sid, block, leaves, text) -> (sid, links, root)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                own = row["leaf"], row["i"], row["j"]
                if own != key and group:
                    out += _links(group, key[0], key[1] != key[2], threshold, words)
                    group = []
                key = own
                group.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if group:
            yield pa.RecordBatch.from_pylist(list(_links(group, key[0], key[1] != key[2], threshold, words)), schema)

    schema = pa.schema([("sid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    return rows.mapInArrow(run, "sid binary, links long, root binary")


def jaccard_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    words: int = WORDS, recall: float = TARGET_RECALL) -> DataFrame:
    """A row for each row of `docs`: doc, class_id (the least document id of
    its class), n_links (other distinct sets within the threshold), n_copies
    (rows with the same set) and (r1, r2), the hash of (doc, text) by which
    ``one_of_each`` knows the row."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"),
                       F.xxhash64(doc, text).alias("r1"), F.xxhash64(F.lit(1), doc, text).alias("r2"))
    members = materialise(_sets(rows, words), "shingle-sets")
    light = members.select("doc", "r1", "r2", "sid")
    sets = materialise(members.filter(F.col("sid").isNotNull()).groupBy("sid").agg(
        F.min("doc").alias("least"), F.count("*").alias("n_copies"),
        F.min(F.struct("r1", "r2")).alias("row"), F.first("signature").alias("signature")), "distinct-sets")
    leaves = materialise(_leaves(sets.select("sid", "signature"), runs_for(threshold, recall)), "leaves")

    # Each set that has company, with its leaves and one row's text.
    company = (leaves.groupBy(F.col("sid").alias("id")).agg(F.collect_list("leaf").alias("leaves"),
                                                            F.collect_list(F.struct("leaf", "size")).alias("in"))
               .join(sets.select("sid", "row"), F.col("id") == F.col("sid")).drop("sid"))
    texts = (rows.join(company, (F.col("r1") == F.col("row.r1")) & (F.col("r2") == F.col("row.r2")))
             .select(F.col("id").alias("sid"), "leaves", "text", F.explode("in").alias("at")))
    blocks = F.ceil(F.col("at.size") / SMALL)
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    grouped = (texts.withColumn("block", own)
               .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
               .select(F.col("at.leaf").alias("leaf"), F.least("block", "other").alias("i"),
                       F.greatest("block", "other").alias("j"), "sid", "block", "leaves", "text")
               .repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j"))
    linked = materialise(_compare(grouped, threshold, words), "links")
    roots = components(linked.select(F.col("sid").alias("u"), F.col("root").alias("v")))

    links = linked.groupBy(F.col("sid").alias("l")).agg(F.sum("links").alias("n_links"))
    rooted = (sets.select("sid", "least", "n_copies")
              .join(roots, F.col("sid") == F.col("u"), "left")
              .join(links, F.col("sid") == F.col("l"), "left")
              .select("sid", "least", "n_copies", F.coalesce("root", "sid").alias("root"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links")))
    rooted = materialise(rooted, "rooted-sets")
    least = rooted.groupBy(F.col("root").alias("c")).agg(F.min("least").alias("class_id"))
    classes = (rooted.join(least, F.col("root") == F.col("c"))
               .select(F.col("sid").alias("s"), "class_id", "n_links", "n_copies", "root"))
    return (light.join(classes, F.col("sid") == F.col("s"), "left")
            .select("doc", F.when(F.col("s").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "r1", "r2", "root"))


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                words: int = WORDS, recall: float = TARGET_RECALL) -> DataFrame:
    """One row of each class: that of the least document id, then of the
    least hash; of equal rows, any.  Rows without words all stay."""
    found = jaccard_classes(docs, doc, text, threshold, words, recall)
    first = found.filter(F.col("root").isNotNull()).groupBy("root").agg(
        F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "r1", "r2")).alias("one"))
    stay = materialise(first.select(F.col("one.r1").alias("k1"), F.col("one.r2").alias("k2"), F.lit(True).alias("sole"))
                       .unionByName(found.filter(F.col("root").isNull())
                                    .select(F.col("r1").alias("k1"), F.col("r2").alias("k2"),
                                            F.lit(False).alias("sole")).distinct()), "one-of-each")
    # The join and the window share one partitioning by the row's hash.
    row = Window.partitionBy("r1", "r2").orderBy(F.lit(0))
    kept = (docs.select(sealed(docs).alias("row"), F.xxhash64(doc, text).alias("r1"),
                        F.xxhash64(F.lit(1), doc, text).alias("r2"))
            .join(stay, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")))
            .withColumn("n", F.row_number().over(row)).filter(~F.col("sole") | (F.col("n") == 1)))
    return opened(kept, "row", docs.columns)
