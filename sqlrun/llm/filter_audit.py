"""Filter interaction audit: what each order of five filters removes.

Filters are bits A (too short), B (few distinct words), C (shouting), D (odd
symbols) and E (an exact copy of a document with a smaller id).  E is an
existential self-join: a document fails if the table holds a row of equal hash,
equal text and smaller doc_id.  Only texts whose 128-bit hash occurs twice take
part; the side that is searched has one row for each distinct text, its least
doc_id, gathered by map-side partial aggregation, and that row is repeated once
for every ``COPIES_PER_SALT`` copies, so that a group of copies of any size is
spread over as many join keys.  The ids that it finds are united with the ids
that fail the other filters, and bits are combined by id.

Whatever the order of the filters, a document's fate depends on its
combination of bits alone.  So documents are counted by part and combination
(32 at most), and the 600 rows of each part (120 orders of 5 steps) are sums
over those counts.

Defined results:
- a null text is an empty one, a null source the empty part;
- a null doc_id is never smaller than another and has no smaller one, so its
  document doesn't fail E; nor has it labels;
- rows equal in doc_id and text count once each and share their fate; a
  repeated row of `labels` counts as one, good or toxic if any of them is;
- texts are read whole, whatever their length (a row's words are an array);
- an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
ODD_SYMBOLS = "[#$%&*|]"

COPIES_PER_SALT = 256
# Largest table of repeated hashes that is broadcast (a row is under 50 bytes).
BROADCAST_HASHES = 200_000

_ID = ("doc_id", "part", "h1", "h2")


def _text_hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _with_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
                       *_text_hash(text), text.alias("text"))


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < LEAST_WORDS,
             100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
             100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length(text),
             text.rlike(ODD_SYMBOLS)]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def copies_of_smaller(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ids (doc_id, part, h1, h2) of documents whose text a document of
    smaller doc_id has too.  `hashes`: (h1, h2) of every document."""
    repeated = materialise(hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                           "audit-repeated")
    if repeated.count() <= BROADCAST_HASHES:
        repeated = F.broadcast(repeated)
    rows = materialise(_with_id(docs).join(repeated, ["h1", "h2"]), "audit-copies", "zstd")
    salts = F.ceil(F.col("n") / COPIES_PER_SALT).cast("int")
    least = (rows.groupBy("h1", "h2", "text", salts.alias("salts")).agg(F.min("doc_id").alias("least"))
             .select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("text").alias("same"), "least",
                     F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("slot")))
    searched = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts.cast("long")).cast("int"))
    return searched.join(least, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))
                         & (F.col("salt") == F.col("slot")) & (F.col("text") == F.col("same"))
                         & (F.col("least") < F.col("doc_id")), "left_semi").select(*_ID)


def failures(docs: DataFrame) -> DataFrame:
    """One row for each (doc_id, part, text): the bits of the filters that it
    fails, and how many rows of `docs` are such."""
    texts = _with_id(docs).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = materialise(texts.select(*_ID, own_failures(F.col("text"), F.col("words")).alias("bits"),
                                   F.lit(1).cast("long").alias("rows")), "audit-failures")
    copies = copies_of_smaller(docs, own.select("h1", "h2"))
    found = copies.select("*", F.lit(1 << FILTERS.index("E")).alias("bits"), F.lit(0).cast("long").alias("rows"))
    return own.unionByName(found).groupBy(*_ID).agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows"))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits) -> rows, and how many of them are good or toxic by `labels`."""
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(
        is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # Rows without an id have no label; joined, they would meet in one task.
    known = failed.filter(F.col("doc_id").isNotNull()).join(marks, F.col("doc_id") == F.col("of"), "left")
    marked = lambda df, good, toxic: df.select("part", "bits", "rows", good.alias("good"), toxic.alias("toxic"))
    zero = F.lit(0).cast("long")
    every = marked(known, *(F.coalesce(F.col(c), zero) for c in ("good", "toxic"))).unionByName(
        marked(failed.filter(F.col("doc_id").isNull()), zero, zero))
    return every.groupBy("part", "bits").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("good")).alias("good"),
        F.sum(F.col("rows") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, source) and `labels` (doc_id, quality, toxic) ->
    one row for each part, order of the filters and step."""
    counted = combinations(failures(docs), labels)
    by_part = counted.groupBy("part").agg(
        F.collect_list(F.struct("bits", "rows", "good", "toxic")).alias("found"))  # 32 at most
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = (by_part.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))
    place = lambda f: F.locate(f, F.col("filter_order"))
    sum_bits = lambda test: sum((F.when(test(place(f)), F.lit(1 << k)).otherwise(F.lit(0))
                                 for k, f in enumerate(FILTERS)), F.lit(0))
    steps = (steps.withColumn("own", sum_bits(lambda at: at == F.col("step")))
             .withColumn("before", sum_bits(lambda at: at < F.col("step"))))

    def total(of: str, test) -> Column:
        return F.aggregate(F.filter("found", test), F.lit(0).cast("long"), lambda a, x: a + x[of])

    own, before = F.col("own"), F.col("before")
    fails = lambda x: x["bits"].bitwiseAND(own) != 0
    early = lambda x: x["bits"].bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~early(x)
    # A filter is the first of k failed ones in 120 / k of the orders.
    first_in = F.aggregate(F.filter("found", fails), F.lit(0).cast("long"),
                           lambda a, x: a + x["rows"] * (F.lit(120) / F.bit_count(x["bits"])).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("rows", lambda x: ~fails(x) & ~early(x)).alias("kept"),
        total("rows", removed).alias("removed"),
        total("rows", lambda x: fails(x) & early(x)).alias("redundant"),
        total("rows", lambda x: x["bits"] == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        first_in.alias("shapley"))
