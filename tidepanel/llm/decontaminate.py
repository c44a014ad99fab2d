"""Benchmark decontamination by size-partitioned MinHash containment search.

The test items are the sets, the documents are searched.  A short item inside a
long document has next to no Jaccard similarity with it, but the least-hashed
shingles of the item are a uniform sample of its shingles, and the document must
hold most of them: the share of an item's MinHash values found in the document
estimates containment without any regard to the document's length.

Items are partitioned by their number n of distinct shingles.  The sketch of an
item is its floor((1 - threshold) * n) + 1 least hashes: at containment of
threshold or more fewer than that can be missing, so at least one sketch value
occurs in the document, whatever the hashes are.  Partitions share the sketch
size of their largest member; items shorter than a shingle make partitions of
their own width.  Documents that hold a sketch value of an item are candidates,
and each candidate is verified on the words themselves: the share of the item's
shingles that stand in the document.

Everything is DataFrame functions.  The sketches are written, so that Spark knows
their size when it chooses to broadcast or to sort; candidates are grouped by
document and item only, so an item that a third of the documents hold is not hot.

Defined cases: words are longest runs of characters other than ASCII signs,
blanks and controls, in lower case; items without words, null ids and null texts
match nothing; equal rows give one result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
THRESHOLD = 0.8
# Fixed value: everything in ASCII that is neither a letter nor a digit.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(column: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.col(column)), BREAKS), "")


def _grams(words: str, width: int) -> Column:
    """Hashes of the width and all runs of ``width`` words, from an array of word hashes."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    gram = lambda i: F.xxhash64(F.lit(width), *[F.get(F.col(words), i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(at, gram)).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, width, shingles): the distinct shingles of each item, as words joined by blanks."""
    df = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), words_of().alias("w")).filter(F.size("w") > 0).distinct()
    df = df.withColumn("width", F.least(F.lit(SHINGLE), F.size("w")))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " "))
    return df.select("item_id", "width", F.array_distinct(runs).alias("shingles"))


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(hash, item_id): the MinHash sketches, sized by partition."""
    hashed = F.array_sort(F.transform("shingles", lambda s: F.xxhash64("width", F.transform(F.split(s, " "), lambda w: F.xxhash64(w)))))
    df = shingles.select("item_id", "width", hashed.alias("h"))
    # Partition p holds the sizes from 2**p on; its sketches are sized for its largest possible member.
    partition = F.floor(F.log2(F.size("h")))
    size = F.floor((1 - threshold) * (F.pow(F.lit(2), partition + 1) - 1) + 1e-9) + 1
    return df.select("item_id", F.explode(F.slice("h", F.lit(1), F.least(F.size("h"), size.cast("int")))).alias("hash"))


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that holds ``threshold`` or more of an item's shingles."""
    shingles = written(spark, item_shingles(items), "items")
    sketch = written(spark, sketches(shingles, threshold), "sketches")
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())  # at most SHINGLE rows
    source = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row_key"))
    hashes = source.select("doc_id", "row_key", F.transform(words_of(), lambda w: F.xxhash64(w)).alias("w"))
    if not widths:
        return shingles.select(F.lit(None).cast("long").alias("doc_id"), "item_id", F.lit(0).alias("n_shingles"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    # One generator for all widths; the outer form, as Spark would filter by the size of the array first and so make it twice.
    grams = hashes.select("doc_id", "row_key", F.explode_outer(F.concat(*[_grams("w", k) for k in widths])).alias("hash"))
    candidates = written(spark, grams.join(sketch, "hash").select("doc_id", "row_key", "item_id").distinct(), "candidates")
    texts = source.join(candidates, ["doc_id", "row_key"]).join(shingles, "item_id")
    flat = texts.select("doc_id", "item_id", "shingles", F.concat(F.lit(" "), F.array_join(words_of(), " "), F.lit(" ")).alias("flat"))
    shared = F.size(F.filter("shingles", lambda s: F.contains(F.col("flat"), F.concat(F.lit(" "), s, F.lit(" ")))))
    # Written before it is filtered: Spark 4.1 pushes a filter on this lambda below the join, to the side that lacks the text.
    counted = written(spark, flat.select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), shared.alias("n_shared")), "counted")
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold).distinct()
