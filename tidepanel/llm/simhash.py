"""Near-duplicate documents: 64-bit SimHash and covering locality-sensitive hashing.

Covering hashing (R. Pagh, "Locality-sensitive hashing without false negatives",
2016): every bit position gets a vector of ``radius + 1`` bits.  For each nonzero
vector v of that length one table keeps the positions whose vector has an odd
inner product with v, and zeroes the rest.  The at most ``radius`` positions in
which two near fingerprints differ span less than the whole space, so some v is
orthogonal to all of them: in that table the two masked fingerprints are equal.
No near pair is missed, whatever the data.

Only distinct fingerprints enter the tables.  Buckets of one fingerprint end
there, buckets of two are compared in SQL, others in numpy, which returns a
spanning forest of the links in the bucket rather than its pairs.  A bucket of
more than ``SPLIT`` fingerprints is first covered once more on the positions that
its own mask zeroed; that leaves at most about 2**16 different fingerprints to
any bucket, of any input.

Defined cases: words are longest runs of bytes other than space and controls 9
to 13, A-Z in lower case; fewer than four words make one shingle; no words (null
or empty text) give fingerprint zero, linked like any other.  Null ``doc_id``
rows get a fingerprint and the component of their fingerprint; the component is
null if it has no other member.  Repeated rows repeat in the result.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, text_buffers, written
from .components import connected_components
from .minhash import sketch_links, sketches

RADIUS = 4
SHINGLE = 4
SEED = 42
SPLIT = 1024


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # of bytes: only A-Z and only ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    n = len(words) - SHINGLE + 1
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.append(0, end[:-1] + 1)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes) -> int:
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        data, at = text_buffers(batch.column("text"))
        raw = data.tobytes()
        found = np.array([fingerprint(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(as_long(found))], names=["doc_id", "fp"])


def _keyed_fingerprints(batches):
    for batch in batches:
        found = next(_fingerprints([batch.rename_columns(["doc_id" if c == "id" else c for c in batch.schema.names])]))
        sketch, bands = sketches(batch.column("text"))
        columns = [batch.column("id"), batch.column("key"), found.column("fp"), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "fp", "sketch", "bands"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """A mask for each nonzero vector of radius + 1 bits, over the given bit positions.  The positions take the nonzero vectors in turn, which makes the masks about equally large."""
    top = 1 << (radius + 1)
    vector = {p: i % (top - 1) + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, top)]


def _table_keys(fps: DataFrame) -> DataFrame:
    masks = covering_masks(list(range(64)))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    return fps.select("fp", F.inline(keys))


def _refined(rows: DataFrame) -> DataFrame:
    """Rows (fp, t, key) of oversize buckets, covered again on the positions that mask t zeroed."""
    table = F.lit(None).cast("array<bigint>")
    for t, m in enumerate(covering_masks(list(range(64)))):
        masks = covering_masks([p for p in range(64) if not m >> p & 1])
        table = F.when(F.col("t") == t, F.array(*[F.lit(_signed(x)) for x in masks])).otherwise(table)
    again = rows.select("fp", "t", F.posexplode(table).alias("t2", "mask"), "key")
    return again.select("fp", F.xxhash64("t", "t2", "key", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), (F.col("t") * 100 + F.col("t2") + 100).alias("t"))


def _forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is connected within distance ``radius``, one fewer than members of each tree: a breadth-first search over rows of comparisons, of memory in proportion to the bucket."""
    left = np.unique(fps)
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            here, front = front[0], front[1:]
            near = np.bitwise_count((left ^ here).view(np.uint64)) <= radius
            if near.any():
                new = left[near]
                a.append(np.full(len(new), here))
                b.append(new)
                front, left = np.concatenate([front, new]), left[~near]
    return a, b


def _links(radius: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                x, y = _forest(members.values.to_numpy(), radius)
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def fingerprint_links(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp) that connect all within ``radius`` bits."""
    keyed = _table_keys(fps)
    sizes = written(spark, keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    pairs = sizes.filter(F.col("n") == 2).select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowded = keyed.join(sizes.filter("n > 2").select("t", "key", "n"), ["t", "key"])
    crowded = written(spark, crowded.select("fp", "t", "key", "n"), "crowded")
    fine = _refined(crowded.filter(F.col("n") > split))
    shared = fine.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    fine = fine.join(shared, ["t", "key"]).select("fp", "t", "key")
    gathered = crowded.filter(F.col("n") <= split).select("fp", "t", "key").unionByName(fine)
    members = gathered.groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    return pairs.unionByName(members.mapInArrow(_links(radius), "a long, b long"))


def fingerprint_roots(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, split: int = SPLIT, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) for each of the distinct fingerprints ``fps`` (fp): the least fingerprint that it reaches by links, and by those in ``more`` (a, b)."""
    links = fingerprint_links(spark, fps, radius, split)
    roots = connected_components(spark, links if more is None else links.unionByName(more)).withColumnRenamed("id", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = written(spark, fingerprints(docs), "fingerprints")
    fps = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    nodes = written(spark, fps.join(fingerprint_roots(spark, fps.select("fp"), radius, split), "fp"), "roots")
    least = written(spark, nodes.groupBy("root").agg(F.min("node").alias("component_id")), "least")
    # Both sides of each join are tables, so that Spark may split a root or a fingerprint that most rows share.
    placed = written(spark, nodes.join(least, "root").select("fp", "component_id"), "placed")
    return prints.join(placed, "fp").select("doc_id", "fp", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), one of each group of near copies: that of the least doc_id (null last), then of the least hash of the text; of rows equal in both, any one.

    Documents are near if their fingerprints link, or if the sketches of their five-word shingles agree as those of texts
    at a similarity of 0.8 do (``minhash``): 4 of 64 bits are tighter than that similarity.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("key"))
    kind = keyed.schema["id"].dataType.simpleString()
    source = keyed.select("id", "key", F.col("row.text").alias("text"))
    prints = written(spark, source.mapInArrow(_keyed_fingerprints, f"id {kind}, key long, fp long, sketch binary, bands array<long>"), "fingerprints")
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("best"))
    fps = written(spark, best, "nodes")
    texts = prints.filter("sketch is not null").groupBy("key").agg(F.first(F.struct(F.col("fp").alias("node"), "sketch", "bands")).alias("text")).select("key", "text.*")
    near = sketch_links(spark, written(spark, texts, "texts"))
    nodes = fps.join(fingerprint_roots(spark, fps.select("fp"), radius, split, near), "fp")
    kept = nodes.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.key")
    same = keyed.id.eqNullSafe(kept.id) & (keyed.key == kept.key)
    return keyed.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
