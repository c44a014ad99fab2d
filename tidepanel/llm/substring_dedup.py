"""Removal of long repeated word spans through a compacted de Bruijn graph.

The graph: an edge is a window, the ``WINDOW`` words that start at some word of a
document; it leads from the node of its first ``WINDOW - 1`` words to the node of
its last.  A document is a walk.

1. Runs.  The least-hashed k-mer of ``K`` words inside a window is its anchor, so
   equal windows have equal anchors wherever they stand, and neighbouring edges
   mostly share theirs.  Edges of a walk with one anchor form a run, about one row
   for 16 words: (anchor, hash of all its words, coordinates).
2. Runs whose anchor stands in one document only hold no repeat and end there.  The
   others are compacted into one class for each (anchor, words).
3. An anchor with one class branches nowhere, and the class is kept as one piece.
   At an anchor with several the walks branch: the source coordinates of each class
   lead back to its text, which gives its single edges; equal ones make one piece.
4. Pieces with their two end nodes give the in and out degree of each node.  Where
   one piece ends and one begins, and the second follows the first in their source,
   a join links the two; linked pieces are one path, the compacted repeat.
5. A later document's pieces that lie in one path behind each other are one long
   repeated span, with the coordinates of its source.  Source and repeat are each
   read back, and the words are removed if 128-bit digests of the words agree.

Copies cost one class however many there are; windows are never compared in pairs.
Both sides of every join on an anchor, class or node are written tables, so Spark
may split a hot one.  Texts are compressed before they are shuffled.

Hashes: an edge is known by the 64-bit hash of its anchor and another one of all
its words, built from pairs with mixing between (``common.pair``).  Words of equal
hashes but different digests are kept.

Defined cases: null or empty text has no words and keeps nothing; a document
shorter than a window keeps all its words; a null ``doc_id`` has no order, so
such a row neither loses words nor makes others lose any; rows with equal
``doc_id`` do not remove words from each other, and every input row gives one
output row; repeats inside one document stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, as_long, blocks, pair, ranges, run_codes, window_min, word_codes, written

WINDOW = 50
K = 20

RUNS = "doc_id long, row_key long, start int, n_windows int, anchor long, words long"
PIECES = "doc_id long, row_key long, start int, n_windows int, anchor long, words long, head long, tail long, single boolean"


def _columns(batch, *names):
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _runs(window: int, k: int):
    def run(batches):
        for batch in batches:
            ids, keys = _columns(batch, "doc_id", "row_key")
            for lo, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                n = len(words)
                if n < window:
                    continue
                begins = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
                if not len(begins):
                    continue
                kmers, windows = run_codes(word_codes(data, words), k, window)
                low = np.uint64(28)  # a block holds fewer than 2**28 words
                ranked = (kmers >> low << low) | np.arange(n - k + 1).astype(np.uint64)
                least = window_min(ranked, window - k + 1)[begins]
                anchor = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
                new = np.ones(len(begins), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (begins[1:] != begins[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(begins)) - 1
                a, b, e = begins[first], begins[last], anchor[first]
                # First and last window overlap, so together they tell all words of the run.
                code = pair(pair(windows[a], windows[b]), ((b - a) * window + (e - a)).astype(np.uint64))
                doc = words.doc[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + doc]), pa.array(keys[lo + doc]), pa.array((a - words.first[doc]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32)), pa.array(as_long(kmers[e])), pa.array(as_long(code))],
                    names=["doc_id", "row_key", "start", "n_windows", "anchor", "words"],
                )

    return run


def _packed(batches):
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [None if t is None else zstd.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(texts, pa.binary())], names=["doc_id", "row_key", "packed"])


def _unpack(column) -> list[bytes]:
    zstd = zstandard.ZstdDecompressor()
    return [b"" if x is None else zstd.decompress(x) for x in column.to_pylist()]


def _pieces(window: int):
    """Whole runs as they are, with their end nodes, and the single edges of runs at branching anchors."""

    def run(batches):
        for batch in batches:
            ids, keys = _columns(batch, "doc_id", "row_key")
            texts = pa.array(_unpack(batch.column("packed")), pa.large_binary())
            parts = batch.column("parts")
            flat = parts.flatten()
            count = np.diff(parts.offsets.to_numpy())
            part_at = np.append(0, np.cumsum(count))
            start, n_windows, anchor, code, whole, branching = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            for lo, hi, data, offsets in blocks(texts):
                words = Words(data, offsets)
                edges, nodes = run_codes(word_codes(data, words), window, window - 1)
                mine = np.arange(part_at[lo], part_at[hi])
                doc = np.repeat(np.arange(lo, hi), count[lo:hi])
                for single, chosen in ((False, whole[mine]), (True, branching[mine])):
                    at, d = mine[chosen], doc[chosen]
                    begin, n = start[at].astype(np.int64), n_windows[at].astype(np.int64)
                    if single:
                        begin, d, at, n = ranges(begin, n), np.repeat(d, n), np.repeat(at, n), np.ones(int(n.sum()), np.int64)
                    here = begin + words.first[d - lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[d]), pa.array(keys[d]), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor[at]), pa.array(as_long(edges[here]) if single else code[at]), pa.array(as_long(nodes[here])), pa.array(as_long(nodes[here + n])), pa.array(np.full(len(at), single))],
                        names=["doc_id", "row_key", "start", "n_windows", "anchor", "words", "head", "tail", "single"],
                    )

    return run


class _Digests:
    """128-bit digests of spans of the words of a text."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        self.end = np.append(0, np.cumsum([len(w) + 1 for w in words]))

    def of(self, start: int, stop: int) -> bytes:
        return hashlib.blake2b(memoryview(self.joined)[self.end[start] : self.end[stop] - 1], digest_size=16).digest()


def _source_digests(window: int):
    def run(batches):
        for batch in batches:
            src_doc, src_key, src_start, n_windows, digest = [], [], [], [], []
            for doc, key, text, asked in zip(batch.column("src_doc").to_pylist(), batch.column("src_key").to_pylist(), _unpack(batch.column("packed")), batch.column("asked").to_pylist(), strict=True):
                digests = _Digests(text.split())
                for span in asked:
                    src_doc.append(doc)
                    src_key.append(key)
                    src_start.append(span["src_start"])
                    n_windows.append(span["n_windows"])
                    digest.append(digests.of(span["src_start"], span["src_start"] + span["n_windows"] + window - 1))
            yield pa.RecordBatch.from_arrays([pa.array(src_doc, pa.int64()), pa.array(src_key, pa.int64()), pa.array(src_start, pa.int32()), pa.array(n_windows, pa.int32()), pa.array(digest, pa.binary())], names=["src_doc", "src_key", "src_start", "n_windows", "digest"])

    return run


def _kept(window: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(_unpack(batch.column("packed")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    digests = _Digests(words)
                    change = np.zeros(len(words) + 1, np.int64)
                    for span in spans:
                        stop = span["start"] + span["n_windows"] + window - 1
                        if stop <= len(words) and digests.of(span["start"], stop) == span["digest"]:
                            change[span["start"]] += 1
                            change[stop] -= 1
                    keep = np.cumsum(change[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("row_key"))


def _packed_texts(source: DataFrame) -> DataFrame:
    return source.mapInArrow(_packed, "doc_id long, row_key long, packed binary")


def compacted(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """Pieces with ``path_start``, the place in their source where their nonbranching path begins."""
    ends = pieces.select("single", F.col("tail").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out"), F.xxhash64("src_doc", "src_key", F.col("src_start") + F.col("n_windows")).alias("place"))
    begins = pieces.select("single", F.col("head").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"), F.xxhash64("src_doc", "src_key", "src_start").alias("place"))
    degrees = ends.unionByName(begins).groupBy("single", "node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    through = written(spark, degrees.filter("into = 1 and out = 1 and lo = hi").select("single", F.col("node").alias("head"), F.lit(True).alias("linked")), "through")
    walk = Window.partitionBy("single", "src_doc", "src_key").orderBy("src_start").rowsBetween(Window.unboundedPreceding, 0)
    linked = pieces.join(through, ["single", "head"], "left")
    return linked.withColumn("path_start", F.last(F.when(F.col("linked").isNull(), F.col("src_start")), ignorenulls=True).over(walk)).select("single", "anchor", "words", "src_doc", "src_key", "src_start", "path_start")


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, row_key, start, n_windows, src_doc, src_key, src_start): the longest spans, by word position, of windows that also start in a document with a smaller doc_id, and where."""
    source = _source(docs).filter("doc_id is not null and text is not null")
    runs = written(spark, source.mapInArrow(_runs(window, k), RUNS), "runs")
    anchors = written(spark, runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"), "anchors")
    hits = written(spark, runs.join(anchors, "anchor", "left_semi"), "hits")

    classes = written(spark, hits.groupBy("anchor", "words").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")), "classes")
    branching = written(spark, classes.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.lit(True).alias("branching")), "branching")
    marked = classes.join(branching, "anchor", "left").select("anchor", "words", F.col("first_doc").alias("doc_id"), (F.col("last_doc") > F.col("first_doc")).alias("whole"), F.coalesce("branching", F.lit(False)).alias("branching"))
    marked = written(spark, marked, "marked")
    parts = hits.join(marked, ["anchor", "words", "doc_id"]).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n_windows", "anchor", "words", "whole", "branching")).alias("parts"))
    at = written(spark, _packed_texts(source).join(parts, ["doc_id", "row_key"]).mapInArrow(_pieces(window), PIECES), "pieces")

    pieces = at.groupBy("single", "anchor", "words").agg(F.min(F.struct("doc_id", "row_key", "start")).alias("src"), F.max("doc_id").alias("last_doc"), F.min("n_windows").alias("n_windows"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    pieces = pieces.filter("not single or last_doc > src.doc_id").select("single", "anchor", "words", "n_windows", "head", "tail", F.col("src.doc_id").alias("src_doc"), F.col("src.row_key").alias("src_key"), F.col("src.start").alias("src_start"))
    paths = written(spark, compacted(spark, written(spark, pieces, "graph")), "paths")

    seen = hits.withColumn("single", F.lit(False)).unionByName(at.filter("single").drop("head", "tail"))
    later = seen.join(paths, ["single", "anchor", "words"]).filter("doc_id > src_doc").withColumn("shift", F.col("start") - F.col("src_start"))
    same = ["doc_id", "row_key", "single", "src_doc", "src_key", "path_start", "shift"]
    along = Window.partitionBy(*same).orderBy("start")
    gap = F.col("start") > F.coalesce(F.lag(F.col("start") + F.col("n_windows")).over(along), F.lit(-1))
    spans = later.withColumn("gap", gap.cast("int")).withColumn("stretch", F.sum("gap").over(along)).groupBy(*same, "stretch").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_windows")).alias("stop"))
    return spans.select("doc_id", "row_key", "start", (F.col("stop") - F.col("start")).alias("n_windows"), "src_doc", "src_key", (F.col("start") - F.col("shift")).alias("src_start"))


def with_digests(spark: SparkSession, docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans (doc_id, row_key, start, n_windows) with the digest of the words that stand at their source."""
    spans = written(spark, spans, "spans")
    source = _source(docs).filter("doc_id is not null and text is not null")
    place = ["src_doc", "src_key", "src_start", "n_windows"]
    asked = spans.select(*place).distinct().groupBy("src_doc", "src_key").agg(F.collect_list(F.struct("src_start", "n_windows")).alias("asked"))
    texts = _packed_texts(source).withColumnsRenamed({"doc_id": "src_doc", "row_key": "src_key"})
    digests = texts.join(asked, ["src_doc", "src_key"]).mapInArrow(_source_digests(window), "src_doc long, src_key long, src_start int, n_windows int, digest binary")
    # Rows that repeat in the table give equal digests.
    digests = written(spark, digests.groupBy(*place).agg(F.max("digest").alias("digest")), "digests")
    return spans.join(digests, place).select("doc_id", "row_key", "start", "n_windows", "digest")


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs`` (doc_id, text)."""
    spans = with_digests(spark, docs, repeated_spans(spark, docs, window, k), window)
    spans = spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n_windows", "digest")).alias("spans"))
    joined = _packed_texts(_source(docs)).join(spans, ["doc_id", "row_key"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_text string")
