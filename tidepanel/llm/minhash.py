"""Near copies by word shingles: MinHash sketches in bands, compared within buckets.

A text's sketch holds, for each of ``BANDS * ROWS`` multipliers, the least of its shingle codes times the
multiplier; two texts agree in a place with a chance equal to the similarity of their sets of
five-word shingles.  Texts whose sketches agree in a whole band meet in a bucket: of pairs at a similarity of 0.8
all but 3 in a million do.  Within a bucket sketches are compared by one byte a place, and a spanning forest of the
links comes back rather than pairs.  A pair links if the share of agreeing places is at least ``LEAST``: with 160 places that
finds 97 of 100 pairs at 0.8 exactly, more above, and takes 2 of 100 at 0.65.

A bucket of more than ``SPLIT`` texts is compared whole too: equal sketches link to one of them, the others are cut
into chunks, and every two chunks meet in a group of their own, so that the memory of a task is bounded and no pair is left out.
The work of such a bucket grows with the square of its different sketches, spread over the groups.

Defined cases: words are those of the fingerprint; fewer than five words make one shingle; a text without words has no
sketch and links by its fingerprint alone.  Equal texts share a node before this.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, as_long, blocks, mix, pair, run_codes, word_codes, written

SHINGLE = 5
BANDS, ROWS = 32, 5
LEAST = 0.74
SPLIT, HUBS = 4096, 64  # rows of a group, and how many of them are left free as chunks are dealt unevenly
_MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(column) -> tuple[list[bytes | None], list[np.ndarray | None]]:
    """(one byte a place, a code a band) of each text of an Arrow column; None for texts without words."""
    prints: list = []
    bands: list = []
    for lo, hi, data, offsets in blocks(column, 1 << 18):
        data = LOWER[data]
        words = Words(data, offsets)
        codes = word_codes(data, words)
        (runs,) = run_codes(codes, SHINGLE)
        n = np.diff(words.first)
        inside = np.flatnonzero(words.doc[: len(runs)] == words.doc[SHINGLE - 1 :]) if len(runs) else np.zeros(0, np.int64)
        code, doc = runs[inside], words.doc[inside]
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):  # a short text is one shingle of all its words
            at = np.minimum(words.first[short] + k, max(0, len(codes) - 1))
            whole = np.where(n[short] > k, pair(whole, codes[at]), whole) if len(short) else whole
        doc = np.concatenate([doc, short])
        code = np.concatenate([code, whole])
        order = np.argsort(doc, kind="stable")
        doc, code = doc[order], code[order]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        least = np.stack([np.minimum.reduceat(code * m, first) for m in _MULTIPLIERS], 1) if len(doc) else np.zeros((0, BANDS * ROWS), np.uint64)
        mixed = mix(least)
        band = np.zeros((len(first), BANDS), np.uint64)
        for k in range(ROWS):
            band = pair(band, mixed[:, k::ROWS])
        band = as_long(pair(band, np.arange(BANDS, dtype=np.uint64)[None]))
        byte = (mixed & np.uint64(255)).astype(np.uint8)
        rows: dict = {int(d): i for i, d in enumerate(doc[first])}
        for d in range(hi - lo):
            i = rows.get(d)
            prints.append(None if i is None else byte[i].tobytes())
            bands.append(None if i is None else band[i])
    return prints, bands


def _agree(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (others == one).sum(1) >= LEAST * (BANDS * ROWS)


def forest(nodes: np.ndarray, places: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what is connected by agreeing sketches, one fewer than members of each tree: a breadth-first search, of memory in proportion to the bucket."""
    a, b = [], []
    left = np.arange(len(nodes))
    while len(left):
        front, left = left[:1].tolist(), left[1:]
        while front and len(left):
            here = front.pop()
            near = _agree(places[here], places[left])
            new = left[near]
            for i in new.tolist():
                if nodes[i] != nodes[here]:
                    a.append(int(nodes[here]))
                    b.append(int(nodes[i]))
            front += new.tolist()
            left = left[~near]
    return a, b


def _links(batches):
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            rows = members.values
            x, y = forest(rows.field("node").to_numpy(), np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(rows), -1))
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def sketch_links(spark: SparkSession, texts: DataFrame, split: int = SPLIT, hubs: int = HUBS) -> DataFrame:
    """Links (a, b) between nodes whose texts are near: the table ``texts`` holds (key, node, sketch, bands), one row for each distinct text.

    Only keys and codes are dealt by band.  Bands in which the same texts meet are compared once, in one of them, and sketches join
    only the texts that meet another.
    """
    keyed = texts.filter("sketch is not null").select("key", F.explode("bands").alias("band"))
    met = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor(F.xxhash64("key")).alias("mark")).filter("n > 1")
    chosen = written(spark, met.groupBy("n", "lo", "hi", "mark").agg(F.min("band").alias("band")).select("band", "n"), "bands")
    # Both sides of the joins are tables, so that Spark may split a band that many texts share.
    members = written(spark, keyed.join(chosen, "band"), "members")
    crowded = written(spark, members.join(texts.select("key", "node", "sketch"), "key").drop("key"), "crowded")
    small = crowded.filter(F.col("n") <= split).select("band", F.lit(0).alias("chunk"), "node", "sketch")
    large = crowded.filter(F.col("n") > split)
    first = written(spark, large.groupBy("band", "sketch").agg(F.min("node").alias("node")), "first")
    equal = large.select("band", "sketch", F.col("node").alias("b")).join(first, ["band", "sketch"]).filter("b <> node").select(F.col("node").alias("a"), "b")
    sizes = first.groupBy("band").agg(F.count("*").alias("n"))
    parts = F.when(F.col("n") <= split, 1).otherwise(F.ceil(2 * F.col("n") / max(1, split - hubs))).cast("int")
    dealt = first.join(sizes.select("band", parts.alias("chunks")), "band").withColumn("chunk", F.pmod(F.xxhash64("band", "sketch"), F.col("chunks")).cast("int"))
    # Every two chunks of a band; a chunk by itself only if the band has no other.
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i != F.col("chunk"))))
    paired = dealt.withColumn("other", other).select("band", F.least("chunk", "other").alias("chunk"), F.greatest("chunk", "other").alias("other"), "node", "sketch")
    gathered = small.withColumn("other", F.lit(0)).select("band", "chunk", "other", "node", "sketch").unionByName(paired).groupBy("band", "chunk", "other").agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
    return gathered.select("members").mapInArrow(_links, "a long, b long").unionByName(equal).distinct()
