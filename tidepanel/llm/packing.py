"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest permitted length and packed,
longest piece first, into the open sequence that it leaves fullest.  Where none
has room, a new sequence is opened with the permitted length of least cost for
each token it can expect to hold.  The cost of a length is linear plus a
quadratic share, as attention has; the expectation fills the length, longest
first, with the pieces of the shard that are still to come and that no sequence
opened before expects.  In the end each sequence is cut down to the least
permitted length that holds its contents, so the capacities that were opened only steer.

Pieces are dealt over shards by a hash of document, text, piece and number among equal
rows, so that rows that repeat are dealt like others and the order of rows and their partitions
do not matter, about ``SHARD`` tokens a shard; their number follows from the total.  A shard is packed by itself and its
memory does not depend on the input.

Defined cases: lengths are words plus one end mark, so null and empty texts have
one token; equal documents are packed each for itself; null ids are packed like
others; ties go to the sequence opened first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD = 4_000_000
QUADRATIC = 1 / 65536  # share of the quadratic term: it equals the linear one at 65,536 tokens


def cost(length: int) -> float:
    return length * (1 + QUADRATIC * length)


class _ToCome:
    """Pieces still to come, by size, and how many of them no open sequence expects yet."""

    def __init__(self, sizes: list[int], longest: int):
        self.all = [0] * (longest + 1)
        for size in sizes:
            self.all[size] += 1
        self.free = self.all.copy()
        self.below = [0] * (longest + 1)  # a smaller size; no piece of a size between the two is free
        for size in range(2, longest + 1):
            self.below[size] = size - 1 if self.all[size - 1] else self.below[size - 1]

    def _largest(self, size: int) -> int:
        """The largest size of a free piece that is at most ``size``; 0 if there is none."""
        top = size
        while top and not self.free[top]:
            top = self.below[top]
        while size > top:
            self.below[size], size = top, self.below[size]
        return top

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(size, number) of the free pieces that fit into ``room``, longest first."""
        taken, size = [], self._largest(room)
        while size:
            n = min(self.free[size], room // size)
            taken.append((size, n))
            room -= n * size
            size = self._largest(min(room, size - 1))
        return taken

    def expect(self, taken: list[tuple[int, int]]) -> None:
        for size, n in taken:
            self.free[size] -= n

    def arrived(self, size: int) -> None:
        self.all[size] -= 1
        self.free[size] = min(self.free[size], self.all[size])


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """(sequence of each piece, length of each sequence) of pieces in falling order of size."""
    lengths = tuple(sorted(lengths))
    to_come, room, used, where = _ToCome(sizes, lengths[-1]), [], [], []
    for size in sizes:
        to_come.arrived(size)
        i = bisect.bisect_left(room, (size, -1))
        if i < len(room):
            free, b = room.pop(i)
        else:
            b = len(used)
            used.append(0)
            plans = [(c, to_come.fill(c - size)) for c in lengths if c >= size]
            free, taken = min(plans, key=lambda p: (cost(p[0]) / (size + sum(s * n for s, n in p[1])), p[0]))
            to_come.expect(taken)
        used[b] += size
        where.append(b)
        if free > size:
            bisect.insort(room, (free - size, b))
    return where, [next(c for c in lengths if c >= u) for u in used]


def word_count(column: str = "text"):
    """Words and one end mark."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


BLOCK = 1 << 16


def _copies(lengths: DataFrame) -> DataFrame:
    """``lengths`` with ``copy``, which numbers equal rows from 0, wherever they are: by their count, so that no window holds them."""
    kept = lengths.columns
    counted = lengths.groupBy(*kept).agg(F.count("*").alias("_n"))
    blocks = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK))).alias("_b"))
    return blocks.select(*kept, F.explode(F.sequence(F.col("_b") * BLOCK, F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK) - 1)).alias("copy"))


def pack_documents(spark: SparkSession, lengths: DataFrame, permitted: tuple[int, ...] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """Packs rows (doc_id, n_tokens) or (doc_id, text_key, n_tokens), of which the last token is an end mark.

    One row a piece: doc_id, text_key and copy, which name a row also where ids repeat or lack; piece, n_tokens, start_word and end_word (exclusive; the
    last piece holds the end mark besides), sequence_id, position in the sequence, sequence_length, sequence_tokens.
    """
    longest = max(permitted)
    total = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard))
    if "text_key" not in lengths.columns:
        lengths = lengths.withColumn("text_key", F.lit(0).cast("long"))
    rows = _copies(lengths.select("doc_id", "text_key", "n_tokens"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n_tokens") - 1) / longest).cast("int")))).alias("piece")
    start = (F.col("piece") * longest).cast("long")
    words = F.least(start + longest, F.col("n_tokens") - 1)
    pieces = rows.select("*", piece).select("doc_id", "text_key", "copy", "piece", F.least(F.lit(longest), F.col("n_tokens") - start).cast("int").alias("n_tokens"), start.alias("start_word"), words.alias("end_word"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key", "copy", "piece"), F.lit(shards)))
    kept = ["doc_id", "text_key", "copy", "piece", "n_tokens", "start_word", "end_word"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), *((k, "ascending") for k in kept if k != "n_tokens")])
        sizes = table.column("n_tokens").to_pylist()
        where, used = pack(sizes, permitted)
        held, before = [0] * len(used), []
        for b, size in zip(where, sizes, strict=True):
            before.append(held[b])
            held[b] += size
        base = table.column("shard")[0].as_py() * (1 << 32)
        made = {"sequence_id": pa.array([base + b for b in where], pa.int64()), "position": pa.array(before, pa.int64()), "sequence_length": pa.array([used[b] for b in where], pa.int32()), "sequence_tokens": pa.array([held[b] for b in where], pa.int64())}
        return pa.table({k: table.column(k) for k in kept} | made)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, copy long, piece int, n_tokens int, start_word long, end_word long, sequence_id long, position long, sequence_length int, sequence_tokens long"
    return pieces.groupBy("shard").applyInArrow(run, schema)


def pack_texts(spark: SparkSession, docs: DataFrame, permitted: tuple[int, ...] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """``pack_documents`` of the words of ``docs`` (doc_id, text); ``text_key`` is the xxhash64 of the text."""
    lengths = written(spark, docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_count().alias("n_tokens")), "lengths")  # texts are read once
    return pack_documents(spark, lengths, permitted, shard)
