"""Importance resampling of documents towards a target, with a dictionary of distinct features.

Features are all runs of 1 to ``n`` consecutive words, as strings.  They are counted globally as
strings; each distinct string is hashed once, to one of a bounded number of buckets; buckets are
added up over documents and target; and the gain of a bucket, by how much likelier the target is to hold
it, comes back to the features of each document.  Documents are drawn by weight plus Gumbel noise
that depends on their id alone, which is sampling without replacement.

How it runs.  A pass cuts the documents into blocks of about ``BLOCK`` bytes of whole texts and lists a
block's distinct features with their counts, so that what is shuffled is a dictionary a block
and not an occurrence a row, and no word is frequent any more.  A block's features go, packed and
compressed in alphabetical order, to parts; a feature always goes to the same part, and the number of parts
follows from the input, so that each part is at most some ``PART`` bytes.  A part is the dictionary of its
features: it merges equal strings, hashes each once, adds up counts by bucket, and answers
each block with the buckets of the features it sent.  Gains come from the sums of the buckets, at most
``buckets`` rows, and are broadcast.  A second pass makes the same blocks again, meets their answers,
and adds up gains over the counts of each document.  A block carries a check number of its features: were
the second pass to see other rows in a block than the first, the job would end with an error, so
``docs`` should be a table or something else that reads the same way twice.  Ranks come from a sort
by ranges: a row's rank is its place in its range after all ranges before it.

Defined cases: A-Z count as a-z; words are runs of a-z, 0-9 and characters beyond ASCII; a null text has no
words; a document without features has weight 0.  A row without an id has no score, is not
drawn and is not among the documents whose share is drawn.  Equal rows are documents of their own, with
equal scores and neighbouring ranks.  An empty target leaves the gains that its zero counts give; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, blocks, mix, pair, word_codes, written

BUCKETS = 10_000
WORDS = 2
MIN_WORDS = 20
SHARE = 25
SEED = 7
BLOCK = 4 << 20
PART = 48 << 20
LEVEL = 6
_KEPT = np.full(256, 32, np.uint8)
_KEPT[48:58] = np.arange(48, 58)
_KEPT[97:123] = _KEPT[65:91] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


class Features:
    """Distinct features of a block in a fixed order, and their counts, in all and in each document.

    ``data`` holds words with blanks between, as ``normal`` gives them.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int = WORDS):
        words = Words(data, offsets)
        self.n_words = np.diff(words.first)
        length = words.end - words.start
        ends = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int64())
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, ends.buffers()[1], pa.py_buffer(data[data != 32])])
        coded = strings.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        word = place[coded.indices.to_numpy().astype(np.int64)] if len(words) else np.zeros(0, np.int64)
        first = np.zeros(len(order), np.int64)
        first[word] = np.arange(len(word))
        # Codes only deal features to parts.
        dealt = [word_codes(data, words)[first] if len(words) else np.zeros(0, np.uint64)]
        dictionary = coded.dictionary.take(pa.array(order))
        self.strings, at, doc, run = [dictionary], [word], words.doc, word
        docs = [words.doc]
        for k in range(1, n):
            fits = np.flatnonzero(doc[: len(doc) - k] == doc[k:]) if len(doc) > k else np.zeros(0, np.int64)
            # ``run`` is known for the starts of runs one word shorter.
            shorter = np.full(len(doc), -1, np.int64)
            shorter[self._starts if k > 1 else slice(None)] = run
            distinct, run = np.unique(shorter[fits] * max(1, len(order)) + word[fits + k], return_inverse=True)
            a, b = np.divmod(distinct, max(1, len(order)))
            self.strings.append(pc.binary_join_element_wise(self.strings[-1].take(pa.array(a)), dictionary.take(pa.array(b)), pa.scalar(b" ", pa.large_binary())))
            dealt.append(pair(dealt[-1][a], dealt[0][b]))
            at.append(run + sum(map(len, self.strings[:-1])))
            docs.append(doc[fits])
            self._starts = fits
        self.total = sum(map(len, self.strings))
        self.code = mix(np.concatenate(dealt))
        self._at, self._docs = at, docs

    def counts(self) -> np.ndarray:
        """How often the block holds each feature."""
        return sum((np.bincount(x, minlength=self.total) for x in self._at), np.zeros(self.total, np.int64))

    def by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, count) of the features of each document, in the order of documents."""
        occurrence = np.concatenate([d * max(1, self.total) + x for d, x in zip(self._docs, self._at, strict=True)])
        occurrence.sort()
        first = np.flatnonzero(np.diff(occurrence, prepend=-1))
        doc, feature = np.divmod(occurrence[first], max(1, self.total))
        return doc, feature, np.diff(first, append=len(occurrence))

    def check(self) -> int:
        """A number that two equal lists of features share."""
        return int((mix(self.code + np.arange(self.total, dtype=np.uint64)).sum() if self.total else np.uint64(0)).view(np.int64))

    def by_part(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(features in order of part, first of each part and the end)."""
        part = (self.code % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))


def normal(data: np.ndarray) -> np.ndarray:
    """Lower-case words of bytes with a blank in place of every other byte."""
    return _KEPT[data]


def _numbered(batches):
    """(block number, batch, bytes, offsets, rows) of the blocks of a task, in an order that depends on its rows alone."""
    number = TaskContext.get().partitionId() << 32
    for batch in _gathered(batches):
        for lo, hi, data, offsets in blocks(batch.column("text"), BLOCK):
            yield number, batch.slice(lo, hi - lo), normal(data), offsets
            number += 1


def _gathered(batches):
    """Batches joined until they fill a block."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _send(parts: int, n: int, target: bool):
    """The features of each block, a row a part."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for number, _, data, offsets in _numbered(batches):
            block = Features(data, offsets, n)
            order, first = block.by_part(parts)
            strings = pa.chunked_array(block.strings).combine_chunks().take(pa.array(order))
            lines = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            _, at, raw = lines.buffers()
            at = np.frombuffer(at, np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
            raw = memoryview(raw) if raw is not None else memoryview(b"")
            del strings
            count = block.counts()[order]
            used = np.flatnonzero(np.diff(first))
            packed = [pack.compress(raw[at[first[p]] : at[first[p + 1]]]) for p in used]
            counts = [pack.compress(count[first[p] : first[p + 1]].tobytes()) for p in used]
            same = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([number] * same, pa.int64()), pa.array([block.check()] * same, pa.int64()), pa.array([target] * same, pa.bool_()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=["part", "block", "check", "target", "packed", "counts"])

    return run


_SENT = "part int, block long, check long, target boolean, packed binary, counts binary"
_ANSWER = "block long, check long, part int, answer binary, chunk int, s array<long>, t array<long>"
CHUNK = 100


def _merge(buckets: int):
    """The dictionary of a part: each distinct string is hashed once.  Answers to blocks, and sums by bucket, some buckets a row."""

    def run(sent: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        raw = [unpack.decompress(x) for x in sent.column("packed").to_pylist()]
        counts = [np.frombuffer(unpack.decompress(x), np.int64) for x in sent.column("counts").to_pylist()]
        data = b"".join(raw)
        at = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1]).astype(np.int64)
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        hashed = np.array([zlib.crc32(x[:-1]) % buckets for x in lines.dictionary.to_pylist()], np.int64)
        bucket = hashed[lines.indices.to_numpy()]
        target = np.repeat(np.array(sent.column("target").to_pylist(), bool), [len(c) for c in counts])
        count, sums = np.concatenate(counts), []
        for chosen in (~target, target):
            total = np.zeros(buckets, np.int64)
            np.add.at(total, bucket[chosen], count[chosen])
            sums.append(total)
        chunks = [np.pad(x, (0, -buckets % CHUNK)).reshape(-1, CHUNK) for x in sums]
        used = np.flatnonzero((chunks[0] + chunks[1]).any(1))
        ends = np.cumsum([0, *map(len, counts)])
        answer = [None if t else bucket[a:b].astype("<u4" if buckets > 65536 else "<u2").tobytes() for a, b, t in zip(ends[:-1], ends[1:], sent.column("target").to_pylist(), strict=True)]
        blank = [None] * len(used)
        number = [*sent.column("block").to_pylist(), *blank]
        return pa.table({
            "block": pa.array(number, pa.int64()),
            "check": pa.array([*sent.column("check").to_pylist(), *blank], pa.int64()),
            "part": pa.array([*sent.column("part").to_pylist(), *blank], pa.int32()),
            "answer": pa.array([*answer, *blank], pa.binary()),
            "chunk": pa.array([None] * len(answer) + used.tolist(), pa.int32()),
            "s": pa.array([None] * len(answer) + chunks[0][used].tolist(), pa.list_(pa.int64())),
            "t": pa.array([None] * len(answer) + chunks[1][used].tolist(), pa.list_(pa.int64())),
        })

    return run


_HELD = "block long, doc_ids array<long>, offsets binary, data binary"


def _hold(batches):
    """Each block as one row: its ids and its words."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for number, batch, data, offsets in _numbered(batches):
        ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([offsets.tobytes()], pa.binary()), pa.array([pack.compress(data.tobytes())], pa.binary())], names=["block", "doc_ids", "offsets", "data"])


_WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def _weigh(gains, parts: int, n: int):
    """Weights of a block's documents, by the answers of the parts."""

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        unpack, gain = zstandard.ZstdDecompressor(), gains.value
        out = []
        for row in held.to_pylist():
            offsets = np.frombuffer(row["offsets"], np.int64)
            block = Features(np.frombuffer(unpack.decompress(row["data"]), np.uint8), offsets, n)
            order, first = block.by_part(parts)
            bucket, expected = np.full(block.total, -1, np.int32), block.check()
            for part, check, answer in zip(*(answers.column(c).to_pylist() for c in ("part", "check", "answer")), strict=True):
                if check != expected:
                    raise ValueError("the documents did not read alike twice; write them as a table first")
                bucket[order[first[part] : first[part + 1]]] = np.frombuffer(answer, "<u4" if len(gain) > 65536 else "<u2")
            if (bucket < 0).any():
                raise ValueError("the documents did not read alike twice; write them as a table first")
            doc, feature, count = block.by_document()
            entries = np.searchsorted(doc, np.arange(len(offsets)))
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[entries])  # noqa: E731, B023
            features, total = sums(count), sums(count * gain[bucket[feature]])
            weight = total // np.maximum(features, 1)
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(block.n_words, pa.int64()), "n_features": pa.array(features, pa.int64()), "weight": pa.array(weight, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")})

    return run


def bucket_gains(spark: SparkSession, sums: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket of ``sums`` (bucket, s, t): floor(1000 ln) of the ratio of its smoothed shares."""
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    s_all, t_all = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    x = lambda c: F.col(c).cast("double")
    ratio = (x("t") + 1) * F.lit(float(s_all + buckets)) / ((x("s") + 1) * F.lit(float(t_all + buckets)))
    rows = every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()  # as many rows as buckets
    gain = np.zeros(buckets, np.int64)
    for bucket, g in rows:
        gain[bucket] = g
    return gain


def _ranked(spark: SparkSession, scored: DataFrame, share: int, min_words: int) -> DataFrame:
    """``scored`` with ``rank``; ranges of the order are ranked side by side."""
    chosen = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    most = scored.filter(chosen).count() * share // 100
    # The last key tells equal rows apart, so that ranges can part them.
    order = [F.col("score").desc(), F.col("doc_id"), F.col("row")]
    ranged = scored.filter(chosen).select("doc_id", "score", "row").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(spark, ranged, "ranges")
    before, offsets = 0, []
    for part, n in ranged.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((part, before))
        before += n
    start = spark.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    drawn = ranged.withColumn("place", place).join(F.broadcast(start), "part").select("row", (F.col("place") + F.col("before")).alias("rank")).filter(F.col("rank") <= most)
    return scored.join(drawn, "row", "left").drop("row")


def importance(spark: SparkSession, docs: DataFrame, target: DataFrame, share: int = SHARE, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of ``docs`` (doc_id, text) towards ``target`` (text).

    ``share`` percent of the documents of ``min_words`` words are drawn: they have a rank, from 1.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * words // PART))
    deal = lambda df, is_target: df.mapInArrow(_send(parts, words, is_target), _SENT)
    sent = deal(source, False).unionByName(deal(target.select("text"), True))
    answers = written(spark, sent.groupBy("part").applyInArrow(_merge(buckets), _ANSWER), "answers")
    added = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(CHUNK)])
    chunks = answers.filter("chunk is not null").groupBy("chunk").agg(F.arrays_zip(added("s").alias("s"), added("t").alias("t")).alias("sums"))
    sums = chunks.select("chunk", F.posexplode("sums").alias("i", "x")).select((F.col("chunk") * CHUNK + F.col("i")).alias("bucket"), "x.s", "x.t")
    gains = spark.sparkContext.broadcast(bucket_gains(spark, sums, buckets))
    held = source.mapInArrow(_hold, _HELD)
    replies = answers.filter("answer is not null").select("block", "part", "check", "answer")
    weighed = held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_weigh(gains, parts, words), _WEIGHED)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = written(spark, weighed.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")
    return _ranked(spark, scored, share, min_words)


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, as they are; of rows that share an id all, if one is drawn."""
    ids = importance(spark, docs, target, share).filter("rank is not null").select(F.col("doc_id").alias("drawn id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["drawn id"], "left_semi")
