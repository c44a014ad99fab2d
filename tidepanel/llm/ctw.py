"""Language-model scores by context-tree weighting over bytes.

A text is coded as its lower-case words, one blank behind each, and a line end
behind the last.  A byte is eight binary decisions, most significant bit first.
Each is predicted from the bytes before it, in contexts of 0 to ``DEPTH`` bytes:

* inside a word, and for the blank behind it, the bytes back to the blank before it;
* for the first byte of a word, that blank and the last three bytes before it.

Every node of the context tree (context, bits of this byte so far) holds the
Krichevsky-Trofimov estimate of its two counts.  It weighs its own block probability
against the product of those of the contexts one byte longer, half and half, as
context-tree weighting (Willems, Shtarkov, Tjalkens 1995) does; predictions mix along
the path by these weights.  A node that training never saw leaves the mixture to the
shorter contexts.

The probability of a text is then a product over its words (inner bytes) and over
its steps from word to word (first bytes).  Both are symbols of one vocabulary:

1. Each task counts its symbols, and Spark sums the counts.
2. Symbols are cut into grams (``DEPTH`` bytes of context and the byte); Spark sums
   those, and gathers the grams of one shard, which is the last three context bytes,
   in a row.  Distinct grams are bounded by the byte alphabet, however long the corpus.
3. Contexts of three bytes or more are weighed inside their shards; the sums that
   they leave for shorter contexts, at most 65,536 of 255 nodes, are weighed on the
   driver and broadcast; shards then give each gram its probability.
4. Grams give symbols theirs: the ``FREQUENT`` most frequent grams are looked up in
   place, all others in a join.  Symbols give texts theirs in the same way.

Counts, tree and vocabulary grow with the corpus and stay distributed; tables that
are looked up in place are bounded, and a key outside them is rare, so none is hot.

Defined cases: null text is empty; empty text is the end alone; a null doc_id is
not held out and trains nothing; rows with equal doc_id are scored each by its
own text; with no training rows every node predicts one half; an empty table gives
no rows; other columns are ignored.  Words longer than seven bytes are identified by
a 62-bit hash beside their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, as_long, blocks, crc_mod, ranges, text_buffers, word_codes, written

DEPTH = 7
SHARD = 3  # context bytes that name a shard
TOP = 1 << 18
FREQUENT = 1 << 19
END = 10
STEP = 255 << 56  # a step from word to word: three bytes before the blank, and the next one


def _steps(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of the steps: one into each word, one from the last word (or from nothing) to the end."""
    n_docs = len(words.first) - 1
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    length = words.end - words.start
    tail = np.zeros(len(words), np.uint64)
    for back in (3, 2, 1):
        byte = np.where(length >= back, padded[words.end + 3 - back], 0)
        tail = tail << np.uint64(8) | byte.astype(np.uint64)
    before = np.zeros(len(words), np.uint64)
    before[1:] = tail[:-1]
    filled = np.flatnonzero(np.diff(words.first))
    before[words.first[filled]] = 0
    last = np.zeros(n_docs, np.uint64)
    last[filled] = tail[words.first[filled + 1] - 1]
    into = before << np.uint64(8) | data[words.start].astype(np.uint64)
    codes = np.concatenate([into, last << np.uint64(8) | np.uint64(END)]) | np.uint64(STEP)
    return codes, np.concatenate([words.doc, np.arange(n_docs)])


def _symbols(raw: np.ndarray, offsets: np.ndarray):
    """(words, codes of all symbols, their documents): first those of the words, in order, then the steps."""
    data = LOWER[raw]
    words = Words(data, offsets)
    steps, doc = _steps(data, words)
    return data, words, np.concatenate([word_codes(data, words), steps]), np.concatenate([words.doc, doc])


SYMBOLS = "code long, word binary, n long"
FLUSH = 1 << 20


def _count(batches):
    def summed(parts):
        t = pa.concat_tables(parts).group_by(["code", "word"]).aggregate([("n", "sum")])
        return t.select(["code", "word", "n_sum"]).rename_columns(["code", "word", "n"])

    parts, rows = [], 0
    for batch in batches:
        learns = batch.column("learns").to_numpy(zero_copy_only=False)
        for lo, hi, raw, offsets in blocks(batch.column("text"), 1 << 22):
            data, words, codes, doc = _symbols(raw, offsets)
            unique, at, place = np.unique(codes, return_index=True, return_inverse=True)
            n = np.bincount(place, weights=learns[lo:hi][doc], minlength=len(unique)).astype(np.int64)
            is_word = at < len(words)
            start, end = words.start[at[is_word]], words.end[at[is_word]]
            length = np.zeros(len(unique), np.int64)
            length[is_word] = end - start
            text = data[ranges(start, end - start)]
            word = pa.Array.from_buffers(pa.large_binary(), len(unique), [None, pa.py_buffer(np.append(0, np.cumsum(length))), pa.py_buffer(text)])
            parts.append(pa.table({"code": as_long(unique), "word": word, "n": n}))
            rows += len(unique)
            if rows > FLUSH:
                parts = [summed(parts)]
                rows = len(parts[0])
                if rows > FLUSH // 2:
                    yield from _binary(parts.pop())
                    rows = 0
    if parts:
        yield from _binary(summed(parts))


def _binary(t: pa.Table):
    for part in t.to_batches(max_chunksize=1 << 16):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.binary()), part.column(2)], names=["code", "word", "n"])


def symbol_counts(docs: DataFrame) -> DataFrame:
    """(code, word, n) of all symbols of the texts (text, learns); n counts the rows that learn.  A step has an empty word."""
    return docs.mapInArrow(_count, SYMBOLS).groupBy("code", "word").agg(F.sum("n").alias("n"))


def symbol_grams(codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram, symbol index): ``DEPTH`` bytes of context, then the byte, for all bytes that the symbols stand for."""
    steps = (codes >> np.uint64(56)) == np.uint64(255)
    data, at = text_buffers(words)
    length = np.diff(at)
    # Each word between blanks, behind zeros for what no context reaches.
    ahead = DEPTH
    begin = np.append(0, np.cumsum(np.where(steps, 0, length + ahead + 1)))
    text = np.zeros(int(begin[-1]) + 8, np.uint8)
    own = np.flatnonzero(~steps)
    text[begin[own] + ahead - 1] = 32
    text[ranges(begin[own] + ahead, length[own])] = data[ranges(at[own], length[own])]
    text[begin[own] + ahead + length[own]] = 32
    eight = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    # The blank is predicted too, the first byte is not: it belongs to the step.
    grams = eight[ranges(begin[own] + 1, length[own])].astype(np.uint64)
    step = codes[steps]
    first = (step & np.uint64(0xFFFFFF00)) << np.uint64(8) | np.uint64(32 << 8) | (step & np.uint64(255))
    return np.concatenate([grams, first]), np.concatenate([np.repeat(own, length[own]), np.flatnonzero(steps)])


def _cut(batches):
    for batch in batches:
        codes = batch.column("code").to_numpy().view(np.uint64)
        for lo in range(0, len(codes), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            gram, symbol = symbol_grams(codes[part], batch.column("word")[part])
            unique, place = np.unique(gram, return_inverse=True)
            n = np.bincount(place, weights=batch.column("n").to_numpy()[part][symbol], minlength=len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(((unique >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(as_long(unique)), pa.array(n)], names=["shard", "gram", "n"])


def gram_shards(symbols: DataFrame) -> DataFrame:
    """(shard, grams): the grams (gram, n) of the symbols, one row for each last ``SHARD`` bytes of context."""
    cut = symbols.mapInArrow(_cut, "shard int, gram long, n long").repartition("shard")
    return cut.groupBy("shard", "gram").agg(F.sum("n").alias("n")).groupBy("shard").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series behind a shift by 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one context depth.  Keys hold the context, newest byte first, and the node of the byte's binary tree (1 to 255)."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, deeper: np.ndarray | None):
        self.keys = keys
        own = _log_kt(n0, n1)
        self.seen = n0 + n1 > 0
        self.kt = (n1 + 0.5) / (n0 + n1 + 1.0)
        if deeper is None:
            self.weighted, self.share = own, np.ones_like(own)
        else:
            self.weighted = np.logaddexp(own, deeper) - np.log(2)
            self.share = 1 / (1 + np.exp(np.clip(deeper - own, -700, 700)))
        self.n0, self.n1 = n0, n1

    def shorter(self) -> tuple[Level, np.ndarray]:
        """The level of contexts one byte shorter, and where in it each node of this one hangs."""
        keys, up = np.unique((self.keys >> np.uint64(16)) << np.uint64(8) | (self.keys & np.uint64(255)), return_inverse=True)
        add = lambda x: np.bincount(up, weights=x, minlength=len(keys))
        return Level(keys, add(self.n0), add(self.n1), add(self.weighted)), up


def _reversed_context(grams: np.ndarray) -> np.ndarray:
    return (grams & ~np.uint64(255)).byteswap()


def _decisions(grams: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """(deepest level, node of each decision, bit of each decision), eight decisions a gram."""
    byte = grams & np.uint64(255)
    k = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << k) | (byte[:, None] >> (np.uint64(8) - k))
    bit = ((byte[:, None] >> (np.uint64(7) - k)) & np.uint64(1)).astype(np.int64).ravel()
    keys, at = np.unique((_reversed_context(grams)[:, None] << np.uint64(8) | node).ravel(), return_inverse=True)
    weight = np.repeat(n.astype(float), 8)
    n1 = np.bincount(at, weights=weight * bit, minlength=len(keys))
    return Level(keys, np.bincount(at, weights=weight, minlength=len(keys)) - n1, n1, None), at, bit


def _subtree(grams: np.ndarray, n: np.ndarray):
    """Levels DEPTH to SHARD of whole shards, and the links between them."""
    deepest, at, bit = _decisions(grams, n)
    levels, ups = [deepest], []
    while len(levels) <= DEPTH - SHARD:
        level, up = levels[-1].shorter()
        levels.append(level)
        ups.append(up)
    return levels, ups, at, bit


def _shards(batch, size: int = 1 << 17):
    """(grams, counts) of whole shards, about ``size`` grams at once."""
    rows = batch.column("grams")
    at = rows.offsets.to_numpy()
    flat = rows.values
    gram, n = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield gram[at[lo] : at[hi]], n[at[lo] : at[hi]]
        lo = hi


def _remainders(batches):
    for batch in batches:
        for gram, n in _shards(batch):
            levels, _, _, _ = _subtree(gram, n)
            top = levels[-1]
            keys, up = np.unique((top.keys >> np.uint64(16)) << np.uint64(8) | (top.keys & np.uint64(255)), return_inverse=True)
            columns = [np.bincount(up, weights=x, minlength=len(keys)) for x in (top.n0, top.n1, top.weighted)]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), *map(pa.array, columns)], names=["key", "n0", "n1", "weighted"])


def short_contexts(shards: DataFrame) -> list[Level]:
    """Levels SHARD - 1 to 0.  What is collected is bounded by 65,536 contexts of 255 nodes."""
    sums = shards.mapInArrow(_remainders, "key long, n0 double, n1 double, weighted double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighted")]).toArrow()
    key, n0, n1, deeper = (sums.column(c).to_numpy() for c in ("key", "n0", "n1", "weighted"))
    order = np.argsort(key.view(np.uint64))
    levels = [Level(key.view(np.uint64)[order], n0[order], n1[order], deeper[order])]
    while len(levels) < SHARD:
        levels.append(levels[-1].shorter()[0])
    return levels


def gram_logs(gram: np.ndarray, n: np.ndarray, short: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context; the grams are those of whole shards."""
    levels, ups, at, bit = _subtree(gram, n)
    above = np.arange(len(levels[0].keys))
    p, seen = levels[0].kt, levels[0].seen
    keys = levels[0].keys

    def mixed(level, where):
        own = level.kt[where]
        found = np.where(seen, level.share[where] * own + (1 - level.share[where]) * p, own)
        return found, level.seen[where]

    for level, up in zip(levels[1:], ups, strict=True):
        above = up[above]
        p, seen = mixed(level, above)
    for d, level in zip(range(SHARD - 1, -1, -1), short, strict=True):
        key = (keys >> np.uint64(8 * (DEPTH - d) + 8)) << np.uint64(8) | (keys & np.uint64(255))
        p, seen = mixed(level, np.searchsorted(level.keys, key))
    chosen = np.where(bit == 1, p[at], 1 - p[at])
    return np.log10(chosen).reshape(-1, 8).sum(1)


def _gram_logs(short):
    def run(batches):
        for batch in batches:
            for gram, n in _shards(batch):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(gram)), pa.array(n), pa.array(gram_logs(gram, n, short.value))], names=["gram", "n", "logs"])

    return run


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key among sorted ones."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grouped(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list ends, code, times): the distinct codes of each of n owners."""
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32), code[first], np.diff(np.append(first, len(order)))


RARE = "rare array<struct<code:bigint,times:bigint>>"


def _rare(owner, code, n):
    ends, code, times = _grouped(owner, code, n)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(as_long(code)), pa.array(times)], names=["code", "times"]))


def _symbol_logs(frequent):
    def run(batches):
        grams, logs = frequent.value
        for batch in batches:
            codes, words, n = batch.column("code"), batch.column("word"), batch.column("n")
            for lo in range(0, len(codes), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                code = codes[part].to_numpy().view(np.uint64)
                gram, symbol = symbol_grams(code, words[part])
                at, hit = _lookup(grams, gram)
                total = np.bincount(symbol[hit], weights=logs[at[hit]], minlength=len(code)) if len(grams) else np.zeros(len(code))
                yield pa.RecordBatch.from_arrays([codes[part], n[part], pa.array(total), _rare(symbol[~hit], gram[~hit], len(code))], names=["code", "n", "logs", "rare"])

    return run


def _most_frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows with n at or above the least power of 2 ** (1/8) that leaves at most ``most`` of them."""
    scale = F.ceil(F.log2("n") * 8).cast("int")
    sizes = df.filter("n > 0").groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect()  # at most 505 rows
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r.scale
    return df.filter("n > 0").filter(scale >= least) if least is not None else df.limit(0)


def symbol_scores(spark: SparkSession, symbols: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(code, n, logs): count and log10 probability of every symbol."""
    shards = written(spark, gram_shards(symbols), "shards")
    short = spark.sparkContext.broadcast(short_contexts(shards))
    grams = written(spark, shards.mapInArrow(_gram_logs(short), "gram long, n long, logs double"), "grams")
    head = _most_frequent(grams, frequent).select("gram", "logs").toArrow()
    key, logs = head.column("gram").to_numpy().view(np.uint64), head.column("logs").to_numpy()
    order = np.argsort(key)
    share = spark.sparkContext.broadcast((key[order], logs[order]))
    partial = written(spark, symbols.mapInArrow(_symbol_logs(share), f"code long, n long, logs double, {RARE}"), "partial")
    rare = partial.filter(F.size("rare") > 0).select(F.col("code").alias("symbol"), F.inline("rare"))
    more = rare.join(grams.select(F.col("gram").alias("code"), "logs"), "code").select(F.col("symbol").alias("code"), F.lit(0).cast("long").alias("n"), (F.col("logs") * F.col("times")).alias("logs"))
    return partial.select("code", "n", "logs").unionByName(more).groupBy("code").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs"))


def _score(top):
    def run(batches):
        codes, logs, counts = top.value
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column("text")):
                _, words, mine, doc = _symbols(raw, offsets)
                n = hi - lo
                at, hit = _lookup(codes, mine)
                score = np.bincount(doc[hit], weights=logs[at[hit]], minlength=n) if len(codes) else np.zeros(n)
                of_words = np.flatnonzero(hit[: len(words)])
                known = np.bincount(doc[of_words], minlength=n)
                base = np.bincount(doc[of_words], weights=counts[at[of_words]], minlength=n) if len(codes) else np.zeros(n)
                n_bytes = np.bincount(words.doc, weights=words.end - words.start + 1, minlength=n).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(np.diff(words.first) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(n_bytes), _rare(doc[~hit], mine[~hit], n)],
                    names=["doc_id", "n_tokens", "known", "base", "logs", "n_bytes", "rare"],
                )

    return run


def score_texts(spark: SparkSession, docs: DataFrame, learns, top: int = TOP, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs`` (doc_id, text); ``learns`` tells which rows train."""
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    symbols = written(spark, symbol_counts(source), "symbols")
    is_word = F.shiftrightunsigned("code", 56) != 255
    ends = F.when(~is_word & (F.col("code").bitwiseAND(F.lit(255)) == END), F.col("n"))
    word_n = F.when(is_word & (F.col("n") > 0), F.col("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total, distinct, end_n = symbols.agg(zero(F.sum(word_n)), F.count(word_n), zero(F.sum(ends))).first()
    total, distinct = total + end_n, distinct + (end_n > 0)
    scores = written(spark, symbol_scores(spark, symbols.select("code", "word", "n"), frequent), "scores")
    head = _most_frequent(scores, top).toArrow()
    code, n, logs = (head.column(c).to_numpy() for c in ("code", "n", "logs"))
    order = np.argsort(code.view(np.uint64))
    share = spark.sparkContext.broadcast((code.view(np.uint64)[order], logs[order], np.log10(n[order] + 1.0)))

    fields = "doc_id long, n_tokens long, known long, base double, logs double, n_bytes long"
    scored = source.mapInArrow(_score(share), f"{fields}, {RARE}").withColumn("row", F.monotonically_increasing_id())
    scored = written(spark, scored, "scored")  # the number of a row is settled here
    rare = scored.filter(F.size("rare") > 0).select("row", F.inline("rare"))
    found = rare.join(scores.withColumnRenamed("logs", "log"), "code")
    known = F.when(is_word & (F.col("n") > 0), F.col("times"))
    base = F.when(is_word, F.col("times") * F.log10(F.col("n") + 1))
    found = found.groupBy("row").agg(F.sum(known).alias("more_known"), F.sum(base).alias("more_base"), F.sum(F.col("times") * F.col("log")).alias("more_logs"))
    joined = scored.drop("rare").join(found, "row", "left")
    score = F.col("logs") + zero(F.col("more_logs"))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero(F.col("more_known")) + F.lit(int(end_n > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("more_base")) + F.log10(F.lit(float(end_n + 1))) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out():
    return F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
