"""Toxicity scores from a bag of subwords, averaged into a linear softmax.

A word is represented by its character n-grams (3 to 5 bytes, with a blank for
its borders) and by itself, each hashed to a row of an embedding matrix.  A
window of ``WINDOW`` neighbouring words is the mean of all its subword vectors,
and a linear softmax over that mean gives two class probabilities.  A document
scores as its worst window, so that length does not dilute what it says.

Embeddings and softmax weights are trained jointly by Adagrad in numpy: some
rounds on whole documents, then rounds in which each document stands for the
window that the present model finds worst.  Misspellings share n-grams with
their words and so share vectors.

Training uses at most ``SAMPLE`` labelled rows of each class, those with the least
xxhash64 of their id among the ids that ``learns`` admits; of an id that repeats the least
text trains.  The sample of a class is also bounded by ``SAMPLE_CHARS`` characters: texts of more than a
``LONG_SHARE``-th of them come last, so that a long text takes no room from others, and the
first text always trains, by its first ``SAMPLE_CHARS`` characters.  The sample is the only thing that reaches the driver, as it is the
classifier's bounded fit.  Every row is scored, on the executors, with the product
of embeddings and weights, one number a bucket.

Defined cases: A-Z count as lower case; null or empty text is a window without
subwords, whose score is that of the bias; documents shorter than a window are
one window; without training rows of both classes the score is 0 everywhere;
duplicate rows repeat; other columns (labels, lang, source, ids) never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, mix, ranges, word_codes

WINDOW = 4
SIZES = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 8
SAMPLE = 500
SAMPLE_CHARS = 1 << 23
LONG_SHARE = 16
ROUNDS = 30


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a block, and all their subwords as (word, bucket)."""
    data = LOWER[data]
    words = Words(data, offsets)
    if not len(words):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # One blank before, between and after words, whatever stood there.
    length = words.end - words.start
    begin = np.cumsum(length + 1) - length
    text = np.full(int(length.sum()) + len(words) + 1, 32, np.uint64)
    inside = np.arange(int(length.sum()))
    which = np.repeat(np.arange(len(words)), length)
    shift = np.repeat(np.cumsum(length) - length, length)
    text[inside - shift + begin[which]] = data[inside - shift + words.start[which]]
    owner = np.zeros(len(text), np.int64)
    owner[begin[1:] - 1] = 1
    owner = np.cumsum(owner)
    blank = text == 32
    all_words, all_codes = [np.arange(len(words))], [word_codes(data, words)]
    for n in SIZES:
        if len(text) < n:
            continue
        code = text[: len(text) - n + 1].copy()
        for i in range(1, n):
            code = code * np.uint64(257) + text[i : len(text) - n + 1 + i]
        good = np.ones(len(code), bool)
        for i in range(1, n - 1):
            good &= ~blank[i : len(code) + i]
        at = np.flatnonzero(good)
        all_words.append(owner[at + 1] if n > 2 else owner[at])
        all_codes.append(code[at] + np.uint64(n << 56))
    codes = mix(np.concatenate(all_codes))
    return words, np.concatenate(all_words), (codes % np.uint64(BUCKETS)).astype(np.int64)


def _window_sums(x: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """For each word the sum of x over the window that starts there, ended by its document."""
    sums = np.append(0, np.cumsum(x))
    n = len(x)
    doc_end = np.repeat(first[1:], np.diff(first))
    end = np.minimum(np.arange(n) + window, doc_end)
    return sums[end] - sums[np.arange(n)]


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, float]:
    """(logit of each bucket, bias) of the jointly trained embeddings and softmax."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), -np.inf
    # Each different word is cut into subwords once; documents are sequences of words.
    codes_of, kept, first, seen_words = [], [], [np.zeros(1, np.int64)], 0
    for _, _, d, o in blocks(pa.array(texts, pa.large_string()), 1 << 18):
        words, word, bucket = subwords(d, o)
        codes = word_codes(LOWER[d], words)
        unique, at, place = np.unique(codes, return_index=True, return_inverse=True)
        take = np.isin(word, at)
        kept.append((unique, place[word[take]].astype(np.int32), bucket[take].astype(np.int32)))
        codes_of.append(codes)
        first.append(words.first[1:] + seen_words)
        seen_words += len(words)
    first, codes = np.concatenate(first), np.concatenate(codes_of)
    vocabulary, sequence = np.unique(codes, return_inverse=True)
    have, entries = np.zeros(len(vocabulary), bool), []
    for unique, place, bucket in kept:
        number = np.searchsorted(vocabulary, unique)
        new = ~have[number][place]
        entries.append((number[place[new]], bucket[new]))
        have[number] = True
    word, bucket = (np.concatenate(x) for x in zip(*entries, strict=True))
    del kept, entries, codes, codes_of
    n_words = len(sequence)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = np.bincount(word, minlength=len(vocabulary)).astype(np.float64)
    used, bucket = np.unique(bucket, return_inverse=True)  # only the rows that the sample touches
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    seen = [np.full_like(x, 1e-6) for x in (e, w, b)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    n_grams = _window_sums(grams[sequence], first, WINDOW)
    filled = np.flatnonzero(np.diff(first))
    per = lambda index, weights, n: np.stack([np.bincount(index, weights=weights(k), minlength=n) for k in range(DIM)], 1)
    for step in range(rounds):
        vectors = per(word, lambda k: e[bucket, k], len(vocabulary))
        if step < rounds // 3:
            chosen = np.arange(n_words)
        else:
            score = _window_sums((vectors @ (w[:, 1] - w[:, 0]))[sequence], first, WINDOW) / n_grams
            top = np.maximum.reduceat(score, first[filled])
            best = np.flatnonzero(score == np.repeat(top, np.diff(first)[filled]))
            best = best[np.unique(doc_of[best], return_index=True)[1]]
            stop = np.minimum(best + WINDOW, first[doc_of[best] + 1])
            chosen = ranges(best, stop - best)
        rows, ids = doc_of[chosen], sequence[chosen]
        count = np.maximum(np.bincount(rows, weights=grams[ids], minlength=len(texts)), 1)
        mean = per(rows, lambda k: vectors[ids, k], len(texts)) / count[:, None]
        z = mean @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        back = (p @ w.T) / count[:, None]
        g_words = per(ids, lambda k: back[rows, k], len(vocabulary))
        g_e = per(bucket, lambda k: g_words[word, k], len(used)).astype(np.float32)
        for x, g, s, rate in ((e, g_e, seen[0], 0.5), (w, mean.T @ p, seen[1], 0.2), (b, p.sum(0), seen[2], 0.2)):
            s += g * g
            x -= rate * g / np.sqrt(s)
    logit = np.zeros(BUCKETS, np.float32)
    logit[used] = e @ (w[:, 1] - w[:, 0])
    return logit, float(b[1] - b[0])


def _score(model):
    def run(batches):
        logit, bias = model.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for lo, hi, data, offsets in blocks(batch.column("row").field("text"), 1 << 17):  # a byte has three subwords of many numbers each
                words, word, bucket = subwords(data, offsets)
                z = np.zeros(hi - lo)
                if len(words):
                    total = np.bincount(word, weights=logit[bucket], minlength=len(words))
                    grams = np.bincount(word, minlength=len(words)).astype(np.float64)
                    score = _window_sums(total, words.first, WINDOW) / _window_sums(grams, words.first, WINDOW)
                    filled = np.flatnonzero(np.diff(words.first))
                    z[filled] = np.maximum.reduceat(score, words.first[filled])
                out[lo:hi] = 1 / (1 + np.exp(-(z + bias)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "score"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, learns, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``sample`` labelled texts of each class; ids are chosen before any text is read."""
    usable = labels.filter(learns).filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    usable = usable.join(docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").select("doc_id"), "doc_id", "left_semi")
    chosen = [usable.filter(F.col("toxic") == k).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # broadcast: at most 2 * sample ids
    # Windows of at most ``sample`` rows.
    order = Window.partitionBy("toxic").orderBy(F.length("text") > chars // LONG_SHARE, F.xxhash64("doc_id"), "doc_id")
    part = F.substring("text", 1, chars)
    placed = texts.withColumns({"place": F.row_number().over(order), "so_far": F.sum(F.length(part)).over(order)})
    return [(r.text, r.toxic) for r in placed.filter((F.col("so_far") <= chars) | (F.col("place") == 1)).select("doc_id", part.alias("text"), "toxic").orderBy("doc_id", "text").collect()]


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, learns, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text); ``learns`` tells which label rows may train."""
    return scored_rows(spark, docs.select("doc_id", "text"), labels, learns, sample).select("row.doc_id", "score")


def scored_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, learns, sample: int = SAMPLE) -> DataFrame:
    """(row, score): every row of ``docs`` (doc_id, text, ...) as a struct, and its score."""
    rows = training_sample(docs, labels, learns, sample)
    model = spark.sparkContext.broadcast(train([t for t, _ in rows], [y for _, y in rows]))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return source.mapInArrow(_score(model), source.withColumn("score", F.lit(0.0)).schema)
