"""Importance resampling against plain counting."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import importance


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(rows, target, n=2, buckets=10_000, share=25, seed=7, least=20):
    def features(text):
        w = words_of(text)
        return [" ".join(w[p : p + k]) for k in range(1, n + 1) for p in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for g in features(x):
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(x)), len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    chosen = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    drawn = chosen[: share * len(chosen) // 100]
    ranks = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(tuple(r), []).append(k + 1)
    return sorted((tuple(r) + ((ranks[tuple(r)].pop(0) if ranks.get(tuple(r)) else None),) for r in out), key=str)


def corpus(n=90, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "naïve", "Ünder", "x1", "漢字", "the", "the", "the", "long" * 30, "e"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00 ", "  "]) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60))) for i in range(n)]
    rows += [(None, text(40)), (None, None), (n, None), (n + 1, ""), (n + 2, " .,! "), rows[5], rows[5], (5, text(30)), (n + 3, text(4_000)), (n + 4, "the " * 6_000)]
    return rows, [text(rng.randint(5, 40)) for _ in range(20)] + [None, "", "unseen words only here"]


def found(spark, rows, target, **k):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "block", "rank", "score", "row")})
    return sorted((tuple(r) for r in importance.importance(spark, docs, spark.createDataFrame([(t,) for t in target], "text string"), **k).collect()), key=str)


@pytest.mark.parametrize(("words", "buckets", "block"), [(2, 10_000, 8 << 20), (3, 70_000, 3000)])
def test_importance_is_plain_counting(spark, monkeypatch, words, buckets, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rows, target = corpus()
    assert found(spark, rows, target, words=words, buckets=buckets) == plain(rows, target, words, buckets)


def test_importance_of_empty_tables(spark):
    rows, target = corpus(40)
    assert found(spark, [], target) == []
    assert found(spark, rows, []) == plain(rows, [])
    assert found(spark, [(1, None), (2, "")], target) == plain([(1, None), (2, "")], target)


def test_each_distinct_string_is_hashed_once(spark):
    """A feature goes to one part from every block, and its part lists it once."""
    blocks = [importance.Features(importance.normal(np.frombuffer(t, np.uint8)), np.array([0, len(t)])) for t in (b"The cat, the dog the cat", b"a DOG the cat 7")]
    parts = {}
    for b in blocks:
        names = [s for k in b.strings for s in k.to_pylist()]
        assert len(set(names)) == len(names) == b.total
        order, first = b.by_part(5)
        for p in range(5):
            for f in order[first[p] : first[p + 1]]:
                assert parts.setdefault(names[f], p) == p
    assert set(parts) == {b"the", b"cat", b"dog", b"a", b"7", b"the cat", b"cat the", b"the dog", b"dog the", b"a dog", b"cat 7"}


def test_other_rows_at_the_second_reading_end_the_job(spark):
    def unsteady(batches):
        for pdf in batches:
            yield pdf.assign(text=[os.urandom(4).hex() for _ in range(len(pdf))])

    docs = spark.range(0, 300, 1, 2).withColumnRenamed("id", "doc_id").mapInPandas(unsteady, "doc_id long, text string")
    with pytest.raises(Exception, match="read alike twice"):
        importance.importance(spark, docs, spark.createDataFrame([("word1",)], "text string")).count()


def test_drawn_rows_come_as_they_are(spark):
    rows, target = corpus(60)
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, rank string")
    drawn = importance.draw(spark, docs, spark.createDataFrame([(t,) for t in target], "text string"))
    ids = {r[0] for r in plain(rows, target) if r[-1]}
    assert drawn.columns == docs.columns and sorted(map(str, drawn.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id in ids)
