"""Near copies by sketches, against the similarity of all pairs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import minhash, simhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed, groups=25):
    """Texts, and copies with words replaced so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(60, 500))]
        texts.append(" ".join(base))
        for rate in (0.005, 0.01, 0.02, 0.08, 0.2):
            texts.append(" ".join(word() if rng.random() < rate else w for w in base))
    return texts


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_sketches_agree_as_often_as_sets_are_alike():
    texts = [None, "", "a b", "A  b", "a b c d e", *corpus(1, 12)]
    prints, bands = minhash.sketches(pa.array(texts))
    assert prints[0] is prints[1] is bands[0] is None and prints[2] == prints[3] and (bands[2] == bands[3]).all()
    for i in range(5, len(texts)):
        for j in range(5, i):
            share = sum(x == y for x, y in zip(prints[i], prints[j], strict=True)) / len(prints[i])
            assert abs(share - similarity(texts[i], texts[j])) < 0.15


@pytest.mark.parametrize(("split", "hubs"), [(4096, 64), (4, 2)])
def test_near_copies_of_different_texts_are_found(spark, split, hubs, monkeypatch):
    texts = corpus(2)
    prints, bands = minhash.sketches(pa.array(texts))
    df = spark.createDataFrame([(i + 7, i, p, b.tolist()) for i, (p, b) in enumerate(zip(prints, bands, strict=True))], "key long, node long, sketch binary, bands array<long>")
    links = [(r.a, r.b) for r in minhash.sketch_links(spark, df, split, hubs).collect()]
    root = components(len(texts), links)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] != texts[j] and similarity(texts[i], texts[j]) >= 0.8]
    assert len(near) > 40 and sum(root[i] == root[j] for i, j in near) >= (0.97 if split > 100 else 0.9) * len(near)
    assert all(similarity(texts[i], texts[j]) > 0.55 for i, j in links)


def test_a_bucket_cut_into_chunks_loses_no_link(spark):
    """60 texts share one band only: every two are near enough along a chain, so that no few of them see all the others."""
    n, places = 60, minhash.BANDS * minhash.ROWS
    prints = [bytes(1 if p < 2 * i else 0 for p in range(places)) for i in range(n)]  # i and j differ in 2 |i - j| places
    prints += prints[:3]
    df = spark.createDataFrame([(i + 7, i, p, [1]) for i, p in enumerate(prints)], "key long, node long, sketch binary, bands array<long>")
    whole = components(len(prints), [(r.a, r.b) for r in minhash.sketch_links(spark, df).collect()])
    assert len(set(whole)) == 1
    # Texts of which only neighbours link: 21 places apart link, 42 do not.
    prints = [bytes(1 if p // 41 == i else 0 for p in range(places)) for i in range(3)] + [bytes(i if p % 2 else 0 for p in range(places)) for i in range(2, 40)]
    pairs = [bytes((i if p % 2 else 0) if p != 4 else 255 for p in range(places)) for i in range(2, 40)]  # one near partner for each of many that do not link
    every = prints + pairs
    df = spark.createDataFrame([(i + 7, i, p, [1]) for i, p in enumerate(every)], "key long, node long, sketch binary, bands array<long>")
    cut = components(len(every), [(r.a, r.b) for r in minhash.sketch_links(spark, df, 8, 2).collect()])
    assert all(cut[3 + i] == cut[len(prints) + i] for i in range(len(pairs)))


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    texts = corpus(3, 15)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (901, None), (902, ""), (903, "a b"), (904, "A b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string").withColumn("bands", F.lit(1))
    kept = {r.doc_id for r in simhash.one_of_each(spark, df).collect()}
    assert 900 not in kept and {901, 903} <= kept and not {902, 904} & kept
    of = dict(rows)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    assert sum(not (i in kept and j in kept) for i, j in near) >= 0.95 * len(near)
    alone = [i for i in range(len(texts)) if all(similarity(texts[i], t) < 0.5 for j, t in enumerate(texts) if j != i)]
    assert alone and set(alone) <= kept and all(of[i] is not None for i in alone)


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "seven eight nine ten"), ("c", "seven eight nine ten")], "doc_id string, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(spark, df).collect()) == ["a", "c"]
