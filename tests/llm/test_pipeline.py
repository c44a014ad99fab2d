"""The stages of the corpus pipeline against brute force, and the queries on rows of odd kinds."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import packing, pii, queries, simhash

WORDS = ["thon", "ered", "blean", "stori", "andou", "hesti", "nesti", "orbin", "walle", "quent", "marsh", "tolve"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=2):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcde") for _ in range(n))
    item = text(30)
    rows = [(i, text(rng.randint(20, 120)) + (" you stupid idiot " if i % 4 == 0 else " ") + text(10)) for i in range(80)]
    rows += [(100, rows[1][1]), (101, rows[1][1]), (101, rows[1][1]), (102, text(50)), (102, text(60)), (103, text(20) + " " + item + " " + text(300)), (104, text(40) + " write to a.b@mail.example.com or +49 (111) 222-3333 " + text(5))]
    rows += [(None, rows[2][1]), (None, item + " " + text(60)), (None, text(70)), (None, None), (105, None), (106, ""), (107, "x" * 5000), (108, text(3000))]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], [(1, item), (2, None)]


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(c, t, r, f"{c} {t}") for c in range(0, 20, 3) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, [0.1 * (i % 7)] * 64) for i in range(20)] + [(None, None), (3, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def near_copies(rows):
    """Brute force: components of fingerprints, and of each the row of the least id (null last)."""
    prints = [simhash.fingerprint((t or "").encode()) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS:
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    return [min((rows[a][0] is None, rows[a][0] or 0) for a in g) for g in groups.values()]


def test_stages_are_brute_force(spark, sf_dir):
    rows, items = made()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert toxic.columns == docs.columns and rows_of(toxic) == sorted(tuple(map(str, r)) for r in rows if "stupid" not in (r[1] or ""))

    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(near_copies(rows))
    assert set(rows_of(kept)) <= {tuple(map(str, r)) for r in rows}

    grams = lambda t: {tuple(w[p : p + 5]) for w in [re.findall(r"[a-z0-9]+", (t or "").lower())] for p in range(len(w) - 4)}
    leaked = lambda t: len(grams(items[0][1]) & grams(t)) >= 0.8 * len(grams(items[0][1]))
    clean = corpus_pipeline.drop_leaks(spark, docs, sf_dir)
    assert clean.columns == docs.columns and rows_of(clean) == sorted(tuple(map(str, r)) for r in rows if not leaked(r[1]))
    assert clean.count() == len(rows) - 2

    def masked(text):
        out, field = text or "", pii.trained()
        for kind, a, b, _ in reversed(pii.find_spans(out, field)):
            out = f"{out[:a]}<{kind}>{out[b:]}"
        return None if text is None else out

    hidden = corpus_pipeline.mask_personal_data(spark, docs, sf_dir)
    assert rows_of(hidden) == sorted((str(i), str(masked(t)), *rest, str(None if t is None else len(masked(t)))) for i, t, *rest, _ in rows)
    assert any("write to <email> or <phone>" in (r.text or "") for r in hidden.collect())


def test_pipeline_is_its_stages_in_turn(spark, sf_dir):
    rows, _ = made()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sum(r.n_tokens for r in out) == sum(len((t or "").split()) + 1 for _, t in left)
    assert sorted({str(r.doc_id) for r in out}) == sorted({str(i) for i, _ in left})
    assert 0 < len(left) < len(rows) and all(r.sequence_length in packing.LENGTHS for r in out)


CLASH = ("score", "component_id", "fp", "key", "row", "row_key", "item_id", "spans", "toxic", "id", "n_tokens", "best", "a.b")


def test_stages_pass_on_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(f"of {c}") for c in CLASH})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[5:] == list(CLASH)
    assert all(r[5:] == tuple(f"of {c}" for c in CLASH) for r in map(tuple, docs.collect()))
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() > 0


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_on_odd_and_on_no_rows(spark, sf_dir, tmp_path, name):
    whole = queries.queries()[name](spark, sf_dir).collect()
    if name not in ("op6_preference", "op8_decontaminate", "op9_packing", "op12_yinyang"):
        assert sorted(str(r.doc_id) for r in whole) == sorted(str(r[0]) for r in made()[0])
    for table in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert queries.queries()[name](spark, f"{tmp_path}/none").collect() == []
