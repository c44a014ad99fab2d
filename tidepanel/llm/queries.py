"""The training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, ctw, decontaminate, importance, language, matroska, packing, pii, preference, simhash, substring_dedup, toxicity, yinyang
from .common import crc_mod, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(spark, docs, labels, crc_mod("doc_id", 5) != 0)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select(F.col("doc_id").cast("long"), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_language(spark, table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) != 2)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(table(spark, sf_dir, "documents"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.pairs_from_conversations(table(spark, sf_dir, "conversations")))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score_texts(spark, table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", ctw.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(spark, table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.decode_ids(spark, byte_bpe.encode_texts(spark, docs, path, public_tokenizers.PATTERN).drop("text"), path)
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(byte_bpe.ids_text(), "ids_sha256"), sha(F.col("decoded"), "decoded_sha256"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.with_inertia(spark, yinyang.cluster_vectors(spark, table(spark, sf_dir, "embeddings")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.importance(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
d AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)
)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / n AS containment
FROM d JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8
"""

OP13_SQL = r"""
WITH both_sides AS (
  SELECT row_number() OVER () AS r, doc_id, false AS target, text FROM documents UNION ALL SELECT row_number() OVER () AS r, NULL AS doc_id, true AS target, text FROM benchmark
), split AS (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_sides
), counted AS MATERIALIZED (
  SELECT r, target, g, count(*) AS n FROM (
    SELECT r, target, unnest(w) AS g FROM split UNION ALL
    SELECT r, target, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM split WHERE len(w) > 1
  ) GROUP BY r, target, g
), lookup AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS crc FROM range(256) t(i)
), hashed AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)
), bucketed AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || h[2 * i - 1 : 2 * i] AS BIGINT)), lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM hashed, lookup
), sums AS (
  SELECT bucket, CAST(sum(n) FILTER (NOT target) AS DOUBLE) AS s, CAST(sum(n) FILTER (target) AS DOUBLE) AS t FROM counted JOIN bucketed USING (g) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1) * (sum(coalesce(s, 0)) OVER () + 10000) / ((coalesce(s, 0) + 1) * (sum(coalesce(t, 0)) OVER () + 10000)))) AS BIGINT) AS gain FROM sums
), weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM counted JOIN bucketed USING (g) JOIN gains USING (bucket) WHERE NOT target GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((CASE WHEN total % n_features < 0 THEN total - total % n_features - n_features ELSE total - total % n_features END) // n_features, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM split LEFT JOIN weighed USING (r) WHERE NOT target
), noisy AS (
  SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(h AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS n FROM noisy WHERE n_words >= 20 AND score IS NOT NULL
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CAST(CASE WHEN rank <= 25 * n // 100 THEN rank END AS BIGINT) AS rank FROM noisy LEFT JOIN placed USING (r)
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE lo < doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone_at FROM hit GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone_at), 0) AS n_removed,
         CASE WHEN gone_at IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone_at, i)) END AS k
  FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds over all distances, one common table a round."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "long AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS p, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY r)"
        )
        if i < rounds:
            mean = "list((CASE WHEN s % n < 0 THEN s - (s % n) - n ELSE s - (s % n) END) // n ORDER BY p)"
            steps.append(f"m{i} AS MATERIALIZED (SELECT c, {mean} AS v FROM (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM long JOIN a{i} USING (r) GROUP BY c, p) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    joined = ",\n".join(steps)
    return f"""WITH {joined}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} f ON f.c = a.c"""


def queries() -> dict:
    found = (op1_substring_dedup, op2_pii, op3_toxicity, op4_language, op5_matroska, op6_preference, op7_context_tree, op8_decontaminate, op9_packing, op10_simhash, op11_byte_bpe, op12_yinyang, op13_importance)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL.strip(), "op8_decontaminate": OP8_SQL.strip(), "op12_yinyang": _op12_sql(), "op13_importance": OP13_SQL.strip()}
