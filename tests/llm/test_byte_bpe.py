"""Byte-level BPE against plain merging of each match, and round trips."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tidepanel.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = f.read()
TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}


def plain(text):
    """Ids by merging, in each match, the pair of least rank until there is none."""
    out = []
    for match in regex.findall(public_tokenizers.PATTERN, text):
        units = [bytes([b]) for b in match.encode()]
        while len(units) > 1:
            rank, i = min((TABLE.get(units[i] + units[i + 1], 1 << 30), i) for i in range(len(units) - 1))
            if rank == 1 << 30:
                break
            units[i : i + 2] = [units[i] + units[i + 1]]
        out += [TABLE[u] for u in units]
    return out


def odd_text(rng, n):
    kinds = ["the", "don't", "'s", "'", " ", "  ", "\n", "\t ", " ", "　", "12", "3", "!", "--", "é", "ß", "漢字", "。", "‍", "𝒳", "\x1c", "\x00", "<|endoftext|>", "Ä'll", "٣", "a.b", "²"]
    return "".join(rng.choice(kinds) for _ in range(n))


def test_the_pattern_is_the_one_that_is_cut():
    assert byte_bpe.LIKE_PATTERN == public_tokenizers.PATTERN


def test_encoding_is_plain_merging():
    rng, coder = random.Random(1), byte_bpe.Coder(RANKS)
    for _ in range(300):
        text = odd_text(rng, rng.randint(0, 60))
        assert coder.encode(text) == plain(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_parts_end_where_matches_end():
    rng, coder = random.Random(2), byte_bpe.Coder(RANKS)
    blanks = re.compile(f"[{byte_bpe.BLANKS}]{{3,}}")
    for k in range(600):
        text = odd_text(rng, rng.randint(0, 80)) + rng.choice(["", " " * 5, "\n\n\n\n", "   x", " \n  y"])
        cut = list(byte_bpe.parts(text, rng.randint(1, 12), blanks))
        assert "".join(p for p, _ in cut) == text
        ids = [i for p, one in cut for i in (coder.as_it_is if one else coder.by_pattern).encode_ordinary(p)]
        assert ids == coder.by_pattern.encode_ordinary(text), (k, text)


def test_very_long_texts_and_runs():
    coder = byte_bpe.Coder(RANKS)
    assert coder.encode("a" + " " * 3_000_000 + "b")[-1] == TABLE[b" b"]
    assert coder.decode(coder.encode("a" + "\n" * 2_000_000)) == b"a" + b"\n" * 2_000_000
    text = "word, and it's 12 more " * 50_000
    assert coder.encode(text) == coder.by_pattern.encode_ordinary(text)
    assert coder.decode(coder.encode("漢" * 300_000 + "!" * 300_000)).decode() == "漢" * 300_000 + "!" * 300_000


def test_ids_pass_through_spark(spark):
    rng = random.Random(3)
    rows = [(1, None, "x"), (2, "", None), (None, "a b", "y"), (2, "a b", "y"), (2, "a b", "y")] + [(i, odd_text(rng, 50), "z") for i in range(5, 40)] + [(99, "long " * 40_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1)).withColumn("a.b", F.lit("dot"))
    encoded = byte_bpe.encode_texts(spark, docs, PATH)
    found = byte_bpe.decode_ids(spark, encoded, PATH).select("doc_id", "text", "ids", "decoded", "`a.b`", byte_bpe.ids_text().alias("line")).collect()
    assert len(found) == len(rows) and all(r["a.b"] == "dot" for r in found)
    for r in found:
        assert bytes(r.decoded) == (r.text or "").encode() and r.line == " ".join(map(str, r.ids))
        if len(r.text or "") < 1000:
            assert r.ids == plain(r.text or "")
    assert byte_bpe.decode_ids(spark, byte_bpe.encode_texts(spark, docs.limit(0), PATH), PATH).count() == 0
    assert byte_bpe.decode_ids(spark, spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == b""


def test_query_of_byte_bpe(spark, tmp_path):
    from tidepanel.llm import queries

    rng = random.Random(4)
    rows = [(i, odd_text(rng, 30)) for i in range(30)] + [(30, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.queries()["op11_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids, sha = plain(text or ""), lambda x: hashlib.sha256(x).hexdigest()
        assert tuple(found[i]) == (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))


def test_a_file_that_is_no_vocabulary_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(byte_bpe, "RANK_BYTES", 10)
    with pytest.raises(ValueError, match="no rank file"):
        byte_bpe.encode_texts(spark, spark.createDataFrame([], "text string"), PATH)
