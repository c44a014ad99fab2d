"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file (one base64 token and its rank a line) is read once by the driver and
broadcast, about a megabyte, so executors need no copy of it; a larger one than
``RANK_BYTES`` is refused.  A Python worker builds its encoder once.

A pattern cuts a text into matches, and each match is encoded by itself.  A long text is
cut into parts before it reaches the library, only at places where every match of a
``LIKE_PATTERN`` pattern ends: before a blank that follows something else, and between a
letter or digit and ASCII marks.  No match spans such a place and no look-ahead sees past it, so the
parts give the ids of the whole text.  A very long run of blanks, which would exhaust the
library's stack, is one match but for its last blank, which may begin the next match; it is
encoded whole.  Another pattern than ``LIKE_PATTERN`` is applied to whole texts.

Ids are decoded to raw bytes, so ids that split a character are no matter.

Defined cases: a null text counts as empty and has no ids; a null list of ids has no bytes; an
unknown id ends the job with an error; an empty table gives no rows; repeated rows repeat; other
columns pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import blocks

RANK_BYTES = 64 << 20
PART = 1 << 16
SLICE = 1 << 18
LIKE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The characters of Unicode's property White_Space, which ``\s`` means to the library.
BLANKS = "\t-\r \u0085   -     　"
# Letters that every version of Unicode knows as such.
LETTERS = "A-Za-zÀ-ÖØ-öぁ-ゔ一-龥가-힣"
SAFE = re.compile(f"(?<=[^{BLANKS}])(?=[{BLANKS}])|(?<=[{LETTERS}])(?=[0-9!-/:-@\\[-`{{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\\[-`{{-~])")
RUN_OF_BLANKS = re.compile(f"[{BLANKS}]{{{PART},}}")
_coders: dict = {}


def parts(text: str, size: int = PART, blanks: re.Pattern = RUN_OF_BLANKS):
    """(part, whether it is one match as it is) of a text, cut only where matches end."""
    at = 0
    while at < len(text):
        run = blanks.search(text, at)
        end = run.start() if run else len(text)
        while at < end:
            cut = SAFE.search(text, at + size, end) if end - at > size else None
            to = cut.start() if cut else end
            yield text[at:to], False
            at = to
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
            if at < len(text):  # the last blank, with what follows up to the next safe place
                cut = SAFE.search(text, at + 1)
                to = cut.start() if cut else len(text)
                yield text[at:to], False
                at = to


class Coder:
    """Encodes texts and decodes ids."""

    def __init__(self, ranks: bytes, pattern: str = LIKE_PATTERN):
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.by_pattern = tiktoken.Encoding("by pattern", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.as_it_is = tiktoken.Encoding("as it is", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={})
        self.cuts = pattern == LIKE_PATTERN

    def encode(self, text: str) -> list[int]:
        if not self.cuts or len(text) <= PART:
            return self.by_pattern.encode_ordinary(text)
        ids: list[int] = []
        for part, one in parts(text):
            ids += (self.as_it_is if one else self.by_pattern).encode_ordinary(part)
        return ids

    def decode(self, ids) -> bytes:
        return self.by_pattern.decode_bytes(ids)


def _coder(ranks: bytes, pattern: str) -> Coder:
    key = (hash(ranks), pattern)
    if key not in _coders:
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        ranks = f.read(RANK_BYTES + 1)
    if len(ranks) > RANK_BYTES:
        raise ValueError(f"{path} has more than {RANK_BYTES} bytes; it is no rank file of a vocabulary")
    return spark.sparkContext.broadcast(ranks)


def _mapped(df: DataFrame, source: str, name: str, kind, run) -> DataFrame:
    """``df`` with the column ``name``, which ``run(values, keep)`` makes from ``source``: it yields keep(lo, hi, made) for rows lo to hi."""
    kept = [f for f in df.schema.fields if f.name != name]
    # Columns go by their place, as their names may be anything.
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    of, places = df.columns.index(source), [i for i, c in enumerate(df.columns) if c != name]

    def rows(batches):
        for batch in batches:

            def keep(lo: int, hi: int, made: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in places), made], names=[*(f"c{i}" for i in range(len(places))), "made"])

            yield from run(batch.column(of), keep)

    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), StructField("made", kind)])
    return numbered.mapInArrow(rows, schema).toDF(*(f.name for f in kept), name)


def encode_texts(spark: SparkSession, docs: DataFrame, path: str, pattern: str = LIKE_PATTERN) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the tokens of its column ``text``."""
    ranks = _ranks(spark, path)

    def run(text, keep):
        coder = _coder(ranks.value, pattern)
        for lo, hi, _, _ in blocks(text):
            ids = [np.array(coder.encode(t) if t else [], np.int32) for t in text.slice(lo, hi - lo).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            yield keep(lo, hi, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())))

    return _mapped(docs, "text", "ids", ArrayType(IntegerType()), run)


def decode_ids(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded`` (binary), the bytes of its column ``ids``."""
    ranks = _ranks(spark, path)

    def run(ids, keep):
        coder = _coder(ranks.value, LIKE_PATTERN)
        flat, length = ids.flatten().to_numpy(), np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(length)])
        lo = 0
        while lo < len(ids):  # some rows at a time, as the numbers of a whole batch take much memory
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
            yield keep(lo, hi, pa.array([coder.decode(flat[at[i] : at[i + 1]].tolist()) for i in range(lo, hi)], pa.binary()))
            lo = hi

    return _mapped(rows, "ids", "decoded", BinaryType(), run)


def ids_text(column: str = "ids"):
    """Decimal ids joined by blanks."""
    return F.array_join(F.col(column).cast("array<string>"), " ")
