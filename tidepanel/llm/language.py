"""Language identification by compression.

For each language, training text becomes a raw-content zstandard dictionary.  A
text is encoded once with every dictionary; the language whose dictionary gives
the fewest bytes wins.  The share by which the second one is longer is the
margin; predictions with a margin under ``MARGIN`` are marked as rejected.

The dictionaries are fitted on a bounded sample: of each language whole texts, in
the order of the xxhash64 of their id, as long as they have ``DICTIONARY`` bytes
together and are at most ``SAMPLE``; the first stands last, as zstandard prefers.
A text longer than a dictionary teaches, by its middle, only where no other does.
Rows are thinned by that hash before any text leaves its task, by about how many
ids their language has, so one scan serves all languages and no task holds one.
Every text is encoded whole.

Defined cases: null text and text without a letter are ``und`` with score 0;
rows with a null lang or id teach nothing; of an id that repeats in a language the
least text teaches; ties go to the language first in order; with no languages
learned everything is ``und``; duplicate rows repeat; an empty table gives no rows;
lang, source and ids never enter a prediction, and other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

DICTIONARY = 96 << 10
SAMPLE = 120
LEVEL = 3
MARGIN = 0.01
SHARPNESS = 60.0
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> bytes:
    """Lower-case letter runs with single blanks between: case and layout tell nothing of a language."""
    return _OTHER.sub(" ", text.lower()).encode()


def _middle(raw: bytes, size: int) -> bytes:
    at = max(0, (len(raw) - size) // 2)
    return raw[at : at + size]


def _pieces(size: int):
    """The letters of each text, whole if a dictionary holds them, and whether they are."""

    def run(batches):
        for batch in batches:
            letters = [_letters(t) for t in batch.column("text").to_pylist()]
            piece = [x if len(x) <= size else _middle(x, size) for x in letters]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array([len(x) > size for x in letters], pa.bool_()), pa.array(piece, pa.binary())], names=["lang", "doc_id", "cut", "piece"])

    return run


THIN = 1 << 30


def dictionaries(docs: DataFrame, learns, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw dictionary content of each language; no more than that content is collected."""
    usable = docs.select("doc_id", "lang", "text").filter(learns).filter("lang is not null and text is not null and doc_id is not null")
    # Of ids, not rows: rows that share an id stay or go together.
    # Written, so that Spark knows its size and need not deal texts out by language to join it.
    counts = written(docs.sparkSession, usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), "languages")
    # About four times the sample of a large language, all of a small one.
    thinned = usable.join(counts, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(THIN)) * F.col("n") <= F.lit(4 * sample * THIN))
    pieces = thinned.select("lang", "doc_id", "text").mapInArrow(_pieces(size), "lang string, doc_id long, cut boolean, piece binary")
    pieces = pieces.groupBy("lang", "doc_id").agg(F.min(F.struct("cut", "piece")).alias("best")).select("lang", "doc_id", "best.*")
    # Windows of some hundred rows a language.
    order = Window.partitionBy("lang").orderBy("cut", F.xxhash64("doc_id"), "doc_id")
    taken = pieces.withColumns({"place": F.row_number().over(order), "so_far": F.sum(F.length("piece") + 1).over(order)}).filter((F.col("place") <= sample) & (F.col("so_far") <= size + 1))
    rows = taken.filter(~F.col("cut") | (F.col("place") == 1)).orderBy("lang", F.desc("place")).collect()
    found: dict[str, list[bytes]] = {}
    for r in rows:
        found.setdefault(r.lang, []).append(bytes(r.piece))
    return {lang: joined for lang, pieces in found.items() if (joined := b"\n".join(pieces)).strip()}


def _predict(model, level: int, margin: float):
    def run(batches):
        content = model.value
        langs = sorted(content)
        encoders = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            encoders.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False))
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            pred, score, rejected = [], [], []
            for text in batch.column("text").to_pylist():
                if not langs or text is None or not _LETTER.search(text):
                    pred.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                raw = _letters(text)
                sizes = np.array([len(e.compress(raw)) for e in encoders], float)
                best = int(sizes.argmin())
                weight = np.exp(-SHARPNESS * (sizes / sizes[best] - 1))
                second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
                pred.append(langs[best])
                score.append(float(1 / weight.sum()))
                rejected.append(bool(second < (1 + margin) * sizes[best]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])

    return run


def identify_language(spark: SparkSession, docs: DataFrame, learns, sample: int = SAMPLE, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text, lang); ``learns`` tells which rows teach."""
    model = spark.sparkContext.broadcast(dictionaries(docs, learns, sample))
    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(_predict(model, level, margin), "doc_id long, lang_pred string, score double, rejected boolean")
