"""Quality rules: counts over whole texts, then zstandard compression bands.

Words are runs of bytes other than ASCII white space.  A text fails the base
rules with fewer than 10 words, or if more than a fifth of its words stand in
five-word windows that the text holds twice or more.  What is left is compressed
with zstandard, whole and in consecutive chunks of ``CHUNK`` bytes (the last one
overlaps the one before, so that all bytes of a text of more than ``CHUNK`` are
judged in chunks of equal length; a shorter text is its only chunk): a ratio of
compressed to plain bytes under the band for its length is repetitive, one above
it incompressible.  A
text is kept if its whole ratio lies in the band, no chunk is incompressible and
fewer than half of its chunks are repetitive.  The bands are fixed limits, wider
for shorter texts, of which zstandard's own frame is a larger part.

Null and empty texts have zero counts and fail the base rules.  Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

CHUNK, LEVEL = 512, 3
#: From so many bytes: lowest and highest ratio of a text, and of a chunk.
BANDS = ((0, 0.0, 9.9), (64, 0.20, 1.30), (128, 0.30, 1.10), (256, 0.28, 0.95), (512, 0.25, 0.85), (1024, 0.20, 0.78), (2048, 0.17, 0.72), (4096, 0.15, 0.68), (16384, 0.12, 0.66))
CHUNK_BAND = (0.20, 0.82)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(offsets) - 1
    starts, ends, per = kernels.words(data, offsets)
    row = np.repeat(np.arange(n), per)

    def total(flag):
        return np.diff(np.concatenate(([0], np.cumsum(flag)))[offsets])

    out = {"n_words": per, "word_chars": total(~kernels.SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data])}
    prefix = kernels.prefix_hash(data)
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    of = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + 1)
    inside = np.concatenate(([0], np.cumsum(~kernels.SPACE[data])))
    full = inside[end] > inside[begin]
    h, of, number, _ = kernels.multiset(kernels.span_hash(prefix, begin[full], end[full]), of[full])
    out["n_dup_lines"] = np.bincount(of[number > 0], minlength=n)
    word = kernels.span_hash(prefix, starts, ends)
    grams = kernels.combine(word, 5)
    place = np.flatnonzero(row[: len(grams)] == row[4:]) if len(grams) else np.zeros(0, int)
    order = np.lexsort((grams[place], row[place]))
    place = place[order]
    same = (grams[place[1:]] == grams[place[:-1]]) & (row[place[1:]] == row[place[:-1]])
    twice = np.zeros(len(place), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(word) + 6, np.int64)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + 5, -1)
    covered = np.cumsum(cover)[: len(word)] > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out


def band(size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def passes(text: memoryview | bytes, compressor: zstandard.ZstdCompressor) -> bool:
    size = len(text)
    if not size:
        return False
    low, high = band(size)
    if not low <= len(compressor.compress(text)) / size <= high:
        return False
    if size <= CHUNK:
        return True
    starts = [*range(0, size - CHUNK, CHUNK), size - CHUNK]
    ratios = np.array([len(compressor.compress(text[k : k + CHUNK])) / CHUNK for k in starts])
    return not (ratios > CHUNK_BAND[1]).any() and 2 * int((ratios < CHUNK_BAND[0]).sum()) < len(starts)


def assess(batch: pa.RecordBatch):
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    data, offsets = kernels.utf8(batch.column(1))
    for i, j, part, at in kernels.blocks(data, offsets, kernels.BLOCK_BYTES):
        c = counts(part, at)
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        view = memoryview(part.tobytes())
        kept = [not f and passes(view[a:b], compressor) for f, a, b in zip(failed, at[:-1].tolist(), at[1:].tolist(), strict=True)]
        cols = [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols, pa.array(failed), pa.array(kept, pa.bool_())], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return common.arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")), assess, schema).withColumnRenamed("id", id_col)


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))
