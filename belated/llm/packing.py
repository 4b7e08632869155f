"""Packing token sequences: exact complements first, then best fit.

A document's ids end with an end id; documents longer than the sequence size are
cut into pieces of that size (the last may be shorter).  All that the plan needs
is how many pieces there are of each length, at most ``SIZE`` numbers.  For each
length, longest first, its gap to the full size is looked up among the sums of
single lengths, of pairs and of triples that are still available, and as many
sequences are filled exactly as the counts allow.  The rest is placed best fit
decreasing, again by counts.  The plan is a list of patterns (lengths of one
sequence, times used) whose size depends on the number of distinct lengths, not
of pieces.

Each piece then finds its place by itself: its number among the pieces of its
length (numbers within a hash bucket of documents plus the count of the buckets
before) picks a slot of a pattern.  No task gathers the pieces of a length.

Null and empty texts are one piece of length 1, the end id.  Rows that repeat an
id are packed each.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels
from .memory import give_back

SIZE, END_ID, CACHE_WORDS, BUCKETS = 4096, 1, 700_000, 64
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class MergeTable:
    """The merges of a byte-level BPE vocabulary with word ends, applied to many
    words at once: each round merges the leftmost pair of least rank of every
    word that still has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.none = len(pairs)
        self.result = np.array([vocab[x + y] for x, y in pairs] + [0], np.int64)
        key = np.array([(vocab[x] << 20) | vocab[y] for x, y in pairs], np.int64)
        self.slots, self.keys = 1 << 22, np.full(1 << 22, -1, np.int64)
        self.ranks = np.full(1 << 22, self.none, np.int32)
        todo = np.arange(len(key))
        step = 0
        while len(todo):  # open addressing: probe number ``step``
            at = self._slot(key[todo], step)
            free = self.keys[at] < 0
            self.keys[at[free][::-1]] = key[todo[free]][::-1]
            won = self.keys[at] == key[todo]
            self.ranks[at[won]] = todo[won]
            todo = todo[~won]
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        x = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(42)).view(np.int64) + step) & (self.slots - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = self._slot(key, 0)
        out = np.where(self.keys[at] == key, self.ranks[at], np.int32(self.none))
        for step in range(1, self.probes):  # a few of the merges were displaced
            at = (at + 1) & (self.slots - 1)
            out = np.where(self.keys[at] == key, self.ranks[at], out)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join(words[k] for k in rows), np.uint8).reshape(-1, size)
            s = self.inner[raw]
            s[:, -1] = self.last[raw[:, -1]]
            r = self.rank(s[:, :-1], s[:, 1:])
            while s.shape[1] > 1:
                at = r.argmin(axis=1)
                every = np.arange(len(rows))
                best = r[every, at]
                done = best == self.none
                if done.any():
                    fin = s[done].astype("<u4")
                    for k, ids in zip(rows[done].tolist(), fin, strict=True):
                        out[k] = ids.tobytes()
                    rows, s, r, at, best = rows[~done], s[~done], r[~done], at[~done], best[~done]
                    every = np.arange(len(rows))
                    if not len(rows):
                        break
                cols = np.arange(s.shape[1] - 1)
                s = np.where(cols[None, :] < at[:, None], s[:, :-1], s[:, 1:])
                s[every, at] = self.result[best]
                if s.shape[1] == 1:
                    break
                cols = cols[:-1]
                r = np.where(cols[None, :] < at[:, None], r[:, :-1], r[:, 1:])
                left, right = at > 0, at < s.shape[1] - 1
                k = np.flatnonzero(left)
                r[k, at[k] - 1] = self.rank(s[k, at[k] - 1], s[k, at[k]])
                k = np.flatnonzero(right)
                r[k, at[k]] = self.rank(s[k, at[k]], s[k, at[k] + 1])
            for k, ids in zip(rows.tolist(), s.astype("<u4"), strict=True):
                out[k] = ids.tobytes()
        return out


class WordIds:
    """Ids of words (runs without ASCII white space) by their 64-bit hash.
    The tokenizer never joins characters across white space, so the ids of a text
    are those of its words in a row.  Words of Latin letters, with or without
    punctuation behind them, go through ``MergeTable`` together; all others
    through the tokenizer.  Holds ``most`` words at most."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cache = kernels.SpanCache(self._learn, most)
        self.tokenizer, self.merges = Tokenizer.from_file(path), MergeTable(path)
        self.marks: dict[str, bytes] = {"": b""}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> list[bytes]:
        out, plain, stems, tails = [b""] * len(new), [], [], []
        for k, w in enumerate(map(bytes.decode, new)):
            if m := _PLAIN.fullmatch(w):
                plain.append(k)
                stems.append(m[1].lower().encode())
                tails.append(m[2])
            else:
                out[k] = self._direct(w)
        for tail in set(tails) - self.marks.keys():
            self.marks[tail] = self._direct(tail)
        for k, ids, tail in zip(plain, self.merges.encode(stems), tails, strict=True):
            out[k] = ids + self.marks[tail] if tail else ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text's begin."""
        starts, ends, per = kernels.words(data, offsets)
        ids, begin = self.cache.encode(data, starts, ends)
        return ids, begin[np.concatenate(([0], np.cumsum(per)))]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, block: int = 2 * kernels.BLOCK_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece.  Words that a worker
    keeps and bytes that it handles at once bound its memory and change no result."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        ids = WordIds(tokenizer, cache_words)
        give_back()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            docs_, (data, offsets) = batch.column(0).to_pylist(), kernels.utf8(batch.column(1))
            for i, j, part, at in kernels.blocks(data, offsets, block):
                found, begin = ids.encode(part, at)
                raw, begin = found.tobytes(), (4 * begin).tolist()
                for k in range(i, j):
                    whole = raw[begin[k - i] : begin[k - i + 1]] + end
                    for n, a in enumerate(range(0, len(whole), 4 * size)):
                        piece = whole[a : a + 4 * size]
                        for col, v in zip(rows, (docs_[k], n, a // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del ids
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _fits(need: tuple[int, ...], left: np.ndarray) -> int:
    return min(left[v] // k for v, k in Counter(need).items())


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of at most ``size`` together, times used) that take each
    length exactly as often as ``counts`` says."""
    left = np.zeros(size + 1, np.int64)
    for v, n in counts.items():
        left[v] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(need: tuple[int, ...]) -> bool:
        n = int(_fits(need, left))
        if n > 0:
            for v in need:
                left[v] -= n
            out.append((need, n))
        return n > 0

    for v in range(size, 0, -1):
        if not left[v]:
            continue
        gap = size - v
        if not gap:
            take((v,))
            continue
        take((v, gap))
        if left[v]:  # pairs a + b = gap, larger part first
            half = np.arange(gap - 1, (gap - 1) // 2, -1)
            for a in half[(left[half] > 0) & (left[gap - half] > 0)]:
                take((v, int(a), gap - int(a)))
                if not left[v]:
                    break
        if left[v]:  # triples a + b + c = gap, by the index of pair sums
            have = (left[: gap + 1] > 0).astype(np.float64)
            have[0] = 0
            n = 1 << (2 * gap + 1).bit_length()
            pair = np.fft.irfft(np.fft.rfft(have, n) ** 2, n)[: gap + 1] > 0.5
            firsts = np.arange(gap - 2, 0, -1)
            for a in firsts[(left[firsts] > 0) & pair[gap - firsts]]:
                rest = gap - int(a)
                b = np.arange(rest - 1, (rest - 1) // 2, -1)
                for b1 in b[(left[b] > 0) & (left[rest - b] > 0)]:
                    take((v, int(a), int(b1), rest - int(b1)))
                    if not left[v] or not left[a]:
                        break
                if not left[v]:
                    break
    # best fit decreasing of what is left: bins by their gap
    gaps: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if gap not in bins or not bins[gap]:
            bisect.insort(gaps, gap)
        bins[gap].append((pattern, n))

    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            k = bisect.bisect_left(gaps, v)
            if k == len(gaps):
                each = min(size // v, n)
                put(size - each * v, (v,) * each, n // each)
                n %= each
                continue
            gap = gaps[k]
            pattern, times = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(k)
            used = min(times, n)
            if times > used:
                put(gap, pattern, times - used)
            put(gap - v, (*pattern, v), used)
            n -= used
    out += [x for found in bins.values() for x in found]
    return out


def pack(parts: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """``parts`` with sequence_id and offset.  Run on a staged table, as it is
    read three times."""
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = common.stage(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")  # size * buckets rows at most
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(counts, size)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for need, times in patterns:
        at = 0
        for v in need:
            slots[v].append((times, base, at))
            at += v
        base += times
    columns = {v: (np.concatenate(([0], np.cumsum([s[0] for s in found]))), np.array([s[1] for s in found]), np.array([s[2] for s in found])) for v, found in slots.items()}
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "r")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for v in np.unique(length).tolist():
            rows = np.flatnonzero(length == v)
            ends, first, at = columns[v]
            k = np.searchsorted(ends, rank[rows], "right") - 1
            seq[rows], off[rows] = first[k] + rank[rows] - ends[k], at[k]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return common.arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, **bounds) -> DataFrame:
    return pack(common.stage(pieces(docs, tokenizer or default_tokenizer(), size, **bounds), "pieces"), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage.  Executors still hold what the stages before needed, so
    workers keep fewer words."""
    return pack_documents(docs, cache_words=200_000, block=kernels.BLOCK_BYTES // 2)
