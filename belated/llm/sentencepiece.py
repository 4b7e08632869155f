"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a model file.  Where its scores are merge ranks instead of
log probabilities (a BPE model), a piece of rank r gets the log of Zipf's law,
-log(r + 2.7) (rank order is frequency order, near enough); pieces with a score of -1e8 or
less are never used, but for the bare marker, which gets the last rank.  A text is a blank and its bytes with every space as the marker U+2581;
the best segmentation maximises the sum of scores.  A character that no piece
covers costs ``UNKNOWN`` less than the worst piece and is written as its byte
pieces.  Ties go to the longer last piece.

No piece holds a line feed, and the marker stands only at a piece's start, so
the best segmentation of a text is that of its spans between them; each distinct
span is solved once, many at a time: for each start the trie is walked for all
spans of one length together.

Null and empty texts have no pieces and decode to an empty text.  A text that
itself holds U+2581 decodes to a space there.  Columns other than id and text
are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

UNKNOWN, LONG, CACHE_SPANS = 10.0, 512, 500_000
MARK = "▁".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> tuple[dict[bytes, tuple[int, float]], list[int], list[bytes]]:
    """Pieces to (id, log score), the ids of the 256 byte pieces, and the bytes
    that each id decodes to."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, plain = {}, [0] * 256, []
    ranks = min((sp.get_score(i) for i in range(len(sp)) if sp.get_score(i) > -1e8), default=0) < -1000
    for i in range(len(sp)):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        raw = piece.encode()
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            plain.append(bytes([int(piece[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            plain.append(b"")
        else:
            plain.append(raw.replace(MARK, b" "))
            inner = raw[len(MARK) :] if raw.startswith(MARK) else raw
            if (score > -1e8 or raw == MARK) and MARK not in inner and b"\n" not in raw and b" " not in raw:
                pieces[raw] = (i, -float(np.log(min(-score, len(sp)) + 2.7)) if ranks else max(score, -1e3))
    return pieces, byte_ids, plain


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is base[s] + c where
    check of that place is s.  ``leaf`` is a piece's id (-1: none)."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float]] = {}
        for raw, value in sorted(pieces.items()):
            node = 0
            for c in raw:
                nxt = tree[node].get(c)
                if nxt is None:
                    nxt = tree[node][c] = len(tree)
                    tree.append({})
                node = nxt
            ends[node] = value
        size = 4 * len(tree) + 1024
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.leaf, self.score = np.full(size, -1, np.int32), np.zeros(size, np.float32)
        place, low, dense = {0: 0}, 1, 1  # first free place; where wide nodes begin to look
        taken = bytearray(size)
        taken[0] = 1
        for node, children in enumerate(tree):
            at = place[node]
            if node in ends:
                self.leaf[at], self.score[at] = ends[node]
            if not children:
                continue
            codes = sorted(children)
            low = taken.index(0, low)
            b, tries = max(1, (low if len(codes) == 1 else max(low, dense)) - codes[0]), 0
            while any(taken[b + c] for c in codes):
                b = max(b + 1, taken.index(0, b + codes[0] + 1) - codes[0])
                tries += 1
            if len(codes) > 1 and tries > 50:
                dense = b
            self.base[at] = b
            for c in codes:
                taken[b + c] = 1
                self.check[b + c] = at
                place[children[c]] = b + c
        self.longest = max(map(len, pieces), default=0)
        top = taken.rindex(1) + 257
        self.base, self.check, self.leaf, self.score = (x[:top].copy() for x in (self.base, self.check, self.leaf, self.score))


class Unigram:
    def __init__(self, pieces: dict[bytes, tuple[int, float]], byte_ids: list[int], plain: list[bytes]):
        self.trie = DoubleArray(pieces)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.floor = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.size = np.array([len(x) for x in plain])
        self.begin = np.cumsum(self.size) - self.size

    def best(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over rows of equally many bytes.  For each row and end: the id
        of the best last piece (-1: an uncovered character) and where it starts."""
        t, (n, size) = self.trie, raw.shape
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        last, start = np.full((n, size + 1), -1, np.int32), np.zeros((n, size + 1), np.int32)
        width = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16)
        for a in range(size):
            rows = np.flatnonzero(total[:, a] > -np.inf)
            state = np.zeros(len(rows), np.int64)
            char = np.minimum(np.maximum(width[raw[rows, a]], 1), size - a)
            covered = np.zeros(n, bool)
            live, depth = rows, 0
            while len(live) and a + depth < size:
                nxt = t.base[state] + raw[live, a + depth]
                ok = t.check[nxt] == state
                live, state = live[ok], nxt[ok].astype(np.int64)
                depth += 1
                leaf = t.leaf[state]
                hit = leaf >= 0
                if hit.any():
                    r, e = live[hit], a + depth
                    s = total[r, a] + t.score[state[hit]]
                    better = s > total[r, e]
                    r2 = r[better]
                    total[r2, e], last[r2, e], start[r2, e] = s[better], leaf[hit][better], a
                    one = np.zeros(n, np.int64)
                    one[rows] = char
                    covered[r[one[r] == depth]] = True
            bare = ~covered[rows]
            r, e = rows[bare], a + char[bare]
            s = total[r, a] + self.floor
            better = s > total[r, e]
            r, e = r[better], e[better]
            total[r, e], last[r, e], start[r, e] = s[better], -1, a
        return last, start

    def one(self, raw: bytes) -> tuple[list[int], list[int]]:
        """The same for a single long span, byte by byte."""
        t, size = self.trie, len(raw)
        base, check, leaf, score = (memoryview(x) for x in (t.base, t.check, t.leaf, t.score))
        total, last, start = [-np.inf] * (size + 1), [-1] * (size + 1), [0] * (size + 1)
        total[0] = 0.0
        for a in range(size):
            here = total[a]
            if here == -np.inf:
                continue
            c = raw[a]
            char = min(1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4, size - a)
            state, e, covered = 0, a, False
            while e < size:
                nxt = base[state] + raw[e]
                if check[nxt] != state:
                    break
                state, e = nxt, e + 1
                if leaf[state] >= 0:
                    covered |= e - a == char
                    if here + score[state] > total[e]:
                        total[e], last[e], start[e] = here + score[state], leaf[state], a
            if not covered and here + self.floor > total[a + char]:
                total[a + char], last[a + char], start[a + char] = here + self.floor, -1, a
        return last, start

    def _trace(self, raw: bytes, last, start) -> bytes:
        out, e = [], len(raw)
        while e:
            a, k = start[e], last[e]
            out += [k] if k >= 0 else self.byte_ids[list(raw[a:e])][::-1].tolist()
            e = a
        return np.array(out[::-1], "<u4").tobytes()

    def solve(self, spans: list[bytes]) -> list[bytes]:
        """Ids of spans; a leading space is the marker."""
        spans = [MARK + s[1:] if s[:1] == b" " else s for s in spans]
        out: list[bytes] = [b""] * len(spans)
        sizes = np.array([len(s) for s in spans])
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size).tolist()
            if size > LONG:
                for k in rows:
                    out[k] = self._trace(spans[k], *self.one(spans[k]))
                continue
            for lo in range(0, len(rows), 1 << 14):
                some = rows[lo : lo + (1 << 14)]
                last, start = self.best(np.frombuffer(b"".join(spans[k] for k in some), np.uint8).reshape(-1, size))
                for k, x, y in zip(some, last.tolist(), start.tolist(), strict=True):
                    out[k] = self._trace(spans[k], x, y)
        return out

    def encoder(self) -> kernels.SpanCache:
        return kernels.SpanCache(self.solve, CACHE_SPANS)

    def encode(self, cache: kernels.SpanCache, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text's begin."""
        full = np.diff(offsets) > 0
        x = np.insert(data, offsets[:-1][full], 0x20)  # the blank before a text
        at = offsets + np.concatenate(([0], np.cumsum(full)))
        cut = (x == 0x20) | (x == 0x0A)
        cut[1:] |= x[:-1] == 0x0A
        cut[at[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ids, begin = cache.encode(x, starts, np.append(starts[1:], len(x)) if len(starts) else starts)
        return ids, begin[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray) -> str:
        raw, _ = kernels.ragged(self.plain, self.begin[ids], self.size[ids])
        text = raw.tobytes().decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_crc32 of little-endian 32-bit ids,
    decoded_sha256, round_trip), and the ids themselves where asked for."""
    unigram = Unigram(*load(model or default_model()))
    first, last = int(unigram.byte_ids.min()), int(unigram.byte_ids.max())

    def run(batches):
        cache = unigram.encoder()
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(1))
            for i, j, part, at in kernels.blocks(data, offsets, 2 * kernels.BLOCK_BYTES):
                ids, begin = unigram.encode(cache, part, at)
                raw, cols = part.tobytes(), [[] for _ in range(6)]
                for k in range(j - i):
                    own = ids[begin[k] : begin[k + 1]]
                    text = unigram.decode(own).encode()
                    for col, v in zip(cols, (len(own), int(((own >= first) & (own <= last)).sum()), zlib.crc32(own.astype("<u4").tobytes()), hashlib.sha256(text).hexdigest(), text == raw[at[k] : at[k + 1]], own.astype(np.int32) if keep_ids else None), strict=True):
                        col.append(v)
                arrays = [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[5], pa.list_(pa.int32()))] if keep_ids else []), names)

    names = ["id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * keep_ids
    schema = "id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
