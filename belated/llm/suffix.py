"""Exact repeats of 400 bytes or more, by enhanced suffix arrays.

Definition: a byte goes if a string of ``min_len`` bytes that covers it also
starts somewhere else, in the same document or another (overlaps count; judged
on the input).  Matches never cross documents.

A suffix array of the whole corpus would move every suffix.  Instead each
``min_len``-byte string is assigned to its anchor, the ``ANCHOR``-gram of least
hash in it, which depends on its bytes alone: equal strings have equal anchors
at the same place.  An anchor occurrence owns the strings that chose it, a run
of consecutive starts; its context is the bytes that these strings cover.

1. Anchor occurrences (one per about 150 bytes) are counted by anchor hash;
   those that occur once are done.
2. Occurrences with equal contexts are counted by context hash before anything
   is moved.  A context that occurs twice is repeated as a whole.
3. Of anchors with different contexts one occurrence of each context fetches its
   bytes.  Contexts of an anchor meet in one task, which builds an enhanced
   suffix array (suffix array, LCP array, left characters) over them, scans it
   with a stack for common-prefix intervals of ``min_len`` or more, tests each
   for diversity of its left characters and reports the maximal repeats with all
   their occurrences.
4. An anchor with more than ``CROWD`` different contexts is dealt by longer
   anchors first.  Its strings hold the anchor at places 0 to ``min_len`` less
   ``ANCHOR``; the strings that hold it at places u to v have the bytes from
   place u of the last to the end of the first in common, and this core is their
   longer anchor (equal strings have equal cores at the same place).  A context
   is cut into ``PARTS`` such ranges of places; steps 2 and 3 then run on the
   parts with the cores as anchors, and so on while a core is still crowded.  A
   range of one place has the whole string for a core, whose contexts are equal,
   so the dealing ends, after about log(``min_len``) steps.
5. Spans are found at one occurrence of each context; a context that occurs more
   than once is repeated as a whole, wherever it stands.  Overlapping spans of a
   document are merged.

With ``words`` all of this is done on words (runs without ASCII white space)
instead of bytes: lengths and places count words, and the symbols of the suffix
array are the words' 64-bit hashes, so that passages are equal if their words
are, however they are spaced.  The pipeline stage removes passages of over 50
words this way; op3 removes those of 400 bytes.

Null and empty texts have no bytes and lose none.  Every row is a document, also
those that repeat an id or have none: rows are told apart by id and a hash of
the text, and rows equal in both have the same repeats.  Columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

U64 = np.uint64
MIN_LEN, ANCHOR, CROWD, PARTS, PIECE = 400, 100, 512, 4, 1 << 18
#: Of the pipeline stage, in words.
MIN_WORDS, ANCHOR_WORDS = 51, 8


def symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What strings are made of: the bytes, or a hash of each word; and the
    offsets of the rows in it."""
    if not words:
        return data, offsets
    parts, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for _, _, part, to in kernels.blocks(data, offsets, kernels.BLOCK_BYTES):
        starts, ends, per = kernels.words(part, to)
        parts.append(kernels.span_hash(kernels.prefix_hash(part), starts, ends))
        at.append(per)
    return np.concatenate(parts), np.cumsum(np.concatenate(at))


def anchors(data: np.ndarray, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, its hash, first start, starts) of the runs of starts that
    share an anchor, for a text of at least ``min_len`` symbols."""
    prefix = kernels.prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    h = kernels.span_hash(prefix, at, at + k)
    w = min_len - k + 1
    key = (h & ~U64((1 << 24) - 1)) | at.astype(U64)  # equal hashes: the leftmost
    n = len(key)
    pad = -n % w
    blocks = np.concatenate((key, np.full(pad, ~U64(0)))).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    place = (least & U64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], h[place[first]], first, np.diff(np.append(first, len(place)))


def _anchor_rows(min_len: int, k: int, words: bool):
    import xxhash

    def run(batch: pa.RecordBatch):
        data, offsets = symbols(*kernels.utf8(batch.column(2)), words)
        unit = data.itemsize
        cols: list[list] = [[] for _ in range(8)]
        held = 0

        def flush():
            arrays = [np.concatenate(c) for c in cols]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["id", "t", "h", "c1", "c2", "start", "n", "off"])

        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            key = [batch.column(c)[row].as_py() for c in (0, 1)] if b - a >= min_len else None
            for lo in range(a, b - min_len + 1, PIECE):
                part = data[lo : min(b, lo + PIECE + min_len - 1)]
                place, h, first, n = anchors(part, min_len, k)
                view = memoryview(np.ascontiguousarray(part)).cast("B")
                digest = xxhash.xxh3_128_digest
                # equal digest: equal symbols, and the anchor at the same place
                whole = b"".join([digest(view[unit * s : unit * (s + m + min_len - 1)], seed=o) for s, m, o in zip(first.tolist(), n.tolist(), (place - first).tolist(), strict=True)])
                c = np.frombuffer(whole, np.int64).reshape(-1, 2)
                for col, v in zip(cols, (*(np.full(len(h), x, np.int64) for x in key), h.view(np.int64), c[:, 0], c[:, 1], first + (lo - a), n, place - first), strict=True):
                    col.append(v.astype(np.int64))
                held += len(h)
                if held > 50_000:
                    yield flush()
                    held = 0
        if cols[0]:
            yield flush()

    return run


def suffix_array(data: np.ndarray, ends: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of concatenated strings of small numbers;
    ``ends`` are their ends, which no match crosses.  LCPs under ``least`` may be
    given as 0.  Prefix doubling from ``per`` packed symbols on; the ranks of all
    rounds stay until the LCPs are read off them."""
    n = len(data)
    limit = (np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(n)).astype(np.int32)
    bits = int(data.max() + 1).bit_length()
    per = 8 if bits <= 7 else 4 if bits <= 15 else 2 if bits <= 31 else 1
    symbol = data.astype(np.int64) + 1
    key, width = np.zeros(n, np.int64), per
    for k in range(per):
        key <<= bits
        inside = np.flatnonzero(limit > k)
        key[inside] |= symbol[inside + k]
    ranks: list[np.ndarray] = []
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        inside = np.flatnonzero(limit > width)
        if new.all() or not len(inside):
            break
        key = rank * np.int64(n + 1)
        key[inside] += rank[inside + width]
        width *= 2
    order = order.astype(np.int32)
    lcp = np.zeros(n, np.int32)
    # the pairs of neighbours whose common prefix can reach ``least``
    deep = max((k for k in range(len(ranks)) if per << k <= least), default=None)
    live = np.arange(1, n) if deep is None else 1 + np.flatnonzero(ranks[deep][order[1:]] == ranks[deep][order[:-1]])
    i, j = order[live].copy(), order[live - 1].copy()
    room = np.minimum(limit[i], limit[j])
    size = np.zeros(len(live), np.int32)
    for level in range(len(ranks) - 1, -1, -1):
        step = per << level
        q = np.flatnonzero(room - size >= step)
        q = q[ranks[level][i[q]] == ranks[level][j[q]]]
        i[q] += step
        j[q] += step
        size[q] += step
    for _ in range(per - 1):
        q = np.flatnonzero(room > size)
        q = q[data[i[q]] == data[j[q]]]
        i[q] += 1
        j[q] += 1
        size[q] += 1
    lcp[live] = size
    return order, lcp


def maximal_repeats(data: np.ndarray, ends: np.ndarray, min_len: int):
    """Yields (length, places) for each maximal repeat of ``min_len`` or more: the
    common-prefix intervals found by a stack scan of the LCP array whose
    occurrences do not all have the same left character."""
    order, lcp = suffix_array(data, ends, min_len)
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate(([0], ends))] = True
    # the first symbols of strings have lefts of their own
    left = np.where(first[:-1], -1 - np.arange(len(data)), np.concatenate(([0], data[:-1])).astype(np.int64))[order]
    deep = lcp >= min_len
    starts = np.flatnonzero(deep & ~np.concatenate(([False], deep[:-1]))) - 1
    stops = np.flatnonzero(deep & ~np.concatenate((deep[1:], [False]))) + 1
    changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    # of a run with one left character every interval within extends to the left
    diverse = np.flatnonzero(changes[stops - 1] > changes[starts])
    for a, b in zip(starts[diverse].tolist(), stops[diverse].tolist(), strict=True):
        depths = [*lcp[a + 1 : b].tolist(), 0]
        stack: list[tuple[int, int]] = []  # length, left boundary
        for k, depth in enumerate(depths, a + 1):
            begin = k - 1
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                if changes[k - 1] > changes[begin]:
                    yield length, order[begin:k]
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def _group_spans(min_len: int, words: bool):
    """Contexts (h, id, t, start, n, symbols), sorted by anchor: the repeated
    spans of each, by their places in the document."""
    kind = np.dtype(U64 if words else np.uint8)

    def solve(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        # strings that no other context of the anchor shares need no suffix array
        data = np.frombuffer(b"".join(r[5] for r in rows), kind)
        size = np.array([len(r[5]) // kind.itemsize for r in rows])
        ends = np.cumsum(size)
        begin = ends - size
        n = np.array([r[4] for r in rows])
        of = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        h = kernels.span_hash(kernels.prefix_hash(data), at, at + min_len)
        order = np.argsort(h)
        twice = h[order[1:]] == h[order[:-1]]
        busy = np.unique(np.concatenate((of[order[1:][twice]], of[order[:-1][twice]])))
        if not len(busy):
            return []
        part = np.concatenate([data[begin[k] : ends[k]] for k in busy])
        if words:
            part = np.unique(part, return_inverse=True)[1]
        else:
            number = np.cumsum(np.bincount(part, minlength=256) > 0) - 1
            part = number[part]
        stop = np.cumsum(size[busy])
        reach = np.zeros(len(part), np.int64)  # the longest repeat that starts at a symbol
        for length, places in maximal_repeats(part, stop, min_len):
            reach[places] = np.maximum(reach[places], length)
        at = np.flatnonzero(reach)
        of = np.searchsorted(stop, at, "right")
        to = np.maximum.accumulate(at + reach[at])
        new = np.flatnonzero(np.concatenate(([True], (at[1:] > to[:-1]) | (of[1:] != of[:-1]))))
        a, b = at[new], np.append(to[new[1:] - 1], to[-1])
        k = np.searchsorted(stop, a, "right")
        shift = (stop - size[busy])[k]
        out = []
        for i, x, y, s in zip(k.tolist(), a.tolist(), b.tolist(), shift.tolist(), strict=True):
            _, doc, t, start, *_ = rows[busy[i]]
            out.append((doc, t, start + x - s, start + y - s))
        return out

    def run(batches):
        held: list[tuple] = []  # whole anchors, and at the end the last one's rows so far
        size, last = 0, None

        def emit(rows):
            found = solve(rows) if len(rows) > 1 else []
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "t", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size > PIECE // 2:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield emit(held)

    return run


_CONTEXT = "h long, id long, t long, start long, off long, n long, m long, u long, v long, raw binary"


def _cut_contexts(min_len: int, anchor: int, words: bool):
    """(id, t, text, [(h, start, off, n, m)]) to one row of symbols a context."""

    def run(batch: pa.RecordBatch):
        data, offsets = symbols(*kernels.utf8(batch.column(2)), words)
        for i, wanted in enumerate(batch.column(3).to_pylist()):
            base, size = int(offsets[i]), len(wanted)
            col = {k: pa.array([w[k] for w in wanted], pa.int64()) for k in ("h", "start", "off", "n", "m")}
            col |= {k: pa.array(np.full(size, v, np.int64)) for k, v in (("id", batch.column(0)[i].as_py()), ("t", batch.column(1)[i].as_py()), ("u", 0), ("v", min_len - anchor))}
            col["raw"] = pa.array([data[base + w["start"] : base + w["start"] + w["n"] + min_len - 1].tobytes() for w in wanted], pa.binary())
            names = [x.split()[0] for x in _CONTEXT.split(", ")]
            yield pa.RecordBatch.from_arrays([col[k] for k in names], names)

    return run


_PART = "h long, c1 long, c2 long, id long, t long, start long, off long, n long, u long, v long, raw binary"


def _split(min_len: int, words: bool):
    """Contexts to their parts, each with the hash of its core for an anchor."""
    import xxhash

    unit = 8 if words else 1

    def run(batch: pa.RecordBatch):
        rows = []
        for _, doc, t, start, off, n, _, u, v, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            view, step = memoryview(raw), -(-(v - u + 1) // PARTS)
            for x in range(u, v + 1, step):
                y = min(v, x + step - 1)
                lo, hi = max(0, off - y), min(n - 1, off - x)
                if lo <= hi:
                    part = view[unit * lo : unit * (hi + min_len)]
                    c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(part, seed=off - lo), np.int64).tolist()
                    core = xxhash.xxh3_64_digest(view[unit * (off - x) : unit * (off - y + min_len)], seed=x)
                    rows.append((int.from_bytes(core, "little", signed=True), c1, c2, doc, t, start + lo, off - lo, hi - lo + 1, x, y, bytes(part)))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], [x.split()[0] for x in _PART.split(", ")])

    return run


def _counted(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Of occurrences (h, c1, c2, id, t, start, ...): the contexts that occur more
    than once (h, c1, c2), and one occurrence (h, id, t, start, m) of each context
    of the anchors that have m > 1 contexts, not all of them repeated."""
    contexts = common.stage(rows.groupBy("h", "c1", "c2").agg(F.count("*").alias("k"), F.min(F.struct("id", "t", "start")).alias("o")), tag)
    # staged, so that both sides of the join are plain exchanges and a hot anchor can be split
    per = common.stage(contexts.groupBy("h").agg(F.count("*").alias("m"), F.min("k").alias("least")).filter("m > 1 and least = 1").select("h", "m"), f"{tag}-open")
    return contexts.filter("k > 1").select("h", "c1", "c2"), contexts.join(per, "h").select("h", "o.id", "o.t", "o.start", "m")


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN, anchor: int = ANCHOR, crowd: int = CROWD, *, words: bool = False) -> DataFrame:
    """(id, t, spans): for each document (id, t, text), see ``_key``, that has any,
    the byte spans [a, b) whose bytes go (``words``: of words, by their number);
    they may overlap."""
    long_ = docs.filter(F.octet_length("text") >= (2 * min_len - 1 if words else min_len))
    place, extent = ["id", "t", "start"], F.col("start") + F.col("n") + (min_len - 1)
    since = common.made()
    found = common.stage(common.arrow_map(long_.select("id", "t", "text"), _anchor_rows(min_len, anchor, words), "id long, t long, h long, c1 long, c2 long, start long, n long, off long"), "anchors")
    often = common.stage(found.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "often")
    repeated = common.settle(found.join(often, "h", "left_semi"), "repeated", since)
    copied, open_ = _counted(repeated, "contexts")
    spans = [repeated.join(copied, ["h", "c1", "c2"], "left_semi").select("id", "t", F.col("start").alias("a"), extent.alias("b"))]
    wanted = open_.join(repeated.select("h", *place, "n", "off"), ["h", *place]).groupBy("id", "t").agg(F.collect_list(F.struct("h", "start", "off", "n", "m")).alias("w"))
    cut = common.stage(common.arrow_map(long_.join(wanted, ["id", "t"]).select("id", "t", "text", "w"), _cut_contexts(min_len, anchor, words), _CONTEXT), "cut")
    groups, crowded = [cut.filter(F.col("m") <= crowd)], cut.filter(F.col("m") > crowd)
    while crowded.head(1):
        parts = common.stage(common.arrow_map(crowded, _split(min_len, words), _PART), "parts")
        copied, open_ = _counted(parts.drop("raw"), "cores")
        spans.append(parts.join(copied, ["h", "c1", "c2"], "left_semi").select("id", "t", F.col("start").alias("a"), extent.alias("b")))
        cut = common.stage(open_.join(parts, ["h", *place]).select([x.split()[0] for x in _CONTEXT.split(", ")]), "cut")
        groups.append(cut.filter(F.col("m") <= crowd))
        crowded = cut.filter(F.col("m") > crowd)
    group = groups[0]
    for more in groups[1:]:
        group = group.unionByName(more)
    solved = group.select("h", *place, "n", "raw").repartition("h").sortWithinPartitions("h").mapInArrow(_group_spans(min_len, words), "id long, t long, a long, b long")
    for more in spans:
        solved = solved.unionByName(more)
    return solved.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _key(id_: Column, text: Column) -> dict[str, Column]:
    """id (0 for null) and a hash of the text, which together tell rows apart that
    differ in either."""
    return {"id": F.coalesce(id_.cast("long"), F.lit(0).cast("long")), "t": F.xxhash64(id_.isNull(), text.cast("string"))}


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in gone:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, cut, repeats_passage) of each
    row; ``cut``: it loses bytes; ``repeats_passage``: a passage of ``MIN_WORDS``
    words or more stands somewhere else too, however it is spaced."""
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(c.alias(k) for k, c in _key(F.col(id_col), F.col(text_col)).items()))
    since = common.made()
    passages = common.settle(repeated_spans(source, MIN_WORDS, ANCHOR_WORDS, words=True).select("id", "t"), "passages", since)
    since = common.made()
    spans = common.settle(repeated_spans(source, min_len), "spans", since)
    marks = spans.join(passages.withColumn("p", F.lit(True)), ["id", "t"], "full").select("id", "t", "spans", F.coalesce("p", F.lit(False)).alias("p"))
    both = source.join(marks, ["id", "t"], "left").select("key", "text", "spans", F.coalesce("p", F.lit(False)).alias("p"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw, gone = text.as_py().encode(), merged(spans)
            for col, v in zip(cols, (len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array([v > 0 for v in cols[1]], pa.bool_()), batch.column(3)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut", "repeats_passage"])

    return common.arrow_map(both, run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cut boolean, repeats_passage boolean").withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


def _bytes_of(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of spans of words."""
    starts, ends, _ = kernels.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in gone]


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the passages of ``MIN_WORDS`` words or more
    that stand somewhere else too; a null text stays null.  Documents of which
    nothing is left stay, empty."""
    source = docs.select(*(c.alias(k) for k, c in _key(F.col("doc_id"), F.col("text")).items()), F.coalesce("text", F.lit("")).alias("text"))
    since = common.made()
    spans = common.settle(repeated_spans(source, MIN_WORDS, ANCHOR_WORDS, words=True), "spans", since)
    marks = spans.select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("spans").alias("_spans"))
    key = _key(docs["doc_id"], docs["text"])
    both = docs.join(marks, (key["id"] == marks["_id"]) & (key["t"] == marks["_t"]), "left").select(*(docs[c] for c in docs.columns), "_spans")
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            raw = (text or "").encode()
            texts.append(_kept(raw, _bytes_of(raw, merged(spans))).decode() if raw and spans else text)
        cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return common.arrow_map(both, run, docs.schema)
