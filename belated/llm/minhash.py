"""Near-duplicate documents: BagMinHash signatures, banding, exact verification.

A document is the multiset of its lower-cased five-word shingles (all its words,
if fewer than five).  Two documents are linked if the weighted Jaccard
similarity of their multisets is at least 0.8; groups are the connected
components of the links.

* Signature: for each shingle with count w, Poisson processes on the weight axis
  split into (0,1], (1,2], (2,4], (4,8], ...; a point of an interval that w only
  partly covers is placed by successive halvings (the bits of a uniform number)
  and thrown away beyond w.  Each point falls in a uniform slot; a slot keeps
  the earliest time.  Two documents agree in a slot with a probability equal to
  their weighted Jaccard similarity.
* Copies (equal multisets) form classes first, by a commutative 128-bit hash;
  only one document of a class goes on, so a class of any size costs one row.
* Bands: within a bucket all members are compared with one member (a star),
  first that of least id, then that with the most verified links.  Then members
  that are still in different components meet in blocks of ``BUCKET_BLOCK``, each
  pair of blocks a task's key of its own, so no link that a bucket holds is lost to
  the stars, and a group of near copies that hang together costs rows in
  proportion to its size.
* Before sets are fetched, pairs are tested by size, by the parities of ``FOLD``
  hashed counts (never more of them differ than elements do, so no link fails
  this) and by four bits of each slot (a link fails this with probability 3e-7).
* Texts stay where they are read: a broadcast bitmap of hashed ids (``WORDS`` longs,
  whatever the input) leaves the documents that share a bucket and a few others, of
  which only the sets travel; an exact join follows, so the bitmap loses none.
* Verification: |A ∩ B| * 9 >= 4 * (|A| + |B|) on multisets, in the JVM.

With 28 bands of 5 slots a link of similarity 0.8 is missed with probability
1.5e-5, one of 0.9 with less than 1e-10.

Null, empty and wordless texts are near-duplicates of nothing: each is its own
class and group.  Rows with a null id come back with null class and group.
Rows that repeat an id are one document, whose text is the one of the least
(number of shingles, hash of the multiset) among theirs; each such row comes back
with that document's result.  Columns other than the id and the text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels
from .components import connected_components

U64 = np.uint64
BANDS, ROWS, FOLD, BUCKET_BLOCK = 28, 5, 2048, 256
#: Longs of the bitmaps of ids.
WORDS = 1 << 18
_ONE = np.uint64(1)


def bag_minhash(h: np.ndarray, weight: np.ndarray, row: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (n_rows x slots, times as float64; inf where a row
    has no element).  h, weight, row: the elements, their counts and their rows."""
    seeds, rates, parts, rows = [], [], [], []
    level, low = 0, 0
    live = np.arange(len(h))
    while len(live):
        width = max(1, low)
        seeds.append(kernels.mix(h[live] + U64(level * 0xD6E8FEB86659FD93 & kernels.MASK)))
        rates.append(np.full(len(live), float(width)))
        parts.append(np.minimum(1.0, (weight[live] - low) / width))
        rows.append(row[live])
        low += width
        level += 1
        live = live[weight[live] > low]
    sig = np.full((n_rows, slots), np.inf)
    if not seeds:
        return sig
    seed, rate, part, at = (np.concatenate(x) for x in (seeds, rates, parts, rows))
    flat, latest, time, k = sig.reshape(-1), np.full(n_rows, np.inf), np.zeros(len(seed)), 0
    while len(seed):
        many = max(1, min(64, 4096 // len(seed)))  # points of a process in one round
        steps = np.arange(k, k + many, dtype=U64) * U64(0x9E3779B97F4A7C15)
        u = kernels.mix(seed[:, None] + steps)
        gap = np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        # one point after another from the running time, whatever ``many`` is
        t = np.cumsum(np.concatenate((time[:, None], -gap), axis=1), axis=1)[:, 1:] if many > 1 else time[:, None] - gap
        time = t[:, -1]
        early = t < latest[at][:, None]
        v = kernels.mix(u ^ U64(0xA0761D6478BD642F))
        if (part < 1).any():
            early &= (v & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < part[:, None]
        slot = (((v >> U64(32)) * U64(slots)) >> U64(32)).astype(np.int64) + (at * slots)[:, None]
        np.minimum.at(flat, slot[early], t[early])
        touched = at[np.flatnonzero(np.diff(at, prepend=-1))] if many > 1 or k % 2 else None
        if touched is not None:
            latest[touched] = sig[touched].max(axis=1)
        keep = time < latest[at]
        if not keep.all():
            seed, rate, part, at, time = seed[keep], rate[keep], part[keep], at[keep], time[keep]
        k += many
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(U64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), bits.shape[:2]).copy()
    for k in range(rows):
        out = kernels.mix(out ^ bits[:, :, k]) + _ONE
    return out


NIBBLES = 0x1111111111111111


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, 16 slots a long."""
    bits = kernels.mix(np.ascontiguousarray(sig).view(U64)) >> U64(60)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16))).reshape(len(sig), -1, 16)
    out = np.zeros(bits.shape[:2], U64)
    for k in range(16):
        out |= bits[:, :, k] << U64(4 * k)
    return out


def unequal(x: str, y: str, slots: int) -> str:
    """SQL: in how many slots the four bits of two documents differ."""
    terms = []
    for k in range(-(-slots // 16)):
        z = f"({x}[{k}] ^ {y}[{k}])"
        terms.append(f"bit_count(({z} | shiftright({z}, 1) | shiftright({z}, 2) | shiftright({z}, 3)) & {NIBBLES}L)")
    return " + ".join(terms)


def parities(element: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """``FOLD`` bits a row: whether an odd number of its elements hash there."""
    at = row * FOLD + (kernels.mix(element) & U64(FOLD - 1)).astype(np.int64)
    place, count = np.unique(at, return_counts=True)
    bits = np.zeros(n_rows * FOLD, np.uint8)
    bits[place] = count & 1
    return np.packbits(bits, bitorder="little").view(U64).reshape(n_rows, -1)


def least_different(x: str, y: str) -> str:
    """SQL: a lower bound of the size of the symmetric difference."""
    return " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(FOLD // 64))


def most_unequal(slots: int, num: int, den: int) -> int:
    """Five standard deviations above the mean number of unequal four bits at a
    similarity of num/den: a link is refused with probability 3e-7."""
    p = (1 - num / den) * 15 / 16
    return int(slots * p + 5 * (slots * p * (1 - p)) ** 0.5)


def _signatures(bands: int, rows: int, size: int):
    def run(batch: pa.RecordBatch):
        data, offsets = kernels.utf8(batch.column(1), lower=True)
        for i, j, part, at in kernels.blocks(data, offsets, kernels.BLOCK_BYTES):
            h, row = kernels.shingles(part, at, size)
            n = np.bincount(row, minlength=j - i)
            h, row, number, start = kernels.multiset(h, row)
            element, whole = elements(h, row, number, j - i)
            weight = np.diff(np.append(start, len(h)))
            sig = bag_minhash(h[start], weight, row[start], j - i, bands * rows)
            few = nibbles(sig)[n > 0]
            odd = parities(element, row, j - i)[n > 0]
            keys = band_hashes(sig, bands, rows)[n > 0]

            def lists(values):
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((n > 0) * values.shape[1]))).astype(np.int32)), pa.array(values.reshape(-1).view(np.int64)))

            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), lists(keys), lists(few), lists(odd)], ["id", "n", "c1", "c2", "bands", "sig", "odd"])

    return run


def elements(h: np.ndarray, row: np.ndarray, number: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the k-th copy of a shingle is an element of its own;
    and a commutative 128-bit hash of each row's set."""
    element = kernels.mix(h + number.astype(U64) * U64(0x9E3779B97F4A7C15))
    whole = np.zeros((2, n_rows), U64)
    if len(row):
        edges = np.flatnonzero(np.diff(row, prepend=-1))
        whole[0, row[edges]] = np.add.reduceat(element, edges)
        whole[1, row[edges]] = np.add.reduceat(kernels.mix(element ^ U64(0x2545F4914F6CDD1D)), edges)
    return element, whole


def _sets(size: int):
    """(id, text) to the hash of the multiset and its elements (64-bit hashes)."""

    def run(batch: pa.RecordBatch):
        data, offsets = kernels.utf8(batch.column(1), lower=True)
        for i, j, part, at in kernels.blocks(data, offsets, kernels.BLOCK_BYTES):
            h, row = kernels.shingles(part, at, size)
            n = np.bincount(row, minlength=j - i)
            h, row, number, _ = kernels.multiset(h, row)
            element, whole = elements(h, row, number, j - i)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(element.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), lists], ["id", "c1", "c2", "e"])

    return run


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` and, of n such ids, about n / (64 * WORDS) of the
    others, by a broadcast bitmap of hashes: what an exact join needs not shuffle."""
    word, bit = F.pmod(F.xxhash64("id"), F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), 58) as int))").alias("bit")
    bitmap = ids.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.select("*", word, bit).join(F.broadcast(bitmap), "word").filter("bits & bit <> 0").select(rows.columns)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of similarity num/den or more.  The sets of their members
    travel to the pairs by plain equi-joins, so a member of many pairs can be split
    by AQE."""
    of_a, of_b = (_likely(sets, pairs.select(F.col(c).alias("id"))).select(F.col("id").alias(c), F.col("e").alias(f"e{c}")) for c in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b")
    common_n = F.size(F.array_intersect("ea", "eb"))
    return both.filter((num + den) * common_n >= num * (F.size("ea") + F.size("eb"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (least id of the documents
    with an equal multiset) and group_id (least id of the near-duplicate group)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = source.filter(F.col("id").isNotNull())
    signed = common.stage(common.arrow_map(keyed, _signatures(bands, rows, shingle), "id long, n long, c1 long, c2 long, bands array<long>, sig array<long>, odd array<long>"), "signatures")
    of_id = signed.groupBy("id").agg(F.min(F.struct("n", "c1", "c2")).alias("s"), F.count("*").alias("k"))
    chosen = common.stage(of_id.select("id", "s.*", "k"), "chosen")
    classes = common.stage(chosen.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep")), "classes")
    same = ["id", "n", "c1", "c2"]
    reps = classes.select(F.col("rep").alias("id"), "n", "c1", "c2")
    exploded = common.stage(signed.join(reps, same, "left_semi").select("id", F.explode("bands").alias("h")), "bands")
    # staged, so that both sides of the join are plain exchanges and a hot bucket can be split
    crowded = common.stage(exploded.groupBy("h").agg(F.min("id").alias("c"), F.max("id").alias("z")).filter("c < z").select("h", "c"), "crowded")
    member = common.stage(exploded.join(crowded, "h"), "members")  # h, id, c
    common.free(exploded, crowded)
    candidates = common.stage(member.select("id").distinct().join(reps, "id"), "candidates")
    signs = common.stage(_likely(signed, candidates).dropDuplicates(same).join(candidates, same, "left_semi").select("id", "n", "bands", "sig", "odd"), "signs")
    common.free(signed)
    limit = most_unequal(bands * rows, num, den)
    near = f"x.n * {num} <= y.n * {den} and y.n * {num} <= x.n * {den} and {unequal('x.sig', 'y.sig', bands * rows)} <= {limit}"
    near += f" and ({least_different('x.odd', 'y.odd')}) * {num + den} <= (x.n + y.n) * {den - num}"
    found = common.arrow_map(_likely(keyed, candidates), _sets(shingle), "id long, c1 long, c2 long, e array<long>").dropDuplicates(["id", "c1", "c2"])
    sets = common.stage(found.join(candidates, ["id", "c1", "c2"], "left_semi").select("id", "e"), "sets")

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow a link."""
        x = signs.select(F.col("id").alias("p"), F.struct("n", "sig", "odd").alias("x"))
        y = signs.select(F.col("id").alias("q"), F.struct("n", "sig", "odd").alias("y"))
        both = pairs.select(F.col("a").alias("p"), F.col("b").alias("q")).join(x, "p").join(y, "q")
        return both.filter(F.expr(near)).select(F.col("p").alias("a"), F.col("q").alias("b"))

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        some = common.stage(pairs, f"{tag}-pairs")
        out = common.stage(_verified(some, sets, num, den), tag)
        common.free(some)
        return out

    first = common.stage(member.filter("id <> c").select(*pair(F.col("id"), F.col("c"))).distinct(), "first")
    links = verified(plausible(first), "links1")
    degree = common.stage(links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")), "degree")
    ranked = member.join(degree, "id", "left").select("h", "c", F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-F.col("id")).alias("i")).alias("r"))
    hub = common.stage(ranked.groupBy("h").agg(F.max("r").alias("r"), F.first("c").alias("c")).select("h", (-F.col("r.i")).alias("hub"), "c").filter("hub <> c").select("h", "hub"), "hubs")
    second = common.stage(member.join(hub, "h").filter("id <> hub and c <> hub").select(*pair(F.col("id"), F.col("hub"))).distinct().join(first, ["a", "b"], "left_anti"), "second")
    links = common.stage(links.unionByName(verified(plausible(second), "links2")), "links")
    component = connected_components(links)  # id, component
    # what stars have left open: members of one bucket in different components
    placed = common.stage(member.join(component, "id", "left").select("h", "id", F.coalesce("component", "id").alias("g")), "placed")
    common.free(member, degree, hub)
    split = common.stage(placed.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("h", F.ceil(F.col("k") / BUCKET_BLOCK).cast("int").alias("blocks")), "split")
    open_ = common.stage(placed.join(split, "h").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "open")
    common.free(placed, split)
    detail = open_.join(signs, "id")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # a pair of blocks is one key; a pair of documents is tested in its blocks and, of
    # several common buckets, in that of the first common band
    x, y = detail.withColumn("other", every).alias("x"), detail.withColumn("other", every).alias("y")
    once = "x.h = element_at(filter(zip_with(x.bands, y.bands, (u, v) -> if(u = v, u, null)), w -> w is not null), 1)"
    rest = x.join(y, F.expr(f"x.h = y.h and x.own = y.other and x.other = y.own and x.id < y.id and x.g <> y.g and {near} and {once}"))
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    late = verified(rest.join(first.unionByName(second), ["a", "b"], "left_anti"), "links3")
    if late.head(1):
        component = connected_components(links.unionByName(late))
    common.free(open_, signs, sets, candidates, first, second)
    grouped = chosen.filter("n > 0").join(classes, ["c1", "c2", "n"]).select("id", "n", "k", F.col("rep").alias("class_id"))
    grouped = grouped.join(component.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    grouped = grouped.select("id", "n", "k", "class_id", F.coalesce("component", "class_id").alias("group_id"))
    grouped = grouped.unionByName(chosen.filter("n = 0").select("id", "n", "k", F.col("id").alias("class_id"), F.col("id").alias("group_id")))
    grouped = grouped.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).drop("_", "k")
    missing = source.filter(F.col("id").isNull()).select("id", *(F.lit(None).cast("long").alias(c) for c in ("n", "class_id", "group_id")))
    return grouped.unionByName(missing).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "group_id")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; ``kept`` marks one of each group."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document of least id stays; rows without
    an id stay."""
    since = common.made()
    groups = near_duplicates(docs)
    drop = common.settle(groups.filter(F.col("doc_id") != F.col("group_id")).select("doc_id").distinct(), "drop", since)
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
