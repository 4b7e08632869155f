"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

DataFrame and SQL functions only.  A text is cut into paragraphs at line feeds
and sentence ends; its distinct paragraphs have 64-bit digests whose low 16 bits
check the other 48.  By their top bits digests are dealt to sub-tables, a power
of two of them with about ``LOAD`` digests each.  A sub-table has three groups
of eight cells; a digest is XORed into one cell of each group.  The fingerprint
is the number of digests and all cells.

To compare two texts both sketches are taken at one size (that of the larger, and
for unrelated texts that of both together) and their cells subtracted by XOR, so
what both hold cancels.  Peeling then recovers the differing digests: a cell with
a valid check and place holds one alone; it is taken out of its other cells, and
so on until no cell is left or none holds one alone.  In the second case the
sub-table is built again for both texts with twice as many cells and places from
another hash, and again, until all peel.
With n1 and n2 digests and d recovered differences the likeness is
(n1 + n2 - d) / (n1 + n2 + d), the Jaccard similarity of the paragraph sets;
two texts without paragraphs have likeness 1.

Null texts are empty.  Rows with a null id, and a table of one id, have an edit
that draws on the empty text or on themselves.  Of rows that repeat an id each
is fingerprinted; as a next document the least of their texts stands.  Columns
other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LOAD, GROUPS, CELLS = 8, 3, 8


def paragraphs(text: Column) -> Column:
    parts = F.split(text, r"\n+|(?<=[.!?])\s+")
    return F.array_distinct(F.filter(parts, lambda p: F.trim(p) != ""))


def digests(text: Column) -> Column:
    def digest(p):
        high = F.xxhash64(p).bitwiseAND(F.lit(~0xFFFF))
        return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(0xFFFF)))

    return F.transform(paragraphs(text), digest)


def depth(n: Column) -> Column:
    """log2 of the number of sub-tables for n digests."""
    return F.when(n <= LOAD, 0).otherwise(F.ceil(F.log2(n / F.lit(float(LOAD))) - 1e-9)).cast("int")


def sub_table(digest: Column, bits: Column) -> Column:
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", digest, F.lit(64) - bits))


def place(digest: Column, group: int) -> Column:
    return F.shiftright(digest, 16 + 3 * group).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _let(value: Column, body) -> Column:
    """body(value), value being evaluated once."""
    return F.transform(F.array(value), body)[0]


def mixed(digest: Column, attempt: int) -> Column:
    """What places and sub-tables are read from: the digest, in attempts to build
    a sub-table again another hash of it."""
    return F.xxhash64(digest, F.lit(attempt)) if attempt else digest


def cells(digest: Column, attempt: int = 0) -> list[Column]:
    """Aggregates: the cells of a sub-table."""
    where = mixed(digest, attempt)
    return [F.coalesce(F.bit_xor(F.when(place(where, g) == c, digest)), F.lit(0).cast("long")).alias(f"c{g * CELLS + c}") for g in range(GROUPS) for c in range(CELLS)]


ALL_CELLS = [f"c{i}" for i in range(GROUPS * CELLS)]


def peel(attempt: int = 0) -> Column:
    """Number of digests recovered from the cells, -1 if some stay."""

    def mask(v):
        """A bit for each of a digest's cells."""

        def bits(h):
            return F.call_function("shiftleft", F.lit(1), place(h, 0)).bitwiseOR(F.call_function("shiftleft", F.lit(1 << CELLS), place(h, 1))).bitwiseOR(F.call_function("shiftleft", F.lit(1 << 2 * CELLS), place(h, 2)))

        return _let(mixed(v, attempt), bits) if attempt else bits(v)

    def has(m, i):
        return F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1

    def pure(v, i):
        return (v != 0) & (F.xxhash64(v.bitwiseAND(F.lit(~0xFFFF))).bitwiseAND(F.lit(0xFFFF)) == v.bitwiseAND(F.lit(0xFFFF))) & has(mask(v), i)

    def step(state, _):
        def take_out(alone):
            def clear(v, i):
                return F.when(v == 0, v).otherwise(F.aggregate(alone, v, lambda acc, a: F.when(has(a["m"], i), acc.bitwiseXOR(a["v"])).otherwise(acc)))

            changed = F.struct(F.transform(state["c"], clear).alias("c"), (state["d"] + F.size(alone)).alias("d"), F.lit(True).alias("live"))
            return F.when(F.size(alone) > 0, changed).otherwise(F.struct(state["c"].alias("c"), state["d"].alias("d"), F.lit(False).alias("live")))

        alone = F.transform(F.array_distinct(F.filter(state["c"], pure)), lambda v: F.struct(v.alias("v"), mask(v).alias("m")))
        return F.when(~state["live"], state).otherwise(_let(alone, take_out))

    start = F.struct(F.array(*ALL_CELLS).alias("c"), F.lit(0).alias("d"), F.lit(True).alias("live"))
    # a round that goes on recovers one digest at least, and a cell holds one at most
    rounds = F.sequence(F.lit(0), F.lit(GROUPS * CELLS))
    return F.aggregate(rounds, start, step, lambda x: F.when(F.forall(x["c"], lambda v: v == 0), x["d"].cast("long")).otherwise(F.lit(-1).cast("long")))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n, next_id): its most code points; the largest smaller id, for the least id the largest.
    Ids are range partitioned; only the bounds of partitions meet in one task."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    parts = common.stage(ids.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").withColumn("p", F.spark_partition_id()), "ranges")
    bounds = parts.groupBy("p").agg(F.max("doc_id").alias("top"))
    w = Window.orderBy("p")
    last = F.max("top").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = bounds.select("p", F.coalesce(F.lag("top").over(w), last).alias("before"))
    inside = parts.withColumn("lower", F.lag("doc_id").over(Window.partitionBy("p").orderBy("doc_id")))
    return inside.join(F.broadcast(before), "p").select("doc_id", "n", F.coalesce("lower", "before").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = source.filter(F.col("doc_id").isNotNull())
    uses = common.stage(next_ids(source), "next").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("user"), F.col("n").alias("user_n"))
    # A document goes to the one that draws on it as its digests and as much of
    # its text as the edit can take.  Whole texts are shuffled once, by their id:
    # both joins read that one exchange.
    lent = keyed.join(uses, "doc_id").select(F.col("user").alias("doc_id"), F.struct(F.col("text").substr(F.lit(1), F.floor(F.col("user_n") / 2).cast("int")).alias("head"), digests(F.col("text")).alias("x")).alias("lent"))
    lent = lent.groupBy("doc_id").agg(F.min("lent").alias("lent"))
    nothing = F.struct(F.lit("").alias("head"), F.array().cast("array<bigint>").alias("x"))
    return _compared(keyed.join(lent, "doc_id"), id_col).unionByName(_compared(source.filter(F.col("doc_id").isNull()).withColumn("lent", nothing), id_col))


def _compared(rows: DataFrame, id_col: str) -> DataFrame:
    """rows: doc_id, text, lent (head and digests of the next document)."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("lent.head").substr(F.lit(1), half))
    base = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("edited", edited)
    base = base.select("row", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), digests(F.col("text")).alias("o"), digests(F.col("edited")).alias("e"), F.col("lent.x").alias("x"))
    no, ne, nx = (F.size(k) for k in "oex")
    keys = ["doc_id", "row"]
    # one row a digest and use: kind 0 the fingerprints, 1 compared with the edit,
    # 2 with the next; and one of kind 3 for what the document itself has
    own = F.struct("n_chars", "sha", "o", "e", "x")
    with_edit, with_next = depth(F.greatest(no, ne)), depth(no + nx)
    uses = ((0, "o", "o", depth(no)), (0, "e", "e", depth(ne)), (1, "", "o", with_edit), (1, "", "e", with_edit), (2, "", "o", with_next), (2, "", "x", with_next))
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side"), F.col(c).alias("ds"), b.alias("bits"), F.lit(None).cast(_OWN).alias("own")) for k, s, c, b in uses]
    kinds.append(F.struct(F.lit(3).alias("kind"), F.lit("").alias("side"), F.array(F.lit(0).cast("long")).alias("ds"), F.lit(0).alias("bits"), own.cast(_OWN).alias("own")))
    flat = base.select(*keys, F.explode(F.array(*kinds)).alias("k")).select(*keys, "k.kind", "k.side", "k.bits", "k.own", F.explode("k.ds").alias("d"))
    flat = flat.withColumn("sub", sub_table(F.col("d"), F.col("bits")))
    # own is a key and not an aggregate, which keeps the aggregation in generated code
    tables = flat.groupBy(*keys, "kind", "side", "bits", "sub", "own").agg(*cells(F.col("d")))
    line = F.when(F.col("kind") == 0, F.struct("sub", F.array(*ALL_CELLS).alias("s")))
    tables = tables.select(*keys, "kind", "side", "bits", "sub", "own", line.alias("line"), F.when(F.col("kind").isin(1, 2), peel()).alias("d"))

    def differing(kind):
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("d") >= 0), F.col("d"))), F.lit(0).cast("long")).alias(f"d{kind}")

    per = tables.groupBy(*keys).agg(
        F.collect_list("own")[0].alias("own"),
        F.collect_list(F.when(F.col("side") == "o", F.col("line"))).alias("fo"),
        F.collect_list(F.when(F.col("side") == "e", F.col("line"))).alias("fe"),
        differing(1), differing(2),
        F.collect_list(F.when(F.col("d") < 0, F.struct("kind", "bits", "sub"))).alias("open"))

    def text_of(count, lines):
        text = F.transform(F.array_sort(lines), lambda x: F.concat(x["sub"].cast("string"), F.lit(":"), F.concat_ws(",", F.transform(x["s"], lambda v: F.hex(v)))))
        return F.concat(F.col(count).cast("string"), F.lit(";"), F.concat_ws(";", text))

    def still(f):
        """A sub-table that did not peel, with the digests of both sides."""
        own = {c: F.filter(F.col(f"own.{c}"), lambda d: sub_table(d, f["bits"]) == f["sub"]) for c in "oex"}
        return F.struct(f["kind"].alias("kind"), f["sub"].alias("sub"), F.concat(own["o"], F.when(f["kind"] == 1, own["e"]).otherwise(own["x"])).alias("ds"))

    counts = {f"n{k}": F.size(f"own.{k}").cast("long") for k in "oex"}
    judged = common.stage(per.select(*keys, "own.n_chars", F.col("own.sha").alias("edited_sha256"), "fo", "fe", "d1", "d2", *(v.alias(k) for k, v in counts.items()), F.transform("open", still).alias("open")), "judged")
    more = _again(judged.select("row", F.explode("open").alias("f")).select("row", "f.*"))
    more = more.groupBy("row").agg(*(F.sum(F.when(F.col("kind") == k, F.col("d"))).alias(f"m{k}") for k in (1, 2)))
    # only documents with such sub-tables are joined to what these gave
    peeled = judged.filter(F.size("open") == 0).withColumns({m: F.lit(None).cast("long") for m in ("m1", "m2")})
    done = peeled.unionByName(judged.filter(F.size("open") > 0).join(more, "row", "left"))

    def likeness(n1, n2, d, m):
        d = (F.col(d) + F.coalesce(F.col(m), F.lit(0))).cast("double")
        return F.when(F.col(n1) + F.col(n2) == 0, 1.0).otherwise((F.col(n1) + F.col(n2) - d) / (F.col(n1) + F.col(n2) + d))

    return done.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", text_of("no", F.col("fo")).alias("fingerprint"), text_of("ne", F.col("fe")).alias("edited_fingerprint"), likeness("no", "ne", "d1", "m1").alias("near_edited"), likeness("no", "nx", "d2", "m2").alias("near_next"))


def _again(failed: DataFrame) -> DataFrame:
    """failed: row, kind, sub and ds (the digests of both sides) of each sub-table that
    did not peel; (row, kind, d) with the number of its differing digests.
    Each attempt doubles the cells and takes places from another hash."""
    open_ = common.stage(failed, "open")
    key, found, attempt = ["row", "kind", "sub"], [], 0
    while True:
        attempt += 1
        flat = open_.select(*key, (depth(F.size("ds")) + attempt).alias("bits"), F.explode("ds").alias("g"))
        flat = flat.withColumn("part", sub_table(mixed(F.col("g"), attempt), F.col("bits")))
        tables = flat.groupBy(*key, "part").agg(*cells(F.col("g"), attempt)).select(*key, peel(attempt).alias("d"))
        tried = common.stage(tables.groupBy(*key).agg(F.sum("d").alias("d"), F.min("d").alias("least")), "tried")
        found.append(tried.filter("least >= 0").select("row", "kind", "d"))
        stuck = tried.filter("least < 0").select(*key)
        if not stuck.head(1):
            break
        spent, open_ = open_, common.stage(open_.join(stuck, key, "left_semi"), "open")
        common.free(spent)
    common.free(open_)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_OWN = "struct<n_chars:bigint,sha:string,o:array<bigint>,e:array<bigint>,x:array<bigint>>"


def op7_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
