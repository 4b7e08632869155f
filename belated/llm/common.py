"""Plumbing shared by the corpus operators: inputs, staged tables, Arrow maps."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import give_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``; where that is unset and the master is this machine
    (tests), a temporary folder that is set once as the checkpoint folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="belated-"))
            path = sc.getCheckpointDir()
    return path.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/belated-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def settle(df: DataFrame, tag: str, since: int) -> DataFrame:
    """``stage`` of a result, after which the folders made since ``since``
    (``len`` of those made before) are removed: the result reads none of them.
    Spark's cleaner then drops the shuffle files that nothing refers to any more."""
    out = stage(df, tag)
    spent = _made[since:-1]
    del _made[since:-1]
    _remove_folders(spent)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def made() -> int:
    return len(_made)


@atexit.register
def _remove_folders(folders: list[tuple[SparkSession, str]] | None = None) -> None:
    for spark, path in _made if folders is None else folders:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that a lost
    executor costs a reread, and both consumers of a table see one result.  The
    shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._belated_folder = path
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in staged:
        gone = [x for x in _made if x[1] == df._belated_folder]
        _made[:] = [x for x in _made if x[1] != df._belated_folder]
        _remove_folders(gone)


def bound_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch: 2000, where the session still has Spark's default,
    so that a Python worker holds some megabytes of text at a time."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        give_back(False)

    return df.mapInArrow(run, schema)


def is_held_out(doc_id) -> F.Column:
    """The evaluation fold of the classifiers: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, key: str, by: str, per_class: int | dict, max_chars: int) -> DataFrame:
    """At most about ``per_class`` rows of each value of ``by`` (all, where there
    are fewer; a dict has a number for each value), the choice depending on a hash of
    ``key`` alone.  Texts of more than ``max_chars`` code points are not used for
    fitting.  The bound holds in expectation per class and exactly, by a final
    limit, for the whole."""
    df = df.filter(F.col(by).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
    most = {value: per_class.get(value, 0) if isinstance(per_class, dict) else per_class for value in counts}
    mark = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        rate = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, most[value] / n))).otherwise(rate)
    cap = int(sum(most.values()) * 1.25) + 64
    return df.filter(mark < rate).orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(cap)
