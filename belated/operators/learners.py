"""Learners over feature columns: trees, logistic regression, scaling, principal
components, clusters, text vectors and minority oversampling.  All are fitted on
the training fold and applied to every row.  Trees and logistic regression are
fitted on its different rows with their counts (``trees``), the former by MLlib
on all rows where there are many; the others are MLlib's, and nothing is
collected but model parameters."""

from __future__ import annotations

import tempfile
from math import ceil, sqrt

import numpy as np
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Config
from . import trees as ensembles
from .labels import finite
from .vectors import cosine_distance


def assemble(df: DataFrame, features: list[str], psb: str = "psb", cfg: Config = Config()) -> DataFrame:
    """x of the features (null and infinite: 0), y and the sample weight."""
    safe = df.withColumns({f: finite(F.col(f).cast("double")) for f in features})
    y = F.coalesce(F.col(psb), F.lit(0)).cast("double")
    return VectorAssembler(inputCols=features, outputCol="x").transform(safe).withColumn("y", y).withColumn("weight", F.when(y == 1, cfg.positive_weight).otherwise(1.0))


def scale(train: DataFrame, df: DataFrame) -> DataFrame:
    """x to mean 0 and population deviation 1 of the training rows."""
    n = train.count()
    model = StandardScaler(inputCol="x", outputCol="_scaled", withMean=True).fit(train)
    by = float(sqrt(n / (n - 1))) if n > 1 else 1.0
    scaled = model.transform(df).drop("x")
    return scaled.withColumn("x", array_to_vector(F.transform(vector_to_array("_scaled"), lambda v: v * by))).drop("_scaled")


def cut_lineage(df: DataFrame) -> None:
    """Boosting cuts its lineage every ten trees, if there is a checkpoint folder:
    the session's, or else a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="belated-"))


def _classifier(kind: str, train: DataFrame, trees: int, seed: int):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    columns = {"featuresCol": "x", "labelCol": "y", "weightCol": "weight"}
    if kind == "forest":
        return RandomForestClassifier(**columns, numTrees=trees, maxDepth=10, seed=seed)
    if kind == "boosted":
        cut_lineage(train)
        return GBTClassifier(**columns, maxIter=trees, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=seed)
    if kind == "logistic":
        # an L2 penalty of strength 1 on the summed loss, in terms of the mean loss
        total = train.agg(F.sum("weight")).first()[0] or 1.0
        return LogisticRegression(**columns, regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=2000)
    raise ValueError(kind)


def classify(data: DataFrame, kind: str, id_col: str = "entity_id", trees: int = 500, seed: int = 42, rows: tuple | None = None) -> DataFrame:
    """(id, fold, y, score) of all rows; data: id, fold, x, y, weight.  A training
    fold without both classes gives its rate of positives to all rows.  ``rows``:
    ``ensembles.different`` of the training fold, if it is known."""
    spark, train = data.sparkSession, data.filter("fold = 'train'")
    keep = [id_col, "fold", "y"]
    rows = rows or ensembles.different(train, "y")
    if rows:
        x, y, weight, count = rows
        n, positives = int(count.sum()), float(y @ count)
    else:
        n, positives = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if positives in (0, n):
        return data.select(*keep, F.lit(float(positives / n) if n else 0.0).alias("score"))
    if rows and kind in ("forest", "boosted"):
        model = ensembles.forest(spark, rows, trees, seed) if kind == "forest" else ensembles.boosted(rows, trees, seed, logistic=True)
        return data.select(*keep, ensembles.score(spark, model, F.col("x"), logistic=kind == "boosted").alias("score"))
    if rows and kind == "logistic":
        mean = count @ x / n
        sd = np.sqrt(count @ (x - mean) ** 2 / n)
        x = (x - mean) / np.where(sd > 0, sd, np.inf)  # a constant feature: 0, as by StandardScaler
        schema = StructType().add("x", VectorUDT()).add("y", "double").add("weight", "double")
        few = spark.createDataFrame(zip(map(Vectors.dense, x), y.tolist(), (weight * count).tolist(), strict=True), schema).coalesce(1)
        model = _classifier(kind, few, trees, seed).fit(few)
        by = model.coefficients.toArray() / np.where(sd > 0, sd, np.inf)
        margin = F.aggregate(F.zip_with(vector_to_array("x"), F.array(*map(F.lit, by.tolist())), lambda a, b: a * b), F.lit(model.intercept - float(by @ mean)), lambda s, v: s + v)
        return data.select(*keep, (1 / (1 + F.exp(-margin))).alias("score"))
    if kind == "logistic":
        data = scale(train, data)
        train = data.filter("fold = 'train'")
    model = _classifier(kind, train, trees, seed).fit(train)
    return model.transform(data).select(*keep, vector_to_array("probability")[1].alias("score"))


def components(vectors: DataFrame, k: int = 50) -> DataFrame:
    """v replaced by its k principal components; vectors: id, v, train.  The mean
    of the training rows is taken off first."""
    data = vectors.withColumn("_v", array_to_vector("v"))
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data.filter("train"))
    data = centre.transform(data)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(data.filter("train"))
    return model.transform(data).withColumn("v", vector_to_array("_p")).drop("_v", "_c", "_p")


def clusters(vectors: DataFrame, k: int = 50, starts: int = 10, seed: int = 42) -> DataFrame:
    """Cluster and cosine distance to its centre; the best of ``starts`` fits on
    the training rows by cost."""
    from pyspark.ml.clustering import KMeans

    data = vectors.withColumn("_v", array_to_vector("v"))
    train = data.filter("train")
    models = [KMeans(k=k, featuresCol="_v", predictionCol="cluster", seed=seed + i).fit(train) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in best.clusterCenters()))
    return best.transform(data).drop("_v").withColumn("cluster_distance", cosine_distance(F.col("v"), F.element_at(centres, F.col("cluster") + 1)))


def encode(df: DataFrame, text: str = "text", dims: int = 1 << 14) -> DataFrame:
    """x: hashed words weighed by inverse document frequency, of length 1 (0
    where the text is null or has no words)."""
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+").transform(df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))))
    counts = HashingTF(inputCol="_w", outputCol="_n", numFeatures=dims).transform(words)
    weighed = IDF(inputCol="_n", outputCol="_i").fit(counts).transform(counts)
    return Normalizer(inputCol="_i", outputCol="x").transform(weighed).drop("_t", "_w", "_n", "_i")


#: Rows of a block of positives, and of those of it that meet another block at once.
CELL, SLICE = 8192, 512


def nearest(points: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """(id, near): the k other ids of least squared distance, nearest first (ties:
    the least id).  points: id, v array<double>.  All pairs are compared, a pair of
    blocks of about ``cell`` rows in a group of its own, which yields k ids a row;
    products of matrices choose candidates, exact sums decide."""
    blocks = max(1, -(-points.count() // cell))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x, y = points.select("id", "v", block.alias("xb"), every.alias("yb")), points.select("id", "v", block.alias("yb"), every.alias("xb"))

    def compare(left, right):
        import numpy as np
        import pandas as pd

        out = [pd.DataFrame({"id": left["id"][:0], "d": np.zeros(0), "other": right["id"][:0]})]
        if not len(left) or not len(right):
            return out[0]
        a, b = (np.stack(t["v"].to_numpy()).astype(float) for t in (left, right))
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        size = (b * b).sum(1)
        for lo in range(0, len(a), SLICE):
            part = a[lo : lo + SLICE]
            own = (part * part).sum(1)[:, None]
            same = ids[lo : lo + SLICE, None] == others[None, :]
            d = own + size - 2 * (part @ b.T)
            d[same] = np.inf
            at = min(k, d.shape[1]) - 1
            # rounding moves a product's distance by far less than this
            bound = np.partition(d, at, axis=1)[:, at : at + 1] + 1e-10 * (own + size.max())
            r, c = np.nonzero(~(d > bound) & ~same)
            step = max(k, CELL * SLICE // (4 * a.shape[1]))
            exact = np.zeros(len(r))
            for at in range(0, len(r), step):
                few = slice(at, at + step)
                for j in range(a.shape[1]):
                    exact[few] += (part[r[few], j] - b[c[few], j]) ** 2
            pairs = pd.DataFrame({"row": r, "id": ids[lo + r], "d": exact, "other": others[c]})
            out.append(pairs.sort_values(["row", "d", "other"]).groupby("row").head(k)[["id", "d", "other"]])
        return pd.concat(out[1:] or out)

    kind = dict(points.dtypes)["id"]
    best = x.groupBy("xb", "yb").cogroup(y.groupBy("xb", "yb")).applyInPandas(compare, f"id {kind}, d double, other {kind}")
    return best.groupBy("id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k), lambda p: p["other"]).alias("near"))


def oversample(df: DataFrame, ratio: float = 0.1, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows between a positive and one of its k nearest positives, as many as
    bring positives to ``ratio`` of the negatives (in expectation); df: id, v, y.
    Returns df's rows and the made ones, which have a null id.  Positives without
    id or vector are neither ends nor counted among those that rows start from."""
    usable = F.col("id").isNotNull() & F.col("v").isNotNull()
    n = {r["y"]: r for r in df.groupBy("y").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable")).collect()}
    count = lambda y, c: n[y][c] if y in n else 0
    have, starts, want = count(1, "n"), count(1, "usable"), int(ratio * count(0, "n"))
    base = df.select("id", "v", "y")
    if starts < 2 or want <= have:
        return base
    pos = df.filter((F.col("y") == 1) & usable).select("id", F.col("v").cast("array<double>").alias("v"))
    each = ceil((want - have) / starts)

    def uniform(tag):
        return F.pmod(F.xxhash64("id", "i", F.lit(tag), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    made = nearest(pos, k).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(each)))).filter(uniform("kept") < (want - have) / (each * starts))
    mate = F.element_at("near", (F.floor(uniform("mate") * F.size("near")) + 1).cast("int"))
    ends = pos.dropDuplicates(["id"])
    made = made.select("id", mate.alias("other"), uniform("place").alias("f")).join(ends, "id").join(ends.select(F.col("id").alias("other"), F.col("v").alias("u")), "other")
    v = F.transform(F.arrays_zip("v", "u"), lambda p: p["v"] + F.col("f") * (p["u"] - p["v"]))
    return base.unionByName(made.select(F.lit(None).cast(dict(base.dtypes)["id"]).alias("id"), v.cast(dict(base.dtypes)["v"]).alias("v"), F.lit(1).cast(dict(base.dtypes)["y"]).alias("y")))
