"""Which sample tables play entities, edges, events, vectors and scores, in Spark
and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (1980 + F.col("p_partkey") % 10).cast("int").alias("grant_year"), F.substring("p_type", 1, 1).alias("section"), F.col("p_type").alias("class_full"), F.concat_ws("/", "p_type", "p_brand").alias("subclass"), "p_size", "p_retailprice")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Citations: rows of lineitem above a quantity, so that some entities have none."""
    return _edges(table(spark, sf, "lineitem").filter("l_quantity > 45"))


def _edges(li: DataFrame) -> DataFrame:
    year = 1980 + (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    category = F.when(F.col("l_returnflag") == "A", "examiner").when(F.col("l_returnflag") == "R", "applicant").otherwise("other")
    e = li.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("citing"), F.col("l_suppkey").alias("supplier"), year.cast("int").alias("cite_year"), category.alias("category"))
    return e.withColumn("age", (F.col("cite_year") - (1980 + F.col("entity_id") % 10)).cast("int")).withColumn("cited", F.col("entity_id"))


def rich_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with attributes of the citing side."""
    who = table(spark, sf, "orders").select(F.col("o_orderkey").alias("citing"), F.col("o_custkey").alias("c_custkey")).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    cited = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("p_size") % 5 + 1).cast("int")).alias("cited_class"))
    parties = table(spark, sf, "supplier").agg(F.count("*").alias("parties"))  # one row
    e = edges(spark, sf).join(who, "citing", "left").join(cited, "entity_id", "left").crossJoin(F.broadcast(parties))
    known = F.coalesce("c_mktsegment", F.lit("UNK"))
    return e.select("entity_id", "age", "category", known.alias("citing_class"), F.col("supplier").alias("citing_assignee"), F.col("c_nationkey").alias("citing_location"), ((known != F.col("cited_class")) & (known != "UNK")).alias("cross"), (F.col("supplier") == F.col("entity_id") % F.col("parties")).alias("same_assignee"))


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw text rows: padded ids, some dates and numbers that don't parse."""
    k = F.col("o_orderkey")
    date = F.when(k % 13 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    filed = F.date_format(F.date_sub(F.to_date("o_orderdate"), (k % 900).cast("int")), "yyyyMMdd")
    small = F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N")
    return table(spark, sf, "orders").select(F.lpad(k.cast("string"), 10, "0").alias("raw_id"), date.alias("date_text"), filed.alias("filed_text"), small.alias("small_entity"))


def details(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, withdrawal and numbers of six in seven orders, as text."""
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "design").otherwise("utility")
    withdrawn = F.when(k % 11 == 0, "1").when(k % 19 == 0, "x").otherwise("0")
    claims = F.when(k % 17 == 0, "n/a").when(k % 5 != 0, (k % 40).cast("string"))
    return table(spark, sf, "orders").filter(k % 7 != 0).select(k.cast("string").alias("entity_id"), kind.alias("kind"), withdrawn.alias("withdrawn"), claims.alias("num_claims"))


def parties(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of lineitem as classes, assignees and inventors of an order; some
    sequences and codes are null."""
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("entity_id"), F.nullif(n - 1, F.lit(2)).alias("sequence"), F.col("l_returnflag").alias("section"), F.nullif(F.col("l_linestatus"), F.lit("F")).alias("class"), F.col("l_suppkey").alias("party"), F.element_at(F.array(*(F.lit(x) for x in (1, 2, 3, 9, None))), (F.col("l_suppkey") % 5 + 1).cast("int")).cast("int").alias("party_type"), F.col("l_quantity").alias("quantity"))


def paid_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    first = ev.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("anchor"))
    e = ev.filter(F.col("event_type").startswith("pu") & (F.col("value") > 20)).join(first, "user_id")
    return e.select(F.col("user_id").alias("entity_id"), F.datediff(F.to_date("ts"), "anchor").cast("double").alias("age"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.col("embedding").alias("v"), ((1980 + F.col("vec_id") % 10).between(1982, 1986)).alias("train"))


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Citations: all rows of lineitem."""
    return _edges(table(spark, sf, "lineitem"))


def scores(spark: SparkSession, sf: str, label: str = "quality", tied: bool = False) -> DataFrame:
    s = F.col("n_chars").cast("double")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), (F.floor(s / 500).cast("double") if tied else s).alias("score"))
    return d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col(label).cast("long").alias("y")), "id")


EDGES = """
e AS (SELECT l_partkey AS entity_id, l_orderkey AS citing, l_suppkey AS supplier,
        CAST(1980 + (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INT) AS cite_year,
        CASE l_returnflag WHEN 'A' THEN 'examiner' WHEN 'R' THEN 'applicant' ELSE 'other' END AS category,
        CAST(1980 + (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 - (1980 + l_partkey % 10) AS INT) AS age
      FROM lineitem WHERE l_quantity > 45)"""


def curve_sql(top: int, universe: str = "SELECT DISTINCT entity_id FROM e WHERE age BETWEEN 0 AND {top}") -> str:
    """c: entity, age 0..top, count x."""
    return f"""{EDGES},
u AS ({universe.format(top=top)}),
k AS (SELECT entity_id, age, count(*) AS n FROM e WHERE age BETWEEN 0 AND {top} GROUP BY ALL),
c AS (SELECT u.entity_id, CAST(r.range AS BIGINT) AS age, coalesce(k.n, 0) AS x
      FROM u CROSS JOIN range({top + 1}) r LEFT JOIN k ON k.entity_id = u.entity_id AND k.age = r.range)"""


def beauty_sql(top: int) -> str:
    return f"""{curve_sql(top)},
m AS (SELECT entity_id, min(age) FILTER (x = mx) AS tm, max(mx) AS mx, max(x) FILTER (age = 0) AS c0, sum(x) AS total
      FROM (SELECT *, max(x) OVER (PARTITION BY entity_id) AS mx FROM c) GROUP BY entity_id),
w AS (SELECT c.entity_id, sum((m.c0 + (m.mx - m.c0) / CAST(nullif(m.tm, 0) AS DOUBLE) * c.age - c.x) / greatest(1, c.x)) AS b,
             max(abs((m.mx - m.c0) * c.age - m.tm * c.x + m.tm * m.c0)) AS far
      FROM c JOIN m USING (entity_id) WHERE c.age <= m.tm GROUP BY c.entity_id),
s AS (SELECT m.entity_id, round(CASE WHEN m.tm = 0 THEN 0.0 ELSE w.b END, 9) AS b, CAST(m.tm AS INT) AS t_m,
             CAST((SELECT min(age) FROM c WHERE c.entity_id = m.entity_id AND c.age <= m.tm AND abs((m.mx - m.c0) * c.age - m.tm * c.x + m.tm * m.c0) = w.far) AS INT) AS t_a,
             CAST(m.total AS BIGINT) AS total_citations, m.mx AS peak_citations
      FROM m JOIN w USING (entity_id))"""


REGISTRATIONS = """
reg AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS raw_id, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y%m%d') END AS date_text,
          strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 900 AS INT), '%Y%m%d') AS filed_text, CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS small_entity FROM orders),
det AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, CASE WHEN o_orderstatus = 'P' THEN 'design' ELSE 'utility' END AS kind,
          CASE WHEN o_orderkey % 11 = 0 THEN '1' WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '0' END AS withdrawn,
          CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 40 AS VARCHAR) END AS num_claims FROM orders WHERE o_orderkey % 7 <> 0),
par AS (SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, nullif(l_linenumber - 1, 2) AS sequence, l_returnflag AS section, nullif(l_linestatus, 'F') AS class, l_suppkey AS party,
          ([1, 2, 3, 9, NULL])[l_suppkey % 5 + 1] AS party_type, l_quantity AS quantity FROM lineitem)"""


SCORES = """
s AS (SELECT d.doc_id AS id, lang AS grp, CAST(n_chars AS DOUBLE) AS dscore, floor(n_chars / 500.0) AS tscore, CAST(l.{label} AS BIGINT) AS y
      FROM documents d JOIN labels l USING (doc_id))"""
