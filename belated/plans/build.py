"""Registered queries of the feature build: cohort, static block, model table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, labels, prepare
from . import roles
from .registry import CFG, ORACLE_SQL, QUERIES, query, r

_COHORT = f"""{roles.REGISTRATIONS},
coh AS (SELECT ltrim(raw_id, '0') AS entity_id, CAST(try_strptime(date_text, '%Y%m%d') AS DATE) AS grant_date, CAST(try_strptime(filed_text, '%Y%m%d') AS DATE) AS filing_date, small_entity
        FROM reg WHERE date_text BETWEEN '19950301' AND '19981231'),
own AS (SELECT coh.*, kind, coalesce(try_cast(withdrawn AS DOUBLE), 0.0) AS withdrawn, try_cast(num_claims AS DOUBLE) AS num_claims FROM coh LEFT JOIN det USING (entity_id)),
pat AS (SELECT *, year(grant_date) AS grant_year, CAST(grant_date - filing_date AS INT) AS filing_to_grant_days FROM own WHERE kind = 'utility' AND withdrawn = 0)"""


def _cohort(spark, sf):
    reg = roles.registrations(spark, sf).filter(prepare.text_between(F.col("date_text"), "19950301", "19981231"))
    base = reg.select(prepare.strip_zeros(F.col("raw_id")).alias("entity_id"), prepare.day(F.col("date_text")).alias("grant_date"), prepare.day(F.col("filed_text")).alias("filing_date"), "small_entity")
    det = roles.details(spark, sf).withColumns({"withdrawn": prepare.number(F.col("withdrawn"), 0), "num_claims": prepare.number(F.col("num_claims"))})
    own = prepare.granted(prepare.joined(base, "entity_id", det))
    return own.withColumns({"grant_year": F.year("grant_date"), "filing_to_grant_days": F.datediff("grant_date", "filing_date")})


@query(f"WITH {_COHORT} SELECT entity_id, grant_date, grant_year, filing_to_grant_days, num_claims, small_entity FROM pat")
def cohort(spark, sf):
    """Granted entities of a range of date strings: padded ids stripped, dates and
    numbers read where they can be."""
    return _cohort(spark, sf).select("entity_id", "grant_date", "grant_year", "filing_to_grant_days", "num_claims", "small_entity")


@query(f"WITH {roles.REGISTRATIONS} SELECT raw_id, CAST(try_strptime(date_text, '%Y%m%d') AS DATE) AS day, coalesce(try_cast(num_claims AS DOUBLE), 999.0) AS claims, CAST(coalesce(small_entity = 'Y', false) AS INT) AS small, CAST(num_claims IS NOT NULL AS INT) AS has_claims FROM reg LEFT JOIN det ON ltrim(raw_id, '0') = entity_id")
def coerced(spark, sf):
    """Dates and numbers that may not parse, and flags of them."""
    both = roles.registrations(spark, sf).withColumn("entity_id", prepare.strip_zeros(F.col("raw_id"))).join(roles.details(spark, sf), "entity_id", "left")
    return both.select("raw_id", prepare.day(F.col("date_text")).alias("day"), prepare.number(F.col("num_claims"), 999).alias("claims"), prepare.flag(F.col("small_entity") == "Y").alias("small"), F.col("num_claims").isNotNull().cast("int").alias("has_claims"))


_STATIC = f"""{_COHORT},
cls AS (SELECT entity_id, coalesce(section, '') AS section, coalesce(section, '') || coalesce(class, '') AS class_full FROM par
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sequence ASC NULLS LAST, party, section, class NULLS FIRST) = 1),
asg AS (SELECT entity_id, CAST(party_type IS NOT NULL AS INT) AS is_organization, CAST(coalesce(party_type IN (2), false) AS INT) AS is_domestic, CAST(coalesce(party_type IN (3, 9), false) AS INT) AS is_foreign, CAST(coalesce(party_type IN (1), false) AS INT) AS is_individual
        FROM par WHERE sequence = 0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY party, quantity, section, class NULLS FIRST) = 1),
inv AS (SELECT entity_id, count(DISTINCT party) AS inventor_count FROM par WHERE quantity > 20 GROUP BY ALL),
bwd AS (SELECT entity_id, count(*) AS bwd_own, count(*) FILTER (section = 'A') AS bwd_examiner, count(*) FILTER (section = 'R') AS bwd_applicant FROM par WHERE quantity > 10 GROUP BY ALL),
frn AS (SELECT entity_id, count(*) AS bwd_foreign FROM par WHERE class IS NULL GROUP BY ALL),
sta AS (SELECT entity_id, grant_year, filing_to_grant_days, num_claims, CAST(coalesce(small_entity = 'Y', false) AS INT) AS small_entity, section, class_full,
          coalesce(is_organization, 0) AS is_organization, coalesce(is_domestic, 0) AS is_domestic, coalesce(is_foreign, 0) AS is_foreign, coalesce(is_individual, 0) AS is_individual,
          coalesce(inventor_count, 1) AS inventor_count, coalesce(bwd_own, 0) AS bwd_own, coalesce(bwd_examiner, 0) AS bwd_examiner, coalesce(bwd_applicant, 0) AS bwd_applicant, coalesce(bwd_foreign, 0) AS bwd_foreign
        FROM pat LEFT JOIN cls USING (entity_id) LEFT JOIN asg USING (entity_id) LEFT JOIN inv USING (entity_id) LEFT JOIN bwd USING (entity_id) LEFT JOIN frn USING (entity_id))"""


@query(f"WITH {_STATIC} SELECT *, bwd_own + bwd_foreign AS bwd_total, round(bwd_examiner / (bwd_own + 1.0::DOUBLE), 8) AS bwd_examiner_ratio FROM sta")
def static_features(spark, sf):
    """The static block: class of least sequence, flags of the party of sequence 0,
    counts of inventors and of both kinds of citations made, with defaults."""
    p = roles.parties(spark, sf)
    t = F.col("party_type")
    first = prepare.least_in_sequence(F.col("sequence"), F.col("party"), F.col("section"), F.col("class"))
    cls = p.groupBy("entity_id").agg(F.min_by(F.struct("section", "class"), first).alias("x")).select("entity_id", prepare.code(F.col("x.section")).alias("section"), prepare.code(F.col("x.section"), F.col("x.class")).alias("class_full"))
    at_zero = p.filter("sequence = 0").groupBy("entity_id").agg(F.min_by(F.struct("party_type"), F.struct("party", "quantity", "section", "class")).alias("x")).select("entity_id", F.col("x.party_type").alias("party_type"))
    asg = at_zero.select("entity_id", t.isNotNull().cast("int").alias("is_organization"), prepare.flag(t.isin(2)).alias("is_domestic"), prepare.flag(t.isin(3, 9)).alias("is_foreign"), prepare.flag(t.isin(1)).alias("is_individual"))
    inv = p.filter("quantity > 20").groupBy("entity_id").agg(F.countDistinct("party").alias("inventor_count"))
    bwd = p.filter("quantity > 10").groupBy("entity_id").agg(F.count("*").alias("bwd_own"), F.count_if(F.col("section") == "A").alias("bwd_examiner"), F.count_if(F.col("section") == "R").alias("bwd_applicant"))
    frn = p.filter("class is null").groupBy("entity_id").agg(F.count("*").alias("bwd_foreign"))
    base = _cohort(spark, sf).select("entity_id", "grant_year", "filing_to_grant_days", "num_claims", prepare.flag(F.col("small_entity") == "Y").alias("small_entity"))
    zero = ("is_organization", "is_domestic", "is_foreign", "is_individual", "bwd_own", "bwd_examiner", "bwd_applicant", "bwd_foreign")
    out = prepare.filled(prepare.joined(base, "entity_id", cls, asg, inv, bwd, frn), {"inventor_count": 1} | dict.fromkeys(zero, 0))
    return r(prepare.backward_totals(out))


@query(f"WITH {roles.REGISTRATIONS} SELECT entity_id, count(*) AS bwd_foreign FROM par WHERE class IS NULL GROUP BY ALL")
def foreign_counts(spark, sf):
    """Group size of one kind of rows."""
    return roles.parties(spark, sf).filter("class is null").groupBy("entity_id").agg(F.count("*").alias("bwd_foreign"))


_BLOCKS = {"features": "citation_features_7_5", "shape": "shape_features", "quality": "citer_quality_7_5"}


def _model_sql():
    shape = ["burstiness", "gini", "first_nonzero_age", "zero_run", "resurgences"]
    quality = ["n_citers", "citer_recency_mean", "citer_ipc_cross_rate", "citer_assignee_hhi"]
    cite = ["cum_citations", "cite_growth_rate", "zero_citation"]
    sub = {k: f"(FROM ({ORACLE_SQL[v]}))" for k, v in _BLOCKS.items()}
    fill = lambda c: f"CAST(coalesce({c}, 0) AS DOUBLE)"
    return f"""SELECT l.entity_id, psb, {', '.join(f'{fill(c)} AS t75__{c}' for c in cite)}, {', '.join(f'{fill(c)} AS {c}' for c in [*shape, *quality])},
CAST(CASE WHEN l.entity_id % 10 BETWEEN 2 AND 6 THEN 'train' WHEN l.entity_id % 10 = 7 THEN 'val' WHEN l.entity_id % 10 IN (8, 9) THEN 'test' END AS VARCHAR) AS fold
FROM (FROM ({ORACLE_SQL['beauty_labels']})) l JOIN {sub['features']} f USING (entity_id) LEFT JOIN {sub['shape']} s USING (entity_id) LEFT JOIN {sub['quality']} q USING (entity_id)"""


@query(_model_sql())
def model_table(spark, sf):
    """Labels inner-joined with prefixed citation features, left-joined with the
    optional blocks (one of them is not there); null numbers are 0, so an entity
    that no block knows has zeros throughout."""
    lab = QUERIES["beauty_labels"](spark, sf).select("entity_id", "psb")
    feats, shape, quality = (QUERIES[q](spark, sf) for q in _BLOCKS.values())
    out = prepare.model_table(lab, prepare.prefixed(feats, "t75", "entity_id"), shape, quality, None)
    columns = prepare.feature_columns(out, ["t75__cum_citations", "t75__cite_growth_rate", "t75__zero_citation", "emb_0"], ["burstiness", "gini", "first_nonzero_age", "zero_run", "resurgences"], ["n_citers", "citer_recency_mean", "citer_ipc_cross_rate", "citer_assignee_hhi", "gini"])
    return out.select("entity_id", "psb", *columns, labels.fold(1980 + F.col("entity_id") % 10).alias("fold"))


@query(f"SELECT entity_id, lapsed_age FROM ({ORACLE_SQL['maintenance_flags']}) WHERE paid_3_5 = 1 AND paid_7_5 = 1")
def survivors(spark, sf):
    """Entities that paid at both cutoffs before the last."""
    return prepare.survivors(QUERIES["maintenance_flags"](spark, sf), 11.5, enabled=True).select("entity_id", "lapsed_age")


@query(f"WITH {roles.SCORES.format(label='quality')} SELECT doc_id AS id, coalesce(y, 0) AS y, coalesce(tscore, -999.0) AS score FROM documents LEFT JOIN (SELECT id AS doc_id, y, tscore FROM s) USING (doc_id)")
def aligned_scores(spark, sf):
    """Scores of the labelled rows on all rows: missing ones rank last, missing
    outcomes are 0."""
    base = roles.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return prepare.aligned(base, roles.scores(spark, sf, tied=True), {"y": 0, "score": -999.0})


def _panel_sql(at):
    c = "sum(x) FILTER (age {}) "
    cum, now, prev, prev2, first, third = c.format(f"<= {at}"), c.format(f"= {at}"), c.format(f"= {at - 1}"), c.format(f"= {at - 2}"), c.format("= 0"), c.format(f"= {at - 3}")
    parts = {"cum_citations": cum, "cite_last1yr": now, "cite_last3yr": c.format(f"BETWEEN {at - 2} AND {at}"), "cite_growth_rate": f"({now} - {first}) / ({first} + 1.0)", "cite_growth_last3": f"({now} - {third}) / ({third} + 1.0)", "cite_acceleration": f"({now} - {prev}) - ({prev} - {prev2})", "cite_peak_ratio": f"max(x) FILTER (age <= {at}) / greatest({cum}, 1.0)", "cite_active_years": f"count(*) FILTER (age <= {at} AND x > 0)", "zero_citation": f"CAST({cum} = 0 AS INT)"}
    return f"WITH {roles.curve_sql(CFG.feature_age)} SELECT entity_id, {', '.join(f'round(CAST({v} AS DOUBLE), 8) + 0.0 AS panel{at}__{k}' for k, v in parts.items())} FROM c GROUP BY entity_id"


@query(_panel_sql(7))
def yearly_panel(spark, sf):
    """Features of the curve at every age as yearly rows, and their pick at one age."""
    c = graph.curves(roles.edges(spark, sf), CFG.feature_age)
    return r(prepare.panel_last(prepare.panel(c, list(range(3, 12))), 7))


@query("""
SELECT doc_id AS id, lang AS grp, coalesce(text, '') AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def abstracts(spark, sf):
    """Texts of the entities that have a label, one each (the least text where an id
    repeats), empty where there is none."""
    docs = roles.table(spark, sf, "documents").join(roles.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    first = graph.keep_first(docs, "doc_id", "text")
    return first.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.coalesce("text", F.lit("")).alias("text"))
