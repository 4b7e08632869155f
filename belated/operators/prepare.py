"""From raw text columns to the static block of features and the model table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import finite


def text_between(col: Column, first: str, last: str) -> Column:
    """Comparison of strings as they are, both ends included."""
    return col.between(first, last)


def strip_zeros(col: Column) -> Column:
    return F.ltrim(col, F.lit("0"))


def number(col: Column, default: float | None = None) -> Column:
    """A string as a double; what is none, and null, is the default."""
    value = col.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def day(col: Column, pattern: str = "yyyyMMdd") -> Column:
    """A string as a date; null where it is none."""
    return F.to_date(F.try_to_timestamp(col, F.lit(pattern)))


def code(*parts: Column) -> Column:
    """Parts of a hierarchy joined, a null part as an empty string."""
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def flag(condition: Column) -> Column:
    """1 or 0; null counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def granted(df: DataFrame, kind: str = "utility") -> DataFrame:
    """Rows of one kind that are not withdrawn.  Rows that a left join left without
    a kind go."""
    return df.filter((F.col("kind") == kind) & (F.col("withdrawn") == 0))


def least_in_sequence(sequence: Column, *ties: Column) -> Column:
    """An order for ``min_by``: by sequence, nulls last, then by ``ties``."""
    return F.struct(sequence.isNull().alias("none"), sequence.alias("sequence"), *(t.alias(f"tie{k}") for k, t in enumerate(ties)))


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """All columns but ``keep`` with the prefix and two underscores."""
    return df.select(*(F.col(c).alias(c if c in keep else f"{prefix}__{c}") for c in df.columns))


def joined(base: DataFrame, key: str, *blocks: DataFrame | None) -> DataFrame:
    """Left joins of the blocks that are there."""
    for block in blocks:
        if block is not None:
            base = base.join(block, key, "left")
    return base


def filled(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()})


def backward_totals(df: DataFrame) -> DataFrame:
    """Total of both kinds of citations made, and the share of examiners' ones."""
    return df.withColumns({"bwd_total": F.col("bwd_own") + F.col("bwd_foreign"), "bwd_examiner_ratio": F.col("bwd_examiner") / (F.col("bwd_own") + 1)})


def survivors(df: DataFrame, cutoff: float, enabled: bool = False) -> DataFrame:
    """With ``enabled``: only entities that paid at all cutoffs before this one."""
    paid = {7.5: ["paid_3_5"], 11.5: ["paid_3_5", "paid_7_5"]}.get(cutoff, [])
    for c in paid if enabled else []:
        df = df.filter(F.col(c) == 1)
    return df


def feature_columns(df: DataFrame, *groups: list[str]) -> list[str]:
    """The columns of the groups that the table has, in order, once each."""
    return list(dict.fromkeys(c for group in groups for c in group if c in df.columns))


def model_table(labels: DataFrame, features: DataFrame, *optional: DataFrame | None, key: str = "entity_id") -> DataFrame:
    """Labelled entities with features, and the optional blocks that are there;
    null and infinite numbers are 0.  Entities without a label are in no model."""
    out = joined(labels.join(features, key), key, *optional)
    number_types = ("double", "float", "int", "bigint")
    own = set(labels.columns)
    return out.select(*(finite(F.col(c).cast("double")).alias(c) if c not in own and t in number_types else F.col(c) for c, t in out.dtypes))


def aligned(base: DataFrame, scores: DataFrame, defaults: dict[str, float], key: str = "id") -> DataFrame:
    """Scores of another table on the rows of ``base``; a missing one is its default."""
    return filled(base.join(scores.select(key, *defaults), key, "left"), defaults)


def panel(curve: DataFrame, ages: list[int]) -> DataFrame:
    """(entity_id, age, features) of a curve at each age: yearly rows."""
    from ..functions import curves

    rows = [F.struct(F.lit(a).alias("age"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in curves.citation_features(F.col("c"), a).items() if not k.startswith("cite_yr"))) for a in ages]
    return curve.select("entity_id", F.explode(F.array(*rows)).alias("r")).select("entity_id", "r.*")


def panel_last(panel_rows: DataFrame, at: int) -> DataFrame:
    """The panel's columns at one age."""
    return prefixed(panel_rows.filter(F.col("age") == at).drop("age"), f"panel{at}", "entity_id")
