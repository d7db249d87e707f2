"""Confidence scores and decisions as Catalyst expressions, and number formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column) -> Column:
    """A double, or null for what doesn't read as one."""
    return c.try_cast("double")


def _clamped(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.5)), F.lit(0.95)), 2)


def confidence_from_fdr(fdr: Column) -> Column:
    """Fixed steps; 0.5 for null and for 0.05 or more."""
    return F.when(fdr < 1e-10, 0.95).when(fdr < 1e-5, 0.92).when(fdr < 1e-3, 0.88).when(fdr < 0.01, 0.85).when(fdr < 0.05, 0.80).otherwise(0.5)


def confidence_of_finding(ratio: Column, method: Column) -> Column:
    """0.85, more with a ratio, less by an uncommon method."""
    low = F.lower(F.coalesce(method, F.lit("")))
    common, uncommon = low.rlike("16s|metagenomic|shotgun"), low.rlike("qpcr|dgge")
    given = F.coalesce((ratio != "") & (ratio != "0"), F.lit(False))
    return _clamped(F.lit(0.85) + F.when(given, 0.03).otherwise(0.0) - F.when(~common & uncommon, 0.05).otherwise(0.0))


def has_concentration(standard: Column, original: Column) -> Column:
    return F.coalesce(standard > 0, F.lit(False)) | F.coalesce(original > 0, F.lit(False))


def below_detection(standard: Column, original: Column) -> Column:
    """A measured 0: the standard value, or the original one where there is no standard value."""
    return F.coalesce(standard == 0, F.lit(False)) | (standard.isNull() & F.coalesce(original == 0, F.lit(False)))


def confidence_of_content(allowed: Column, measured: Column) -> Column:
    return _clamped(F.lit(0.80) + F.when(allowed, 0.05).otherwise(0.0) + F.when(measured, 0.05).otherwise(-0.10))


def confidence_of_pathway(priority: Column) -> Column:
    return F.when(priority == "high", 0.92).otherwise(0.88)


def direction(beta: Column) -> Column:
    return F.when(beta > 0, F.lit("increases")).otherwise(F.lit("decreases"))


def decide(id_a: Column, exact_a: Column, id_b: Column, exact_b: Column, exact_required: Column) -> Column:
    """MERGE, KEEP or MANUAL for two resolved labels."""
    exact = F.coalesce(exact_a, F.lit(False)) & F.coalesce(exact_b, F.lit(False))
    return F.when(id_a.isNull() | id_b.isNull() | (exact_required & ~exact), F.lit("MANUAL")).when(id_a == id_b, F.lit("MERGE")).otherwise(F.lit("KEEP"))


def decision_status(decision: Column, current: Column, types: tuple[str, ...]) -> Column:
    """What a reviewer's decision does: retype, none, or unrecognised."""
    d = F.trim(F.coalesce(decision, F.lit("")))
    known = d.isin(*types)
    return F.when(known & (d != current), F.lit("retype")).when(known | (d == "") | (F.lower(d) == "keep"), F.lit("none")).otherwise(F.lit("unrecognised"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


@F.pandas_udf(T.StringType())
def format_g3(values: pd.Series) -> pd.Series:
    """Three significant digits as in notes; the JVM's %g differs, so this one runs in Arrow batches."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.3g}")


def citation(kind: Column, text: Column, presence_only: Column) -> Column:
    given = F.when(kind.isNotNull() & text.isNotNull(), F.concat(kind, F.lit(": "), text))
    parts = F.concat_ws(" | ", given, F.when(presence_only, F.lit("presence_only")))
    return F.when(parts != "", parts)


def batch_cost(input_tokens: Column, output_tokens: Column, per_million_in: float, per_million_out: float, discount: float = 1.0) -> Column:
    return (input_tokens * per_million_in + output_tokens * per_million_out) / 1e6 * discount
