"""Audit rules as data: one projection, one explode for all rules of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, rules: list[tuple[str, str, Column, Column | None]], key: str = "url") -> DataFrame:
    """(key, severity, rule, detail) for each rule (name, severity, condition, detail)
    that holds; a null condition does not."""
    made = F.array(
        *[F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))) for name, severity, cond, detail in rules]
    )
    return rows.select(key, F.explode(F.array_compact(made)).alias("f")).select(key, "f.*")


def findings_summary(found: DataFrame, *by: str) -> DataFrame:
    """Findings by severity for each key, and whether the gate closes."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy(*by).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("notice").alias("notices"), (n("error") > 0).alias("blocked"))
