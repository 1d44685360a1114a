"""Score, severity and rule expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.keys import col
from flowspark.schemas import RISK, SEVERITIES, SEVERITY_OF_TYPE


def normalize_score(err: str | Column, threshold: Column | float, max_err: Column | float | None = None) -> Column:
    """Error to a 0..1 score; without a usable maximum it is a 0/1 step at the threshold."""
    e = col(err)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    step = F.when(e > thr, 1.0).otherwise(0.0)
    if max_err is None:
        return step
    top = max_err if isinstance(max_err, Column) else F.lit(float(max_err))
    return (
        F.when(top.isNull() | (top <= thr), step)
        .when(e <= thr, 0.0)
        .otherwise(F.least(F.lit(1.0), (e - thr) / (top - thr)))
    )


def confidence(score: str | Column, threshold: float) -> Column:
    return F.least(F.lit(1.0), F.abs(col(score) - F.lit(threshold)) * 2)


def rule_predicates(df: DataFrame) -> DataFrame:
    """The two flow indicators a rule with a selection block activates."""
    return df.withColumns(
        {
            "syn_flood": (F.col("syn_flag_count") > 100) & (F.col("duration") < 1.0),
            "port_scan": (F.col("fwd_packets") > 1000) & (F.col("fwd_bytes") < 5000),
        }
    )


def severity_rank(c: str | Column, default: int | None = 3) -> Column:
    """0 for debug to 7 for emergency; case-insensitive; ``default`` for unknown names."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(col(c))) - 1
    known = F.when(rank >= 0, rank.cast("int"))
    return known if default is None else F.coalesce(known, F.lit(default))


def severity_from_type(c: str | Column, mapping: dict[str, str] = SEVERITY_OF_TYPE) -> Column:
    """First mapping key contained in the alert type decides; otherwise warning."""
    value = F.coalesce(col(c), F.lit("unknown"))
    out = F.when(F.lit(False), F.lit("warning"))
    for key, severity in mapping.items():
        out = out.when(F.contains(value, F.lit(key)), F.lit(severity))
    return out.otherwise("warning")


def risk_score(c: str | Column) -> Column:
    """Severity to risk 0..100; unknown 40, null stays null."""
    value = col(c)
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for severity, risk in RISK.items():
        out = out.when(value == severity, F.lit(risk))
    return out.otherwise(40)


def route(c: str | Column = "severity") -> Column:
    """Destination topic of a severity; unknown severities go to the warning topic."""
    value = col(c)
    return F.when(value.isin(*SEVERITIES), F.concat(F.lit("alerts."), value)).otherwise("alerts.warning")


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols])


def alert_score() -> Column:
    return first_truthy(
        F.col("anomaly_score"), F.col("reconstruction_error"), F.col("anomaly_probability")
    )
