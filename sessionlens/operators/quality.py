"""Data-quality rules over the feature table, all counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A column must be non-null, or lie within [low, high] where it is not null."""

    column: str
    low: float | None = None
    high: float | None = None

    @property
    def name(self) -> str:
        return f"{self.column} {'not null' if self.low is None else 'between'}"

    def broken(self) -> Column:
        value = F.col(self.column)
        if self.low is None:
            return value.isNull()
        return ~value.between(self.low, self.high)


# The feature table's expected ranges.
RULES = {
    "dq_session_id": Rule("session_id"),
    "dq_epm": Rule("events_per_minute", 0, 10000),
    "dq_pages": Rule("unique_pages_visited", 0, 500),
    "dq_gap": Rule("avg_time_between_events", 0, 3600),
    "dq_cart": Rule("cart_to_purchase_ratio", 0, 1.001),
    "dq_duration": Rule("session_duration_seconds", 0, 86400),
    "dq_diversity": Rule("event_type_diversity", 1, 8),
    "dq_payment": Rule("has_payment", 0, 1),
    "dq_signup": Rule("signup_to_purchase_speed", 0, 86400),
    "dq_revisit": Rule("page_revisit_ratio", 0, 1),
}


def check_rules(features: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: rows checked, unexpected values, passed.

    Range rules skip nulls, so their checked rows are the non-null ones.
    """
    counts = []
    for i, rule in enumerate(rules):
        checked = F.lit(1) if rule.low is None else F.col(rule.column)
        counts += [
            F.count(checked).alias(f"_n{i}"),
            F.count_if(rule.broken()).alias(f"_bad{i}"),
        ]
    one_row = features.agg(*counts)
    verdicts = F.array(
        *[
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.col(f"_n{i}").alias("rows_checked"),
                F.col(f"_bad{i}").alias("unexpected"),
                (F.col(f"_bad{i}") == 0).alias("passed"),
            )
            for i, rule in enumerate(rules)
        ]
    )
    return one_row.select(F.inline(verdicts))


def scorecard(features: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every rule plus an ``overall`` row that passes when all rules do."""
    checked = check_rules(features, rules or list(RULES.values()))
    overall = checked.agg(
        F.lit("overall").alias("rule"),
        F.max("rows_checked").alias("rows_checked"),
        F.sum("unexpected").alias("unexpected"),
        F.bool_and("passed").alias("passed"),
    )
    return checked.unionByName(overall)
