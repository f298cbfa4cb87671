"""Fault rules against stored traces.

Rules come from command arguments, so there are only a few. They become one
literal array that every row filters in place: no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.params import FaultRule
from wirebook.schema import FAULT_BODY, FAULT_HEADER

RULE_DDL = (
    "struct<rule_no:int,kind:string,min_ms:bigint,max_ms:bigint,"
    "status_code:int,probability:double,url_pattern:string>"
)


def rule_array(rules: list[FaultRule]) -> Column:
    rows = [
        F.struct(*[F.lit(value).alias(name) for name, value in asdict(rule).items()]).cast(RULE_DDL)
        for rule in rules
    ]
    return F.array(*rows).cast(f"array<{RULE_DDL}>")


def matching_rules(url: Column, rules: list[FaultRule]) -> Column:
    """Rules whose pattern is part of the URL (case counts), in order."""
    return F.filter(
        rule_array(rules),
        lambda rule: rule["url_pattern"].isNull() | F.contains(url, rule["url_pattern"]),
    )


def rule_matches(traces: DataFrame, rules: list[FaultRule]) -> DataFrame:
    """One row per trace and matching rule."""
    return traces.select("span_id", "url", F.inline(matching_rules(F.col("url"), rules)))


def rule_coverage(traces: DataFrame, rules: list[FaultRule]) -> DataFrame:
    """What the rules would do to each trace, as bounds instead of a random draw.

    Rules count up to and including the first certain error. Their delays add
    up to ``delay_min_ms`` .. ``delay_max_ms``; ``error_status`` is the status
    of the first error that may fire, ``error_probability`` the chance that
    any fires.
    """
    c = F.col
    certain = F.filter("matched", lambda r: (r["kind"] == "error") & (r["probability"] >= 1.0))
    last = F.get(certain, F.lit(0))["rule_no"]

    def total(name: str) -> Column:
        return F.aggregate("delays", F.lit(0).cast("bigint"), lambda sum_, r: sum_ + r[name])

    matched = traces.select("span_id", "url", matching_rules(c("url"), rules).alias("matched"))
    in_reach = matched.withColumn(
        "matched", F.filter("matched", lambda r: r["rule_no"] <= F.coalesce(last, F.lit(2**31 - 1)))
    ).withColumns({
        "delays": F.filter("matched", lambda r: r["kind"] == "delay"),
        "errors": F.filter("matched", lambda r: (r["kind"] == "error") & (r["probability"] > 0)),
    })
    return in_reach.select(
        "span_id", "url",
        total("min_ms").alias("delay_min_ms"),
        total("max_ms").alias("delay_max_ms"),
        F.get("errors", F.lit(0))["status_code"].alias("error_status"),
        (1.0 - F.aggregate("errors", F.lit(1.0), lambda left, r: left * (1.0 - r["probability"])))
        .alias("error_probability"),
    )


def injected_faults(traces: DataFrame) -> DataFrame:
    """Traces whose response was made up by a fault rule."""
    headers = F.col("response_headers")
    return traces.where(
        headers[FAULT_HEADER].isNotNull()
        & (headers["content-type"] == "application/json")
        & (F.col("response_body") == F.lit(FAULT_BODY.encode()))
    )
