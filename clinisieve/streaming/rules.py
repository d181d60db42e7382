"""Row rules and link checks over a stream of domain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinisieve.operators.cross import link_rule
from clinisieve.operators.domains import DOMAINS
from clinisieve.operators.rules import evaluate
from clinisieve.operators.subjects import SUBJECT, distinct_subjects, subject


def stream_row_rules(stream: DataFrame, code: str) -> DataFrame:
    """Findings of the row rules that look at one row only (all but the uniqueness of subjects)."""
    missing = [c for c in DOMAINS[code].required if c not in stream.columns]
    if missing:
        raise ValueError(f"Missing required columns for {code}: {missing}")
    return evaluate(stream, DOMAINS[code].rules(), domain=code)


def stream_dm_link(stream: DataFrame, dm: DataFrame, code: str) -> DataFrame:
    """Orphans among arriving rows, against a demographics table that stands still."""
    known = distinct_subjects(dm).withColumn("in_dm", F.lit(True))
    joined = stream.select("*", subject()).join(known, SUBJECT, "left")
    return evaluate(joined, [link_rule(code)], domain="CROSS")
