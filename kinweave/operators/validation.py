"""Checks of result lists. Each check gives its offending rows; ``report`` sums them up with a few sorted examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

EXAMPLES = 5


@dataclass
class Finding:
    rule: str
    severity: str  # fatal, error, warning
    total: int
    examples: list[str]


def header_problem(spark: SparkSession, path: str, expected: tuple[str, str]) -> str | None:
    """Why the file can't be read as a list at all, or None: missing, empty, comma-separated, another header."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except Exception as e:  # the reader's own word for a missing path
        if "PATH_NOT_FOUND" in str(e):
            return "missing"
        raise
    if not first:
        return "empty"
    columns = [c.strip().lower() for c in first[0]["value"].split("\t")]
    if columns == list(expected):
        return None
    return "comma-separated" if len(columns) == 1 and "," in columns[0] else "wrong header"


def rows_without_tab(lines: DataFrame) -> DataFrame:
    return lines.filter((F.trim("value") != "") & ~F.contains("value", F.lit("\t")))


def duplicate_rows(lists: DataFrame) -> DataFrame:
    """source1_entity_id, n: ids with more than one row."""
    return lists.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _ids(list_col: str):
    return F.filter(F.transform(F.split(F.coalesce(list_col, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def repeated_ids(lists: DataFrame, list_col: str) -> DataFrame:
    """Rows whose list names an id twice."""
    ids = _ids(list_col)
    return lists.filter(F.size(ids) != F.size(F.array_distinct(ids))).select("source1_entity_id")


def bad_prefixes(lists: DataFrame, list_col: str) -> DataFrame:
    """source1_entity_id, bad_id: listed ids that are not of S2 or S3."""
    return lists.select("source1_entity_id", F.explode(_ids(list_col)).alias("bad_id")).filter(~F.col("bad_id").startswith("S2-") & ~F.col("bad_id").startswith("S3-"))


def unknown_ids(lists: DataFrame, list_col: str, known: DataFrame) -> DataFrame:
    """source1_entity_id, unknown_id: listed ids that no target has."""
    named = lists.select("source1_entity_id", F.explode(_ids(list_col)).alias("unknown_id"))
    return named.join(known.select(F.col("entity_id").alias("unknown_id")), "unknown_id", "left_anti").select("source1_entity_id", "unknown_id")


def missing_rows(lists: DataFrame, s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("source1_entity_id")).distinct().join(lists, "source1_entity_id", "left_anti")


def extra_rows(lists: DataFrame, s1: DataFrame) -> DataFrame:
    return lists.select("source1_entity_id").distinct().join(s1.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_anti")


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """source1_entity_id, n_outside: matches that were no candidates."""
    both = matches.join(candidates, "source1_entity_id", "left")
    outside = F.size(F.array_except(X.id_list(F.col("matched_entity_ids")), X.id_list(F.col("candidate_entity_ids"))))
    return both.select("source1_entity_id", outside.alias("n_outside")).filter(F.col("n_outside") > 0)


def finding(rule: str, severity: str, offenders: DataFrame, column: str) -> Finding:
    """The total and the first few offenders in order; only these come to the driver."""
    examples = [r[0] for r in offenders.select(F.col(column).cast("string")).orderBy(column).limit(EXAMPLES).collect()]
    return Finding(rule, severity, offenders.count(), examples)


def report(spark: SparkSession, lists: DataFrame, list_col: str, s1: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> list[Finding]:
    """All findings with any offender."""
    checks = [
        ("duplicate row", "error", duplicate_rows(lists), "source1_entity_id"),
        ("repeated id", "error", repeated_ids(lists, list_col), "source1_entity_id"),
        ("bad prefix", "error", bad_prefixes(lists, list_col), "bad_id"),
        ("missing row", "error", missing_rows(lists, s1), "source1_entity_id"),
        ("extra row", "error", extra_rows(lists, s1), "source1_entity_id"),
    ]
    if known is not None:
        checks.append(("unknown id", "error", unknown_ids(lists, list_col, known), "unknown_id"))
    if candidates is not None:
        checks.append(("match is no candidate", "warning", not_candidates(lists, candidates), "source1_entity_id"))
    found = [finding(*c) for c in checks]
    return [f for f in found if f.total]


def exit_code(findings: list[Finding]) -> int:
    """Warnings never fail."""
    return int(any(f.severity != "warning" for f in findings))
