"""Summaries, filters and orderings of findings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keyhound.fixed_values import OTHER_RULE_TYPE, RULE_TYPE_WORDS, SEVERITY_WEIGHTS

#: Findings sorted by one task, in bytes of their rows.
SORT_BYTES = 64 << 20


def scan_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files looked at (parsed or not) and findings."""
    seen = files.select(F.lit(1).alias("file"), F.lit(0).alias("finding"))
    found = findings.select(F.lit(0).alias("file"), F.lit(1).alias("finding"))
    return seen.unionByName(found).agg(
        F.coalesce(F.sum("file"), F.lit(0)).alias("files_scanned"),
        F.coalesce(F.sum("finding"), F.lit(0)).alias("findings"),
    )


def observe_findings(findings: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """Findings that count themselves while they are written, without a second pass."""
    observation = Observation(name)
    return findings.observe(observation, F.count(F.lit(1)).alias("findings")), observation


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row with the counts of the four reported severities."""
    return findings.agg(
        *[F.count_if(F.col("Severity") == s).alias(s.lower()) for s in SEVERITY_WEIGHTS]
    )


def count_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("Severity").agg(F.count(F.lit(1)).alias("findings"))


def critical_total(findings: DataFrame) -> DataFrame:
    """Critical findings, blockers included."""
    severity = F.upper("Severity")
    return findings.agg(
        F.count_if(severity.isin("CRITICAL", "BLOCKER")).alias("critical_total"),
        F.count_if(severity == "MAJOR").alias("major_total"),
    )


def rule_type(rule_id: Column) -> Column:
    """The first of a few words that the rule identifier contains."""
    lowered = F.lower(rule_id)
    chain = F.when(F.lit(False), F.lit(""))
    for word in RULE_TYPE_WORDS:
        chain = chain.when(F.contains(lowered, F.lit(word)), F.lit(word))
    return chain.otherwise(F.lit(OTHER_RULE_TYPE))


def rule_type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(rule_type(F.col("RuleID")).alias("rule_type")).agg(
        F.count(F.lit(1)).alias("findings")
    )


def filter_severity(findings: DataFrame, severity: str = "ALL") -> DataFrame:
    return findings if severity == "ALL" else findings.filter(F.upper("Severity") == severity)


def search_text(findings: DataFrame, text: str = "") -> DataFrame:
    """Case-insensitive search in path, rule identifier and content."""
    if not text:
        return findings
    wanted = F.lit(text.lower())
    hits = [F.contains(F.lower(c), wanted) for c in ("FilePath", "RuleID", "Content")]
    return findings.filter(reduce(or_, hits))


def severity_weight(severity: Column, blocker_rank: int = 0) -> Column:
    """4 for CRITICAL down to 1 for INFO; ``blocker_rank`` for BLOCKER, 0 for the rest."""
    upper, chain = F.upper(severity), F.when(F.lit(False), F.lit(0))
    for name, weight in {**SEVERITY_WEIGHTS, "BLOCKER": blocker_rank}.items():
        chain = chain.when(upper == name, F.lit(weight))
    return chain.otherwise(F.lit(0))


def sort_findings(
    findings: DataFrame,
    key: str = "Severity",
    descending: bool = True,
    blocker_rank: int = 0,
) -> DataFrame:
    """Findings by severity weight or by a column, then in scan order.

    The second part of the order also keeps the sort balanced: five severities alone
    would send all findings to five tasks.  Findings are measured first and dealt by ranges of
    about ``SORT_BYTES``: findings compress so well that partitions sized by what was shuffled hold many times as
    much in memory.
    """
    main = severity_weight(F.col("Severity"), blocker_rank) if key == "Severity" else F.col(key)
    ties = [c for c in ("FilePath", "LineNumber", "RuleID", "Content") if c != key]
    order = [main.desc() if descending else main.asc(), *(F.col(c).asc() for c in ties)]
    texts = [F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in findings.dtypes if kind == "string"]
    row = sum(texts, F.lit(16 * len(findings.columns))).cast("long")
    size = findings.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]
    return findings.repartitionByRange(1 + size // SORT_BYTES, *order).sortWithinPartitions(*order)


def short_path(path: Column) -> Column:
    """Paths over 40 characters as ``.../parent/name``, or cut when there is no parent."""
    parts = F.split(path, r"[/\\]")
    return (
        F.when(F.char_length(path) <= 40, path)
        .when(F.size(parts) <= 2, F.concat(F.left(path, F.lit(40)), F.lit("...")))
        .otherwise(
            F.concat(
                F.lit(".../"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)
            )
        )
    )


def masked(content: Column, shown: int = 4) -> Column:
    """Content with all but the first characters hidden, for reports that travel."""
    return F.concat(
        F.left(content, F.lit(shown)),
        F.repeat(F.lit("*"), F.greatest(F.char_length(content) - shown, F.lit(0))),
    )
