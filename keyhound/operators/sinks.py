"""Report files."""

from __future__ import annotations

import logging
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.fixed_values import CSV_COLUMNS, EXCEL_HEADER, HTML_TABLE_HEADER
from keyhound.operators.report import masked, observe_findings
from keyhound.schemas import FINDING_COLUMNS
from keyhound.sources.filesystem import open_root

log = logging.getLogger(__name__)

BYTE_ORDER_MARK = "\ufeff"


def _prepared(findings: DataFrame, mask: bool) -> DataFrame:
    return findings.withColumn("Content", masked(F.col("Content"))) if mask else findings


def write_json(findings: DataFrame, path: str) -> None:
    """JSON lines, one file per partition."""
    findings.select(*FINDING_COLUMNS).write.mode("overwrite").json(path)


def write_json_array(findings: DataFrame, path: str) -> None:
    """One JSON array of any length, in one folder of text files that concatenate by name.

    Each task writes its rows with commas between them; a bracket comes before and after
    all parts, and a part with rows is parted from the next one by a comma in a small file.
    """
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition
    row = F.to_json(F.struct(*FINDING_COLUMNS))
    findings.select(F.concat(F.when(first, "").otherwise(","), row).alias("value")).write.mode("overwrite").text(path)
    filesystem, inner = open_root(path)
    files = filesystem.get_file_info(fs.FileSelector(inner))
    parts = sorted({"-".join(f.base_name.split("-")[:2]) for f in files if f.size and f.base_name.startswith("part-")})
    for part in parts[:-1]:
        _write_first(path, ",\n", f"{part}~comma.txt")
    _write_first(path, "[\n", "part-!head.txt")
    _write_first(path, "]\n", "part-~tail.txt")


def read_json_array(spark, path: str) -> DataFrame:
    """Findings back from ``write_json_array``."""
    schema = ", ".join(f"{c} {'INT' if c == 'LineNumber' else 'STRING'}" for c in FINDING_COLUMNS)
    row = F.ltrim(F.col("value"), F.lit(","))
    rows = spark.read.text(path).where(F.startswith(row, F.lit("{")))
    return rows.select(F.from_json(row, schema).alias("row")).select("row.*")


def write_csv(findings: DataFrame, path: str) -> None:
    """CSV with a header in every part; quotes are doubled, line breaks kept."""
    (
        findings.select(*CSV_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark, path: str) -> DataFrame:
    """Findings back from ``write_csv``."""
    schema = ", ".join(f"{c} {'INT' if c == 'LineNumber' else 'STRING'}" for c in CSV_COLUMNS)
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    return reader.option("quote", '"').option("escape", '"').csv(path)


def excel_rows(findings: DataFrame) -> DataFrame:
    """Five columns under a spreadsheet header; only the content is quoted, always."""
    values = [F.col(c).cast("string") for c in ("Severity", "RuleID", "FilePath", "LineNumber")]
    content = F.replace(F.coalesce("Content", F.lit("")), F.lit('"'), F.lit('""'))
    quoted = F.concat(F.lit('"'), content, F.lit('"'))
    return findings.select(F.concat_ws(",", *values, quoted).alias("value"))


def write_excel_csv(findings: DataFrame, path: str) -> None:
    """``excel_rows`` below a byte order mark and the header, in one folder of text files.

    The header is a file of its own, first by name, so the parts concatenate to one sheet.
    """
    excel_rows(findings).write.mode("overwrite").text(path)
    _write_first(path, BYTE_ORDER_MARK + ",".join(EXCEL_HEADER) + "\n")


def _write_first(path: str, text: str, name: str = "part-!header.txt") -> None:
    filesystem, inner = open_root(path)
    with filesystem.open_output_stream(f"{inner}/{name}") as stream:
        stream.write(text.encode("utf-8"))


def html_row(severity: Column, rule_id: Column, path: Column, line: Column, content: Column):
    """One table row; the badge class is the severity in lower case."""
    safe = F.replace(F.replace(content, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.format_string(
        '<tr><td><span class="badge %s">%s</span></td><td>%s</td>'
        '<td class="font-mono">%s:%d</td><td><code>%s</code></td></tr>',
        F.lower(severity),
        severity,
        rule_id,
        path,
        line,
        F.coalesce(safe, F.lit("")),
    )


def html_rows(findings: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("Severity", "RuleID", "FilePath", "LineNumber", "Content")]
    return findings.select(html_row(*columns).alias("value"))


def html_head(total: int) -> str:
    cells = "".join(f"<th>{title}</th>" for title in HTML_TABLE_HEADER)
    return (
        '<!DOCTYPE html><html lang="zh-CN"><head><meta charset="UTF-8">'
        "<title>Security Audit Report</title></head><body>"
        f'<h1>Security Audit Report</h1><p class="meta">{total}</p>'
        f"<table><thead><tr>{cells}</tr></thead><tbody>\n"
    )


HTML_TAIL = "</tbody></table></body></html>\n"


def write_html(findings: DataFrame, path: str) -> None:
    """Table rows as text parts between a head and a tail part; together one page.

    The total in the head is counted while the rows are written.
    """
    observed, observation = observe_findings(findings, "html")
    html_rows(observed).write.mode("overwrite").text(path)
    _write_first(path, html_head(observation.get["findings"]), "part-!head.txt")
    _write_first(path, HTML_TAIL, "part-~tail.txt")


WRITERS = {
    "json": write_json,
    "json_array": write_json_array,
    "csv": write_csv,
    "excel": write_excel_csv,
    "html": write_html,
}
SUFFIXES = {"json": ".json", "json_array": ".json", "csv": ".csv", "excel": ".csv", "html": ".html"}


def write_report(findings: DataFrame, path: str, fmt: str, mask: bool = False) -> str | None:
    """Write a report unless there is nothing to report.

    Returns the path written, with the suffix of the format added when it is missing;
    nothing for an empty result or an unknown format.  The findings are computed once: they are counted while
    they are written beside the target, which the finished report then replaces.  A failed or empty
    run leaves the target as it was.
    """
    if fmt not in WRITERS:
        log.warning("unknown report format %s, nothing written", fmt)
        return None
    target = path if path.endswith(SUFFIXES[fmt]) else path + SUFFIXES[fmt]
    staged = f"{target.rstrip('/')}.{uuid.uuid4().hex}.part"
    observed, counts = observe_findings(findings, f"report-{uuid.uuid4().hex}")
    filesystem, inner = open_root(staged)
    try:
        WRITERS[fmt](_prepared(observed, mask), staged)
        total = counts.get["findings"]
        if total:
            _replace(filesystem, inner, open_root(target)[1])
    finally:
        if filesystem.get_file_info(inner).type == fs.FileType.Directory:
            filesystem.delete_dir(inner)
    if not total:
        log.info("no findings, nothing written")
        return None
    return target


def _replace(filesystem: fs.FileSystem, staged: str, target: str) -> None:
    kind = filesystem.get_file_info(target).type
    if kind == fs.FileType.Directory:
        filesystem.delete_dir(target)
    elif kind == fs.FileType.File:
        filesystem.delete_file(target)
    filesystem.move(staged, target)
