"""Queries over whole scans, context, reports, report files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhound.fixed_values import (
    CONTEXT_MESSAGE_SINGLE,
    FALSE_POSITIVE_MARK,
    REVIEW_PROMPT,
    VERDICT_FALSE_POSITIVE,
    VERDICT_TRUE_POSITIVE,
)
from keyhound.operators import context, report, sinks
from keyhound.operators.line_extractors import LINE_EXTRACTORS, extract_lines
from keyhound.operators.match import findings, match
from keyhound.plans import catalog_extract as ce
from keyhound.plans.catalog import ORACLES, built_files, document_files, document_lines, query, table
from keyhound.plans.catalog_match import (
    PAIRS_SQL,
    built_pairs,
    findings_sql,
    matches_sql,
)
from keyhound.plans.catalog_sources import remove_files, write_files
from keyhound.plans.scan import Extractors, extract, parse_errors, scan, scan_corpus, scan_corpus_outputs
from keyhound.session import scratch_path, spread, written
from keyhound.sources.config import load_config
from keyhound.sources.rules import read_rules
from keyhound.sources.tables import files_from_table, to_lines
from keyhound.streaming import live
from keyhound.streaming.manifest import follow_corpus

#: Customers whose settings files are on the disk at a time, seven files and folders each: a disk holds so many and no more.
SETTINGS_PORTION = 1_000_000

# --- whole scans ------------------------------------------------------------


def everything(spark, sf) -> DataFrame:
    """Documents as Python sources, pages as HTML, chat turns and page addresses as text."""

    def files_of(df: DataFrame, path: str, text: str) -> DataFrame:
        return files_from_table(df, F.expr(path), F.expr(text))

    documents = files_of(
        table(spark, sf, "documents"), "'documents/' || CAST(doc_id AS STRING) || '.py'", "text"
    )
    # Two files of each page, from one read.
    both = "inline(array(struct('pages/' || CAST(page_id AS STRING) || '.html' AS path, html AS text), " \
        "struct('urls/' || CAST(page_id AS STRING) || '.txt' AS path, url AS text)))"
    pages = files_of(table(spark, sf, "pages").selectExpr(both), "path", "text")
    turns = files_of(
        table(spark, sf, "conversations"),
        "'chat/' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '.txt'",
        "text",
    )
    properties = files_of(
        table(spark, sf, "events"), "'events/' || CAST(event_id AS STRING) || '.json'", "props"
    )
    files = documents.unionByName(pages).unionByName(turns)
    return spread(files.unionByName(properties))


def _named(table_name: str, folder: str, key: str, ext: str) -> str:
    path = f"'{folder}/' || {key} || '{ext}'"
    return f"""SELECT {path} AS file_path, 'file' AS key, {key} || '{ext}' AS value,
                      'metadata' AS kv_path, CAST(0 AS INTEGER) AS line FROM {table_name}"""


_PYTHON_KV = f"""SELECT 'documents/' || file_path || '.py' AS file_path, key, value, kv_path, line
    FROM ({ce._first_match_sql(ce._ASSIGN, "assignment")}
          UNION ALL {ce._every_match_sql(ce._DICT, "dict")}
          UNION ALL {ce._every_match_sql(ce._KEYWORD, "keyword",
                                         f"NOT regexp_matches(text, {ce._ASSIGN})")}
          UNION ALL SELECT path, 'function', unnest(regexp_extract_all(text, {ce._CALL}, 1)) || '()',
                           'call', line
                    FROM ({document_lines()}) WHERE NOT regexp_matches(text, '^\\s*#'))
    """.replace(ce._CODE, "text")
_HTML_KV = r"""SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.html' AS file_path,
           'comment' AS key, value, 'html' AS kv_path, CAST(0 AS INTEGER) AS line
    FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '<!--((?:.|\n)*?)-->', 1))) AS value
          FROM pages) WHERE value <> ''"""
_URL_KV = """SELECT 'urls/' || CAST(page_id AS VARCHAR) || '.txt' AS file_path,
           split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS value,
           'plaintext.uri' AS kv_path, CAST(1 AS INTEGER) AS line
    FROM (SELECT page_id, unnest(string_split(
              split_part(split_part(url, '#', 1), '?', 2), '&')) AS p
          FROM pages WHERE contains(url, '?')) WHERE p <> ''"""
_JSON_KV = """SELECT 'events/' || CAST(event_id AS VARCHAR) || '.json' AS file_path, 'k' AS key,
           json_extract_string(props, '$.k') AS value, 'k' AS kv_path, CAST(1 AS INTEGER) AS line
    FROM events"""
_CHAT_ID = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
_EVERYTHING_KV = " UNION ALL ".join(
    f"SELECT * FROM ({part})"
    for part in (
        _PYTHON_KV, _HTML_KV, _URL_KV, _JSON_KV,
        _named("documents", "documents", "CAST(doc_id AS VARCHAR)", ".py"),
        _named("pages", "pages", "CAST(page_id AS VARCHAR)", ".html"),
        _named("pages", "urls", "CAST(page_id AS VARCHAR)", ".txt"),
        _named("conversations", "chat", _CHAT_ID, ".txt"),
        _named("events", "events", "CAST(event_id AS VARCHAR)", ".json"),
    )
)


@query(
    "scan_everything",
    f"""SELECT rule_id AS "RuleID", severity AS "Severity", count(*) AS findings
        FROM ({matches_sql(_EVERYTHING_KV)}) GROUP BY ALL""",
)
def scan_everything(spark, sf):
    """The flagship: one scan of all text tables, findings per rule and severity."""
    found = scan(everything(spark, sf))
    return found.groupBy("RuleID", "Severity").agg(F.count(F.lit(1)).alias("findings"))


@query("scan_everything_findings", findings_sql(_EVERYTHING_KV))
def scan_everything_findings(spark, sf):
    return scan(everything(spark, sf))


@query(
    "scan_everything_all_rules",
    f"""SELECT rule_id AS "RuleID", severity AS "Severity", count(*) AS findings
        FROM ({matches_sql(_EVERYTHING_KV, 'all')}) GROUP BY ALL""",
)
def scan_everything_all_rules(spark, sf):
    found = scan(everything(spark, sf), mode="all")
    return found.groupBy("RuleID", "Severity").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "extract_everything",
    f"SELECT kv_path, count(*) AS pairs FROM ({_EVERYTHING_KV}) GROUP BY kv_path",
)
def extract_everything(spark, sf):
    kv = extract(everything(spark, sf))
    return kv.groupBy("kv_path").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "scan_summary",
    f"""SELECT (SELECT count(*) FROM documents) + 2 * (SELECT count(*) FROM pages)
               + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM events)
                   AS files_scanned,
               (SELECT count(*) FROM ({matches_sql(_EVERYTHING_KV)})) AS findings""",
)
def scan_summary(spark, sf):
    files = everything(spark, sf)
    return report.scan_summary(files, scan(files))


@query(
    "scan_corpus_settings",
    findings_sql(
        """SELECT 'Dockerfile' AS file_path, 'SECRET' AS key, c_name || '-pass' AS value,
                  'env' AS kv_path, CAST(2 AS INTEGER) AS line FROM customer
           UNION ALL SELECT 'app.ini', 'password', c_name || '-' || c_mktsegment, 'config', 2
           FROM customer
           UNION ALL SELECT 'app.ini', 'file', 'app.ini', 'metadata', 0 FROM customer
           UNION ALL SELECT '.env', 'DB_PWD', md5(c_name) || '!', 'shell', 1 FROM customer
           UNION ALL SELECT '.env', 'file', '.env', 'metadata', 0 FROM customer
           UNION ALL SELECT 'web.config', 'file', 'web.config', 'metadata', 0 FROM customer
           UNION ALL SELECT 'web.config', 'key', md5(c_name), 'a.key', 2 FROM customer"""
    ),
)
def scan_corpus_settings(spark, sf):
    """A tree of settings files, hidden ones included, under a settings file of its own; large tables give several, one after another."""
    customers = table(spark, sf, "customer")
    folder = "CAST(c_custkey AS STRING)"
    lines = "' || chr(10) || '"
    parts = [
        ("/Dockerfile", f"'FROM alpine{lines}ENV SECRET=' || c_name || '-pass'"),
        ("/app.ini", f"'[default]{lines}password=' || c_name || '-' || c_mktsegment"),
        ("/.env", "'DB_PWD=' || md5(c_name) || '!'"),
        ("/web.config",
         f"'<?xml version=' || chr(34) || '1.0' || chr(34) || '?>{lines}<a><key>' "
         "|| md5(c_name) || '</key></a>'"),
        ("/skipped/run.sh", "'PASSWORD=' || md5(c_name)"),
    ]
    # All files of a customer, from one read.
    tree = ", ".join(f"struct({folder} || '{name}' AS path, {text} AS content)" for name, text in parts)
    portions = max(1, -(-customers.count() // SETTINGS_PORTION))
    found = None
    for portion in range(portions):
        # Files of one path are in one portion.
        own = customers if portions == 1 else customers.where(F.pmod(F.xxhash64("c_custkey"), F.lit(portions)) == portion)
        root = scratch_path(spark, "settings")
        write_files(built_files(spread(own).selectExpr(f"inline(array({tree}))"), "path", "content"), root)
        write_files(spark.createDataFrame([(".keyhoundrc", "exclude:\n  files: [skipped]")], "path STRING, content STRING"), root)
        config = load_config(root=root)
        hits = scan_corpus(spark, root, config=config)
        if portions > 1:
            hits = written(hits, "settings-findings")
            remove_files(spark, root)
        found = hits if found is None else found.unionByName(hits)
    return found.withColumn("FilePath", F.substring_index("FilePath", "/", -1))


@query(
    "scan_errors",
    f"""SELECT 'finding' AS output, file_path AS name, rule_id AS what FROM ({matches_sql(
        """SELECT CAST(c_custkey AS VARCHAR) || '.json' AS file_path, 'db_password' AS key, c_name || '#' AS value,
                  'db_password' AS kv_path, CAST(1 AS INTEGER) AS line
           FROM customer WHERE c_mktsegment <> 'BUILDING'
           UNION ALL SELECT CAST(c_custkey AS VARCHAR) || '.json', 'file', CAST(c_custkey AS VARCHAR) || '.json', 'metadata', 0
           FROM customer""")})
        UNION ALL
        SELECT 'error', CAST(c_custkey AS VARCHAR) || '.json', 'ParserError' FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL
        SELECT 'error', CAST(c_custkey AS VARCHAR) || '.xml', 'ValueError' FROM customer WHERE c_mktsegment = 'MACHINERY'
        """,
)
def scan_errors(spark, sf):
    """Findings and failures of a file tree, from one run over it."""
    customers = table(spark, sf, "customer")
    text = """CASE WHEN c_mktsegment = 'BUILDING' THEN '{broken: [' || c_name
                   ELSE '{' || chr(34) || 'db_password' || chr(34) || ': ' || chr(34) || c_name || '#' || chr(34) || '}' END"""
    root = scratch_path(spark, "errors")
    write_files(built_files(customers, "CAST(c_custkey AS STRING) || '.json'", text), root)
    broken = customers.where("c_mktsegment = 'MACHINERY'")
    write_files(built_files(broken, "CAST(c_custkey AS STRING) || '.xml'", "'<a><b>' || c_name"), root)
    hits, failures = scan_corpus_outputs(spark, root)
    name = F.substring_index(F.col("FilePath"), "/", -1).alias("name")
    return hits.select(F.lit("finding").alias("output"), name, F.col("RuleID").alias("what")).union(
        failures.select(F.lit("error"), F.substring_index("file_path", "/", -1), "message")
    )


_LINES_PER_NATION = """SELECT CAST(c_nationkey AS VARCHAR) || '.properties' AS file_path,
              'password_' || CAST(c_custkey AS VARCHAR) AS key, c_name || '!' AS value, 'properties' AS kv_path,
              CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS line FROM customer"""


@query(
    "scan_files_in_ranges",
    findings_sql(
        f"""{_LINES_PER_NATION}
            UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || '.properties', 'file',
                   CAST(c_nationkey AS VARCHAR) || '.properties', 'metadata', CAST(0 AS INTEGER) FROM customer"""
    ),
)
def scan_files_in_ranges(spark, sf):
    """Large files of a line format, read in ranges: line numbers are those of the whole file."""
    line = F.expr("'password_' || CAST(c_custkey AS STRING) || '=' || c_name || '!'")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"])
    files = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(lines, "\n").alias("content"))
    root = scratch_path(spark, "ranges")
    write_files(files.select(F.expr("CAST(c_nationkey AS STRING) || '.properties'").alias("path"), "content"), root)
    found = scan_corpus(spark, root, range_bytes=1_000)
    return found.withColumn("FilePath", F.substring_index("FilePath", "/", -1))


@query(
    "scan_parse_errors",
    """SELECT CAST(c_custkey AS VARCHAR) || '.json' AS file_path, 'json' AS format
       FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def scan_parse_errors(spark, sf):
    text = """CASE WHEN c_mktsegment = 'BUILDING' THEN '{broken: [' || c_name
                   ELSE '{' || chr(34) || c_name || chr(34) || ': 1}' END"""
    files = built_files(
        table(spark, sf, "customer"), "CAST(c_custkey AS STRING) || '.json'", text
    )
    return parse_errors(files).select("file_path", "format")


@query(
    "custom_extractor",
    f"""SELECT rule_id, count(*) AS n FROM ({matches_sql(
        '''SELECT CAST(c_custkey AS VARCHAR) || '.kv' AS file_path, 'db_password' AS key,
                  c_name AS value, 'kv' AS kv_path, CAST(1 AS INTEGER) AS line FROM customer''')})
        GROUP BY rule_id""",
)
def custom_extractor(spark, sf):
    """A registered extractor for files no built-in one takes."""

    def pipes(files: DataFrame) -> DataFrame:
        text = F.col("content").cast("string")
        return files.select(
            F.col("path").alias("file_path"),
            F.split_part(text, F.lit("|"), F.lit(1)).alias("key"),
            F.split_part(text, F.lit("|"), F.lit(2)).alias("value"),
            F.lit("kv").alias("kv_path"),
            F.lit(1).alias("line"),
        )

    files = built_files(
        table(spark, sf, "customer"), "CAST(c_custkey AS STRING) || '.kv'",
        "'db_password|' || c_name",
    )
    found = match(extract(files, Extractors().register("pipes", pipes, [".kv"])), read_rules())
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# --- context ----------------------------------------------------------------
# Findings are the assignments put into real documents; each asks for the lines around it.

_SPOTS = f"""SELECT path, line, regexp_extract(text, p, 2) AS content
    FROM ({document_lines(ce._CODE)}),
         (SELECT '([a-zA-Z_]\\w*)\\s*(?::=|=)\\s*[''"]([^''"]+)[''"]' AS p)
    WHERE regexp_matches(text, p)"""


def _spots(spark, sf) -> DataFrame:
    kv = extract_lines(ce._code_lines(spark, sf), LINE_EXTRACTORS["go"])
    return kv.select(
        F.lit("assignment").alias("RuleID"),
        F.lit("an assignment").alias("Description"),
        F.col("file_path").alias("FilePath"),
        F.col("line").alias("LineNumber"),
        F.col("value").alias("Content"),
        F.lit("INFO").alias("Severity"),
    )


def _context_sql(radius: int, level: int) -> str:
    return f"""
        SELECT s.path AS "FilePath", s.line AS "LineNumber", s.content AS "Content",
               string_agg(CAST(l.line AS VARCHAR) || ': ' ||
                   CASE WHEN l.line = s.line THEN '>>> ' || l.text || ' <<<' ELSE l.text END
                   || chr(10), '' ORDER BY l.line) AS context_block,
               CAST(count(*) AS INTEGER) AS context_lines,
               '（Lv{level}：视野打开，已注入前后共 ' || CAST(count(*) AS VARCHAR)
                   || ' 行代码作为研判支撑）' AS context_msg
        FROM ({_SPOTS}) s JOIN ({document_lines(ce._CODE)}) l
             ON s.path = l.path AND l.line BETWEEN s.line - {radius} AND s.line + {radius}
        GROUP BY s.path, s.line, s.content"""


def _with_context(spark, sf, level: int) -> DataFrame:
    framed = context.with_context(_spots(spark, sf), ce._code_lines(spark, sf), level)
    return framed.drop("RuleID", "Description", "Severity")


@query("context_5_lines", _context_sql(5, 2))
def context_5_lines(spark, sf):
    return _with_context(spark, sf, 2)


@query("context_20_lines", _context_sql(20, 3))
def context_20_lines(spark, sf):
    return _with_context(spark, sf, 3)


@query("context_50_lines", _context_sql(50, 4))
def context_50_lines(spark, sf):
    return _with_context(spark, sf, 4)


@query(
    "context_single_line",
    f"""SELECT path AS "FilePath", line AS "LineNumber", content AS "Content",
               content AS context_block, CAST(0 AS INTEGER) AS context_lines,
               '{CONTEXT_MESSAGE_SINGLE}' AS context_msg FROM ({_SPOTS})""",
)
def context_single_line(spark, sf):
    return _with_context(spark, sf, 1)


@query(
    "context_of_whole_files",
    """SELECT CAST(page_id AS VARCHAR) AS "FilePath", count(*) AS blocks,
              CAST(max(n) AS INTEGER) AS context_lines, bool_or(marked) AS marked
       FROM (SELECT page_id, least(5, length(html) - length(replace(html, chr(10), ''))
                    + CASE WHEN ends_with(html, chr(10)) THEN 0 ELSE 1 END) AS n,
                    false AS marked,
                    trim(unnest(regexp_extract_all(html, '<!--((?:.|\\n)*?)-->', 1))) AS value
             FROM pages) WHERE value <> '' GROUP BY page_id""",
)
def context_of_whole_files(spark, sf):
    """Findings on line 0 get the first lines and no marker."""
    files = document_files(spark, sf, F.col("html"), "pages", "page_id")
    found = files.select("path", F.inline(ce.html_items(F.col("content")))).select(
        F.lit("comments").alias("RuleID"), F.lit("").alias("Description"),
        F.col("path").alias("FilePath"), F.lit(0).alias("LineNumber"),
        F.col("value").alias("Content"), F.lit("MINOR").alias("Severity"),
    )
    framed = context.with_context(found, to_lines(files), 2)
    return framed.groupBy("FilePath").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.max("context_lines").alias("context_lines"),
        F.bool_or(F.col("context_block").contains(": >>> ")).alias("marked"),
    )


@query(
    "parse_context_lines",
    f"""SELECT s.path AS "FilePath", s.line AS "LineNumber", l.line, l.text,
               l.line = s.line AS is_target
        FROM (SELECT DISTINCT path, line FROM ({_SPOTS})) s
        JOIN (SELECT path, line, text FROM ({document_lines(ce._CODE)})) l
             ON s.path = l.path AND l.line BETWEEN s.line - 5 AND s.line + 5""",
)
def parse_context_lines(spark, sf):
    """Blocks back to rows; the target's own text loses its marks here."""
    lines = ce._code_lines(spark, sf)
    blocks = context.context_blocks(
        _spots(spark, sf).select("FilePath", "LineNumber").distinct(), lines, 5
    )
    parsed = context.parse_context(blocks.drop("context_lines"))
    unmarked = F.regexp_extract("text", r"(?s)\A>>> (.*) <<<\z", 1)
    return parsed.withColumn("text", F.when(F.col("is_target"), unmarked).otherwise(F.col("text")))


def _prompt_sql() -> str:
    pieces = REVIEW_PROMPT.replace("%d", "%s").split("%s")
    values = ["path", "'assignment'", "CAST(line AS VARCHAR)", f"'{CONTEXT_MESSAGE_SINGLE}'",
              "content"]
    joined = f"'{pieces[0]}'"
    for value, piece in zip(values, pieces[1:]):
        joined += f" || {value} || '{piece}'"
    return joined


@query(
    "review_prompts",
    f"""SELECT path AS "FilePath", line AS "LineNumber", {_prompt_sql()} AS prompt
        FROM ({_SPOTS})""",
)
def review_prompts(spark, sf):
    framed = context.with_context(_spots(spark, sf), ce._code_lines(spark, sf), 1)
    return context.with_prompt(framed).select("FilePath", "LineNumber", "prompt")


@query(
    "verdicts",
    f"""SELECT conv_id, turn, CASE WHEN contains(text, 'la') THEN '{VERDICT_FALSE_POSITIVE}'
               ELSE '{VERDICT_TRUE_POSITIVE}' END AS verdict FROM conversations""",
)
def verdicts(spark, sf):
    """Replies that state a false positive; the mark is put in place of a word."""
    turns = table(spark, sf, "conversations")
    reply = F.replace("text", F.lit("la"), F.lit(FALSE_POSITIVE_MARK))
    return turns.select("conv_id", "turn", context.verdict(reply).alias("verdict"))


# --- reports ----------------------------------------------------------------

_FINDINGS = findings_sql(PAIRS_SQL)


def _found(spark, sf) -> DataFrame:
    return findings(match(built_pairs(spark, sf), read_rules()))


@query(
    "severity_counts",
    f"""SELECT count(*) FILTER ("Severity" = 'CRITICAL') AS critical,
               count(*) FILTER ("Severity" = 'MAJOR') AS major,
               count(*) FILTER ("Severity" = 'MINOR') AS minor,
               count(*) FILTER ("Severity" = 'INFO') AS info FROM ({_FINDINGS})""",
)
def severity_counts(spark, sf):
    return report.severity_counts(_found(spark, sf))


@query(
    "findings_per_severity",
    f"""SELECT "Severity", count(*) AS findings FROM ({_FINDINGS}) GROUP BY "Severity" """,
)
def findings_per_severity(spark, sf):
    return report.count_by_severity(_found(spark, sf))


@query(
    "critical_total",
    f"""SELECT count(*) FILTER ("Severity" IN ('CRITICAL', 'BLOCKER')) AS critical_total,
               count(*) FILTER ("Severity" = 'MAJOR') AS major_total FROM ({_FINDINGS})""",
)
def critical_total(spark, sf):
    return report.critical_total(_found(spark, sf))


@query(
    "findings_per_rule_type",
    f"""SELECT CASE WHEN contains(r, 'password') THEN 'password'
                    WHEN contains(r, 'secret') THEN 'secret' WHEN contains(r, 'uri') THEN 'uri'
                    WHEN contains(r, 'file') THEN 'file' WHEN contains(r, 'key') THEN 'key'
                    ELSE 'other' END AS rule_type, count(*) AS findings
        FROM (SELECT lower("RuleID") AS r FROM ({_FINDINGS})) GROUP BY rule_type""",
)
def findings_per_rule_type(spark, sf):
    return report.rule_type_counts(_found(spark, sf))


@query(
    "filtered_findings",
    f"""SELECT * FROM ({_FINDINGS}) WHERE "Severity" = 'CRITICAL'
        AND (contains(lower("FilePath"), 'pass') OR contains(lower("RuleID"), 'pass')
             OR contains(lower("Content"), 'pass'))""",
)
def filtered_findings(spark, sf):
    return report.search_text(report.filter_severity(_found(spark, sf), "CRITICAL"), "PASS")


@query(
    "sorted_findings",
    f"""SELECT *, CASE "Severity" WHEN 'CRITICAL' THEN 4 WHEN 'MAJOR' THEN 3 WHEN 'MINOR' THEN 2
                       WHEN 'INFO' THEN 1 ELSE 0 END AS weight FROM ({_FINDINGS})""",
)
def sorted_findings(spark, sf):
    found = written(_found(spark, sf), "found")
    weight = report.severity_weight(F.col("Severity"))
    return report.sort_findings(found.withColumn("weight", weight))


@query(
    "sorted_findings_blockers_first",
    f"""SELECT *, CASE "Severity" WHEN 'CRITICAL' THEN 4 WHEN 'BLOCKER' THEN 4 WHEN 'MAJOR' THEN 3
                       WHEN 'MINOR' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END AS weight
        FROM ({_FINDINGS})""",
)
def sorted_findings_blockers_first(spark, sf):
    found = written(_found(spark, sf), "found")
    weight = report.severity_weight(F.col("Severity"), blocker_rank=4)
    return report.sort_findings(found.withColumn("weight", weight), blocker_rank=4)


@query(
    "short_paths",
    r"""SELECT url, CASE WHEN length(path) <= 40 THEN path
                         WHEN len(parts) <= 2 THEN left(path, 40) || '...'
                         ELSE '.../' || parts[len(parts) - 1] || '/' || parts[len(parts)] END
                    AS short_path
        FROM (SELECT url, path, string_split_regex(path, '[/\\]') AS parts
              FROM (SELECT url, unnest([url, replace(url, '/', '\'), replace(url, '/', '.'),
                                        url || '/' || url]) AS path FROM pages))""",
)
def short_paths(spark, sf):
    forms = F.array(
        F.col("url"),
        F.replace("url", F.lit("/"), F.lit("\\")),
        F.replace("url", F.lit("/"), F.lit(".")),
        F.concat("url", F.lit("/"), "url"),
    )
    pages = table(spark, sf, "pages").select("url", F.explode(forms).alias("path"))
    return pages.select("url", report.short_path(F.col("path")).alias("short_path"))


# --- report files -----------------------------------------------------------


@query("report_json", _FINDINGS)
def report_json(spark, sf):
    """Written as JSON lines and read back."""
    path = sinks.write_report(_found(spark, sf), scratch_path(spark, "report"), "json")
    schema = "RuleID STRING, Description STRING, FilePath STRING, LineNumber INT, " \
        "Content STRING, Severity STRING"
    return spark.read.schema(schema).json(path)


@query("report_json_array", _FINDINGS)
def report_json_array(spark, sf):
    """Written as one JSON array and read back."""
    path = sinks.write_report(_found(spark, sf), scratch_path(spark, "report"), "json_array")
    return sinks.read_json_array(spark, path)


@query("report_csv", _FINDINGS)
def report_csv(spark, sf):
    """Written as CSV and read back: quotes, blanks and line breaks survive."""
    path = sinks.write_report(_found(spark, sf), scratch_path(spark, "report"), "csv")
    return sinks.read_csv(spark, path)


@query(
    "report_excel_rows",
    f"""SELECT "Severity" || ',' || "RuleID" || ',' || "FilePath" || ','
               || CAST("LineNumber" AS VARCHAR) || ',"' || replace("Content", '"', '""') || '"'
               AS value FROM ({_FINDINGS})""",
)
def report_excel_rows(spark, sf):
    return sinks.excel_rows(_found(spark, sf))


@query(
    "report_html_rows",
    f"""SELECT '<tr><td><span class="badge ' || lower("Severity") || '">' || "Severity"
               || '</span></td><td>' || "RuleID" || '</td><td class="font-mono">' || "FilePath"
               || ':' || CAST("LineNumber" AS VARCHAR) || '</td><td><code>'
               || replace(replace("Content", '<', '&lt;'), '>', '&gt;') || '</code></td></tr>'
               AS value FROM ({_FINDINGS})""",
)
def report_html_rows(spark, sf):
    return sinks.html_rows(_found(spark, sf))


_HTML_HEAD = (
    '<!DOCTYPE html><html lang="zh-CN"><head><meta charset="UTF-8">'
    "<title>Security Audit Report</title></head><body>"
    '<h1>Security Audit Report</h1><p class="meta">'
)
_HTML_TABLE = "</p><table><thead><tr><th>风险等级</th><th>规则标识</th><th>文件位置</th><th>内容快照</th></tr></thead><tbody>"


@query(
    "report_html_file",
    f"""SELECT value, count(*) AS n FROM (
            SELECT '{_HTML_HEAD}' || CAST(count(*) AS VARCHAR) || '{_HTML_TABLE}' AS value FROM ({_FINDINGS})
            UNION ALL SELECT '</tbody></table></body></html>'
            UNION ALL SELECT unnest(string_split(value, chr(10))) FROM ({ORACLES["report_html_rows"]}))
        GROUP BY value""",
)
def report_html_file(spark, sf):
    """Every line of the written page: the head with the total, the rows, the tail."""
    path = sinks.write_report(_found(spark, sf), scratch_path(spark, "report"), "html")
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_excel_file",
    f"""SELECT value, count(*) AS n FROM (
            SELECT '风险等级,命中规则,文件路径,行号,内容快照' AS value
            UNION ALL SELECT unnest(string_split(value, chr(10))) FROM ({ORACLES["report_excel_rows"]}))
        GROUP BY value""",
)
def report_excel_file(spark, sf):
    """Every line of the written sheet, header and rows; reading drops the byte order mark."""
    path = sinks.write_report(_found(spark, sf), scratch_path(spark, "report"), "excel")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_guard",
    f"""SELECT fmt, kept, CASE WHEN kept = 'none' THEN 0 ELSE (SELECT count(*) FROM ({_FINDINGS}) WHERE "Severity" = 'CRITICAL') END AS findings
        FROM (SELECT unnest(['json', 'csv']) AS fmt), (SELECT unnest(['none', 'critical']) AS kept)
        UNION ALL SELECT 'pdf', 'critical', 0""",
)
def report_guard(spark, sf):
    """Reports of nothing and of unknown formats are not written; a report of nothing leaves an earlier one alone."""
    found = _found(spark, sf).filter("Severity = 'CRITICAL'")
    rows = []
    for fmt in ("json", "csv", "pdf"):
        target = scratch_path(spark, "guard")
        path = sinks.write_report(found, target, fmt)
        if fmt != "pdf":
            empty = sinks.write_report(found.filter("false"), target, fmt)
            rows.append((fmt, "none", 0 if empty is None else -1))
        reader = {"json": spark.read.schema("RuleID STRING").json, "csv": lambda x: sinks.read_csv(spark, x)}.get(fmt)
        rows.append((fmt, "critical", reader(path).count() if path else 0))
    return spark.createDataFrame(rows, "fmt STRING, kept STRING, findings BIGINT")


# --- streams ----------------------------------------------------------------


def _stream_of_pages(spark, sf) -> DataFrame:
    pages = live.stream_table(spark, sf, "pages")
    return files_from_table(
        pages, F.expr("'pages/' || CAST(page_id AS STRING) || '.html'"), F.col("html")
    )


_PAGE_KV = f"{_HTML_KV} UNION ALL {_named('pages', 'pages', 'CAST(page_id AS VARCHAR)', '.html')}"


@query("stream_findings", findings_sql(_PAGE_KV))
def stream_findings(spark, sf):
    """A live scan of all pages: what the stream wrote equals the batch scan."""
    found = live.live_scan(_stream_of_pages(spark, sf))
    return spark.read.schema(found.schema).parquet(live.run_to_table(found, "stream-findings"))


@query(
    "stream_corpus_arrivals",
    """SELECT page_id % 2 || '/.page_' || CAST(page_id AS VARCHAR) || '.html' AS name,
              CAST(strlen(html) AS BIGINT) AS length, md5(html) AS digest
       FROM pages""",
)
def stream_corpus_arrivals(spark, sf):
    """A file tree streamed, grown and streamed on: every file comes once."""
    pages = table(spark, sf, "pages")
    root, target, progress = (scratch_path(spark, f"arrivals{x}") for x in ("", "-seen", "-progress"))
    path = "CAST(page_id % 2 AS STRING) || '/.page_' || CAST(page_id AS STRING) || '.html'"
    for part in (0, 1):
        write_files(built_files(pages.where(F.col("page_id") % 2 == part), path, "html"), root)
        files = live.stream_corpus(spark, root, settle_ms=0).select(
            F.substring_index("path", "/", -2).alias("name"), "length", F.md5("content").alias("digest")
        )
        live.run_to_table(files, "arrivals", target, progress)
    return spark.read.parquet(target)


@query(
    "followed_tree_arrivals",
    """SELECT CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS run, '.page_' || CAST(page_id AS VARCHAR) || '.html' AS name
       FROM pages
       UNION ALL SELECT 2, 'changed_' || CAST(page_id AS VARCHAR) || '.html' FROM pages WHERE page_id % 3 = 1""",
)
def followed_tree_arrivals(spark, sf):
    """Two runs over a growing tree with a manifest: files come once, renamed ones under their new name."""
    pages = table(spark, sf, "pages")
    root, folder = scratch_path(spark, "tree"), scratch_path(spark, "manifest")
    name = "'.page_' || CAST(page_id AS STRING) || '.html'"
    write_files(built_files(pages.where("page_id % 3 <> 0"), name, "html"), root)
    first = follow_corpus(spark, root, folder, lambda new: None, settle_ms=0)
    write_files(built_files(pages.where("page_id % 3 = 0"), name, "html"), root)
    changed = "'changed_' || CAST(page_id AS STRING) || '.html'"
    write_files(built_files(pages.where("page_id % 3 = 1"), changed, "html"), root)
    second = follow_corpus(spark, root, folder, lambda new: None, settle_ms=0)
    base = F.substring_index("path", "/", -1).alias("name")
    return first.select(F.lit(1).alias("run"), base).union(second.select(F.lit(2), base))


@query(
    "stream_running_counts",
    f"""SELECT "Severity", count(*) AS findings FROM ({findings_sql(_PAGE_KV)})
        GROUP BY "Severity" """,
)
def stream_running_counts(spark, sf):
    counts = live.running_counts(live.live_scan(_stream_of_pages(spark, sf)))
    return spark.read.schema(counts.schema).parquet(live.run_counts(counts, "stream-counts"))


@query(
    "stream_progress_events",
    """SELECT 'progress' AS type, 'pages/' || CAST(page_id AS VARCHAR) || '.html' AS data
       FROM pages""",
)
def stream_progress_events(spark, sf):
    events = live.progress_events(_stream_of_pages(spark, sf))
    return spark.read.schema(events.schema).parquet(live.run_to_table(events, "stream-progress"))


@query(
    "stream_found_events",
    f"""SELECT 'found' AS type, count(*) AS events FROM ({findings_sql(_PAGE_KV)})""",
)
def stream_found_events(spark, sf):
    events = live.found_events(live.live_scan(_stream_of_pages(spark, sf)))
    seen = spark.read.schema(events.schema).parquet(live.run_to_table(events, "stream-found"))
    return seen.groupBy("type").agg(F.count(F.lit(1)).alias("events"))


@query("stream_reloaded_rules", findings_sql(_PAGE_KV))
def stream_reloaded_rules(spark, sf):
    """Each batch is scanned with the rules read at that moment."""
    from keyhound.sources.rules import BUILTIN_RULES

    target = scratch_path(spark, "stream-reload")

    def append(found: DataFrame, _batch_id: int) -> None:
        found.write.mode("append").parquet(target)

    live.scan_batches(_stream_of_pages(spark, sf), BUILTIN_RULES, append).awaitTermination()
    return spark.read.parquet(target)


@query(
    "stream_document_scan",
    f"""SELECT rule_id AS "RuleID", count(*) AS findings FROM ({matches_sql(
        _PYTHON_KV + " UNION ALL " +
        _named("documents", "documents", "CAST(doc_id AS VARCHAR)", ".py"))}) GROUP BY rule_id""",
)
def stream_document_scan(spark, sf):
    """A live scan of all documents as Python sources."""
    documents = live.stream_table(spark, sf, "documents")
    files = files_from_table(
        documents, F.expr("'documents/' || CAST(doc_id AS STRING) || '.py'"), F.col("text")
    )
    hits = live.live_scan(files)
    found = spark.read.schema(hits.schema).parquet(live.run_to_table(hits, "stream-documents"))
    return found.groupBy("RuleID").agg(F.count(F.lit(1)).alias("findings"))
