"""Queries over extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyhound.operators import line_extractors as le
from keyhound.operators.document_extractors import (
    dockercfg_items,
    extract_documents,
    extract_shell,
    html_items,
    shell_lines,
)
from keyhound.operators.line_extractors import LINE_EXTRACTORS, extract_lines
from keyhound.plans.catalog import (
    built_files,
    document_files,
    document_lines,
    kv_rows,
    query,
    table,
    text_lines,
)
from keyhound.sources.tables import to_lines

_CUSTOMER = "CAST(c_custkey AS STRING)"
_ORDER = "CAST(o_orderkey AS STRING)"


def _customers(spark, sf, *lines: str):
    return built_files(table(spark, sf, "customer"), _CUSTOMER, text_lines(*lines))


def _orders(spark, sf, *lines: str):
    return built_files(table(spark, sf, "orders"), _ORDER, text_lines(*lines))


# --- settings files ---------------------------------------------------------


@query(
    "extract_config",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'password'", "c_name", "config", 2),
        ("c_mktsegment", "'a=' || c_name", "config", 4),
        ("''", "c_name", "config", 7),
    ),
)
def extract_config(spark, sf):
    files = _customers(
        spark, sf,
        "'# user=' || c_name", "'  password = ' || c_name || '  '", "'; x=1'",
        "c_mktsegment || '=a=' || c_name", "'empty='", "'[section]'", "'=' || c_name",
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["conf"])


@query(
    "extract_properties",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'db_' || lower(c_mktsegment) || '_pass'", "c_name", "properties", 2),
        ("'a_b'", "c_name || ':x'", "properties", 3),
        ("'empty'", "''", "properties", 5),
    ),
)
def extract_properties(spark, sf):
    files = _customers(
        spark, sf,
        "'! note=' || c_name", "'db.' || lower(c_mktsegment) || '.pass = ' || c_name",
        "'a.b : ' || c_name || ':x'", "'# c=d'", "'empty='", "'no mark here'",
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["properties"])


@query(
    "extract_pip_settings",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'user'", "c_name", "pip", 2),
        ("'empty'", "''", "pip", 3),
    ),
)
def extract_pip_settings(spark, sf):
    files = _customers(spark, sf, "'[global]'", "'user = ' || c_name", "'empty='", "';a=b'")
    return extract_lines(to_lines(files), le.pip_setting_items)


@query(
    "extract_pip_passwords",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'pip password'", "c_name", "pip", 1),
        ("'pip password'", "'p+' || lower(c_mktsegment) || '/x'", "pip", 2),
        ("'pip password'", "''", "pip", 4),
    ),
)
def extract_pip_passwords(spark, sf):
    files = _customers(
        spark, sf,
        "'url = https://user:' || replace(c_name, '#', '%23') || '@host/simple'",
        "'url = https://user:p+' || lower(c_mktsegment) || '%2Fx@host:8080/simple'",
        "'url = https://' || lower(c_mktsegment) || '@host/simple'",
        "'url = https://user:@host/simple'",
        "'url = https://user:pass@host:port/simple'",
        "'url = https://user:%zz@host/simple'",
    )
    return extract_lines(to_lines(files), le.pip_url_items)


@query(
    "extract_htpasswd",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'htpasswd Hash'", "md5(c_name)", "htpasswd", 1),
        ("'htpasswd Hash'", "c_name", "htpasswd", 3),
    ),
)
def extract_htpasswd(spark, sf):
    files = _customers(
        spark, sf, "c_name || ':' || md5(c_name)", "c_mktsegment", "'u: ' || c_name || ' :rest'"
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["htpasswd"])


@query(
    "extract_npmrc",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'npm authToken'", "md5(c_name)", "npmrc", 1),
        ("'npm authToken'", "c_name", "npmrc", 3),
    ),
)
def extract_npmrc(spark, sf):
    files = _customers(
        spark, sf,
        "'//registry.example.com/:_authToken=' || md5(c_name)",
        "'registry=https://registry.example.com'",
        "'a:_authToken=b:_authToken= ' || c_name || '  '",
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["npmrc"])


@query(
    "extract_pypirc",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'PyPI password'", "md5(c_name)", "pypirc", 3),
        ("'PyPI password'", "''", "pypirc", 4),
    ),
)
def extract_pypirc(spark, sf):
    files = _customers(
        spark, sf, "'[pypi]'", "'username: ' || c_name", "'password: ' || md5(c_name)",
        "'password:'", "'password = ' || c_name",
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["pypirc"])


@query(
    "extract_dockerfile",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'SECRET'", "c_name", "env", 2),
        ("'USER_NAME'", "c_name", "env", 3),
        ("'TOKEN'", "md5(c_name)", "arg", 4),
        ("'X'", "'= ' || c_mktsegment", "arg", 6),
    ),
)
def extract_dockerfile(spark, sf):
    files = _customers(
        spark, sf,
        "'FROM alpine'", "'ENV SECRET=' || c_name",
        "'  env  USER_NAME  ' || chr(34) || c_name || chr(34)",
        "'ARG TOKEN=' || chr(39) || md5(c_name) || chr(39)",
        "'# ENV A=' || c_name", "'ARG X = ' || c_mktsegment", "'ENV 1A=' || c_name",
        "'RUN ENV Z=1'",
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["dockerfile"])


# --- source code ------------------------------------------------------------
# Real text with assignments put in: every comma becomes one, so that identifiers,
# accents, blanks and digits of the documents decide what is captured.

_CODE = """replace(replace(replace(text, ', ', ' = "v1" '), '. ', ': "w=2" '), ' | ', '="')"""


def _first_match_sql(pattern: str, kv_path: str, key: int = 1, value: int = 2) -> str:
    return f"""
        SELECT path AS file_path, regexp_extract(text, {pattern}, {key}) AS key,
               regexp_extract(text, {pattern}, {value}) AS value, '{kv_path}' AS kv_path, line
        FROM ({document_lines(_CODE)}) WHERE regexp_matches(text, {pattern})"""


def _every_match_sql(pattern: str, kv_path: str, extra: str = "true") -> str:
    return f"""
        SELECT path AS file_path, unnest(regexp_extract_all(text, {pattern}, 1)) AS key,
               unnest(regexp_extract_all(text, {pattern}, 2)) AS value,
               '{kv_path}' AS kv_path, line
        FROM ({document_lines(_CODE)})
        WHERE NOT regexp_matches(text, '^\\s*#') AND {extra}"""


# The patterns of assignments, calls and pairs, as SQL texts; a single quote is written twice there.
_Q = "[''\"]"
_GO = rf"'([a-zA-Z_]\w*)\s*(?::=|=)\s*{_Q}([^''\"]+){_Q}'"
_JAVA = rf"'(?:[a-zA-Z_]\w*\s+)+([a-zA-Z_]\w*)\s*=\s*{_Q}([^''\"]+){_Q}'"
_JS = rf"'(?:const|let|var)\s+([a-zA-Z_]\w*)\s*=\s*{_Q}([^''\"]+){_Q}'"
_ASSIGN = rf"'^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*{_Q}([^''\"]*){_Q}'"
_DICT = rf"'{_Q}([^''\"]+){_Q}\s*:\s*{_Q}([^''\"]*){_Q}'"
_KEYWORD = rf"'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*{_Q}([^''\"]*){_Q}'"


def _code_lines(spark, sf):
    return to_lines(document_files(spark, sf, F.expr(_CODE)))


@query("extract_go", _first_match_sql(_GO, "go"))
def extract_go(spark, sf):
    return extract_lines(_code_lines(spark, sf), LINE_EXTRACTORS["go"])


@query("extract_java", _first_match_sql(_JAVA, "java"))
def extract_java(spark, sf):
    return extract_lines(_code_lines(spark, sf), LINE_EXTRACTORS["java"])


_JS_TEXT = """replace(replace(text, 'the ', 'let x1'), ', ', ' = "v1" ')"""


@query("extract_javascript", _first_match_sql(_JS, "javascript").replace(_CODE, _JS_TEXT))
def extract_javascript(spark, sf):
    lines = to_lines(document_files(spark, sf, F.expr(_JS_TEXT)))
    return extract_lines(lines, LINE_EXTRACTORS["js"])


@query("extract_python_assignments", _first_match_sql(_ASSIGN, "assignment"))
def extract_python_assignments(spark, sf):
    return extract_lines(_code_lines(spark, sf), le.python_assign_items)


_DICTS = """replace(replace(replace(text, ', ', '": "'), 'n ', 'n "'), 't ', 't" ')"""


@query("extract_python_dicts", _every_match_sql(_DICT, "dict").replace(_CODE, _DICTS))
def extract_python_dicts(spark, sf):
    lines = to_lines(document_files(spark, sf, F.expr(_DICTS)))
    return extract_lines(lines, le.python_dict_items)


@query(
    "extract_python_keywords",
    _every_match_sql(_KEYWORD, "keyword", f"NOT regexp_matches(text, {_ASSIGN})"),
)
def extract_python_keywords(spark, sf):
    return extract_lines(_code_lines(spark, sf), le.python_keyword_items)


_CALLS = """replace(replace(text, ', ', '.x('), 'e ', 'e ( ')"""
_CALL = r"'([a-zA-Z_][a-zA-Z0-9._]*)\s*\('"


@query(
    "extract_python_calls",
    f"""SELECT path AS file_path, 'function' AS key,
               unnest(regexp_extract_all(text, {_CALL}, 1)) || '()' AS value,
               'call' AS kv_path, line
        FROM ({document_lines(_CALLS)}) WHERE NOT regexp_matches(text, '^\\s*#')""",
)
def extract_python_calls(spark, sf):
    lines = to_lines(document_files(spark, sf, F.expr(_CALLS)))
    return extract_lines(lines, le.python_call_items)


_GETENV_LINES = (
    "'a = os.getenv(' || chr(39) || c_mktsegment || chr(39) || ')'",
    "'b = environ.get( ' || chr(34) || 'K1' || chr(34) || ' , ' || chr(39) || c_name "
    "|| chr(39) || ' ) + os.getenv(' || chr(34) || 'K2' || chr(34) || ', '"
    " || chr(34) || chr(34) || ')'",
    "'# os.getenv(' || chr(39) || c_name || chr(39) || ')'",
)


@query(
    "extract_python_getenv",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("c_mktsegment", "''", "env", 1),
        ("'K1'", "''", "env", 2),
        ("'K2'", "''", "env", 2),
    ),
)
def extract_python_getenv(spark, sf):
    return extract_lines(to_lines(_customers(spark, sf, *_GETENV_LINES)), le.python_getenv_items)


@query(
    "extract_python_getenv_defaults",
    kv_rows("customer", _CUSTOMER, ("'K1'", "c_name", "env_default", 2)),
)
def extract_python_getenv_defaults(spark, sf):
    lines = to_lines(_customers(spark, sf, *_GETENV_LINES))
    return extract_lines(lines, le.python_getenv_default_items)


@query(
    "extract_python_documents",
    f"""SELECT kv_path, count(*) AS pairs FROM (
            {_first_match_sql(_ASSIGN, "assignment")}
            UNION ALL {_every_match_sql(_DICT, "dict")}
            UNION ALL {_every_match_sql(_KEYWORD, "keyword",
                                        f"NOT regexp_matches(text, {_ASSIGN})")}
            UNION ALL SELECT path, 'function', unnest(regexp_extract_all(text, {_CALL}, 1)) || '()',
                             'call', line
                      FROM ({document_lines(_CODE)}) WHERE NOT regexp_matches(text, '^\\s*#')
        ) GROUP BY kv_path""",
)
def extract_python_documents(spark, sf):
    """All Python extractors at once; environment reads do not occur here."""
    kv = extract_lines(_code_lines(spark, sf), LINE_EXTRACTORS["python"])
    return (
        kv.groupBy("kv_path")
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


@query(
    "extract_php_defines",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("c_mktsegment", "c_name", "php.define", 1),
        ("'b'", "md5(c_name)", "php.define", 2),
    ),
)
def extract_php_defines(spark, sf):
    files = _customers(
        spark, sf,
        "'define(' || chr(39) || c_mktsegment || chr(39) || ', ' || chr(34) || c_name "
        "|| chr(34) || ');'",
        "'DEFINE ( ' || chr(34) || 'b' || chr(34) || ',' || chr(39) || md5(c_name) || chr(39) "
        "|| ' ) define(' || chr(39) || 'c' || chr(39) || ',' || chr(39) || 'd' || chr(39) || ')'",
        "'define(A, ' || c_name || ')'",
    )
    return extract_lines(to_lines(files), le.php_define_items)


@query(
    "extract_php_assignments",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'user_' || lower(c_mktsegment)", "c_name", "php.assignment", 1),
        ("'k'", "c_name", "php.assignment", 3),
    ),
)
def extract_php_assignments(spark, sf):
    files = _customers(
        spark, sf,
        "'$user_' || lower(c_mktsegment) || ' = ' || chr(34) || c_name || chr(34) || ';'",
        "chr(39) || 'k' || chr(39) || ' => ' || chr(39) || c_name || chr(39)",
        "chr(39) || 'k' || chr(39) || ' => = ' || chr(39) || c_name || chr(39)",
    )
    return extract_lines(to_lines(files), le.php_assign_items)


# --- shell ------------------------------------------------------------------

_SHELL = (
    "'export KEY=' || c_name || '  '",
    "'A=1 ' || chr(92)",
    "''",
    "'  ' || c_mktsegment || chr(92)",
    "'end'",
    "'# B=' || c_name || ' ' || chr(92)",
    "'C=' || c_name",
    "'curl -s -u ' || chr(39) || 'admin:' || md5(c_name) || chr(39) || ' http://h'",
    "'CURL --user admin:' || c_custkey || ' http://h'",
    "'=' || c_name",
    "'D=' || c_name || chr(92) || chr(92)",
    "'last=' || c_name || ' ' || chr(92)",
)


@query(
    "shell_logical_lines",
    " UNION ALL ".join(
        f"SELECT {_CUSTOMER} AS path, CAST({line} AS INTEGER) AS line, {text} AS text FROM customer"
        for line, text in [
            (1, "'export KEY=' || c_name"),
            (5, "'A=1  ' || c_mktsegment || ' end'"),
            (7, "'# B=' || c_name || '  C=' || c_name"),
            (8, "'curl -s -u ' || chr(39) || 'admin:' || md5(c_name) || chr(39) || ' http://h'"),
            (9, "'CURL --user admin:' || c_custkey || ' http://h'"),
            (10, "'=' || c_name"),
        ]
    ),
)
def shell_logical_lines(spark, sf):
    """Line 11 ends in a backslash, so it is joined to line 12, which stays open."""
    return shell_lines(_customers(spark, sf, *_SHELL))


@query(
    "extract_shell",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'export KEY'", "c_name", "shell", 1),
        ("'A'", "'1  ' || c_mktsegment || ' end'", "shell", 5),
        ("'cURL_Password'", "md5(c_name)", "curl", 8),
        ("'cURL_Password'", "c_custkey || ' http://h'", "curl", 9),
    ),
)
def extract_shell_scripts(spark, sf):
    return extract_shell(_customers(spark, sf, *_SHELL))


@query(
    "shell_lines_of_documents",
    """SELECT path, CAST(max(line) AS INTEGER) AS line,
              string_agg(CASE WHEN goes_on THEN left(t, length(t) - 1) || ' ' ELSE t END, ''
                         ORDER BY line) AS text
       FROM (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (
                        PARTITION BY path ORDER BY line
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
             FROM (SELECT path, line, t, ends_with(t, chr(92)) AS goes_on
                   FROM (SELECT path, line, trim(text, ' ' || chr(9)) AS t FROM (%s))
                   WHERE t <> ''))
       GROUP BY path, grp HAVING NOT bool_or(goes_on AND line = last_line)"""
    .replace("bool_or(goes_on AND line = last_line)", "arg_max(goes_on, line)")
    % document_lines("replace(text, '.' || chr(10), ' ' || chr(92) || chr(10))"),
)
def shell_lines_of_documents(spark, sf):
    """Real text in which every sentence end before a line break continues the line."""
    text = F.expr("replace(text, '.' || chr(10), ' ' || chr(92) || chr(10))")
    return shell_lines(document_files(spark, sf, text))


# --- documents --------------------------------------------------------------


@query(
    "extract_html_comments",
    r"""SELECT CAST(page_id AS VARCHAR) AS file_path, 'comment' AS key, value, 'html' AS kv_path,
               CAST(0 AS INTEGER) AS line
        FROM (SELECT page_id,
                     trim(unnest(regexp_extract_all(html, '<!--((?:.|\n)*?)-->', 1))) AS value
              FROM pages) WHERE value <> ''""",
)
def extract_html_comments(spark, sf):
    return extract_documents(
        document_files(spark, sf, F.col("html"), "pages", "page_id"), html_items
    )


@query(
    "extract_docker_logins",
    kv_rows(
        "customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 5 < 3",
        _CUSTOMER,
        ("'Dockercfg'", "md5(c_name)", "dockercfg", 0),
        ("'Dockercfg'", "c_mktsegment", "dockercfg", 0),
    ),
)
def extract_docker_logins(spark, sf):
    """Field names in any case; a number as login or text behind the object spoils a file."""
    q = "chr(34)"
    name = "CASE WHEN c_custkey % 5 = 1 THEN 'Auths' ELSE 'auths' END"
    auth = "CASE WHEN c_custkey % 5 = 2 THEN 'AUTH' ELSE 'auth' END"
    last = f"CASE WHEN c_custkey % 5 = 3 THEN '5' ELSE {q} || {q} END"
    text = (
        f"CASE WHEN c_mktsegment = 'FURNITURE' THEN 'not json ' || c_name ELSE "
        f"'{{' || {q} || {name} || {q} || ': {{' || {q} || 'a' || {q} || ': {{' || {q} || {auth} "
        f"|| {q} || ':' || {q} || md5(c_name) || {q} || '}}, ' || {q} || 'b' || {q} || ': {{' "
        f"|| {q} || 'auth' || {q} || ':' || {q} || c_mktsegment || {q} || '}}, ' || {q} || 'c' "
        f"|| {q} || ': {{' || {q} || 'auth' || {q} || ':' || {last} || '}}}}}}' "
        f"|| CASE WHEN c_custkey % 5 = 4 THEN ' ' || c_name ELSE '' END END"
    )
    files = built_files(table(spark, sf, "customer"), _CUSTOMER, text)
    return extract_documents(files, dockercfg_items)


# --- URIs -------------------------------------------------------------------


@query(
    "uri_query_of_pages",
    """SELECT CAST(page_id AS VARCHAR) AS file_path, split_part(p, '=', 1) AS key,
              split_part(p, '=', 2) AS value, 'plaintext.uri' AS kv_path,
              CAST(1 AS INTEGER) AS line
       FROM (SELECT page_id, unnest(string_split(
                 split_part(split_part(url, '#', 1), '?', 2), '&')) AS p
             FROM pages WHERE contains(url, '?')) WHERE p <> ''""",
)
def uri_query_of_pages(spark, sf):
    files = document_files(spark, sf, F.col("url"), "pages", "page_id")
    return extract_lines(to_lines(files), LINE_EXTRACTORS["text"])


@query(
    "uri_passwords",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'URI_Password'", "md5(c_name)", "plaintext.uri", 1),
        ("'URI_Password'", "c_name || '+x'", "plaintext.uri", 2),
        ("'password'", "c_name || ' y'", "plaintext.uri", 3),
        ("'n'", "c_mktsegment", "plaintext.uri", 3),
        ("'n'", "''", "plaintext.uri", 3),
        ("'ok'", "c_mktsegment", "plaintext.uri", 4),
        ("'URI_Password'", "''", "plaintext.uri", 6),
    ),
)
def uri_passwords(spark, sf):
    """Passwords, opaque URIs, repeats and undecodable parts."""
    name = "replace(c_name, '#', '%23')"
    files = _customers(
        spark, sf,
        "'see ftp://user:' || md5(c_name) || '@host/x and more'",
        f"'https://u:' || {name} || '+x@host'",
        f"'jdbc:mysql://host/db?password=' || {name} || '+y&n=' || c_mktsegment || '&n=&;=1'",
        "'http://h/p?a=%zz&ok=' || c_mktsegment || '&b=1;2#frag?c=' || c_name",
        "'http://h:' || c_name || '/p?x=1  http://h/%zz?x=1 (http://h/?x=1 not a uri ?x=1'",
        "'SSH://u:@host'",
    )
    return extract_lines(to_lines(files), LINE_EXTRACTORS["text"])


@query(
    "uri_detector",
    r"""SELECT url, regexp_matches(x, '(?i)(http|ftp|smtp|scp|ssh|jdbc[:\w\d]*|s3)s?://?.+')
                    AS is_uri, x AS text
        FROM (SELECT url, unnest([url, replace(url, '://', ':/'), replace(url, 'http', 'jdbc:x'),
                                  replace(url, '://', ':'), split_part(url, '//', 1) || '//',
                                  replace(url, 'http', 'gopher'), upper(url),
                                  replace(url, 'https', 's3')]) AS x FROM pages)""",
)
def uri_detector(spark, sf):
    from keyhound.functions.predicates import is_uri_ascii

    forms = F.expr(
        """explode(array(url, replace(url, '://', ':/'), replace(url, 'http', 'jdbc:x'),
                  replace(url, '://', ':'), split_part(url, '//', 1) || '//',
                  replace(url, 'http', 'gopher'), upper(url), replace(url, 'https', 's3')))"""
    )
    pages = table(spark, sf, "pages").select("url", forms.alias("text"))
    return pages.select("url", is_uri_ascii(F.col("text")).alias("is_uri"), "text")


@query(
    "plain_text_tokens",
    """SELECT CAST(page_id AS VARCHAR) AS file_path, split_part(p, '=', 1) AS key,
              split_part(p, '=', 2) AS value, 'plaintext.uri' AS kv_path, line
       FROM (SELECT page_id, line, unnest(string_split(
                 split_part(split_part(url, '#', 1), '?', 2), '&')) AS p
             FROM pages, (VALUES (CAST(1 AS INTEGER)), (2), (2)) AS v(line)
             WHERE contains(url, '?')) WHERE p <> ''""",
)
def plain_text_tokens(spark, sf):
    text = "'first ' || url || ' word' || chr(10) || chr(9) || url || chr(160) || url"
    files = built_files(table(spark, sf, "pages"), "CAST(page_id AS STRING)", text)
    return extract_lines(to_lines(files), LINE_EXTRACTORS["text"])
