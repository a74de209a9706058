"""Queries over predicates and rule matching.

The oracle states the rules in SQL of its own (see ``RULE_TESTS``): look-aheads
become separate conditions, and similarity is counted character by character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhound.functions import predicates as p
from keyhound.functions.strings import similarity_ratio
from keyhound.operators.line_extractors import LINE_EXTRACTORS, extract_lines
from keyhound.operators.match import findings, keep_scannable, match, rule_predicate
from keyhound.plans.catalog import document_files, document_lines, query, table
from keyhound.plans.scan import line_scan
from keyhound.session import spread
from keyhound.sources.config import ScanConfig
from keyhound.sources.rules import MatchConfig, Rule, load_rules, parse_rules, read_rules, rules_table
from keyhound.sources.tables import kv_from_table, to_lines

# Pairs built from one customer: SQL that both engines read alike.
_MD5 = "md5(c_name)"
_PAIRS = [
    ("'api_token'", f"{_MD5} || '-x'"),
    ("'monkey'", f"'two words ' || {_MD5}"),
    ("'token'", f"{_MD5} || '_'"),
    ("'API-KEY'", f"upper({_MD5}) || '+-'"),
    ("'id'", f"'AKIA' || upper(substr({_MD5}, 1, 16))"),
    ("'aws_secret'", f"'Ab1' || {_MD5} || 'Zx9qT'"),
    ("'aws_name'", f"'Ab1' || {_MD5} || 'Zx9qT'"),
    ("'session'", f"'Ab1/' || repeat({_MD5}, 8) || substr({_MD5}, 1, 12)"),
    ("'session'", f"'Ab1/' || repeat({_MD5}, 8) || substr({_MD5}, 1, 13)"),
    ("'blob'", f"substr({_MD5}, 1, 8)"),
    ("'blob'", f"substr({_MD5}, 1, 6) || '=='"),
    ("'card'", "'4' || lpad(CAST(c_custkey AS STRING), 14, '0')"),
    ("'card'", "'37828224631' || lpad(CAST(c_custkey AS STRING), 6, '0')"),
    ("'card'", "'4' || lpad(CAST(c_custkey AS STRING), 15, '0')"),
    ("'function'", "'eval(' || c_name || ')'"),
    ("'function'", "'OS.System(' || c_name || ')'"),
    ("'function'", "'print(' || c_name || ')'"),
    ("'function'", "'ResourceOptions(' || c_name || ', allow_headers=True)'"),
    ("'Dockercfg'", f"'ab' || {_MD5} || 'c='"),
    ("'Dockercfg'", f"'ab' || chr(10) || {_MD5} || 'c='"),
    ("'git'", f"'ghp_' || {_MD5} || 'abcd'"),
    ("'git'", f"'ghr_' || {_MD5} || {_MD5} || substr({_MD5}, 1, 12)"),
    ("'htpasswd Hash'", f"'$apr1$' || {_MD5}"),
    ("'npm authToken'", f"substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 6)"),
    ("'pip password'", "c_mktsegment || '!'"),
    ("'PyPI password'", "c_mktsegment || '?'"),
    ("'db_password'", "c_name"),
    ("'Secret_Hash1'", "c_mktsegment || c_name"),
    ("'pass word'", "c_name || '!'"),
    ("'cert'", "'-----BEGIN RSA PRIVATE KEY----- ' || c_name"),
    ("'cert'", "'--BEGIN RSA PRIVATE KEY-- ' || c_name"),
    ("'file'", "'id_' || CAST(c_custkey AS STRING) || '.pem'"),
    ("'file'", "c_mktsegment || '.txt'"),
    ("'file'", "lower(c_mktsegment) || '.RB'"),
    ("'dir'", "'/etc/' || c_name"),
    ("'dir'", "'C:' || chr(92) || c_name"),
    ("'dir'", "'etc/' || c_name"),
    ("'comment'", "c_name || ' note ' || c_mktsegment"),
    ("'link'", "'HTTP://h/' || c_name"),
    ("'link'", "'jdbc:oracle:thin://' || c_name"),
    ("'link'", "'http:' || c_name"),
    ("'hook'", f"'https://hooks.slack.com/services/' || upper(substr({_MD5}, 1, 9)) || '/' "
               f"|| upper(substr({_MD5}, 10, 9)) || '/' || {_MD5}"),
    ("'hook'", f"'https://API.hubapi.com/webhooks/v1/' || {_MD5} || '/'"),
    ("'hook'", f"'https://chat.twilio.com/v2/Services/' || upper({_MD5})"),
    ("'password'", "'$' || c_name"),
    ("'password'", "'${' || c_name || '}'"),
    ("'password'", "'<' || c_name || '>'"),
    ("'password'", "'{{ ' || c_name || ' }}'"),
    ("'password'", "'!Ref ' || c_name"),
    ("'password'", "'null'"),
    ("'password'", "''"),
    ("'password'", "c_mktsegment || ' PassWord '"),
    ("'password'", "'pasword-' || substr(c_mktsegment, 1, 2)"),
    ("' '", "c_name || chr(9)"),
    ("c_mktsegment || '_pwd'", "'drowssap' || c_name"),
    ("'pässwd'", "'ÄÖÜ ßé ' || c_mktsegment"),
]
_ARRAY = ", ".join(f"struct({k} AS key, {v} AS value)" for k, v in _PAIRS)
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT 'customer/' || CAST(c_custkey AS STRING) AS file_path, {k} AS key, {v} AS value, "
    f"'row.{i}' AS kv_path, CAST({i} AS INTEGER) AS line FROM customer"
    for i, (k, v) in enumerate(_PAIRS)
)


def built_pairs(spark, sf) -> DataFrame:
    """All built pairs of all customers; the position of a pair is its line."""
    return spread(table(spark, sf, "customer")).select(
        F.expr("'customer/' || CAST(c_custkey AS STRING)").alias("file_path"),
        F.posexplode(F.expr(f"array({_ARRAY})")).alias("line", "kv"),
    ).select(
        "file_path", "kv.key", "kv.value",
        F.concat(F.lit("row."), F.col("line").cast("string")).alias("kv_path"), "line",
    )


_SPACES = "' ' || chr(9) || chr(10) || chr(13)"
_NAME, _TEXT = f"lower(trim(key, {_SPACES}))", f"lower(trim(value, {_SPACES}))"
STATIC = f"""(value NOT IN ('', 'null')
    AND NOT (starts_with(value, '$') AND NOT contains(substr(value, 2), '$'))
    AND NOT (contains(value, '{{{{') AND contains(value, '}}}}'))
    AND NOT (starts_with(value, '${{') AND ends_with(value, '}}'))
    AND NOT (starts_with(value, '<') AND ends_with(value, '>'))
    AND NOT starts_with(value, '!')
    AND NOT ({_NAME} <> '' AND ends_with({_TEXT}, {_NAME})))"""
RATIO = f"""CASE WHEN {_NAME} = '' OR {_TEXT} = '' THEN 0.0
    WHEN {_NAME} = {_TEXT} THEN 1.0
    ELSE 2.0 * coalesce(list_sum([least(
            length({_NAME}) - length(replace({_NAME}, c, '')),
            length({_TEXT}) - length(replace({_TEXT}, c, '')))
        for c in list_distinct(string_split({_NAME}, ''))]), 0)
        / (strlen({_NAME}) + strlen({_TEXT})) END::DOUBLE"""
_STRICT_BASE64 = """regexp_full_match(replace(replace(value, chr(10), ''), chr(13), ''),
    '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?')"""
_DIGITS = "replace(replace(value, ' ', ''), '-', '')"
LUHN = f"""(regexp_full_match({_DIGITS}, '[0-9]{{2,}}') AND
    list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0
                   THEN CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER)
                   ELSE (2 * CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER)) % 10
                        + (2 * CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER)) // 10
              END
              for i in CASE WHEN regexp_full_match({_DIGITS}, '[0-9]{{2,}}')
                            THEN range(1, length({_DIGITS}) + 1) ELSE [] END]) % 10 = 0)"""
_ALL_CASES = " AND ".join(f"regexp_matches(value, '{c}')" for c in ("[A-Z]", "[a-z]", "[0-9]"))
# Fixed value: names of sensitive files.
_SENSITIVE = r""".*(rsa|dsa|ed25519|ecdsa|pem|crt|cer|ca-bundle|p7b|p7c|p7s|(private-)?key|keystore|jks|pkcs12|pfx|p12|asc|dockercfg|npmrc|pypirc|pip.conf|terraform.tfvars|env|cfg|conf|config|ini|s3cfg|\.aws/credentials|htpasswd|(\.|-)?netrc|git-credentials|gitconfig|gitrobrc|(password|credential|secret)(\.[A-Za-z0-9]+)?|servlist-?\.conf|irssi/config|keys\.db|settings\.py|database\.yml|(config(\.inc)?|LocalSettings)\.php|(secret-token|omniauth|carrierwave|schema|knife)\.rb|(accounts|dbeaver-data-sources|BapSshPublisherPlugin|credentials|filezilla|recentservers)\.xml|(ba|z|da)?sh-history|(bash|zsh)rc|(bash-|zsh-)?(profile|aliases)|kdbx?|(agile)?keychain|key(store|ring)|mysql-history|psql-history|pgpass|irb-history|log|pcap|sql(dump)?|gnucash|dump|backup|back|bck|~1|kwallet|tblk|pubxml(\.user)?|Favorites\.plist|configuration\.user\.xpl|proftpdpasswd|robomongo\.json|ventrilo-srv.ini|muttrc|trc|ovpn|dayone|tugboat)$"""

# Fixed values: (rule, similarity limit, test) in match order.
RULE_TESTS = [
    ("apikey", 0.35, """regexp_matches(key, '(?i)[A-Za-z0-9_-](key|token)$')
        AND NOT regexp_matches(split_part(value, chr(10), 1), ' ') AND strlen(value) >= 16"""),
    ("aws-id", 0.7, """regexp_matches(value,
        '^A(AG|CC|GP|ID|IP|KI|NP|NV|PK|RO|SC|SI)A[A-Z0-9]{16}$')
        AND regexp_matches(value, '[0-9]')"""),
    ("aws-secret", 0.7, f"""NOT regexp_matches(key, '(?i)name')
        AND regexp_matches(value, '^[A-Za-z0-9+/]{{40}}$') AND {_ALL_CASES}"""),
    ("aws-token", 0.7, f"""regexp_matches(value, '^[A-Za-z0-9+/]{{270,450}}$') AND {_ALL_CASES}
        AND {_STRICT_BASE64}"""),
    ("base64", 0.7, """regexp_matches(value,
        '^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)?$')"""),
    ("creditcards", 0.7, f"regexp_matches(value, '^[0-9]{{14,}}$') AND {LUHN}"),
    ("dangerous-functions", 0.7, r"""key = 'function' AND regexp_matches(value,
        '(?i)^(eval|exec|(os.)?system|popen|call|subprocess\.(check_output|call))\(')"""),
    ("dockercfg", 0.7, f"""key = 'Dockercfg' AND {_STRICT_BASE64}
        AND strlen(value) = length(value) AND strlen(value) >= 1"""),
    ("github", 0.7, """regexp_matches(value,
        '^(gh[pous]_[a-zA-Z0-9]{36}|ghr_[a-zA-Z0-9]{76})$')"""),
    ("htpasswd", 0.7, "key = 'htpasswd Hash' AND value <> ''"),
    ("npmrc", 0.7, "key = 'npm authToken' AND value <> ''"),
    ("pip", 0.7, "key = 'pip password' AND value <> ''"),
    ("pypirc", 0.7, "key = 'PyPI password' AND value <> ''"),
    ("password-variable", 0.7, r"""strlen(value) >= 5 AND regexp_matches(key,
        '(?i)^\S*(passwords?|passwd|pass|pwd|secret)_?(hash)?[0-9]*$')"""),
    ("privatekey", 0.7, """regexp_matches(value,
        '---BEGIN (RSA|DSA|EC|OPENSSH|PRIVATE)? ?(PRIVATE)? KEY---')"""),
    ("cors", 0.7, r"""key = 'function' AND regexp_matches(value,
        '^(aiohttp_cors.)?ResourceOptions.*(allow_credentials|expose_headers|allow_headers)=(True|''?"?\*''?"?)')"""),
    ("sensitive-files", 0.7, f"""key = 'file'
        AND regexp_matches(value, '(?i){_SENSITIVE}')"""),
    ("path", 0.7, r"""regexp_matches(value, '(?i)^((([A-Z]|file|root):)?(\.+)?[/\\]+)')"""),
    ("comments", 0.7, "key = 'comment'"),
    ("uri-detection", 0.7, r"""regexp_matches(value,
        '(?i)(http|ftp|smtp|scp|ssh|jdbc[:\w\d]*|s3)s?://?.+')"""),
    ("slack-webhook", 0.7, r"""regexp_matches(value,
        '(?i)https://hooks\.slack\.com/services/[A-Z0-9]{9}/[A-Z0-9]{9}/[a-zA-Z0-9]+')"""),
    ("hubspot-webhook", 0.7, r"""regexp_matches(value,
        '(?i)https://api\.hubapi\.com/webhooks/v1/[a-z0-9]+/')"""),
    ("twilio-webhook", 0.7, r"""regexp_matches(value,
        '(?i)https://chat\.twilio\.com/v2/Services/[A-Z0-9]{32}')"""),
]
# Description and severity of each rule, in match order.
RULE_TEXTS = [
    ("apikey", "变量名中包含 API Key 或 Token 的敏感信息", "MAJOR"),
    ("aws-id", "格式类似于 AWS Access Key ID 的值", "BLOCKER"),
    ("aws-secret", "格式类似于 AWS Secret Access Key 的值", "BLOCKER"),
    ("aws-token", "格式类似于 AWS Session Token 的值", "BLOCKER"),
    ("base64", "看起来像 Base64 编码的文本", "INFO"),
    ("creditcards", "识别可能的信用卡号", "MAJOR"),
    ("dangerous-functions", "识别可能导致远程代码执行的危险函数调用", "MAJOR"),
    ("dockercfg", "硬编码的 .dockercfg 认证信息", "CRITICAL"),
    ("github", "Github Token (包含个人、OAuth 等)", "CRITICAL"),
    ("htpasswd", "硬编码的 .htpasswd 凭据 (Hash值)", "MAJOR"),
    ("npmrc", "硬编码的 .npmrc authToken", "CRITICAL"),
    ("pip", "硬编码的 pip.conf 密码", "CRITICAL"),
    ("pypirc", "硬编码的 .pypirc 密码", "CRITICAL"),
    ("password-variable", "变量名中包含 password 等字样的敏感信息", "CRITICAL"),
    ("privatekey", "格式类似于私钥的文本", "CRITICAL"),
    ("cors", "不安全的跨域资源共享 (CORS) 配置", "MAJOR"),
    ("sensitive-files", "识别包含敏感信息的文件名或特定后缀文件", "MAJOR"),
    ("path", "识别字符串中的系统或网络路径 (通常用于负面过滤)", "INFO"),
    ("comments", "识别注释中的潜在泄露", "MINOR"),
    ("uri-detection", "识别常见的协议链接并触发深度解析", "MAJOR"),
    ("slack-webhook", "Slack Webhook 地址", "MINOR"),
    ("hubspot-webhook", "Hubspot Webhook 地址", "MINOR"),
    ("twilio-webhook", "Twilio Webhook 地址", "MINOR"),
]
_META = " UNION ALL ".join(
    f"SELECT {i} AS o, '{name}' AS rule_id, '{text}' AS description, '{severity}' AS severity"
    for i, (name, text, severity) in enumerate(RULE_TEXTS)
)


def matches_sql(kv: str, mode: str = "first", where: str = "true") -> str:
    """SQL for matched pairs of a pair query: file_path, key, value, kv_path, line and rule."""
    checks = ", ".join(
        f"CASE WHEN ({test}) AND ratio < {limit} THEN {i} END"
        for i, (_, limit, test) in enumerate(RULE_TESTS)
    )
    orders = f"[x for x in [{checks}] if x IS NOT NULL]"
    picked = f"unnest({orders})" if mode == "all" else f"list_min({orders})"
    return f"""
        SELECT m.file_path, m.key, m.value, m.kv_path, m.line, r.rule_id, r.description, r.severity
        FROM (SELECT *, {picked} AS o
              FROM (SELECT *, {RATIO} AS ratio FROM ({kv}) WHERE {STATIC} AND ({where}))) m
        JOIN ({_META}) r ON m.o = r.o"""


def findings_sql(kv: str, mode: str = "first", where: str = "true") -> str:
    return f"""
        SELECT rule_id AS "RuleID", description AS "Description", file_path AS "FilePath",
               line AS "LineNumber", value AS "Content", severity AS "Severity"
        FROM ({matches_sql(kv, mode, where)})"""


# --- predicates -------------------------------------------------------------


def _flag(name: str, sql: str, column) -> None:
    @query(name, f"SELECT file_path, line, ({sql}) AS passed FROM ({PAIRS_SQL})")
    def run(spark, sf):
        passed = column(F.col("key"), F.col("value"))
        return built_pairs(spark, sf).select("file_path", "line", passed.alias("passed"))


_flag("predicate_is_static", STATIC, p.is_static)
_flag("predicate_min_length", "strlen(value) >= 17", lambda k, v: p.has_min_length(v, 17))
_flag("predicate_base64", _STRICT_BASE64, lambda k, v: p.is_base64(v))
_flag(
    "predicate_uri",
    r"regexp_matches(value, '(?i)(http|ftp|smtp|scp|ssh|jdbc[:\w\d]*|s3)s?://?.+')",
    lambda k, v: p.is_uri(v),
)
_flag("predicate_ascii", "strlen(value) = length(value)", lambda k, v: p.is_ascii(v))
_flag("predicate_luhn", LUHN, lambda k, v: p.is_luhn(v))
_flag(
    "predicate_regex_ignore_case",
    "regexp_matches(value, '(?i)[a-f]{2,}[0-9].*building|MACHIN.*[0-9]$')",
    lambda k, v: p.regex.search(v, "[a-f]{2,}[0-9].*building|MACHIN.*[0-9]$", True),
)
_flag("predicate_similarity_limit", f"{RATIO} < 0.35", lambda k, v: p.passes_similarity(k, v, 0.35))
_flag(
    "predicate_one_rule",
    f"({RULE_TESTS[13][2]}) AND {RATIO} < 0.7",
    lambda k, v: rule_predicate(next(r for r in read_rules() if r.rule_id == "password-variable"), k, v),
)


@query(
    "similarity_ratio",
    f"SELECT file_path, line, round({RATIO}, 9) AS ratio FROM ({PAIRS_SQL})",
)
def similarity(spark, sf):
    ratio = F.round(similarity_ratio(F.col("key"), F.col("value")), 9)
    return built_pairs(spark, sf).select("file_path", "line", ratio.alias("ratio"))


_EXCLUDED = ScanConfig(
    exclude_keys=["^api", "TOKEN$", "("], exclude_values=["machin", "^4"],
    exclude_paths=[r"row\.[12]\d$"],
)


@query(
    "exclude_pairs",
    f"""SELECT * FROM ({PAIRS_SQL}) WHERE {STATIC}
        AND NOT regexp_matches(key, '(?i)^api|token$') AND NOT regexp_matches(value, '(?i)machin|^4')
        AND NOT regexp_matches(kv_path, 'row\\.[12][0-9]$')""",
)
def exclude_pairs(spark, sf):
    """Exclusions ignore case, and a pattern that does not compile is left out."""
    return keep_scannable(built_pairs(spark, sf), _EXCLUDED)


# --- rules ------------------------------------------------------------------


@query(
    "match_first",
    f"SELECT file_path, line, rule_id, severity FROM ({matches_sql(PAIRS_SQL)})",
)
def match_first(spark, sf):
    matched = match(built_pairs(spark, sf), read_rules())
    return matched.select("file_path", "line", "rule_id", "severity")


@query(
    "match_all",
    f"SELECT file_path, line, rule_id, severity FROM ({matches_sql(PAIRS_SQL, 'all')})",
)
def match_all(spark, sf):
    matched = match(built_pairs(spark, sf), read_rules(), "all")
    return matched.select("file_path", "line", "rule_id", "severity")


@query("findings_of_pairs", findings_sql(PAIRS_SQL))
def findings_of_pairs(spark, sf):
    return findings(match(built_pairs(spark, sf), read_rules()))


@query(
    "match_with_exclusions",
    findings_sql(
        PAIRS_SQL,
        where="""NOT regexp_matches(key, '(?i)^api|token$')
            AND NOT regexp_matches(value, '(?i)machin|^4')
            AND NOT regexp_matches(kv_path, 'row\\.[12][0-9]$')""",
    ),
)
def match_with_exclusions(spark, sf):
    return findings(match(built_pairs(spark, sf), read_rules(), config=_EXCLUDED))


@query(
    "rules_with_findings",
    f"""SELECT CAST(r.o AS INTEGER) AS rule_order, r.rule_id, r.severity, count(m.rule_id) AS n
        FROM ({_META}) r LEFT JOIN ({matches_sql(PAIRS_SQL, 'all')}) m ON r.rule_id = m.rule_id
        GROUP BY r.o, r.rule_id, r.severity""",
)
def rules_with_findings(spark, sf):
    """The rule table joined to its match counts; rules without findings stay."""
    rules = load_rules(spark)
    counts = (
        match(built_pairs(spark, sf), rules, "all")
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rules.join(counts, "rule_id", "left").select(
        "rule_order", "rule_id", "severity", F.coalesce("n", F.lit(0)).alias("n")
    )


_CUSTOM = """
order-reference:
  description: an order priority that names a level
  severity: MINOR
  key:
    regex: "^O_.*PRIORITY$"
    ignorecase: true
  value:
    regex: "[0-9]-(URGENT|HIGH)"
    minlen: 6
broken:
  severity: CRITICAL
  value:
    regex: "(unclosed"
status:
  description: a finished order
  severity: INFO
  key:
    regex: "status$"
  value:
    regex: "^F$"
  similar: 0.9
"""


@query(
    "match_custom_rules",
    """SELECT 'orders/' || CAST(o_orderkey AS VARCHAR) AS "FilePath", 'order-reference' AS "RuleID",
              'MINOR' AS "Severity", o_orderpriority AS "Content" FROM orders
       WHERE regexp_matches(o_orderpriority, '[0-9]-(URGENT|HIGH)')
       UNION ALL SELECT 'orders/' || CAST(o_orderkey AS VARCHAR), 'status', 'INFO', o_orderstatus
       FROM orders WHERE o_orderstatus = 'F'""",
)
def match_custom_rules(spark, sf):
    """User rules over a table's columns; the rule that does not compile never matches."""
    kv = kv_from_table(
        table(spark, sf, "orders"),
        F.expr("'orders/' || CAST(o_orderkey AS STRING)"),
        ["o_orderstatus", "o_orderpriority"],
        "row",
    )
    found = findings(match(kv, parse_rules(_CUSTOM)))
    return found.select("FilePath", "RuleID", "Severity", "Content")


@query(
    "match_many_rules",
    """SELECT o_orderkey, 'customer-' || CAST(o_custkey AS VARCHAR) AS "RuleID", 'c' || CAST(o_custkey AS VARCHAR) AS "Description"
       FROM orders
       UNION ALL SELECT o_orderkey, 'urgent', 'any customer' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def match_many_rules(spark, sf):
    """Every rule that fits, of one rule per customer and one without a fixed text: rules are joined, not compiled."""
    urgent = rules_table(spark, [Rule("urgent", "any customer", severity="MAJOR", value=MatchConfig(r"[1]-[U][R]", True))])
    number = "coalesce(CAST(c_custkey AS STRING), 'None')"
    config = urgent.schema["value"].dataType.simpleString()
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey AS rule_order", f"'customer-' || {number} AS rule_id", f"'c' || {number} AS description", "'' AS message",
        "'INFO' AS severity", "0D AS similar", f"CAST(NULL AS {config}) AS key",
        f"CAST(struct(r'(?i)\\bCUSTOMER#' || {number} || r'\\b', false, 0, false, false, false, false) AS {config}) AS value",
    )
    first = F.lit(None).cast("long").alias("rule_order")  # nulls are sorted first
    rules = urgent.select(first, *urgent.columns[1:]).union(customers)
    value = "'order of customer#' || CAST(o_custkey AS STRING) || ' ' || o_orderpriority AS note"
    orders = spread(table(spark, sf, "orders")).selectExpr("o_orderkey", value)
    kv = kv_from_table(orders, F.col("o_orderkey").cast("string"), ["note"], "row")
    found = findings(match(kv, rules, "all"))
    return found.select(F.col("FilePath").cast("long").alias("o_orderkey"), "RuleID", "Description")


_MULTILINE = r"""
note:
  description: a note that begins a line
  severity: MINOR
  value:
    regex: '(?im)^clé-\d+$'
over-lines:
  description: two words with anything between them
  severity: INFO
  value:
    regex: '(?is)été.+hiver'
"""


@query(
    "match_multiline_rules",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'over-lines' ELSE 'note' END AS "RuleID"
       FROM customer WHERE c_custkey % 5 IN (0, 2, 4)""",
)
def match_multiline_rules(spark, sf):
    """Flag groups that cover several flags; letters beyond ASCII have case too."""
    text = """CASE c_custkey % 5
        WHEN 0 THEN 'x' || chr(10) || 'CLÉ-' || c_custkey || chr(10) || 'y'
        WHEN 1 THEN 'x CLÉ-' || c_custkey
        WHEN 2 THEN 'clé-' || c_custkey
        WHEN 3 THEN 'CLÉ-' || c_custkey || 'z' || chr(10)
        ELSE 'ÉTÉ ' || c_custkey || chr(10) || 'HIVER' END AS note"""
    customers = table(spark, sf, "customer").selectExpr("c_custkey", text)
    kv = kv_from_table(customers, F.col("c_custkey").cast("string"), ["note"], "row")
    found = findings(match(kv, parse_rules(_MULTILINE)))
    return found.select(F.col("FilePath").cast("long").alias("c_custkey"), "RuleID")


_DIALECT = r"""
scoped-case:
  severity: MINOR
  value:
    regex: '^(?i:é)clair-\d{2,}$'
spaced:
  severity: MINOR
  value:
    regex: |-
      (?x) ^ tok [ ] key  # two words and a number
      \s \d+ $
named:
  severity: MINOR
  value:
    regex: "^(?'a_1'[bc])(d)\\1\\k<a_1>\\d+$"
explicit:
  severity: MINOR
  value:
    regex: '(?n)^(ab)+(?<q>c)\1\d+$'
case-off:
  severity: MINOR
  value:
    regex: '(?i)^x(?-i:y)z{1}{-\d+$'
never:
  severity: CRITICAL
  value:
    regex: '(a)++|\d'
"""


@query(
    "match_dialect_rules",
    """SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'scoped-case' WHEN 2 THEN 'spaced' WHEN 4 THEN 'named'
                             WHEN 6 THEN 'explicit' ELSE 'case-off' END AS "RuleID"
       FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 10 <> 0 OR c_custkey >= 10)""",
)
def match_dialect_rules(spark, sf):
    """Scoped flags, free spacing, group names and numbers; even keys hold what a rule asks for, odd ones nearly so."""
    text = """CASE c_custkey % 10
        WHEN 0 THEN 'Éclair-' || c_custkey WHEN 1 THEN 'ÉCLAIR-' || c_custkey
        WHEN 2 THEN 'tok key ' || c_custkey WHEN 3 THEN 'tokkey ' || c_custkey
        WHEN 4 THEN 'bddb' || c_custkey WHEN 5 THEN 'bdbd' || c_custkey
        WHEN 6 THEN 'ababcc' || c_custkey WHEN 7 THEN 'ababcab' || c_custkey
        WHEN 8 THEN 'XyZ{-' || c_custkey ELSE 'XYZ{-' || c_custkey END AS note"""
    customers = table(spark, sf, "customer").selectExpr("c_custkey", text)
    kv = kv_from_table(customers, F.col("c_custkey").cast("string"), ["note"], "row")
    found = findings(match(kv, parse_rules(_DIALECT)))
    return found.select(F.col("FilePath").cast("long").alias("c_custkey"), "RuleID")


def _table_kv_sql(name: str, key: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}/' || CAST({key} AS VARCHAR) AS file_path, '{c}' AS key,
                   coalesce(CAST({c} AS VARCHAR), '') AS value, 'row' AS kv_path,
                   CAST(0 AS INTEGER) AS line FROM {name}"""
        for c in columns
    )


@query(
    "scan_table_columns",
    f"""SELECT rule_id, severity, key, count(*) AS findings
        FROM ({matches_sql(_table_kv_sql('orders', 'o_orderkey',
                           ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']))})
        GROUP BY ALL""",
)
def scan_table_columns(spark, sf):
    """Every column of a table as pairs."""
    kv = kv_from_table(
        table(spark, sf, "orders"),
        F.expr("'orders/' || CAST(o_orderkey AS STRING)"),
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
        "row",
    )
    return (
        match(kv, read_rules())
        .groupBy("rule_id", "severity", "key")
        .agg(F.count(F.lit(1)).alias("findings"))
    )


_GO_KV = f"""
    SELECT path AS file_path, regexp_extract(text, p, 1) AS key, regexp_extract(text, p, 2) AS value,
           'go' AS kv_path, line
    FROM ({document_lines()}), (SELECT '([a-zA-Z_]\\w*)\\s*(?::=|=)\\s*[''"]([^''"]+)[''"]' AS p)
    WHERE regexp_matches(text, p)"""


@query("scan_document_assignments", findings_sql(_GO_KV))
def scan_document_assignments(spark, sf):
    """The minimal scan: document lines, assignments, rules."""
    return line_scan(to_lines(document_files(spark, sf)), LINE_EXTRACTORS["go"])


@query(
    "scan_document_assignments_all",
    f"""SELECT rule_id, count(*) AS n FROM ({matches_sql(_GO_KV, 'all')}) GROUP BY rule_id""",
)
def scan_document_assignments_all(spark, sf):
    kv = extract_lines(to_lines(document_files(spark, sf)), LINE_EXTRACTORS["go"])
    return match(kv, read_rules(), "all").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
