"""Fixed values.

Every text in this file is part of a published format (a rule format, a report
format, a file-type convention) and has to stay exactly as it is for results to
be right.  Logic lives elsewhere; nothing here is derived from data.
"""

# --- files ------------------------------------------------------------------
MIN_FILE_BYTES = 7
XML_DECLARATION_START = "<?xml "
DEFAULT_EXCLUDED_FILES = [".git", "node_modules", "vendor", ".idea", ".vscode"]
DEFAULT_INCLUDED_FILES = ["**/*"]
TEMPLATE_SUFFIXES = [".dist", ".template"]

# --- whitespace (Unicode White_Space) ---------------------------------------
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- matching ---------------------------------------------------------------
DEFAULT_SIMILARITY_LIMIT = 0.7
URI_PATTERN = r"(http|ftp|smtp|scp|ssh|jdbc[:\w\d]*|s3)s?://?.+"
FILE_NAME_KEY = "file"
FILE_NAME_KV_PATH = "metadata"

# --- severities -------------------------------------------------------------
SEVERITY_WEIGHTS = {"CRITICAL": 4, "MAJOR": 3, "MINOR": 2, "INFO": 1}
RULE_TYPE_WORDS = ["password", "secret", "uri", "file", "key"]
OTHER_RULE_TYPE = "other"

# --- context ----------------------------------------------------------------
CONTEXT_RADIUS = {2: 5, 3: 20, 4: 50}
CONTEXT_MESSAGE_SINGLE = "（Lv1：极速模式，仅含有单行违规代码）"
CONTEXT_MESSAGE_BLOCK = "（Lv%d：视野打开，已注入前后共 %d 行代码作为研判支撑）"
REVIEW_PROMPT = """你是一个资深的安全审计专家。现在有一个静态代码扫描工具拦截了一段疑似凭据泄露的代码片段/上下文。
请分析定位行所触发的告警，是真实的敏感信息硬编码（True Positive），还是误报、测试占位符（False Positive）。
文件路径：%s
命中规则：%s
定位行数：%d
%s

代码实况上下文抽取：
%s

请结合上述上下文环境和代码语义，直接给出你的思考过程，最后必须用一句加粗的文字 "结论：确认高危" 或 "结论：属于误报" 结尾。"""
FALSE_POSITIVE_MARK = "属于误报"
VERDICT_FALSE_POSITIVE = "确认误报"
VERDICT_TRUE_POSITIVE = "确认高危"

# --- reports ----------------------------------------------------------------
CSV_COLUMNS = ["Severity", "RuleID", "Description", "FilePath", "LineNumber", "Content"]
EXCEL_HEADER = ["风险等级", "命中规则", "文件路径", "行号", "内容快照"]
HTML_TABLE_HEADER = ["风险等级", "规则标识", "文件位置", "内容快照"]
