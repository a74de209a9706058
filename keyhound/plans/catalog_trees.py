"""Queries over YAML, JSON and XML extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyhound.operators.tree import (
    clean_json,
    clean_yaml,
    extract_trees,
    flatten_json_column,
    read_trees,
    tree_errors,
)
from keyhound.plans.catalog import built_files, document_files, kv_rows, query, table, text_lines

_CUSTOMER = "CAST(c_custkey AS STRING)"
_Q = "chr(34)"


def _documents(spark, sf, fmt: str, text: str, name: str = "customer", path: str = _CUSTOMER):
    files = built_files(table(spark, sf, name), path, text)
    return files.withColumn("format", F.lit(fmt))


def _quoted(*parts: str) -> str:
    """SQL for a text in which ``~`` stands for a double quote and ``{x}`` for an expression."""
    out = []
    for part in parts:
        for i, piece in enumerate(part.split("@")):
            out.append(f"replace('{piece}', '~', {_Q})" if i % 2 == 0 else f"({piece})")
    return " || ".join(out)


# --- JSON -------------------------------------------------------------------

@query(
    "flatten_event_props",
    """SELECT CAST(event_id AS VARCHAR) AS file_path, 'k' AS key,
              json_extract_string(props, '$.k') AS value, 'k' AS kv_path,
              CAST(0 AS INTEGER) AS line FROM events""",
)
def flatten_event_props(spark, sf):
    """A JSON column of a table, unfolded without leaving the JVM."""
    events = table(spark, sf, "events")
    return flatten_json_column(events, F.col("event_id").cast("string"), F.col("props"))


_NESTED = _quoted(
    "{~user~: {~name~: ~@c_name@~, ~id~: @c_custkey@, ~deep~: {~segment~: ~a=@c_mktsegment@~}},",
    " ~n~: 1.50, ~flag~: true}",
)
_PLAIN = _quoted("{~a~: {~b~: {~c~: ~@c_mktsegment@~, ~d~: @c_custkey@}}, ~e~: ~@c_mktsegment@=1~}")


@query(
    "flatten_plain_json_column",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'a'", "''", "a", 0),
        ("'b'", "''", "a.b", 0),
        ("'c'", "c_mktsegment", "a.b.c", 0),
        ("'d'", _CUSTOMER, "a.b.d", 0),
        ("'e'", "c_mktsegment || '=1'", "e", 0),
        ("c_mktsegment", "'1'", "e", 0),
    ),
)
def flatten_plain_json_column(spark, sf):
    """Three levels of plain objects, unfolded by column expressions."""
    customers = table(spark, sf, "customer")
    return flatten_json_column(customers, F.expr(_CUSTOMER), F.expr(_PLAIN))


_ODD = """CASE c_custkey % 4
    WHEN 0 THEN '{' || chr(34) || chr(34) || ':{' || chr(34) || 'a' || chr(34) || ':' || chr(34) || c_name || chr(34) || '}}'
    WHEN 1 THEN '{' || chr(34) || 'a' || chr(34) || ':' || chr(34) || 'x' || chr(127) || 'y' || chr(34) || '}'
    WHEN 2 THEN '{' || chr(34) || 'a' || chr(34) || ':' || chr(34) || 'x' || chr(133) || 'y' || chr(34) || '}'
    ELSE '{' || chr(34) || repeat('k', 1100) || chr(34) || ':' || chr(34) || c_name || chr(34) || '}' END"""


@query(
    "flatten_odd_json_column",
    f"""SELECT {_CUSTOMER} AS file_path, '' AS key, '' AS value, '' AS kv_path, CAST(0 AS INTEGER) AS line
        FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT {_CUSTOMER}, 'a', c_name, 'a', 0 FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT {_CUSTOMER}, 'a', 'x y', 'a', 0 FROM customer WHERE c_custkey % 4 = 2""",
)
def flatten_odd_json_column(spark, sf):
    """An empty key, a control character, a line separator and a key too long: the document reader decides."""
    customers = table(spark, sf, "customer")
    return flatten_json_column(customers, F.expr(_CUSTOMER), F.expr(_ODD))


@query(
    "flatten_nested_json_column",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'user'", "''", "user", 0),
        ("'name'", "c_name", "user.name", 0),
        ("'id'", _CUSTOMER, "user.id", 0),
        ("'deep'", "''", "user.deep", 0),
        ("'segment'", "'a=' || c_mktsegment", "user.deep.segment", 0),
        ("'a'", "c_mktsegment", "user.deep.segment", 0),
        ("'n'", "'1.50'", "n", 0),
        ("'flag'", "'true'", "flag", 0),
    ),
)
def flatten_nested_json_column(spark, sf):
    customers = table(spark, sf, "customer")
    return flatten_json_column(customers, F.expr(_CUSTOMER), F.expr(_NESTED))


_JSON_LINES = text_lines(
    "'// note about ' || c_name",
    "'{'",
    _quoted("  ~db~: {   // settings"),
    _quoted("    ~password~: ~@c_name@~, // secret"),
    _quoted("    ~url~: ~http://u:@md5(c_name) || chr(64)@host/p?k=@c_mktsegment@~,"),
    _quoted("    ~list~: [~x=@c_mktsegment@~, {~inner~: @c_custkey@}, 3]"),
    "'  },'",
    "chr(9) || " + _quoted("~opts~: ~--token = @c_mktsegment@ ~"),
    "'}'",
)


@query(
    "extract_json_files",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'db'", "''", "db", 3),
        ("'password'", "c_name", "db.password", 4),
        ("'url'", "'http://u:' || md5(c_name) || '@host/p?k=' || c_mktsegment", "db.url", 5),
        ("'http://u:' || md5(c_name) || '@host/p?k'", "c_mktsegment", "db.url", 5),
        ("'URI_Password'", "md5(c_name)", "db.url.uri", 5),
        ("'k'", "c_mktsegment", "db.url.uri", 5),
        ("'list'", "''", "db.list", 6),
        ("'x'", "c_mktsegment", "db.list", 6),
        ("'inner'", _CUSTOMER, "db.list.inner", 6),
        ("'opts'", "'--token = ' || c_mktsegment || ' '", "opts", 8),
        ("'--token'", "c_mktsegment", "opts", 8),
    ),
)
def extract_json_files(spark, sf):
    """Comments, nesting, lists, embedded pairs and URIs, with true line numbers."""
    return extract_trees(_documents(spark, sf, "json", _JSON_LINES))


@query(
    "strip_json_comments",
    """SELECT CAST(c_custkey AS VARCHAR) AS path,
              chr(10) || '{"a": "http://' || c_name || '"' || chr(10) || '}' || chr(10) AS clean
       FROM customer""",
)
def strip_json_comments(spark, sf):
    text = text_lines(
        "'  // ' || c_name", _quoted("{~a~: ~http://@c_name@~   // @c_mktsegment@"), "'}'"
    )
    files = _documents(spark, sf, "json", text)
    return files.select("path", clean_json(F.col("content")).alias("clean"))


@query(
    "json_parse_errors",
    """SELECT CAST(c_custkey AS VARCHAR) AS file_path, 'json' AS format
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def json_parse_errors(spark, sf):
    """Broken documents give no pairs and one error row each."""
    text = _quoted("{~a~: [~@c_name@~") + (
        " || CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '}' ELSE ']}' END"
    )
    errors = tree_errors(read_trees(_documents(spark, sf, "json", text)))
    return errors.select("file_path", "format")


# --- YAML -------------------------------------------------------------------

_YAML_LINES = text_lines(
    "'--- # start'",
    "'# comment: ' || c_name",
    "'db:'",
    "'  password: ' || md5(c_name)",
    "'  ref: !Ref ' || c_mktsegment",
    "'  number: 0' || c_custkey",
    "'  anchor: &a1 ' || c_mktsegment",
    "'  alias: *a1'",
    "'env:'",
    "'  - key: name'",
    "'    value: ' || c_mktsegment",
    "'  - A=' || c_mktsegment",
    "'  - [x, ' || chr(39) || 's3://' || lower(c_mktsegment) || '?q=1' || chr(39) || ']'",
    "'tpl: {{ ' || c_mktsegment || ' }}'",
    "'text: |'",
    "'  one ' || c_mktsegment",
    "'  two'",
)


@query(
    "extract_yaml_files",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'db'", "''", "db", 4),
        ("'password'", "md5(c_name)", "db.password", 4),
        ("'ref'", "'!Ref ' || c_mktsegment", "db.ref", 5),
        ("'number'", "'0' || c_custkey", "db.number", 6),
        ("'anchor'", "c_mktsegment", "db.anchor", 7),
        ("'alias'", "'a1'", "db.alias", 8),
        ("'env'", "''", "env", 10),
        ("'key'", "'name'", "env.key", 10),
        ("'value'", "c_mktsegment", "env.value", 11),
        ("'name'", "c_mktsegment", "env.explicit_pair", 10),
        ("'A'", "c_mktsegment", "env", 12),
        ("'s3://' || lower(c_mktsegment) || '?q'", "'1'", "env", 13),
        ("'q'", "'1'", "env.uri", 13),
        ("'tpl'", "'{{ ' || c_mktsegment || ' }}'", "tpl", 14),
        ("'text'", "'one ' || c_mktsegment || chr(10) || 'two' || chr(10)", "text", 15),
    ),
)
def extract_yaml_files(spark, sf):
    return extract_trees(_documents(spark, sf, "yaml", _YAML_LINES))


_OTHER = "'other/' || CAST(c_custkey AS VARCHAR)"


@query(
    "yaml_template_defaults",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'DbPass'", "md5(c_name)", "Parameters.DbPass.Default", 3),
        ("'Parameters'", "''", "Parameters", 2),
        ("'DbPass'", "''", "Parameters.DbPass", 3),
        ("'Default'", "md5(c_name)", "Parameters.DbPass.Default", 3),
        ("'Type'", "'String'", "Parameters.DbPass.Type", 4),
        ("'Resources'", "''", "Resources", 5),
    )
    + " UNION ALL "
    + kv_rows(
        "customer",
        _OTHER,
        ("'Parameters'", "''", "Parameters", 2),
        ("'P'", "''", "Parameters.P", 3),
        ("'Default'", "c_mktsegment", "Parameters.P.Default", 3),
    ),
)
def yaml_template_defaults(spark, sf):
    """Defaults of template parameters, besides all other pairs; without a template marker there are none."""
    text = text_lines(
        "'Parameters:'", "'  DbPass:'", "'    Default: ' || md5(c_name)", "'    Type: String'",
        "'Resources: {}'",
    )
    other = text_lines("'Parameters:'", "'  P:'", "'    Default: ' || c_mktsegment")
    both = _documents(spark, sf, "yaml", text).unionByName(
        _documents(spark, sf, "yaml", other, path="'other/' || CAST(c_custkey AS STRING)")
    )
    return extract_trees(both)


@query(
    "clean_yaml_templates",
    """SELECT CAST(c_custkey AS VARCHAR) AS path,
              chr(10) || 'a: "{{ ' || c_mktsegment || ' }}"' || chr(10) || 'b: ''"{{x}}"'''
              || chr(10) || 'c:  ' || c_name || chr(10) || chr(10) || '  # kept' || chr(10)
                  AS clean
       FROM customer""",
)
def clean_yaml_templates(spark, sf):
    text = text_lines(
        "'--- ' || c_name", "'a: {{ ' || c_mktsegment || ' }}'", _quoted("b: ~{{x}}~"),
        "'c: {% if x' || chr(10) || ' %} ' || c_name", "'# ' || c_name", "'  # kept'",
    )
    files = _documents(spark, sf, "yaml", text)
    return files.select("path", clean_yaml(F.col("content")).alias("clean"))


@query(
    "yaml_raw_fallback",
    kv_rows("customer", _CUSTOMER, ("'a'", "'{{ \"x\" }} ' || c_mktsegment", "a", 1)),
)
def yaml_raw_fallback(spark, sf):
    """When cleaning breaks a document, it is read as it is."""
    text = "'a: ' || chr(39) || '{{ ' || chr(34) || 'x' || chr(34) || ' }} ' || c_mktsegment " \
        "|| chr(39)"
    return extract_trees(_documents(spark, sf, "yaml", text))


@query(
    "yaml_of_documents",
    """SELECT CAST(doc_id AS VARCHAR) AS file_path, 'text' AS key, text AS value,
              'doc.text' AS kv_path, CAST(2 AS INTEGER) AS line FROM documents
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 'doc', '', 'doc', 2 FROM documents
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lang', lang, 'doc.lang', 3 FROM documents
       UNION ALL SELECT CAST(doc_id AS VARCHAR), trim(split_part(text, '=', 1), chr(10) || ' '),
                        trim(substr(text, instr(text, '=') + 1), chr(10) || ' '), 'doc.text', 2
                 FROM documents WHERE contains(text, '=')""",
)
def yaml_of_documents(spark, sf):
    """Whole document texts as quoted scalars: every character survives."""
    escaped = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), " \
        "chr(92) || chr(34)), chr(10), chr(92) || 'n')"
    text = f"'doc:' || chr(10) || '  text: ' || chr(34) || {escaped} || chr(34) || chr(10) " \
        "|| '  lang: ' || lang"
    files = document_files(spark, sf, F.expr(text)).withColumn("format", F.lit("yaml"))
    return extract_trees(files)


# --- XML --------------------------------------------------------------------

_XML_LINES = text_lines(
    _quoted("<?xml version=~1.0~ encoding=~UTF-8~?>"),
    _quoted("<ns:config id=~@c_custkey@~ xmlns:ns=~urn:x~>"),
    _quoted("  <link href=~https://u:@md5(c_name) || chr(64)@h/?k=v~/>"),
    "'  <pass> ' || c_name || ' </pass>'",
    "'  <opt>'",
    "'    mode=' || c_mktsegment || ' &amp; more'",
    "'  </opt>'",
    "'  <KEY>user</KEY><x>1</x><Value>' || c_mktsegment || '</Value><value>again</value>'",
    "'  <mix>a<!-- ' || c_name || ' -->b<![CDATA[<' || c_mktsegment || '>]]></mix>'",
    "'</ns:config>'",
)


@query(
    "extract_xml_files",
    kv_rows(
        "customer",
        _CUSTOMER,
        ("'id'", _CUSTOMER, "config@id", 2),
        ("'ns'", "'urn:x'", "config@ns", 2),
        ("'href'", "'https://u:' || md5(c_name) || '@h/?k=v'", "config.link@href", 3),
        ("'URI_Password'", "md5(c_name)", "config.link@href.uri", 3),
        ("'k'", "'v'", "config.link@href.uri", 3),
        ("'pass'", "c_name", "config.pass", 4),
        ("'opt'", "'mode=' || c_mktsegment || ' & more'", "config.opt", 6),
        ("'mode'", "c_mktsegment || ' & more'", "config.opt.embedded", 6),
        ("'KEY'", "'user'", "config.KEY", 8),
        ("'x'", "'1'", "config.x", 8),
        ("'Value'", "c_mktsegment", "config.Value", 8),
        ("'user'", "c_mktsegment", "config.Value.pair", 8),
        ("'value'", "'again'", "config.value", 8),
        ("'mix'", "'a'", "config.mix", 9),
        ("'mix'", "'b'", "config.mix", 9),
        ("'mix'", "'<' || c_mktsegment || '>'", "config.mix", 9),
    ),
)
def extract_xml_files(spark, sf):
    """Attributes, texts, embedded pairs, attribute URIs and key/value siblings."""
    return extract_trees(_documents(spark, sf, "xml", _XML_LINES))


@query(
    "xml_parse_errors",
    """SELECT CAST(c_custkey AS VARCHAR) AS file_path, 'xml' AS format
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def xml_parse_errors(spark, sf):
    """A broken document loses the pairs found before the error, too."""
    text = "'<a><b>' || c_name || '</b>' || " \
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '&x;' ELSE '' END || '</a>'"
    errors = tree_errors(read_trees(_documents(spark, sf, "xml", text)))
    return errors.select("file_path", "format")


@query(
    "tree_pairs_per_format",
    """SELECT 'xml' AS format, count(*) AS pairs FROM documents WHERE trim(replace(
              text, chr(10), ' ')) <> ''
       UNION ALL SELECT 'xml, embedded', count(*) FROM documents WHERE contains(text, '=') HAVING count(*) > 0
       UNION ALL SELECT 'json', count(*) FROM events""",
)
def tree_pairs_per_format(spark, sf):
    """Whole documents as XML text, and all event properties as JSON files."""
    escaped = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
    xml = document_files(spark, sf, F.expr(f"'<doc>' || {escaped} || '</doc>'")).select(
        "*", F.lit("xml").alias("format")
    )
    events = document_files(spark, sf, F.col("props"), "events", "event_id").select(
        "*", F.lit("json").alias("format")
    )
    kv = extract_trees(xml.unionByName(events))
    named = F.when(F.col("kv_path") == "doc", F.lit("xml")).when(F.col("kv_path") == "doc.embedded", F.lit("xml, embedded"))
    named = named.otherwise(F.lit("json"))
    return kv.groupBy(named.alias("format")).agg(F.count(F.lit(1)).alias("pairs"))
