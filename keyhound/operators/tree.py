"""Pairs out of YAML, JSON and XML documents.

Cleaning is done in columns.  A small reader per document, run over Arrow batches,
turns the markup into rows of a common *node* table; everything that follows from a
single node (embedded pairs, URIs) is columns again:

    kind    meaning
    pair    a finished pair (key, value, kv_path)
    embed   text that may hold ``k=v``; kv_path is where such a pair belongs
    uri     text that may be a URI; kv_path likewise
    error   the document could not be parsed; value is the reason
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.functions.memo import remembered
from keyhound.functions.strings import after, before, item, no_items, trim_space
from keyhound.functions.uri import uri_items
from keyhound.operators.dispatch import TREE_FORMATS
from keyhound.sources.rules import yaml
from keyhound.sources.tables import line_array, text_of

NODE_SCHEMA = (
    "file_path STRING, format STRING, kind STRING, key STRING, value STRING, "
    "kv_path STRING, line INT"
)
_NODE_NAMES = ["file_path", "format", "kind", "key", "value", "kv_path", "line"]
_NODE_ARROW = pa.schema(
    [(n, pa.int32() if n == "line" else pa.string()) for n in _NODE_NAMES]
)
# A batch ends at either; a text column of a batch holds less than 2 GiB.
_ROWS_PER_BATCH = 20_000
_CHARS_PER_BATCH = 16_000_000
_CHARS_PER_DOCUMENT = 500_000_000
NODE_ARRAY = "ARRAY<STRUCT<kind: STRING, key: STRING, value: STRING, kv_path: STRING, line: INT>>"
_STANDARD_TAG = "tag:yaml.org,2002:"
_TEMPLATE_KEYS = ("AWSTemplateFormatVersion", "Resources")

Node = tuple[str, str, str, str, int]  # kind, key, value, kv_path, line


# --- cleaning ---------------------------------------------------------------


def clean_json(text: Column) -> Column:
    """Blank ``//`` lines, cut trailing ``//`` comments, turn leading tabs into blanks.

    Lines are blanked rather than removed, so line numbers stay true.
    """
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    no_comment_lines = F.regexp_replace(unix, r"(?dm)^[\t\f\r ]*+//.*$", "")
    no_comments = F.regexp_replace(no_comment_lines, r"(?dm)(?<![\t\f\r ])[\t\f\r ]++//.*$", "")
    return F.regexp_replace(no_comments, r"(?dm)^\t[\t ]*+", " ")


def clean_yaml(text: Column) -> Column:
    """Blank ``---`` lines and full-line comments, quote template braces, drop template tags."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    quoted = F.array_join(
        F.transform(
            line_array(F.regexp_replace(unix, r"(?dm)^---.*$", "")),
            lambda line: F.when(
                F.contains(line, F.lit("{{")) & F.contains(after(line, "{{"), F.lit("}}")),
                F.replace(
                    F.replace(
                        F.replace(line, F.lit('"'), F.lit("'")), F.lit("{{"), F.lit('"{{')
                    ),
                    F.lit("}}"),
                    F.lit('}}"'),
                ),
            ).otherwise(line),
        ),
        "\n",
    )
    templated = F.when(F.contains(unix, F.lit("{{")), quoted).otherwise(
        F.regexp_replace(unix, r"(?dm)^---.*$", "")
    )
    untagged = F.when(F.contains(templated, F.lit("%")), _without_tags(templated)).otherwise(templated)
    return F.regexp_replace(untagged, r"(?dm)^#.*$", "")


def _without_tags(text: Column) -> Column:
    """``text`` without template tags.

    Only the part up to the last end mark is searched: there every tag finds its end, so
    that tags never closed do not make the search run to the end of the text each time.
    """
    rest = F.substring_index(F.replace(text, F.lit("%>"), F.lit("%}")), "%}", -1)
    length = F.char_length(text) - F.char_length(rest)
    closed = F.regexp_replace(F.left(text, length), r"(?s)[<{]%.*?%[}>]", "")
    return F.concat(closed, F.substr(text, length + 1))


# --- readers ----------------------------------------------------------------


class _Element:
    """A node of a YAML document: ``map`` (alternating keys and values), ``list``,
    ``scalar`` or ``alias``."""

    __slots__ = ("kind", "value", "tag", "line", "children")

    def __init__(self, kind: str, event, value: str = ""):
        self.kind, self.value = kind, value
        self.tag = _custom_tag(getattr(event, "tag", None))
        self.line = event.start_mark.line + 1
        self.children: list[_Element] = []

    def entries(self) -> Iterator[tuple[_Element, _Element]]:
        return zip(self.children[::2], self.children[1::2])


def _compose(text: str) -> _Element | None:
    """The root of the first document.  Aliases stay what they are: a name."""
    anchors: set[str] = set()
    document = _Element.__new__(_Element)
    document.children = []
    open_nodes = [document]
    for event in yaml.parse(text, Loader=getattr(yaml, "CLoader", yaml.Loader)):
        if isinstance(event, yaml.DocumentEndEvent):
            break
        if isinstance(event, yaml.CollectionEndEvent):
            open_nodes.pop()
            continue
        if isinstance(event, yaml.AliasEvent):
            if event.anchor not in anchors:
                raise ValueError("unknown anchor")
            node = _Element("alias", event, event.anchor)
        elif isinstance(event, yaml.ScalarEvent):
            node = _Element("scalar", event, event.value)
        elif isinstance(event, yaml.CollectionStartEvent):
            is_map = isinstance(event, yaml.MappingStartEvent)
            node = _Element("map" if is_map else "list", event)
        else:
            continue
        if node.kind != "alias" and event.anchor:
            anchors.add(event.anchor)
        open_nodes[-1].children.append(node)
        if node.kind in ("map", "list"):
            open_nodes.append(node)
    return document.children[0] if document.children else None


def read_yaml(text: str, is_yaml: bool = True) -> list[Node]:
    """Nodes of a YAML document, or of JSON read as YAML (``is_yaml=False``).

    Every mapping entry is a pair under its dotted path; list items inherit the
    path of the list.  YAML adds tag prefixes, explicit key/value pairs and the
    defaults of infrastructure templates.
    """
    root = _compose(text)
    if root is None:
        return []
    nodes = _template_defaults(root) if is_yaml else []
    pending = [(root, "")]
    while pending:
        node, path = pending.pop()
        if node.kind == "map":
            explicit = {}
            for key, value in node.entries():
                where = f"{path}.{key.value}" if path else key.value
                shown = f"{value.tag} {value.value}" if is_yaml and value.tag else value.value
                nodes.append(("pair", key.value, shown, where, value.line))
                explicit[key.value] = value.value
                pending.append((value, where))
            if is_yaml and "key" in explicit and "value" in explicit:
                nodes.append(
                    (
                        "pair", explicit["key"], explicit["value"],
                        f"{path}.explicit_pair", node.line,
                    )
                )
        elif node.kind == "list":
            pending += [(child, path) for child in node.children]
        elif node.kind == "scalar":
            if "=" in node.value:
                nodes.append(("embed", "", node.value, path, node.line))
            if ":/" in node.value:
                nodes.append(("uri", "", node.value, f"{path}.uri", node.line))
    return nodes


def _template_defaults(root: _Element) -> list[Node]:
    """Defaults of template parameters: ``Parameters.<name>.Default``."""
    if root.kind != "map":
        return []
    top = {key.value: value for key, value in root.entries()}
    parameters = top.get("Parameters")
    if not any(name in top for name in _TEMPLATE_KEYS) or parameters is None:
        return []
    if parameters.kind != "map":
        return []
    return [
        ("pair", name.value, value.value, f"Parameters.{name.value}.Default", value.line)
        for name, body in parameters.entries()
        if body.kind == "map"
        for key, value in body.entries()
        if key.value == "Default"
    ]


def _custom_tag(tag: str | None) -> str:
    return "" if not tag or tag == "!" or tag.startswith(_STANDARD_TAG) else tag


def read_xml(text: str) -> list[Node]:
    """Nodes of an XML document: attributes, element texts and key/value siblings.

    A text with several roots, or with text around them, is read as a fragment.
    """
    try:
        return _XmlReader().read(text)
    except expat.ExpatError:
        return _XmlReader().read(text, fragment=True)


def _local_name(name: str) -> str:
    space, colon, rest = name.partition(":")
    return rest if colon and space and rest and ":" not in rest else name


class _XmlReader:
    def __init__(self):
        self.nodes: list[Node] = []
        self.path: list[str] = []
        self.buffered: list[str] = []
        self.text_line = 1
        self.last_key = ""
        self.parser = expat.ParserCreate()
        self.parser.ordered_attributes = True

    def read(self, text: str, fragment: bool = False) -> list[Node]:
        if not text.strip():
            return []
        if fragment:
            # One root around everything, opened before and closed after the handlers listen.
            self.parser.Parse("<_>", False)
            declaration = re.match(r"\s*<\?xml\s.*?\?>", text, re.DOTALL)
            if declaration:
                text = "\n" * declaration.group().count("\n") + text[declaration.end() :]
        self._listen()
        self.parser.Parse(text, not fragment)
        if fragment:
            if self.path:
                raise ValueError("an element is not closed")
            self.parser.CharacterDataHandler = self.parser.EndElementHandler = None
            self.parser.Parse("</_>", True)
        return self.nodes

    def _listen(self) -> None:
        parser = self.parser
        parser.StartElementHandler = self._start
        parser.EndElementHandler = self._end
        parser.CharacterDataHandler = self._characters
        # Comments, instructions and CDATA borders end a text.
        parser.CommentHandler = parser.ProcessingInstructionHandler = self._flush
        parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = self._flush
        parser.XmlDeclHandler = self._declaration
        parser.DefaultHandler = self._other

    def _start(self, name: str, attributes: list[str]) -> None:
        self._flush()
        self.path.append(_local_name(name))
        where, line = ".".join(self.path), self.parser.CurrentLineNumber
        for attribute, value in zip(attributes[::2], attributes[1::2]):
            key = _local_name(attribute)
            self.nodes.append(("pair", key, value, f"{where}@{key}", line))
            if ":/" in value:
                self.nodes.append(("uri", "", value, f"{where}@{key}.uri", line))

    def _end(self, _name: str) -> None:
        self._flush()
        if not self.path:
            raise ValueError("an element ends that did not start")
        self.path.pop()

    def _characters(self, data: str) -> None:
        if not self.buffered:
            self.text_line = self.parser.CurrentLineNumber
        self.buffered.append(data)

    def _flush(self, *_ignored) -> None:
        raw = "".join(self.buffered)
        self.buffered.clear()
        value = raw.strip()
        if not value or not self.path:
            return
        line = self.text_line + raw[: len(raw) - len(raw.lstrip())].count("\n")
        tag, where = self.path[-1], ".".join(self.path)
        self.nodes.append(("pair", tag, value, where, line))
        if "=" in value:
            self.nodes.append(("embed", "", value, f"{where}.embedded", line))
        if tag.lower() == "key":
            self.last_key = value
        elif tag.lower() == "value" and self.last_key:
            self.nodes.append(("pair", self.last_key, value, f"{where}.pair", line))
            self.last_key = ""

    def _declaration(self, _version, encoding, _standalone) -> None:
        if encoding and encoding.lower() != "utf-8":
            raise ValueError("unsupported encoding")

    def _other(self, data: str) -> None:
        # Only the predefined entities exist; a declared one is an error when used.
        if data.startswith("&"):
            raise ValueError("unknown entity")


def _read_document(fmt: str, clean: str, raw: str | None) -> list[Node]:
    if fmt == "xml":
        return read_xml(clean)
    if yaml is None:
        raise ImportError("PyYAML is needed to read YAML and JSON files")
    try:
        return read_yaml(clean, is_yaml=fmt == "yaml")
    except (yaml.YAMLError, ValueError):
        if fmt != "yaml" or raw is None or raw == clean:
            raise
        return read_yaml(raw)


def _nodes(fmt: str, clean: str, raw: str | None) -> list[Node]:
    """Nodes of a document, or the reason why there are none."""
    try:
        return _read_document(fmt, clean, raw)
    except (yaml.YAMLError, expat.ExpatError, ValueError, RecursionError) as error:
        # The reason only: parser messages quote the text, which may be a secret.
        return [("error", "", type(error).__name__, "", 0)]


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        columns = [batch[n] for n in ("path", "format", "clean", "raw")]
        for scalars in zip(*columns):
            path, fmt, clean, raw = (x.as_py() for x in scalars)
            for node in _nodes(fmt, clean or "", raw):
                rows.append((path, fmt, *node))
                held += len(path or "") + sum(len(part) for part in node[:-1])
                if len(rows) >= _ROWS_PER_BATCH or held >= _CHARS_PER_BATCH:
                    yield _node_batch(rows)
                    rows, held = [], 0
    if rows:
        yield _node_batch(rows)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _NODE_ARROW)], schema=_NODE_ARROW
    )


def _read_arrays(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A list of nodes per document, and null where there is no document.  Lists are handed over in small batches."""
    lists: list[list[Node] | None] = []
    held = 0
    for formats, cleans, raws in batches:
        for fmt, clean, raw in zip(formats, cleans, raws):
            nodes = _nodes(fmt.as_py(), clean.as_py() or "", raw.as_py()) if fmt.is_valid else None
            size = sum(len(part) for node in nodes or () for part in node[:-1])
            if size > _CHARS_PER_DOCUMENT:
                nodes, size = [("error", "", "TreeTooLarge", "", 0)], 0
            if lists and held + size >= _CHARS_PER_BATCH:
                yield _node_lists(lists)
                lists, held = [], 0
            lists.append(nodes)
            held += size
        if lists:
            yield _node_lists(lists)
            lists, held = [], 0


def _node_lists(lists: list[list[Node] | None]) -> pa.Array:
    flat = [node for nodes in lists for node in nodes or ()]
    columns = list(zip(*flat)) or [()] * 5
    parts = [pa.array(c, f.type) for c, f in zip(columns, list(_NODE_ARROW)[2:])]
    sizes = [0 if nodes is None else len(nodes) for nodes in lists]
    offsets = pa.array([0, *accumulate(sizes)], pa.int32())
    missing = pa.array([nodes is None for nodes in lists])
    values = pa.StructArray.from_arrays(parts, [f.name for f in list(_NODE_ARROW)[2:]])
    return pa.ListArray.from_arrays(offsets, values, mask=missing)


# --- node table → pairs -----------------------------------------------------


def _clean(text: Column) -> Column:
    is_yaml, is_json = F.col("format") == "yaml", F.col("format") == "json"
    return F.when(is_yaml, clean_yaml(text)).when(is_json, clean_json(text)).otherwise(text)


def read_trees(files: DataFrame) -> DataFrame:
    """The node table of all YAML, JSON and XML rows of ``path, format, content``."""
    text = text_of(files)
    documents = files.filter(F.col("format").isin(TREE_FORMATS)).select(
        "path", "format", _clean(text).alias("clean"), F.when(F.col("format") == "yaml", text).alias("raw")
    )
    return documents.mapInArrow(_read_batches, NODE_SCHEMA)


def node_array(files: DataFrame, formats: Sequence[str] = TREE_FORMATS) -> Column:
    """The nodes of a row's document, as an array; null for other formats, whose content never leaves the JVM.

    A document whose nodes hold more than ``_CHARS_PER_DOCUMENT`` characters has an error instead: a
    row of Spark takes no more than 2 GiB.
    """
    text, fmt = text_of(files), F.col("format")
    is_tree = fmt.isin(list(formats)) & F.col("content").isNotNull()

    def read(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _read_arrays(batches)

    function = F.arrow_udf(read, NODE_ARRAY)
    return function(
        F.when(is_tree, fmt), F.when(is_tree, _clean(text)), F.when(is_tree & (fmt == "yaml"), text)
    )


def embedded_items(text: Column, kv_path: Column) -> Column:
    """``k=v`` inside a scalar, split at the first ``=``."""
    return F.when(
        F.contains(text, F.lit("=")),
        F.array(item(trim_space(before(text, "=")), trim_space(after(text, "=")), kv_path)),
    ).otherwise(no_items())


@remembered
def node_items(node: str = "") -> Column:
    """Pairs of the node in a column, or in the columns of a node table."""
    at = f"{node}." if node else ""
    kind, value, kv_path = F.col(f"{at}kind"), F.col(f"{at}value"), F.col(f"{at}kv_path")
    return (
        F.when(kind == "pair", F.array(item(F.col(f"{at}key"), value, kv_path)))
        .when(kind == "embed", embedded_items(value, kv_path))
        .when(kind == "uri", uri_items(value, kv_path))
        .otherwise(no_items())
    )


def tree_kv(nodes: DataFrame) -> DataFrame:
    """Pairs of a node table."""
    return nodes.select("file_path", "line", F.inline(node_items())).select(
        "file_path", "key", "value", "kv_path", "line"
    )


def tree_errors(nodes: DataFrame) -> DataFrame:
    """``file_path, format, message`` of the documents that could not be parsed."""
    return nodes.filter(F.col("kind") == "error").select(
        "file_path", "format", F.col("value").alias("message")
    )


def extract_trees(files: DataFrame) -> DataFrame:
    return tree_kv(read_trees(files))


# --- JSON columns of a table ------------------------------------------------

_NATIVE_DEPTH = 3
# Texts that both readers see alike: objects in printable ASCII of at most 1,000 characters, so that no key is
# too long for the document reader and no sign is a control character, a line end or a special blank, ...
_PLAIN = r"\A *\{[ -~]{0,1000}\} *\z"
# ... without lists, nulls, escapes, comments, single quotes, empty keys, repeated separators, strings that look like
# an object, and numbers whose text is not their shortest form.
_NOT_PLAIN = r"[\[\\/#']|null|\"\" *:|[:,] *[,}]|\" *\{|: *(?:-0|0[0-9]|-?[0-9]+[.eE])"
_ENTRY = "STRUCT<key: STRING, value: STRING, kv_path: STRING, fresh: BOOLEAN>"


def _entries(text: Column, prefix: Column | None = None) -> Column:
    """Entries of a JSON object with the raw text of their values."""

    def shape(entry: Column) -> Column:
        path = entry["key"] if prefix is None else F.concat(prefix, F.lit("."), entry["key"])
        return F.struct(
            entry["key"].alias("key"),
            entry["value"].alias("value"),
            path.alias("kv_path"),
            F.lit(True).alias("fresh"),
        )

    return F.transform(F.map_entries(_object(text)), shape)


def _object(text: Column) -> Column:
    """Keys and raw values of a JSON object; nothing for texts with ``NaN`` or ``Infinity``."""
    return F.from_json(text, "MAP<STRING, STRING>", {"allowNonNumericNumbers": "false"})


def flatten_json_column(df: DataFrame, file_path: Column, json: Column) -> DataFrame:
    """Pairs of a JSON column, without leaving the JVM for plain objects.

    Short ASCII objects with at most three opening braces, which cannot nest deeper than three levels,
    are unfolded by ``from_json``, one level per step.  All other texts take the document reader, and the
    native form is kept to texts that both read alike.  Line numbers are not kept (0).
    """
    source = df.select(file_path.alias("path"), json.alias("content"))
    text = F.col("content")
    braces = F.char_length(text) - F.char_length(F.replace(text, F.lit("{"), F.lit("")))
    plain = F.coalesce(
        (braces <= _NATIVE_DEPTH)
        & text.rlike(_PLAIN)
        & ~text.rlike(_NOT_PLAIN)
        & _object(text).isNotNull(),
        F.lit(False),
    )
    key, value, kv_path = F.col("key"), F.col("value"), F.col("kv_path")
    is_object = F.startswith(value, F.lit("{"))

    rows = source.filter(plain).select(F.col("path").alias("file_path"), F.inline(_entries(text)))
    for _ in range(_NATIVE_DEPTH - 1):
        itself = F.array(F.struct(key, value, kv_path, F.lit(False).alias("fresh")))
        inner = F.when(F.col("fresh") & is_object, _entries(value, kv_path)).otherwise(
            F.expr(f"CAST(array() AS ARRAY<{_ENTRY}>)")
        )
        rows = rows.select("file_path", F.inline(F.concat(itself, inner)))
    pairs = F.when(is_object, F.array(item(key, F.lit(""), kv_path))).otherwise(
        F.concat(F.array(item(key, value, kv_path)), embedded_items(value, kv_path))
    )
    native = rows.select("file_path", F.inline(pairs))
    others = source.filter(~plain & text.isNotNull()).withColumn("format", F.lit("json"))
    return (
        native.unionByName(extract_trees(others).drop("line"))
        .withColumn("line", F.lit(0))
        .select("file_path", "key", "value", "kv_path", "line")
    )
