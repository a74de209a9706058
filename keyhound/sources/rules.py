"""Rule tables: YAML files ↔ ``Rule`` objects ↔ a DataFrame."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from keyhound.schemas import RULE_SCHEMA
from keyhound.sources import filesystem as files

try:
    import yaml
except ImportError:  # pragma: no cover - depends on the installation
    yaml = None

log = logging.getLogger(__name__)

BUILTIN_RULES = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")


@dataclass(frozen=True)
class MatchConfig:
    """Tests on one side (key or value) of a pair; unset tests pass."""

    regex: str = ""
    ignorecase: bool = False
    minlen: int = 0
    is_base64: bool = False
    is_uri: bool = False
    is_luhn: bool = False
    is_ascii: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str = ""
    message: str = ""
    severity: str = ""
    similar: float = 0.0
    key: MatchConfig | None = None
    value: MatchConfig | None = None


def yaml_loader():
    """A safe loader in which only true/false are booleans (yes, no, on, off are texts)."""
    if yaml is None:
        raise ImportError("PyYAML is needed to read YAML rules and settings")

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    Loader.yaml_implicit_resolvers = {
        first: [(tag, rx) for tag, rx in pairs if tag != "tag:yaml.org,2002:bool"]
        for first, pairs in Loader.yaml_implicit_resolvers.items()
    }
    Loader.add_implicit_resolver(
        "tag:yaml.org,2002:bool",
        re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"),
        list("tTfF"),
    )
    return Loader


def parse_yaml(text: str):
    return yaml.load(text, Loader=yaml_loader())


def _typed(source: dict, name: str, kind: type, default):
    found = source.get(name)
    return found if type(found) is kind else default


def _match_config(source) -> MatchConfig | None:
    if not isinstance(source, dict):
        return None
    minlen = source.get("minlen")
    return MatchConfig(
        regex=_typed(source, "regex", str, ""),
        ignorecase=_typed(source, "ignorecase", bool, False),
        minlen=int(minlen) if type(minlen) in (int, float) else 0,
        is_base64=_typed(source, "isBase64", bool, False),
        is_uri=_typed(source, "isUri", bool, False),
        is_luhn=_typed(source, "isLuhn", bool, False),
        is_ascii=_typed(source, "isAscii", bool, False),
    )


def parse_rules(text: str) -> list[Rule]:
    """Rules of one file in document order.  Fields of a wrong type count as absent."""
    document = parse_yaml(text) or {}
    if not isinstance(document, dict) or not all(
        body is None or isinstance(body, dict) for body in document.values()
    ):
        raise ValueError("a rule file maps rule identifiers to rule fields")
    return [
        Rule(
            rule_id=str(rule_id),
            description=_typed(body, "description", str, ""),
            message=_typed(body, "message", str, ""),
            severity=_typed(body, "severity", str, ""),
            similar=_typed(body, "similar", float, 0.0),
            key=_match_config(body.get("key")),
            value=_match_config(body.get("value")),
        )
        for rule_id, body in ((i, b or {}) for i, b in document.items())
    ]


def read_rules(folder: str = BUILTIN_RULES) -> list[Rule]:
    """Rules of every ``.yaml``/``.yml`` file directly in ``folder``, in file-name order.

    A file that cannot be parsed is skipped; the others still count.
    """
    filesystem, root = files.open_root(folder)
    rules: list[Rule] = []
    try:
        found = filesystem.get_file_info(fs.FileSelector(root, recursive=False))
    except PermissionError:
        log.warning("rules folder skipped, no permission: %s", root)
        found = []
    for info in sorted(found, key=lambda i: i.path):
        if not info.is_file or not info.path.endswith((".yaml", ".yml")):
            continue
        try:
            with filesystem.open_input_stream(info.path) as stream:
                rules += parse_rules(stream.read().decode("utf-8"))
        except (yaml.YAMLError, ValueError, OSError) as error:
            log.warning("rule file skipped: %s (%s)", info.path, type(error).__name__)
    return rules


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    def config(c: MatchConfig | None):
        if c is None:
            return None
        return (c.regex, c.ignorecase, c.minlen, c.is_base64, c.is_uri, c.is_luhn, c.is_ascii)

    return spark.createDataFrame(
        [
            (
                order, r.rule_id, r.description, r.message, r.severity, r.similar,
                config(r.key), config(r.value),
            )
            for order, r in enumerate(rules)
        ],
        RULE_SCHEMA,
    )


def load_rules(spark: SparkSession, folder: str = BUILTIN_RULES) -> DataFrame:
    """The rule table of a folder as a DataFrame."""
    return rules_table(spark, read_rules(folder))


def rules_from_table(rules: DataFrame) -> list[Rule]:
    """Rules back from a table, as many as there are; like rules of a folder they go to the driver."""
    rows = rules.orderBy("rule_order").collect()
    return [
        Rule(
            rule_id=row.rule_id,
            description=row.description or "",
            message=row.message or "",
            severity=row.severity or "",
            similar=row.similar or 0.0,
            key=MatchConfig(**row.key.asDict()) if row.key else None,
            value=MatchConfig(**row.value.asDict()) if row.value else None,
        )
        for row in rows
    ]
