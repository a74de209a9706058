"""Scan settings: which files, keys, values and paths to leave out, and which rules to use."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyarrow import fs

from keyhound.fixed_values import DEFAULT_EXCLUDED_FILES, DEFAULT_INCLUDED_FILES
from keyhound.sources import filesystem as files
from keyhound.sources.rules import BUILTIN_RULES, parse_yaml, yaml

SETTINGS_FILE = ".keyhoundrc"


@dataclass
class ScanConfig:
    # Accepted and merged, but without effect on a scan: only exclusions filter files.
    include_files: list[str] = field(default_factory=lambda: list(DEFAULT_INCLUDED_FILES))
    exclude_files: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDED_FILES))
    exclude_keys: list[str] = field(default_factory=list)
    exclude_values: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    rules: str = BUILTIN_RULES


def _texts(section, name: str) -> list[str]:
    found = section.get(name) if isinstance(section, dict) else None
    return [str(x) for x in found if x is not None] if isinstance(found, list) else []


def load_config(
    path: str | None = None, root: str | None = None, settings_file: str = SETTINGS_FILE
) -> ScanConfig:
    """Settings from ``path``, else from ``settings_file`` in ``root``, over the defaults.

    Excluded files are added to the defaults; included files and the rule folder
    replace them; excluded keys, values and paths are taken as given.  A missing or
    broken file leaves the defaults.
    """
    config = ScanConfig()
    source = path or (os.path.join(root, settings_file) if root else None)
    if source is None:
        return config
    filesystem, inner = files.open_root(source)
    if filesystem.get_file_info(inner).type != fs.FileType.File:
        return config
    try:
        document = parse_yaml(files.read_text(source))
    except (yaml.YAMLError, UnicodeDecodeError, OSError):
        return config
    if document is None:
        document = {}
    if not isinstance(document, dict):
        return config
    exclude = document.get("exclude")
    config.include_files = _texts(document.get("include"), "files") or config.include_files
    config.exclude_files += _texts(exclude, "files")
    config.exclude_keys = _texts(exclude, "keys")
    config.exclude_values = _texts(exclude, "values")
    config.exclude_paths = _texts(exclude, "paths")
    if isinstance(document.get("rules"), str) and document["rules"]:
        config.rules = document["rules"]
    return config
