"""Access to local and remote folders through one interface."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyarrow import fs

log = logging.getLogger(__name__)

#: Folders without permission, or gone since their parent was listed; other errors end the listing.
LOST_FOLDER = (PermissionError, FileNotFoundError, NotADirectoryError)


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system behind ``root`` (a plain path or a URI) and the path inside it."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def absolute(root: str) -> str:
    """A local path that means the same in every process; URIs stay as they are."""
    return root if "://" in root or root.startswith("file:") else os.path.abspath(root)


class Entry(NamedTuple):
    """A child of a folder; what is neither a regular file nor a folder has neither mark."""

    path: str
    is_folder: bool
    is_file: bool
    size: int
    modified_ns: int
    problem: str | None = None


def entries(filesystem: fs.FileSystem, folder: str, wanted: Callable[[str], bool] | None = None) -> Iterator[Entry]:
    """Children of a folder, one at a time; links count as neither file nor folder.

    A local folder is never held whole, and only ``wanted`` names are looked at.  Other file
    systems hand over a folder at once.
    """
    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(folder) as children:
            for child in children:
                if wanted and not wanted(child.name):
                    continue
                if any("\ud800" <= c <= "\udfff" for c in child.name):
                    shown = child.path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    yield Entry(shown, False, False, 0, 0, "UnicodeDecodeError")
                    continue
                is_folder, is_file = child.is_dir(follow_symlinks=False), child.is_file(follow_symlinks=False)
                size = modified = 0
                if is_file:
                    try:
                        state = child.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue  # gone since it was listed
                    size, modified = state.st_size, state.st_mtime_ns
                yield Entry(child.path, is_folder, is_file, size, modified)
        return
    for info in filesystem.get_file_info(fs.FileSelector(folder, recursive=False)):
        if not wanted or wanted(info.base_name):
            is_file = info.type == fs.FileType.File
            yield Entry(info.path, info.type == fs.FileType.Directory, is_file, info.size or 0, info.mtime_ns or 0)


def walk(
    filesystem: fs.FileSystem,
    folder: str,
    keep: Callable[[str], bool],
    wanted: Callable[[str], bool] | None = None,
) -> Iterator[Entry | tuple[str, str]]:
    """Regular files below ``folder``; a path and the kind of error for each folder that cannot be listed, and for names
    that are not UTF-8.

    Links and folders that are not kept are not entered.  One listing is open for each level, so
    memory does not grow with the number of children.  ``wanted`` chooses among the direct children.
    """
    open_folders = [(folder, entries(filesystem, folder, wanted))]
    while open_folders:
        inside, children = open_folders[-1]
        try:
            child = next(children, None)
        except LOST_FOLDER as error:
            log.warning("folder skipped: %s (%s)", inside, type(error).__name__)
            yield inside, type(error).__name__
            child = None
        if child is None:
            open_folders.pop()
        elif not keep(child.path):
            continue
        elif child.problem:
            yield child.path, child.problem
        elif child.is_folder:
            open_folders.append((child.path, entries(filesystem, child.path)))
        elif child.is_file:
            yield child


def read_text(path: str) -> str:
    filesystem, inner = open_root(path)
    with filesystem.open_input_stream(inner) as stream:
        return stream.read().decode("utf-8")
