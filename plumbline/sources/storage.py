"""Folders of any file system that Arrow reads, for what Spark's own readers leave out: listings, hidden files, versions."""

from __future__ import annotations

import os

from pyarrow import fs


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI, and the folder's path in it."""
    return fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))


def is_folder(path: str) -> bool:
    at, where = filesystem(path)
    return at.get_file_info(where).type == fs.FileType.Directory


def names(path: str) -> list[str]:
    """Names of what lies in a folder."""
    at, where = filesystem(path)
    return [f.base_name for f in at.get_file_info(fs.FileSelector(where))]
