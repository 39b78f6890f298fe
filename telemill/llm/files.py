"""Opening files of the shared folder from Python, whatever store it is in."""

from __future__ import annotations

import re
from functools import lru_cache

from pyarrow import fs


@lru_cache(16)
def _store(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    store = _store(re.match(r"[\w+.-]+://[^/]*", path)[0] + "/")
    return store, fs.FileSystem.from_uri(path)[1]


def make_folder(path: str) -> None:
    store, inner = locate(path)
    store.create_dir(inner, recursive=True)
