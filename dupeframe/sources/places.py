"""Where files lie: on a file system that the executors mount, or in a store named by a URI.

Paths with a scheme (``s3://``, ``gs://``, ``hdfs://``, ``abfs://``, ``file://``) go through Arrow's
file systems, all others through the operating system. The functions run in tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import BinaryIO

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def is_uri(path: str) -> bool:
    return _SCHEME.match(path) is not None


def absolute(path: str) -> str:
    return path.rstrip("/") if is_uri(path) else os.path.abspath(path)


def resolved(path: str) -> str:
    """The path without links; a URI stays as it is written, without a closing slash."""
    return path.rstrip("/") if is_uri(path) else os.path.realpath(path)


_known: dict[str, tuple] = {}


def _place(uri: str) -> tuple:
    """(file system, path in it, what stands before such a path in the URI).

    The path is cut off as written: a ``%`` in the name of an object is that character.
    """
    from pyarrow import fs

    scheme, rest = uri.split("://", 1)
    authority, slash, below = rest.partition("/")
    base = f"{scheme}://{authority}"
    if base not in _known:
        system, top = fs.FileSystem.from_uri(f"{base}/")
        # some count the bucket as the first part of a path, others begin paths with a slash
        _known[base] = (system, top.startswith("/"))
    system, rooted = _known[base]
    return (system, slash + below or "/", base) if rooted else (system, rest, f"{scheme}://")


def stat(path: str) -> tuple[str, int, float]:
    """(kind, size, mtime) of a path; the kind is file, dir or none. Links are followed."""
    if not is_uri(path):
        if os.path.isfile(path):
            status = os.stat(path)
            return "file", status.st_size, status.st_mtime
        return ("dir" if os.path.isdir(path) else "none"), 0, 0.0
    from pyarrow import fs

    system, inner, _ = _place(path)
    info = system.get_file_info(inner)
    kind = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(info.type, "none")
    return kind, info.size or 0, (info.mtime_ns or 0) / 1e9


def objects(prefix: str) -> Iterator[tuple[str, str, int, float]]:
    """(kind, path, size, mtime) of what lies directly below a prefix of a store, hidden and empty
    objects included; nothing if it is not there or may not be read."""
    from pyarrow import fs

    system, inner, before = _place(prefix)
    try:
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    except (PermissionError, NotADirectoryError):
        return
    for info in found:
        kind = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(info.type, "none")
        yield kind, before + info.path, info.size or 0, (info.mtime_ns or 0) / 1e9


def open_stream(path: str) -> BinaryIO:
    """A stream that is read in chunks, so an object of any size fits."""
    if not is_uri(path):
        return open(path, "rb")
    system, inner, _ = _place(path)
    return system.open_input_stream(inner)
