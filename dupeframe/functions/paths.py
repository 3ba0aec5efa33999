"""Path expressions. Paths are absolute POSIX strings; tests are by component."""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F


def normalize_path(path: Column, base: str = "/") -> Column:
    """Lexical absolute form: ``\\`` to ``/``, no empty, ``.`` or ``..`` components."""
    slashed = F.translate(path, "\\", "/")
    absolute = F.when(slashed.startswith("/"), slashed).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), slashed)
    )
    parts = F.filter(F.split(absolute, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    # most paths are clean already and take neither the split nor the fold
    return F.when(absolute.rlike(r"//|/$|/\.\.?(/|$)"),
                  F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(absolute)


def is_relative_to(path: Column, base: str | Column) -> Column:
    """True if ``path`` is ``base`` or beneath it (``/a/bc`` is not beneath ``/a/b``)."""
    if isinstance(base, str):
        stem = base.rstrip("/")
        return (path == F.lit(stem or "/")) | path.startswith(stem + "/")
    stem = F.regexp_replace(base, "/+$", "")
    return (path == F.when(stem == "", F.lit("/")).otherwise(stem)) | F.startswith(
        path, F.concat(stem, F.lit("/"))
    )


def beginnings(path: Column) -> Column:
    """What stands before each ``/`` of the path, as written: no part is changed or left out."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.transform(
        F.when(slashes > 0, F.sequence(F.lit(1), slashes)).otherwise(F.array().cast("array<int>")),
        lambda i: F.call_function("substring_index", path, F.lit("/"), i),
    )


def is_beneath_any(path: Column, bases: list[str]) -> Column:
    """True if ``path`` is one of ``bases`` or beneath one; a row-local test, no join.

    The same for any number of bases: a path is beneath a base if a beginning of it, cut before
    a ``/``, is that base. Paths with a scheme or empty parts are compared as they are written.
    """
    if not bases:
        return F.lit(False)
    stems = sorted({base.rstrip("/") for base in bases})
    # what all bases begin with is a plain prefix test, which reaches the scan of a stored path
    common = os.path.commonprefix([stem or "/" for stem in stems])
    return path.startswith(common) & (path.isin([stem or "/" for stem in stems]) | F.exists(
        beginnings(path), lambda start: start.isin(stems)))


def path_suffix(path: Column) -> Column:
    """Lower-cased last extension of the file name, or an empty string."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def path_length(path: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(path, "UTF-16BE")) / 2).cast("long")


def truncate_path(path: Column, width: int) -> Column:
    """Shorten to the end of the path so that it fits a progress line of ``width``."""
    room = max(10, width - 65)
    return F.when(
        F.length(path) > room, F.concat(F.lit("..."), F.right(path, F.lit(room - 3)))
    ).otherwise(path)
