"""Moving trash files aside."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from dupeframe.sources.files import spread_files
from dupeframe.staging import stage

_OUTCOME = pa.schema([
    ("path", pa.string()), ("status", pa.string()), ("bytes", pa.int64()), ("error", pa.string()),
])


def quarantine(
    plan: DataFrame, quarantine_root: str, run_id: str, dry_run: bool = True
) -> DataFrame:
    """Move the files of ``plan`` below ``quarantine_root/run_id`` and return one row each:
    ``path, status, bytes, error``.

    ``status`` is ``moved``, ``missing`` or ``failed`` (with the reason in ``error``; the other
    files go on), or ``planned`` in a dry run. The root must be on the file system of the
    files, so that a move is one rename. The target depends on path and run only, so a task
    that runs again finds what an earlier attempt moved and reports it as moved. The outcome
    is staged: reading it again moves nothing.
    """
    target_root = os.path.join(os.path.abspath(quarantine_root), run_id)

    def move(batches):
        for batch in batches:
            rows = [_move(path, target_root, dry_run) for path in batch.column("path").to_pylist()]
            yield pa.record_batch(
                [pa.array(list(c), type=f.type) for c, f in
                 zip(zip(*rows) if rows else [[] for _ in _OUTCOME], _OUTCOME)],
                schema=_OUTCOME,
            )

    moved = spread_files(plan.select("path", "size")).select("path").mapInArrow(
        move, "path string, status string, bytes long, error string"
    )
    return moved if dry_run else stage(moved, "quarantine")


def _move(path: str, target_root: str, dry_run: bool) -> tuple:
    target = target_root + path
    try:
        if not os.path.isfile(path):
            if not dry_run and os.path.isfile(target):
                return path, "moved", os.path.getsize(target), None
            return path, "missing", 0, None
        size = os.path.getsize(path)
        if dry_run:
            return path, "planned", size, None
        if os.path.lexists(target):
            if not os.path.lexists(path):
                raise FileNotFoundError(path)
            return path, "failed", 0, f"{target} is there already"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(path, target)
        return path, "moved", size, None
    except OSError as error:
        if not dry_run and not os.path.lexists(path) and os.path.isfile(target):
            # a concurrent attempt of the same task was faster
            return path, "moved", os.path.getsize(target), None
        return path, "failed", 0, str(error)
