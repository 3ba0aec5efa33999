"""Reclaiming: from a report and decisions to a checked plan and its execution."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from dupeframe.operators import reclaim as ops
from dupeframe.operators.decisions import (
    apply_choices,
    apply_overrides,
    apply_rule,
    default_selection,
    enrich,
    largest_group,
)
from dupeframe.operators.validate import require_safe, validate
from dupeframe.sources.quarantine import quarantine
from dupeframe.staging import stage


@dataclass
class ReclaimPlan:
    """``members`` and ``selection`` are staged. ``violations`` and ``plan`` are computed and staged
    when they are first read, each once."""

    members: DataFrame
    selection: DataFrame
    rejected_choices: DataFrame | None = None
    strict: bool = True

    @cached_property
    def violations(self) -> DataFrame:
        return stage(validate(self.members, self.selection, self.strict), "violations")

    @cached_property
    def plan(self) -> DataFrame:
        return stage(ops.reclaim_plan(self.selection, self.members), "plan").orderBy("path")

    def totals(self) -> DataFrame:
        return ops.reclaim_totals(self.plan)

    def survivors(self, manifest: DataFrame) -> DataFrame:
        """What is left of a table; refused while there are violations."""
        require_safe(self.violations)
        return ops.survivors(manifest, self.plan)

    def execute(
        self, quarantine_root: str, run_id: str | None = None, dry_run: bool = True
    ) -> DataFrame:
        """Move trash files aside; refused while there are violations."""
        require_safe(self.violations)
        return quarantine(self.plan, quarantine_root, run_id or uuid.uuid4().hex, dry_run)


def plan_reclaim(
    members: DataFrame,
    present: DataFrame,
    rule: str | None = None,
    edits: DataFrame | None = None,
    choices: DataFrame | None = None,
    selection: DataFrame | None = None,
    strict: bool = True,
) -> ReclaimPlan:
    """Plan over the ``members`` of a report and the items ``present`` now.

    Start from a given ``selection`` (for instance a read action payload), from one ``choice``
    per group, or else from the default selection; then apply a ``rule`` to all groups and
    ordered ``edits`` to single ones.
    """
    if choices is not None and (rule or edits is not None or selection is not None):
        raise ValueError("choices stand alone")
    members = stage(enrich(members, present), "enriched")
    largest = largest_group(members)
    rejected = None
    if choices is not None:
        selection, rejected = apply_choices(members, choices, largest)
    elif rule is not None:
        selection = apply_rule(members, rule, selection, largest)
    elif selection is None:
        selection = default_selection(members, largest)
    selection = stage(selection, "selection")
    if edits is not None:
        selection = stage(apply_overrides(members, selection, edits, largest), "selection")
    return ReclaimPlan(
        members=members,
        selection=selection,
        rejected_choices=rejected,
        strict=strict,
    )
